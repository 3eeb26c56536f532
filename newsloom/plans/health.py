"""Health of domains over the fetch log."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import health
from newsloom.operators.fetch import fetch_results
from newsloom.operators.incremental import CrawlSettings
from newsloom.session import stage, table


def _out(spark, sf_dir):
    return health.outcomes(table(spark, sf_dir, "fetch_log"))


def captcha_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(spark, sf_dir).where(F.col("failed")).select("seq", "domain", "blocked", "captcha")


def domain_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.domain_counters(_out(spark, sf_dir))


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.failure_streaks(stage(_out(spark, sf_dir), "outcomes")).select("seq", "domain", "streak")


def circuit_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = health.circuit_intervals(stage(_out(spark, sf_dir), "outcomes"))
    return c.select("domain", F.unix_micros("opened_at").alias("opened_us"), F.unix_micros("closed_at").alias("closed_us"), "n_openings")


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = health.rate_windows(_out(spark, sf_dir), 1)
    return r.select("domain", F.unix_seconds("minute").alias("minute_s"), "n", "over")


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits for a bucket of one request a minute for each domain, in whole log order."""
    return health.bucket_waits(stage(_out(spark, sf_dir), "outcomes"), 1)


def page_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each address in the log, with the robots rules and retries of a crawl."""
    return fetch_results(table(spark, sf_dir, "fetch_log"), table(spark, sf_dir, "robots_rules"), CrawlSettings(max_retry_attempts=2))


_OUT = """f AS (SELECT DISTINCT ON (seq) * FROM fetch_log WHERE url <> ''),
    h AS (SELECT seq, ts, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS domain, status, coalesce(status IN (403, 429), false) AS blocked,
        coalesce(regexp_matches(substr(html, 1, 20000), '(?i)are you a (?:robot|human)|pardon our interruption|access denied|please verify|captcha|<title>\\s*just a moment'), false) AS captcha FROM f),
    o AS (SELECT *, blocked OR captcha AS failed, NOT (blocked OR captcha) AND coalesce(status BETWEEN 200 AND 399, false) AS clean FROM h)"""
QUERIES = {"captcha_flag": captcha_flag, "domain_counters": domain_counters, "failure_streaks": failure_streaks, "circuit_intervals": circuit_intervals, "rate_windows": rate_windows, "token_bucket": token_bucket, "page_fetch": page_fetch}
_FETCH_SITE = r"regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[^/?#:]*\.)?([^./?#:]+\.[^./?#:]+)', 1)"
ORACLES = {
    "page_fetch": f"""WITH {_OUT}, t AS (SELECT f.url, o.seq, o.status, o.failed, row_number() OVER (PARTITION BY f.url ORDER BY o.seq) AS n FROM o JOIN f USING (seq)),
        u AS (SELECT url, min(n) FILTER (NOT failed) AS k, count(*) AS made FROM t WHERE n <= 2 GROUP BY url),
        r AS (SELECT domain, unnest(rules) AS rule FROM robots_rules),
        a AS (SELECT *, NOT EXISTS (SELECT 1 FROM r WHERE r.domain = {_FETCH_SITE} AND starts_with(coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), ''), '/'), trim(split_part(r.rule, ':', 2)))) AS allowed FROM u),
        x AS (SELECT a.url, CASE WHEN NOT allowed THEN 'forbidden' WHEN k IS NOT NULL THEN 'fetched' WHEN made >= 2 THEN 'blocked' ELSE 'unfinished' END AS outcome, CASE WHEN allowed THEN t.seq END AS seq, CASE WHEN allowed THEN t.status END AS status,
            CASE WHEN allowed THEN coalesce(k, made) ELSE 0 END::INT AS n_attempts FROM a LEFT JOIN t ON t.url = a.url AND t.n = a.k)
        SELECT *, CASE n_attempts - (outcome = 'fetched')::INT WHEN 0 THEN 0.0 WHEN 1 THEN 2.0 ELSE 6.0 END::DOUBLE AS slept_sec FROM x""",
    "token_bucket": f"""WITH {_OUT}, a AS (SELECT domain, seq, row_number() OVER w AS i, epoch_us(max(ts) OVER w) AS tick FROM o WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY domain ORDER BY seq)),
        p AS (SELECT *, max(tick - i * 60000000) OVER (PARTITION BY domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + i * 60000000 AS free FROM a)
        SELECT seq, domain, greatest(0, coalesce(free - tick, 0))::BIGINT AS waited_us FROM p""",
    "captcha_flag": f"WITH {_OUT} SELECT seq, domain, blocked, captcha FROM o WHERE failed",
    "domain_counters": f"""WITH {_OUT} SELECT domain, count(*) AS n_fetches, count(*) FILTER (blocked) AS total_blocks, count(*) FILTER (status = 403) AS total_403, count(*) FILTER (status = 429) AS total_429,
        count(*) FILTER (captcha) AS total_captcha, count(*) FILTER (clean) AS n_clean FROM o GROUP BY domain""",
    "failure_streaks": f"""WITH {_OUT}, g AS (SELECT *, sum(clean::INT) OVER (PARTITION BY domain ORDER BY seq) AS grp FROM o)
        SELECT seq, domain, (sum(failed::INT) OVER (PARTITION BY domain, grp ORDER BY seq))::BIGINT AS streak FROM g""",
    "circuit_intervals": f"""WITH RECURSIVE {_OUT}, r AS (SELECT domain, failed, clean, row_number() OVER (PARTITION BY domain ORDER BY seq) AS n, epoch_us(max(ts) OVER (PARTITION BY domain ORDER BY seq)) AS tick FROM o WHERE failed OR clean),
        b AS (SELECT domain, n, tick, failed, CASE WHEN failed THEN 1 ELSE 0 END AS streak, 0::BIGINT AS until, 0 AS opened, 0::BIGINT AS spell FROM r WHERE n = 1
            UNION ALL SELECT r.domain, r.n, r.tick, r.failed,
                CASE WHEN r.failed THEN (CASE WHEN b.until > 0 AND r.tick >= b.until THEN 0 ELSE b.streak END) + 1 WHEN r.clean THEN 0 ELSE b.streak END,
                CASE WHEN r.failed AND (CASE WHEN b.until > 0 AND r.tick >= b.until THEN 0 ELSE b.streak END) + 1 >= 3 THEN r.tick + 300000000 WHEN b.until > 0 AND r.tick >= b.until THEN 0 ELSE b.until END,
                CASE WHEN r.failed AND (CASE WHEN b.until > 0 AND r.tick >= b.until THEN 0 ELSE b.streak END) + 1 >= 3 THEN 1 ELSE 0 END,
                CASE WHEN r.failed AND (CASE WHEN b.until > 0 AND r.tick >= b.until THEN 0 ELSE b.streak END) + 1 >= 3 AND (b.until = 0 OR r.tick >= b.until) THEN b.spell + 1 ELSE b.spell END
            FROM b JOIN r ON r.domain = b.domain AND r.n = b.n + 1)
        SELECT domain, min(tick) AS opened_us, max(tick) + 300000000 AS closed_us, count(*) AS n_openings FROM b WHERE opened = 1 GROUP BY domain, spell""",
    "rate_windows": f"WITH {_OUT} SELECT domain, epoch(date_trunc('minute', ts))::BIGINT AS minute_s, count(*) AS n, count(*) > 1 AS over FROM o WHERE ts IS NOT NULL GROUP BY 1, 2",
}
