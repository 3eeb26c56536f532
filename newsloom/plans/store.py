"""The article table: upserts, outcomes, run metrics, lookups."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import store
from newsloom.operators.tiers import derive_status
from newsloom.plans.addresses import HOME, ORACLES as ADDRESSES, TARGET, title_sql
from newsloom.functions.urls import canonical_url
from newsloom.session import scratch, table


NOW = datetime(2026, 8, 1, tzinfo=timezone.utc)
AS_OF = datetime(2026, 7, 1, tzinfo=timezone.utc)
# stamps of one form, which both engines read alike; others count as unknown here
ISO = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:Z|[+-]\d\d:\d\d)$"


def _batch(spark, sf_dir):
    """Records of later batches as rows to be written. Every tenth fetch was blocked, and one run met an open circuit."""
    r = table(spark, sf_dir, "article_data").where(F.col("batch_no") > 0)
    error = F.when(F.col("record_id") % 10 == 3, "blocked").when(F.col("record_id") % 97 == 5, "circuit_open")
    return r.select(
        F.col("record_id").alias("seq"), "run_uuid", canonical_url("source_url", F.lit(HOME), TARGET, HOME).alias("source_url"), "title", "full_content", "language",
        derive_status(F.col("title"), F.col("full_content")).alias("status"), F.when(F.col("published_at").rlike(ISO), F.col("published_at").try_cast("timestamp")).alias("published_at"), error.alias("error_type"),
    )


def _table(spark, sf_dir):
    return table(spark, sf_dir, "articles").select("id", "source_url", "title", "published_at", "language", "status", "first_seen_at", "scraped_at")


def _outcomes(spark, sf_dir):
    return store.outcomes(_table(spark, sf_dir), _batch(spark, sf_dir))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after all rows; new ones have a time of first sighting, the time of the write, and an id of their own."""
    after = store.upsert(_table(spark, sf_dir), _batch(spark, sf_dir), order=["seq"], now=NOW)
    return after.select("source_url", "title", "language", "status", F.unix_micros("first_seen_at").alias("first_seen_us"), F.unix_micros("scraped_at").alias("scraped_us"), F.col("id").isNotNull().alias("has_id"))


def upsert_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids after an upsert: each once, old rows keep theirs, new ones come after the highest."""
    old = _table(spark, sf_dir)
    after = store.upsert(old, _batch(spark, sf_dir), order=["seq"], now=NOW)
    kept = after.join(old.select(F.col("id").alias("old_id"), F.col("source_url").alias("old_url")), F.col("source_url") == F.col("old_url"), "left")
    return kept.agg(F.countDistinct("id").alias("n_ids"), F.count("*").alias("n_rows"), F.sum(F.when(F.col("id") == F.col("old_id"), 1).otherwise(0)).cast("bigint").alias("n_kept"), F.min(F.when(F.col("old_id").isNull(), F.col("id")) > old.agg(F.max("id")).first()[0]).alias("later"))


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stored table, of which the buckets that the rows fall into are rewritten, twice over."""
    kept = store.SnapshotStore(spark, scratch(spark, "article-table"), buckets=8)
    kept.write(_table(spark, sf_dir))
    for _ in range(2):
        kept.upsert(_batch(spark, sf_dir), order=["seq"], now=NOW)
    return kept.read().select("source_url", "title", "language", "status", F.unix_micros("first_seen_at").alias("first_seen_us"), F.unix_micros("scraped_at").alias("scraped_us"), F.col("id").isNotNull().alias("has_id"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written at their end, one for each stage with the totals of the log, and read back."""
    path = scratch(spark, "runs")
    names = ("pages_fetched", "new_articles", "duplicate_articles", "failed_articles", "rate_limit_hits", "cooldown_events")
    totals = table(spark, sf_dir, "scrape_runs").groupBy("stage").agg(*[F.sum(n).alias(n) for n in names], F.max("ended_at").alias("at"))
    for r in totals.collect():  # two stages
        store.end_run(spark, path, store.start_run(spark, r["stage"], AS_OF), r["at"], {n: r[n] or 0 for n in names}, [{"kind": "none"}])
    return spark.read.parquet(path).select("stage", *[F.col(n).cast("bigint").alias(n) for n in names], F.size("errors").alias("n_errors"), F.length("run_uuid").alias("n_uuid"))


def upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass in order finds for each row: by title and minute, in the table and in the run, and by address."""
    return _outcomes(spark, sf_dir).select(F.col("seq").alias("record_id"), "outcome", "action")


def in_run_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards in the order of their ids as rows to be written to an empty table; each takes the publication time of the
    article at its address, so that one story under several addresses meets itself."""
    known = table(spark, sf_dir, "articles").groupBy(F.col("source_url").alias("at_url")).agg(F.max("published_at").alias("published_at"))
    cards = table(spark, sf_dir, "listing_cards").join(known, F.col("url") == F.col("at_url"), "left")
    rows = cards.select(F.col("card_id").alias("seq"), "run_uuid", F.concat("url", F.lit("#"), F.col("pos") % 2).alias("source_url"), F.col("preview_title").alias("title"), "published_at")
    return store.outcomes(_table(spark, sf_dir).limit(0), rows).select(F.col("seq").alias("card_id"), "outcome", "action")


def recent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent_keys(_table(spark, sf_dir), AS_OF)


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.run_counters(_outcomes(spark, sf_dir))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the run log by stage."""
    r = table(spark, sf_dir, "scrape_runs")
    n = lambda c: F.sum(c).cast("bigint").alias(c)
    return r.groupBy("stage").agg(
        F.count("*").alias("n_runs"), *[n(c) for c in ("pages_fetched", "new_articles", "duplicate_articles", "failed_articles", "rate_limit_hits", "cooldown_events")],
        F.sum(F.coalesce(F.size("errors"), F.lit(0))).cast("bigint").alias("n_errors"), F.sum(F.try_element_at("extra_metrics", F.lit("fresh_count"))).alias("fresh_count"),
        F.sum(F.unix_seconds("ended_at") - F.unix_seconds("started_at")).alias("seconds"),
    )


def ticker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.ticker_index(table(spark, sf_dir, "articles")).groupBy("ticker").agg(F.count("*").alias("n_articles"), F.min("id").alias("first_id"))


def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose title or summary holds all words of a search."""
    hits = store.token_index(table(spark, sf_dir, "articles")).where(F.col("token").isin("faces", "review", "nordics"))
    return hits.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == 3).select("id")


_NEW = ADDRESSES["url_canonicalize"].split("AS url")[0].replace("SELECT record_id,", "").strip()
_ISO = r"regexp_matches(published_at, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:Z|[+-]\d\d:\d\d)$')"
_BATCH = f"""b AS (SELECT record_id AS seq, run_uuid, {_NEW} AS source_url, title, language,
    CASE WHEN coalesce(title, '') <> '' AND coalesce(full_content, '') <> '' THEN 'success' WHEN coalesce(title, '') <> '' OR coalesce(full_content, '') <> '' THEN 'partial_extraction' ELSE 'failed' END AS status,
    floor(epoch(CASE WHEN {_ISO} THEN try_cast(published_at AS TIMESTAMPTZ) END) / 60)::BIGINT AS m, CASE WHEN record_id % 10 = 3 THEN 'blocked' WHEN record_id % 97 = 5 THEN 'circuit_open' END AS error_type
    FROM article_data WHERE batch_no > 0),
    a AS (SELECT source_url, {title_sql('title')} AS t, floor(epoch(published_at) / 60)::BIGINT AS m, epoch(published_at) AS s FROM articles)"""
_PASS = """q AS (SELECT b.*, {title} AS t, CASE WHEN seq > min(seq) FILTER (error_type = 'circuit_open') OVER (PARTITION BY run_uuid) THEN 'aborted' WHEN source_url IS NULL OR error_type IS NOT NULL THEN 'failed' END AS state FROM b),
    f AS (SELECT q.*, EXISTS (SELECT 1 FROM a WHERE a.t = q.t AND q.t <> '' AND a.s BETWEEN (q.m - 1) * 60 AND (q.m + 1) * 60) AS known FROM q),
    z AS (SELECT seq, t, m, row_number() OVER (PARTITION BY t ORDER BY seq) AS n FROM f WHERE state IS NULL AND NOT known AND t <> '' AND m IS NOT NULL),
    g AS (SELECT t, n, seq, true AS taken, [m] AS ms FROM z WHERE n = 1 UNION ALL SELECT z.t, z.n, z.seq, len(list_filter(g.ms, lambda x: abs(x - z.m) <= 1)) = 0,
        CASE WHEN len(list_filter(g.ms, lambda x: abs(x - z.m) <= 1)) = 0 THEN list_append(g.ms, z.m) ELSE g.ms END FROM g JOIN z ON z.t = g.t AND z.n = g.n + 1),
    w AS (SELECT f.*, row_number() OVER (PARTITION BY f.source_url ORDER BY f.seq) AS n FROM f LEFT JOIN g USING (seq) WHERE state IS NULL AND NOT known AND (f.t = '' OR f.m IS NULL OR g.taken)),
    o AS (SELECT f.seq, f.run_uuid, coalesce(f.state, CASE WHEN w.n = 1 AND f.source_url NOT IN (SELECT source_url FROM a WHERE source_url IS NOT NULL) THEN 'new' ELSE 'duplicate' END) AS outcome,
        CASE WHEN f.state IS NOT NULL THEN 'none' WHEN w.seq IS NULL THEN 'skip' WHEN w.n = 1 AND f.source_url NOT IN (SELECT source_url FROM a WHERE source_url IS NOT NULL) THEN 'insert' ELSE 'update' END AS action FROM f LEFT JOIN w USING (seq))"""
_OUTCOME = f"{_BATCH}, {_PASS.format(title=title_sql('title'))}"
_CARDS = f"""b AS (SELECT card_id AS seq, run_uuid, url || '#' || (pos % 2) AS source_url, preview_title AS title, floor(epoch((SELECT max(published_at) FROM articles WHERE articles.source_url = listing_cards.url)) / 60)::BIGINT AS m, NULL AS error_type FROM listing_cards),
    a AS (SELECT source_url, '' AS t, 0 AS s FROM articles WHERE false), {_PASS.format(title=title_sql('title'))}"""
_UPSERT = f"""WITH {_BATCH}, l AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY seq DESC) AS n FROM b)
        SELECT coalesce(l.source_url, a.source_url) AS source_url, CASE WHEN l.seq IS NULL THEN a.title ELSE l.title END AS title, CASE WHEN l.seq IS NULL THEN a.language ELSE l.language END AS language,
            CASE WHEN l.seq IS NULL THEN a.status ELSE l.status END AS status, CASE WHEN a.source_url IS NULL THEN 1785542400000000 ELSE epoch_us(a.first_seen_at) END AS first_seen_us,
            CASE WHEN l.seq IS NULL THEN epoch_us(a.scraped_at) ELSE 1785542400000000 END AS scraped_us, true AS has_id FROM articles a FULL JOIN (SELECT * FROM l WHERE n = 1) l ON a.source_url = l.source_url"""
QUERIES = {
    "upsert_merge": upsert_merge, "upsert_ids": upsert_ids, "store_upsert": store_upsert, "run_log": run_log, "upsert_outcome": upsert_outcome, "in_run_dedupe": in_run_dedupe, "recent_keys": recent_keys, "run_counters": run_counters, "run_metrics": run_metrics, "ticker_lookup": ticker_lookup, "token_search": token_search,
}
ORACLES = {
    "upsert_merge": _UPSERT, "store_upsert": _UPSERT,
    "run_log": "SELECT stage, " + ", ".join(f"sum({n})::BIGINT AS {n}" for n in ("pages_fetched", "new_articles", "duplicate_articles", "failed_articles", "rate_limit_hits", "cooldown_events")) + ", 1 AS n_errors, 32 AS n_uuid FROM scrape_runs GROUP BY stage",
    "upsert_ids": f"""WITH {_BATCH}, k AS (SELECT DISTINCT source_url FROM b WHERE source_url IS NOT NULL UNION SELECT source_url FROM articles)
        SELECT count(*) AS n_ids, count(*) AS n_rows, (SELECT count(*) FROM articles) AS n_kept, true AS later FROM k""",
    "upsert_outcome": f"WITH RECURSIVE {_OUTCOME} SELECT seq AS record_id, outcome, action FROM o",
    "in_run_dedupe": f"WITH RECURSIVE {_CARDS} SELECT seq AS card_id, outcome, action FROM o",
    "recent_keys": f"""SELECT DISTINCT {title_sql('title')} || chr(1) || (epoch(date_trunc('minute', published_at))::BIGINT) AS key FROM articles
        WHERE {title_sql('title')} <> '' AND published_at >= TIMESTAMPTZ '2026-06-01 00:00:00+00'""",
    "run_counters": f"""WITH RECURSIVE {_OUTCOME} SELECT run_uuid, count(*) FILTER (outcome = 'new') AS new_articles, count(*) FILTER (outcome = 'duplicate') AS duplicate_articles, count(*) FILTER (outcome = 'failed') AS failed_articles FROM o GROUP BY run_uuid""",
    "run_metrics": """SELECT stage, count(*) AS n_runs, sum(pages_fetched)::BIGINT AS pages_fetched, sum(new_articles)::BIGINT AS new_articles, sum(duplicate_articles)::BIGINT AS duplicate_articles,
        sum(failed_articles)::BIGINT AS failed_articles, sum(rate_limit_hits)::BIGINT AS rate_limit_hits, sum(cooldown_events)::BIGINT AS cooldown_events, sum(coalesce(len(errors), 0))::BIGINT AS n_errors,
        sum(extra_metrics['fresh_count'])::BIGINT AS fresh_count, sum(floor(epoch(ended_at)) - floor(epoch(started_at)))::BIGINT AS seconds FROM scrape_runs GROUP BY stage""",
    "ticker_lookup": "SELECT ticker, count(DISTINCT id) AS n_articles, min(id) AS first_id FROM (SELECT id, upper(trim(unnest(related_tickers))) AS ticker FROM articles) WHERE ticker <> '' GROUP BY ticker",
    "token_search": r"""SELECT id FROM (SELECT id, regexp_extract_all(lower(concat_ws(' ', title, summary)), '[\pL\pN]+') AS w FROM articles) WHERE list_contains(w, 'faces') AND list_contains(w, 'review') AND list_contains(w, 'nordics')""",
}
