"""Addresses, titles and robots rules."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import backoff_seconds, ticker, title_key
from newsloom.functions.urls import TRACKING_PARAMS, canonical_url, is_article_url, netloc, site, with_pagination
from newsloom.operators.dedupe import title_time_key
from newsloom.operators.health import robots_allowed
from newsloom.operators.stamps import parse_stamps
from newsloom.plans.stamps import stamp_sql
from newsloom.session import table

TARGET, HOME = "example", "https://www.harborline.example"
ARTICLE_PATTERN = r"https?://[^/]+/(?:news|article|story|markets)/[a-z0-9-]+\.html$"
# Fixed value: words of relative times, which fix no instant.
RELATIVE = r"(?i)(?:ago|yesterday|hour|min|second)"


def _records(spark, sf_dir, *cols):
    return table(spark, sf_dir, "article_data").select("record_id", *cols)


def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "source_url").select("record_id", canonical_url("source_url", F.lit(HOME), TARGET, HOME).alias("url"))


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "source_url").groupBy(netloc("source_url").alias("host")).agg(F.count("*").alias("n"))


def article_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "source_url").where(is_article_url("source_url", ARTICLE_PATTERN)).select("record_id")


def url_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of a listing's pages, for the listing of every site that records come from."""
    homes = table(spark, sf_dir, "sites").select("domain", F.concat(F.lit("https://www."), F.col("domain"), F.lit("/topic/latest?count=5&tab=all")).alias("home"))
    pages = homes.select("domain", "home", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("page_num"))
    return pages.select("domain", "page_num", with_pagination("home", F.col("page_num") * 10, F.lit(10)).alias("url"))


def title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "title").select("record_id", title_key("title").alias("key"))


def minute_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    return a.select("id", title_time_key("title", "published_at").alias("key"))


def preview_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card stamps that fix an instant; relative ones do not, and those without zone are taken as UTC, days without a time as
    their midnight."""
    cards = table(spark, sf_dir, "listing_cards").select("card_id", "preview_timestamp", F.lit("UTC").alias("zone"), F.lit("MDY").alias("order"))
    cards = cards.where(~F.coalesce(F.col("preview_timestamp").rlike(RELATIVE), F.lit(False)))
    timed = parse_stamps(cards, "preview_timestamp", "zone", "order", "at_us", date_only=True)
    return timed.where(F.col("at_us").isNotNull()).select("card_id", "at_us")


def ticker_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "title").select("record_id", ticker("title").alias("ticker"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _records(spark, sf_dir, F.col("source_url").alias("url"))
    return robots_allowed(urls, table(spark, sf_dir, "robots_rules"), site("url")).select("record_id", "allowed")


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 9).select(F.col("id").alias("attempt"), backoff_seconds("id", 2.0, 60.0).alias("seconds"))


_DROP = ", ".join(f"'{p}'" for p in TRACKING_PARAMS)
_BARE = "regexp_replace(trim(source_url), '#.*$', '')"
_QUERY = f"regexp_extract({_BARE}, '\\?(.*)$', 1)"
_KEPT = f"array_to_string(list_filter(string_split({_QUERY}, '&'), lambda p: split_part(p, '=', 1) NOT IN ({_DROP})), '&')"
_SITE = r"regexp_extract(lower(source_url), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[^/?#:]*\.)?([^./?#:]+\.[^./?#:]+)', 1)"
NOISE = r"[\s\p{Z}\x{200b}\x{200c}\x{200d}\x{feff}\-_\x{2013}\x{2014}\x{b7}\x{2022}|,.:;!?\x{22}\x{27}\x{2018}\x{2019}\x{201c}\x{201d}()\[\]{}<>]+"


def title_sql(c: str) -> str:
    return f"coalesce(regexp_replace(lower({c}), '{NOISE}', '', 'g'), '')"


QUERIES = {
    "url_canonicalize": url_canonicalize, "url_host": url_host, "article_url_filter": article_url_filter, "url_pagination": url_pagination,
    "title_normalize": title_normalize, "minute_key": minute_key, "preview_times": preview_times, "ticker_extract": ticker_extract,
    "robots_allowed": robots, "backoff_schedule": backoff_schedule,
}
_STAMPS = f"""SELECT card_id, preview_timestamp AS stamp, 'UTC' AS zone, false AS dmy FROM listing_cards WHERE NOT coalesce(regexp_matches(preview_timestamp, '{RELATIVE}'), false)"""
ORACLES = {
    "preview_times": f"WITH {stamp_sql(_STAMPS, date_only=True)} SELECT card_id, instant_us AS at_us FROM instants WHERE instant_us IS NOT NULL",
    "url_canonicalize": f"""SELECT record_id, regexp_extract({_BARE}, '^([^?]*)', 1) || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END AS url FROM article_data""",
    "url_host": "SELECT regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, count(*) AS n FROM article_data GROUP BY 1",
    "article_url_filter": f"SELECT record_id FROM article_data WHERE regexp_matches(source_url, '^(?:{ARTICLE_PATTERN})')",
    "url_pagination": "SELECT domain, p::INT AS page_num, 'https://www.' || domain || '/topic/latest?count=10&tab=all&start=' || (p * 10) AS url FROM sites, range(100) t(p)",
    "title_normalize": f"SELECT record_id, {title_sql('title')} AS key FROM article_data",
    "minute_key": f"""SELECT id, CASE WHEN {title_sql('title')} <> '' AND published_at IS NOT NULL
        THEN {title_sql('title')} || chr(1) || (epoch(date_trunc('minute', published_at))::BIGINT) END AS key FROM articles""",
    "ticker_extract": r"""SELECT record_id, coalesce(nullif(regexp_extract(trim(title), '^\(?([A-Z]{1,5})(?:\.|[^\pL\pN_]|$)', 1), ''),
        nullif(regexp_extract(trim(title), '(?:^|[^\pL\pN_])([A-Z]{1,5})(?:[^\pL\pN_]|$)', 1), '')) AS ticker FROM article_data""",
    "robots_allowed": f"""WITH r AS (SELECT domain, unnest(rules) AS rule FROM robots_rules), p AS (SELECT record_id, {_SITE} AS site, coalesce(nullif(regexp_extract(source_url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), ''), '/') AS path FROM article_data)
        SELECT record_id, NOT EXISTS (SELECT 1 FROM r WHERE r.domain = p.site AND starts_with(p.path, trim(split_part(r.rule, ':', 2)))) AS allowed FROM p""",
    "backoff_schedule": "SELECT i AS attempt, least(60.0, 2.0 * pow(2, i - 1))::DOUBLE AS seconds FROM range(1, 9) t(i)",
}
