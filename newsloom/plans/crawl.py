"""Crawl logic over listing cards and accepted articles."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import dedupe, incremental
from newsloom.operators.dedupe import title_time_key
from newsloom.plans.addresses import title_sql
from newsloom.session import stage, table

AS_OF = datetime(2026, 7, 1, tzinfo=timezone.utc)
SETTINGS = incremental.CrawlSettings()


def _articles(spark, sf_dir):
    return table(spark, sf_dir, "articles").select("id", F.col("source_url").alias("url"), "title", "published_at", "first_seen_at", "scraped_at", title_time_key("title", "published_at").alias("key"))


def _cards(spark, sf_dir):
    c = table(spark, sf_dir, "listing_cards").select("card_id", "run_uuid", "page_num", "pos", "url", "preview_title", "preview_published_at")
    return c.withColumn("key", title_time_key("preview_title", "preview_published_at"))


def _state(spark, sf_dir):
    return incremental.state_rows(_articles(spark, sf_dir), AS_OF, SETTINGS).select("url", "key")


def _counted(spark, sf_dir):
    marked = stage(incremental.mark_known(_cards(spark, sf_dir), _state(spark, sf_dir)), "marked")
    cut = incremental.cutoff(_articles(spark, sf_dir), AS_OF, SETTINGS).first()["cutoff"]  # one value
    return incremental.old_runs(marked, F.lit(cut), SETTINGS)


def state_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = incremental.cutoff(_articles(spark, sf_dir), AS_OF, SETTINGS)
    return c.select("n_articles", F.unix_micros("cutoff").alias("cutoff_us"))


def state_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.state_rows(_articles(spark, sf_dir), AS_OF, SETTINGS).select("id")


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.flag_known(_cards(spark, sf_dir), _state(spark, sf_dir)).select("card_id", "in_state")


def greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.greedy_kept(_cards(spark, sf_dir), "run_uuid", ["page_num", "pos", "card_id"], "card_id")


def consecutive_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select("card_id", "is_known", "consecutive_old")


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.early_stop(_counted(spark, sf_dir), SETTINGS).select("run_uuid", "pages", "stopped_old")


def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stage(_counted(spark, sf_dir), "counted")
    return incremental.crawl_queue(counted, incremental.early_stop(counted, SETTINGS)).select("card_id")


def fresh_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.fresh_cards(_cards(spark, sf_dir), _articles(spark, sf_dir), AS_OF, SETTINGS).select("card_id")


def near_time_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards matched to the smallest article of their title around their minute. Cards without a time of their own take
    the publication time of the article at their address."""
    a = _articles(spark, sf_dir)
    known = a.groupBy("url").agg(F.max("published_at").alias("at"))
    c = _cards(spark, sf_dir).join(known, "url", "left").select(F.col("card_id").alias("row_id"), F.col("preview_title").alias("title"), F.coalesce("preview_published_at", "at").alias("published_at"))
    return dedupe.near_time_matches(c, a).withColumnRenamed("row_id", "card_id")


def content_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.content_copies(table(spark, sf_dir, "documents"))


_KEY = lambda t, p: f"CASE WHEN {title_sql(t)} <> '' AND {p} IS NOT NULL THEN {title_sql(t)} || chr(1) || (epoch(date_trunc('minute', {p}))::BIGINT) END"
_HORIZON = "(published_at IS NULL OR published_at >= TIMESTAMPTZ '2026-06-17 00:00:00+00')"
_BASE = f"""a AS (SELECT *, source_url AS url, {_KEY('title', 'published_at')} AS key FROM articles),
    s AS (SELECT url, key FROM a WHERE {_HORIZON}),
    c AS (SELECT card_id, run_uuid, page_num, pos, url, preview_title, preview_published_at, {_KEY('preview_title', 'preview_published_at')} AS key FROM listing_cards),
    k AS (SELECT c.*, (url IN (SELECT url FROM s WHERE url IS NOT NULL) OR coalesce(key IN (SELECT key FROM s WHERE key IS NOT NULL), false)) AS in_state FROM c)"""
_GREEDY = """o AS (SELECT *, row_number() OVER (PARTITION BY run_uuid ORDER BY page_num, pos, card_id) AS n FROM {src}),
    g AS (SELECT run_uuid, n, card_id, true AS kept, [url] AS us, CASE WHEN key IS NULL THEN []::VARCHAR[] ELSE [key] END AS ks FROM o WHERE n = 1
        UNION ALL SELECT o.run_uuid, o.n, o.card_id, NOT (list_contains(g.us, o.url) OR coalesce(list_contains(g.ks, o.key), false)),
            CASE WHEN list_contains(g.us, o.url) OR coalesce(list_contains(g.ks, o.key), false) THEN g.us ELSE list_append(g.us, o.url) END,
            CASE WHEN o.key IS NULL OR list_contains(g.us, o.url) OR coalesce(list_contains(g.ks, o.key), false) THEN g.ks ELSE list_append(g.ks, o.key) END
        FROM g JOIN o ON o.run_uuid = g.run_uuid AND o.n = g.n + 1)"""
_COUNT = f"""WITH RECURSIVE {_BASE}, {_GREEDY.format(src='(SELECT * FROM k WHERE NOT in_state)')},
    cut AS (SELECT greatest(max(published_at), max(first_seen_at)) - INTERVAL 2 MINUTE AS cut FROM articles),
    m AS (SELECT k.*, coalesce(g.kept, false) AS is_kept, coalesce(k.preview_published_at < cut, false) AS past FROM k LEFT JOIN g USING (card_id), cut),
    r AS (SELECT *, sum(is_kept::INT) OVER (PARTITION BY run_uuid ORDER BY page_num, pos, card_id) AS grp FROM m),
    w AS (SELECT *, (sum((NOT is_kept)::INT + past::INT) OVER (PARTITION BY run_uuid, grp ORDER BY page_num, pos, card_id))::BIGINT AS consecutive_old FROM r),
    pg AS (SELECT run_uuid, page_num, arg_max(consecutive_old, (pos, card_id)) AS tail, row_number() OVER (PARTITION BY run_uuid ORDER BY page_num) - 1 AS n FROM w WHERE page_num < 100 GROUP BY run_uuid, page_num),
    e AS (SELECT run_uuid, max(page_num) AS fin, min(page_num) FILTER (tail >= 8) AS old FROM pg WHERE n = page_num GROUP BY run_uuid)"""
QUERIES = {
    "state_cutoff": state_cutoff, "state_horizon": state_horizon, "known_items": known_items, "greedy_dedupe": greedy_dedupe, "consecutive_old": consecutive_old,
    "early_stop": early_stop, "crawl_queue": crawl_queue, "fresh_cards": fresh_cards, "near_time_match": near_time_match, "content_copies": content_copies,
}
ORACLES = {
    "state_cutoff": "SELECT count(id) AS n_articles, epoch_us(greatest(max(published_at), max(first_seen_at)) - INTERVAL 2 MINUTE) AS cutoff_us FROM articles",
    "state_horizon": f"SELECT id FROM articles WHERE {_HORIZON}",
    "known_items": f"WITH {_BASE} SELECT card_id, in_state FROM k",
    "greedy_dedupe": f"WITH RECURSIVE {_BASE}, {_GREEDY.format(src='c')} SELECT card_id FROM g WHERE kept",
    "consecutive_old": f"{_COUNT} SELECT card_id, NOT is_kept AS is_known, consecutive_old FROM w",
    "early_stop": f"{_COUNT} SELECT run_uuid, (coalesce(old, fin) + 1)::BIGINT AS pages, old IS NOT NULL AS stopped_old FROM e",
    "crawl_queue": f"{_COUNT} SELECT card_id FROM w JOIN e USING (run_uuid) WHERE is_kept AND page_num <= coalesce(old, fin)",
    "fresh_cards": f"""WITH {_BASE} SELECT card_id FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.url = c.url AND a.scraped_at >= TIMESTAMPTZ '2026-06-30 12:00:00+00')
        AND NOT (c.url NOT IN (SELECT url FROM a WHERE url IS NOT NULL) AND c.key IS NOT NULL AND c.key IN (SELECT key FROM a WHERE key IS NOT NULL))""",
    "near_time_match": f"""WITH n AS (SELECT id, source_url, published_at, {title_sql('title')} AS t FROM articles),
        q AS (SELECT card_id, {title_sql('preview_title')} AS t, coalesce(preview_published_at, (SELECT max(published_at) FROM n WHERE n.source_url = listing_cards.url)) AS p FROM listing_cards)
        SELECT card_id, min(n.id) AS match_id FROM q JOIN n ON q.t = n.t AND n.published_at BETWEEN date_trunc('minute', q.p) - INTERVAL 1 MINUTE AND date_trunc('minute', q.p) + INTERVAL 1 MINUTE
        WHERE q.t <> '' GROUP BY card_id""",
    "content_copies": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text IS NOT NULL",
}
