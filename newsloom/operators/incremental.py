"""Incremental crawl: cutoff, bounded state, runs of old cards, early stop, freshness."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.dedupe import flag_known, greedy_kept
from newsloom.operators.scans import since_reset


@dataclass(frozen=True)
class CrawlSettings:
    """Limits of a crawl. Checked on creation."""

    # The default limits.
    page_size: int = 10
    max_pages: int = 100
    stop_after_old: int = 8
    initial_days: int = 3
    margin_minutes: int = 2
    recheck_hours: int = 12
    force_refresh: bool = False
    strict_cutoff: bool = False
    requests_per_minute: int = 8
    min_delay_sec: float = 1.5
    max_delay_sec: float = 4.0
    max_retry_attempts: int = 4
    backoff_base_sec: float = 2.0
    backoff_max_sec: float = 60.0
    failure_threshold: int = 3
    failure_cooldown_sec: float = 300.0
    respect_robots_txt: bool = True
    interval_minutes: int = 30
    target_domain: str = ""
    article_url_pattern: str = ""

    def __post_init__(self):
        if min(self.min_delay_sec, self.max_delay_sec) < 0:
            raise ValueError("delays must not be negative")
        if self.max_delay_sec < self.min_delay_sec:
            raise ValueError("the longest delay must not be under the shortest")
        if min(self.page_size, self.max_pages, self.stop_after_old) < 1 or min(self.initial_days, self.margin_minutes, self.recheck_hours) < 0:
            raise ValueError("limits must be positive")

    @property
    def horizon_days(self) -> int:
        return max(self.initial_days * 2, 14)


def cutoff(articles: DataFrame, as_of: datetime, s: CrawlSettings = CrawlSettings()) -> DataFrame:
    """One row (n_articles, cutoff): the later of the newest publication and first sighting, less a margin; for an empty
    table the start of the initial window."""
    now = F.lit(as_of)
    a = articles.agg(F.count("id").alias("n"), F.max("published_at").alias("p"), F.max("first_seen_at").alias("f"))
    newest = F.coalesce(F.greatest("p", "f"), now) - F.expr(f"interval {s.margin_minutes} minutes")
    return a.select(F.col("n").alias("n_articles"), F.when(F.col("n") == 0, now - F.expr(f"interval {s.initial_days} days")).otherwise(newest).alias("cutoff"))


def state_rows(articles: DataFrame, as_of: datetime, s: CrawlSettings = CrawlSettings()) -> DataFrame:
    """Articles that count as seen: published within the horizon or at an unknown time. The filter reaches the scan."""
    return articles.where(F.col("published_at").isNull() | (F.col("published_at") >= F.lit(as_of - timedelta(days=s.horizon_days))))


def past_cutoff(ts: Column, cut: Column) -> Column:
    return F.coalesce(ts < cut, F.lit(False))


def mark_known(cards: DataFrame, state: DataFrame) -> DataFrame:
    """cards(card_id, run_uuid, page_num, pos, url, key, ...) with `in_state`, `is_known` and `is_kept` as a sequential
    pass over each run would find them. Cards known to the state register nothing."""
    flagged = flag_known(cards, state)
    kept = greedy_kept(flagged.where(~F.col("in_state")), "run_uuid", ["page_num", "pos", "card_id"], "card_id").withColumn("__kept", F.lit(True))
    marked = flagged.join(kept, "card_id", "left").withColumn("is_kept", F.coalesce("__kept", F.lit(False))).drop("__kept")
    return marked.withColumn("is_known", ~F.col("is_kept"))


def old_runs(marked: DataFrame, cut: Column, s: CrawlSettings = CrawlSettings()) -> DataFrame:
    """`marked` with `consecutive_old` after each card: known adds one, unknown sets to zero, then a card past the
    cutoff adds one. With strict_cutoff, unknown cards past the cutoff do not set it back."""
    past = past_cutoff(F.col("preview_published_at"), cut)
    reset = ~F.col("is_known") & ~past if s.strict_cutoff else ~F.col("is_known")
    return since_reset(marked, ["run_uuid"], "page_num", ["pos", "card_id"], reset, F.col("is_known").cast("int") + past.cast("int"), "consecutive_old")


def early_stop(counted: DataFrame, s: CrawlSettings = CrawlSettings()) -> DataFrame:
    """(run_uuid, pages, last_page, stopped_old): pages each run reads before it stops.

    A run stops after the first page that ends with enough old cards, before the first missing page, and at the cap.
    """
    pages = counted.where(F.col("page_num") < s.max_pages).groupBy("run_uuid", "page_num").agg(F.max_by("consecutive_old", F.struct("pos", "card_id")).alias("tail"))
    # at most max_pages rows in each run
    pages = pages.withColumn("n", F.row_number().over(Window.partitionBy("run_uuid").orderBy("page_num")) - 1).where(F.col("n") == F.col("page_num"))
    old = F.min(F.when(F.col("tail") >= s.stop_after_old, F.col("page_num")))
    ends = pages.groupBy("run_uuid").agg(F.max("page_num").alias("end"), old.alias("old"))
    last = F.coalesce(F.col("old"), F.col("end"))
    return ends.select("run_uuid", (last + 1).cast("bigint").alias("pages"), last.alias("last_page"), F.col("old").isNotNull().alias("stopped_old"))


def crawl_queue(counted: DataFrame, stops: DataFrame) -> DataFrame:
    """Cards that a run queues: kept ones on the pages it reads."""
    return counted.join(stops.select("run_uuid", "last_page"), "run_uuid").where(F.col("is_kept") & (F.col("page_num") <= F.col("last_page"))).drop("last_page")


def fresh_cards(cards: DataFrame, articles: DataFrame, as_of: datetime, s: CrawlSettings = CrawlSettings()) -> DataFrame:
    """Cards(url, key, ...) still to be fetched: not scraped within the recheck window, and no other article has their
    title and minute. articles(url, key, scraped_at). force_refresh keeps all."""
    if s.force_refresh:
        return cards
    threshold = F.lit(as_of - timedelta(hours=s.recheck_hours))
    have = articles.where(F.col("url").isNotNull()).groupBy(F.col("url").alias("__u")).agg(F.max("scraped_at").alias("__at"))
    keys = articles.where(F.col("key").isNotNull()).select(F.col("key").alias("__k")).distinct().withColumn("__dup", F.lit(True))
    joined = cards.join(have, cards["url"] == F.col("__u"), "left").join(keys, cards["key"] == F.col("__k"), "left")
    recent = F.coalesce(F.col("__at") >= threshold, F.lit(False))
    other = F.col("__u").isNull() & F.coalesce("__dup", F.lit(False))
    return joined.where(~recent & ~other).drop("__u", "__at", "__k", "__dup")
