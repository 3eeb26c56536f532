"""Fetching as stored attempts show it: robots rules, retries with growing waits, and what became of each address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import has_captcha, is_block
from newsloom.functions.urls import site
from newsloom.operators.health import robots_allowed
from newsloom.operators.incremental import CrawlSettings


def slept_seconds(failures: Column, base: float, cap: float) -> Column:
    """Seconds slept after so many failed attempts in a row, each wait twice the one before up to a cap."""
    waits = F.transform(F.sequence(F.lit(0), failures), lambda k: F.when(k == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), k - 1))))
    return F.aggregate(waits, F.lit(0.0), lambda s, x: s + x)


def fetch_results(log: DataFrame, rules: DataFrame, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    """log(seq, ts, url, status, html), rules(domain, rules) -> one row for each address: (url, outcome, seq, status,
    n_attempts, slept_sec).

    outcome: forbidden by the site's rules (nothing is fetched); fetched, with the first attempt that was neither blocked
    nor answered by a bot check, whatever its status; blocked, if none of the allowed attempts was; unfinished, if the log
    ends before they are used up. Deliveries of one attempt count once; rows without an address are left out. Only the
    allowed number of attempts leaves each task for an address, so an address that fills the log moves as few rows.
    """
    tries = log.where(F.coalesce(F.col("url"), F.lit("")) != "").select("seq", "url", "status", (is_block("status") | has_captcha("html")).alias("failed")).distinct()
    tries = tries.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("seq"))).where(F.col("n") <= settings.max_retry_attempts)
    by_url = tries.groupBy("url").agg(F.min(F.when(~F.col("failed"), F.struct("n", "seq", "status"))).alias("got"), F.count("*").alias("made"))
    allowed = robots_allowed(by_url, rules, site("url")) if settings.respect_robots_txt else by_url.withColumn("allowed", F.lit(True))
    got = F.col("got").isNotNull()
    outcome = F.when(~F.col("allowed"), "forbidden").when(got, "fetched").when(F.col("made") >= settings.max_retry_attempts, "blocked").otherwise("unfinished")
    n = F.when(F.col("allowed"), F.coalesce(F.col("got.n").cast("bigint"), F.col("made"))).otherwise(F.lit(0)).cast("int")
    told = allowed.select("url", outcome.alias("outcome"), F.when(F.col("allowed"), F.col("got.seq")).alias("seq"), F.when(F.col("allowed"), F.col("got.status")).alias("status"), n.alias("n_attempts"))
    failures = F.col("n_attempts") - F.when(F.col("outcome") == "fetched", 1).otherwise(0)
    return told.withColumn("slept_sec", slept_seconds(failures, settings.backoff_base_sec, settings.backoff_max_sec))
