"""Health of fetched domains: blocked answers, failure streaks, open circuits, request rates, robots rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import has_captcha, is_block
from newsloom.functions.urls import netloc
from newsloom.operators.scans import by_blocks, running, since_reset


def outcomes(log: DataFrame) -> DataFrame:
    """log(seq, ts, url, status, html), each delivery once: (seq, ts, domain, status, blocked, captcha, failed, clean).

    `failed` is a blocked answer or a bot check, `clean` any other answer from 200 to 399; the rest is neutral. Rows
    without an address belong to no domain and are left out.
    """
    rows = log.where(F.coalesce(F.col("url"), F.lit("")) != "").dropDuplicates(["seq"])
    rows = rows.select("seq", "ts", netloc("url").alias("domain"), "status", is_block("status").alias("blocked"), has_captcha("html").alias("captcha"))
    failed = F.col("blocked") | F.col("captcha")
    return rows.withColumn("failed", failed).withColumn("clean", ~failed & F.coalesce(F.col("status").between(200, 399), F.lit(False)))


def domain_counters(out: DataFrame) -> DataFrame:
    """Totals for each domain. total_blocks counts 403 and 429 alike; total_403 and total_429 are exact."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return out.groupBy("domain").agg(
        F.count("*").alias("n_fetches"), n(F.col("blocked")).alias("total_blocks"), n(F.col("status") == 403).alias("total_403"),
        n(F.col("status") == 429).alias("total_429"), n(F.col("captcha")).alias("total_captcha"), n(F.col("clean")).alias("n_clean"),
    )


def failure_streaks(out: DataFrame) -> DataFrame:
    """`out` with `streak`: failures of the domain since its last clean answer; neutral rows leave it as it is."""
    rows = out.withColumn("__b", by_blocks("seq")).withColumnRenamed("__b", "block")
    return since_reset(rows, ["domain"], "block", ["seq"], F.col("clean"), F.col("failed").cast("int"), "streak").drop("block")


INTERVAL = "domain string, opened_at timestamp, closed_at timestamp, n_openings bigint"


def _breaker(pdf: pd.DataFrame, threshold: int, cooldown_us: int) -> pd.DataFrame:
    """Open intervals within one stretch that begins with a closed circuit and no streak."""
    pdf = pdf.sort_values("seq")
    streak, until, rows = 0, 0, []
    for at, failed, clean in zip(pdf["at_us"], pdf["failed"], pdf["clean"]):
        if until and at >= until:
            streak, until = 0, 0
        if failed:
            streak += 1
            if streak >= threshold:
                if until and rows:
                    rows[-1][1], rows[-1][2] = at + cooldown_us, rows[-1][2] + 1
                else:
                    rows.append([at, at + cooldown_us, 1])
                until = at + cooldown_us
        elif clean:
            streak = 0
    stamp = lambda x: pd.to_datetime([r[x] for r in rows], unit="us", utc=True)
    return pd.DataFrame({"domain": pdf["domain"].iloc[0], "opened_at": stamp(0), "closed_at": stamp(1), "n_openings": [r[2] for r in rows]}) if rows else pd.DataFrame(columns=["domain", "opened_at", "closed_at", "n_openings"])


def circuit_intervals(out: DataFrame, threshold: int = 3, cooldown_s: float = 300.0) -> DataFrame:
    """(domain, opened_at, closed_at, n_openings): when each domain's circuit was open.

    The circuit opens when the streak reaches the threshold and stays open for the cooldown; failures that come while
    it is open extend it; the first answer after it closes resets the streak. Time is the domain's clock so far (late
    stamps do not turn it back).

    A domain's log is cut where the state is known to be closed and without streak: the last outcome was clean and the
    last failure lies a cooldown back. Each stretch with enough failures is stepped through on its own, so a task holds
    one outage of one domain, not a domain.
    """
    cooldown_us = int(cooldown_s * 1_000_000)
    rows = out.select("seq", F.unix_micros("ts").alias("ts_us"), "domain", "failed", "clean").where(F.col("failed") | F.col("clean"))
    rows = rows.withColumn("block", by_blocks("seq"))
    rows = running(rows, ["domain"], "block", ["seq"], maxima={"at_us": F.col("ts_us")})
    rows = running(rows, ["domain"], "block", ["seq"], maxima={"fail_us": F.when(F.col("failed"), F.col("at_us"))})
    # a clean row whose domain last failed a cooldown ago ends a stretch: nothing of it is left
    over = F.col("clean") & (F.coalesce(F.col("at_us") - F.col("fail_us") >= cooldown_us, F.lit(True)))
    rows = running(rows.withColumn("over", over), ["domain"], "block", ["seq"], sums={"stretch": F.col("over").cast("int")})
    rows = rows.where(~F.col("over"))
    enough = rows.groupBy("domain", "stretch").agg(F.sum(F.col("failed").cast("int")).alias("n")).where(F.col("n") >= threshold).select("domain", "stretch")
    held = rows.join(enough, ["domain", "stretch"]).select("domain", "stretch", "seq", "at_us", "failed", "clean")
    return held.groupBy("domain", "stretch").applyInPandas(lambda pdf: _breaker(pdf, threshold, cooldown_us), INTERVAL)


def rate_windows(out: DataFrame, per_minute: int = 8) -> DataFrame:
    """(domain, minute, n, over): requests in each minute and whether they exceed the limit."""
    m = F.date_trunc("minute", "ts")
    return out.where(F.col("ts").isNotNull()).groupBy("domain", m.alias("minute")).agg(F.count("*").alias("n")).withColumn("over", F.col("n") > per_minute)


def bucket_waits(out: DataFrame, per_minute: int = 8) -> DataFrame:
    """(seq, domain, waited_us): how long each request waits for a bucket of `per_minute` requests that leaks as many in a
    minute. Time is the domain's clock so far; requests without a time are left out.

    The time from which the bucket is empty again is that of the request before, or the request's own, and a share of a
    minute later: a running maximum of arrival less the share for each request before it, so nothing is stepped through.
    """
    share = 60_000_000 // per_minute
    rows = out.where(F.col("ts").isNotNull()).select("seq", "domain", F.unix_micros("ts").alias("ts_us")).withColumn("block", by_blocks("seq"))
    rows = running(rows, ["domain"], "block", ["seq"], sums={"i": F.lit(1).cast("long")}, maxima={"at_us": F.col("ts_us")})
    lead = F.col("at_us") - F.col("i") * share
    # the request before: its lead counts from the next row on
    rows = running(rows.withColumn("lead", lead), ["domain"], "block", ["seq"], maxima={"peak": F.col("lead")})
    before = F.lag("peak").over(Window.partitionBy("domain", "block").orderBy("seq"))
    ends = rows.groupBy("domain", "block").agg(F.max("peak").alias("e"))
    carried = ends.select(F.col("domain").alias("d"), F.col("block").alias("b"), F.lag("e").over(Window.partitionBy("domain").orderBy("block")).alias("carried"))
    rows = rows.withColumn("before", before).join(carried, F.col("domain").eqNullSafe(F.col("d")) & (F.col("block") == F.col("b")), "left")
    empty = F.coalesce("before", "carried") + F.col("i") * share
    return rows.select("seq", "domain", F.coalesce(F.greatest(F.lit(0), empty - (per_minute - 1) * share - F.col("at_us")), F.lit(0)).cast("bigint").alias("waited_us"))


def robots_allowed(urls: DataFrame, rules: DataFrame, site: Column) -> DataFrame:
    """`urls`(url, ...) with `allowed` by the rules(domain, rules) of its site; without rules, and where they cannot be
    read, everything is allowed."""
    own = rules.where(F.col("domain").isNotNull()).groupBy(F.lower("domain").alias("__d")).agg(F.first("rules", ignorenulls=True).alias("__r"))
    joined = urls.withColumn("__site", site).join(own, F.col("__site") == F.col("__d"), "left")

    @F.pandas_udf(T.BooleanType())
    def allowed(url: pd.Series, text: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        parsers: dict[str, RobotFileParser] = {}

        def one(u, t):
            if t not in parsers:
                parsers[t] = RobotFileParser()
                parsers[t].parse(["User-agent: *", *t.split("\n")])
                parsers[t].modified()
            try:
                return parsers[t].can_fetch("*", u)
            except Exception:  # noqa: BLE001
                return True

        return pd.Series([one(u, t) for u, t in zip(url, text)], dtype=bool)

    has = F.coalesce(F.size("__r"), F.lit(0)) > 0
    asked = allowed(F.when(has, F.coalesce("url", F.lit(""))).otherwise(F.lit("")), F.when(has, F.array_join("__r", "\n")).otherwise(F.lit("")))
    return joined.withColumn("allowed", F.when(has & F.col("url").isNotNull(), asked).otherwise(F.lit(True))).drop("__site", "__d", "__r")
