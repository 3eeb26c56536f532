"""Stored pages and cards as streams: extraction with upserts, first sightings, circuits of domains."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.functions.text import gzip_text
from newsloom.operators.tiers import extract_tiers, merge_candidates
from newsloom.operators.store import SnapshotStore

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_pages(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of parquet pages as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_stream(pages: DataFrame, store: SnapshotStore, checkpoint: str, interval: str | None = "30 minutes"):
    """Extract and merge each batch of pages(seq, url, html) and upsert it by url; the last page of an address by `seq`
    holds. interval None: take what is there and stop. Pages with nothing on them are written too, with status failed.

    The table has `first_seen_at`, set when an address first comes, `scraped_at`, and the page itself, compressed. A
    batch that is run again after a failure gives the same rows but for the time of the write.
    """

    def write(batch: DataFrame, _: int) -> None:
        merged = merge_candidates(extract_tiers(batch)).withColumnRenamed("url", "source_url")
        kept = merged.join(batch.select("seq", gzip_text("html").alias("raw_html_compressed")), "seq")
        latest = kept.groupBy("source_url").agg(*[F.max_by(c, "seq").alias(c) for c in kept.columns if c not in ("source_url", "seq", "html")])
        now = datetime.now(timezone.utc)
        store.upsert(latest.withColumn("scraped_at", F.lit(now)).withColumn("first_seen_at", F.lit(now)))

    w = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def first_sightings(cards: DataFrame, horizon: str = "14 days", at: str = "seen_at") -> DataFrame:
    """Stream of cards(url, seen_at, ...), each url once within the horizon; state older than it is let go."""
    return cards.where(F.col("url").isNotNull()).withWatermark(at, horizon).dropDuplicatesWithinWatermark(["url"])


class Breaker(StatefulProcessor):
    """Circuit of a domain: streak of failures and the time until which it is open.

    Emits a row whenever the circuit opens or is extended. Rows of one batch are taken in the order of `seq`.
    """

    threshold, cooldown_us = 3, 300_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("circuit", "streak int, until_us long, now_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        streak, until, now = self.state.get() if self.state.exists() else (0, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            now = max(now, int(r.ts_us))
            if until and now >= until:
                streak, until = 0, 0
            if r.failed:
                streak += 1
                if streak >= self.threshold:
                    until = now + self.cooldown_us
                    out.append((key[0], now, until, streak))
            elif r.clean:
                streak = 0
        self.state.update((streak, until, now))
        yield pd.DataFrame(out, columns=["domain", "opened_us", "until_us", "streak"])

    def close(self) -> None:
        pass


def circuits(outcomes: DataFrame, threshold: int = 3, cooldown_s: float = 300.0) -> DataFrame:
    """Stream of outcomes(domain, seq, ts_us, failed, clean) -> openings of circuits. Needs the RocksDB state store."""
    processor = type("Breaker", (Breaker,), {"threshold": threshold, "cooldown_us": int(cooldown_s * 1_000_000)})()
    return outcomes.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType="domain string, opened_us long, until_us long, streak int", outputMode="append", timeMode="none"
    )
