"""The article table: upsert with outcomes, versioned snapshots, run metrics, lookups."""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import title_key
from newsloom.operators.dedupe import near_time_matches, title_time_key
from newsloom.session import file_system

# Columns an upsert never changes on an existing row.
INSERT_ONLY = ("id", "first_seen_at")


ID_BUCKETS = 4096


def numbered(df: DataFrame, key: str, start: int, out: str) -> DataFrame:
    """`df` with `out`: numbers from `start` on, each once, without gaps. Rows are numbered within buckets of their key's
    hash, which follow one another, so no task sees all of them; the same rows get the same numbers."""
    rows = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(ID_BUCKETS)))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__n"))  # at most ID_BUCKETS rows
    before = sizes.select(F.col("__b").alias("__c"), (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return rows.withColumn("__at", place).join(before, F.col("__b") == F.col("__c")).withColumn(out, F.lit(start - 1) + F.col("__before") + F.col("__at")).drop("__b", "__c", "__before", "__at")


def upsert(current: DataFrame, batch: DataFrame, key: str = "source_url", order: list[str] | None = None, now: datetime | None = None, last_id: int | None = None) -> DataFrame:
    """`current` after `batch`: rows of known keys take all columns of the batch but INSERT_ONLY, new keys are added.

    Of several batch rows with one key the last by `order` holds. NULL keys in the batch are refused (left out). Columns
    the batch lacks stay as they are, or NULL in new rows; but with `now`, the time of the write, new rows get an `id`
    after the highest so far (or after `last_id`) and `first_seen_at`, and all rows of the batch `scraped_at`, where the table has these
    columns and the batch doesn't. As with a sequence, known rows use up ids too.
    """
    given = [c for c in current.columns if c in batch.columns]
    rows = batch.where(F.col(key).isNotNull()).select(*given, *[c for c in (order or []) if c not in given])
    if order:
        rows = rows.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in given if c != key])
    else:
        rows = rows.dropDuplicates([key])
    if now is not None:
        kinds = dict(current.dtypes)
        for c in ("first_seen_at", "scraped_at"):
            if c in kinds and c not in given:
                rows, given = rows.withColumn(c, F.lit(now).cast(kinds[c])), [*given, c]
        if "id" in kinds and "id" not in given:
            last = last_id if last_id is not None else current.agg(F.max("id")).first()[0]
            rows, given = numbered(rows, key, (last or 0) + 1, "id"), [*given, "id"]
    old, new = current.alias("o"), rows.select(*[F.col(c).alias(f"__n_{c}") for c in given]).alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"__n_{key}"), "full_outer")
    is_new, untouched = F.col(f"o.{key}").isNull() & F.col(f"__n_{key}").isNotNull(), F.col(f"__n_{key}").isNull()
    out = []
    for c in current.columns:
        if c not in given:
            out.append(F.col(f"o.{c}").alias(c))
        elif c in INSERT_ONLY:
            out.append(F.when(is_new, F.col(f"__n_{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(untouched, F.col(f"o.{c}")).otherwise(F.col(f"__n_{c}")).alias(c))
    return both.select(*out)


def recent_keys(articles: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Distinct `key` (normalised title and minute) of articles(title, published_at) published within the horizon."""
    recent = articles.where(F.col("title").isNotNull() & (F.col("published_at") >= F.lit(as_of - timedelta(days=days))))
    return recent.select(title_time_key("title", "published_at").alias("key")).where(F.col("key").isNotNull()).distinct()


def _registered(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sequential pass over one stretch of minutes of one title: a minute counts unless it or a neighbour came before."""
    kept: dict[int, int] = {}
    for m, seq in sorted(zip(pdf["m"], pdf["seq"]), key=lambda x: x[1]):
        if not any(m + d in kept for d in (-1, 0, 1)):
            kept[m] = seq
    return pd.DataFrame({"t": pdf["t"].iloc[0], "m": list(kept), "seq": list(kept.values())})


def first_of_titles(rows: DataFrame) -> DataFrame:
    """(t, m, seq): the rows(seq, t, m) that a sequential pass by `seq` takes, when a title counts once within a minute
    of itself. Minutes without a neighbour under the same title are taken as they are; only stretches of neighbouring
    minutes are stepped through, each on its own."""
    first = rows.where((F.col("t") != "") & F.col("m").isNotNull()).groupBy("t", "m").agg(F.min("seq").alias("seq"))
    around = first.select("t", F.explode(F.array(F.col("m") - 1, F.col("m") + 1)).alias("m")).distinct()
    alone = first.join(around, ["t", "m"], "left_anti")
    crowd = first.join(around, ["t", "m"], "left_semi")
    crowd = crowd.withColumn("stretch", F.col("m") - F.row_number().over(Window.partitionBy("t").orderBy("m")))
    return alone.unionByName(crowd.groupBy("t", "stretch").applyInPandas(_registered, "t string, m bigint, seq bigint"))


def outcomes(current: DataFrame, batch: DataFrame, key: str = "source_url", run: str = "run_uuid") -> DataFrame:
    """Batch rows(seq, title, published_at, key, run...) with `outcome` and `action`, as a pass in the order of `seq` finds.

    failed: no address, or an `error_type` (where the batch has that column), and nothing is written; aborted: comes in
    its run after a fetch that met an open circuit (error_type circuit_open); duplicate: another article of the table,
    or a row before it, has the same normalised title within a minute (skipped), or its address is known or came before
    (updated); new: inserted. The table is current(id, title, published_at, key). What extraction made of a page does
    not matter here: pages with nothing on them are written too.
    """
    error = F.col("error_type") if "error_type" in batch.columns else F.lit(None).cast("string")
    rows = batch.withColumn("__seq", F.col("seq").cast("long")).withColumn("__error", error)
    opened = rows.where(F.col("__error") == "circuit_open").groupBy(F.col(run).alias("__run")).agg(F.min("__seq").alias("__opened"))
    rows = rows.join(opened, F.col(run).eqNullSafe(F.col("__run")), "left")
    aborted = F.coalesce(F.col("__seq") > F.col("__opened"), F.lit(False))
    failed = F.col(key).isNull() | F.col("__error").isNotNull()
    rows = rows.withColumn("__m", F.floor(F.unix_seconds("published_at") / 60)).withColumn("__t", title_key("title")).withColumn("__state", F.when(aborted, "aborted").when(failed, "failed"))
    open_rows = rows.where(F.col("__state").isNull())
    known = near_time_matches(open_rows.select(F.col("__seq").alias("row_id"), "title", "published_at"), current).select(F.col("row_id").alias("__known"))
    rest = open_rows.join(known, F.col("__seq") == F.col("__known"), "left_anti")
    taken = first_of_titles(rest.select(F.col("__seq").alias("seq"), F.col("__t").alias("t"), F.col("__m").alias("m"))).select(F.col("seq").alias("__taken"))
    keyed = (F.col("__t") != "") & F.col("__m").isNotNull()
    written = rest.join(taken, F.col("__seq") == F.col("__taken"), "left").where(~keyed | F.col("__taken").isNotNull()).select("__seq", F.col(key).alias("__url"))
    have = current.select(F.col(key).alias("__have")).where(F.col("__have").isNotNull()).distinct()
    firsts = written.groupBy("__url").agg(F.min("__seq").alias("__first"))
    # one row for each row that is written: whether its address is there already
    written = written.join(firsts, "__url").join(have, F.col("__url") == F.col("__have"), "left")
    written = written.select(F.col("__seq").alias("__w"), F.when(F.col("__have").isNull() & (F.col("__seq") == F.col("__first")), "insert").otherwise("update").alias("__action"))
    joined = rows.join(written, F.col("__seq") == F.col("__w"), "left")
    outcome = F.coalesce("__state", F.when(F.col("__action") == "insert", "new").otherwise("duplicate"))
    action = F.when(F.col("__state").isNotNull(), "none").otherwise(F.coalesce("__action", F.lit("skip")))
    return joined.withColumn("outcome", outcome).withColumn("action", action).drop(*[c for c in joined.columns if c.startswith("__")])


def run_counters(rows: DataFrame, run: str = "run_uuid") -> DataFrame:
    """(run, new_articles, duplicate_articles, failed_articles) from rows with `outcome`."""
    n = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).cast("bigint")
    return rows.groupBy(run).agg(n("new").alias("new_articles"), n("duplicate").alias("duplicate_articles"), n("failed").alias("failed_articles"))


class SnapshotStore:
    """A table as parquet folders, one for each bucket of the key's hash, and a list of the current ones for each version.

    A write puts new folders beside the old ones, then the list that names them, in one step; readers see the old
    version until then. An upsert reads and writes only the buckets that the batch falls into. Folders that neither of
    the last two versions names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, key: str = "source_url"):
        self.spark, self.path, self.buckets, self.key = spark, path, buckets, key

    def _versions(self) -> list[str]:
        fs, folder = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(n for n in names if n.startswith("version-"))

    def _folders(self, version: str) -> dict[int, str]:
        """Bucket -> folder of a version."""
        rows = self.spark.read.text(os.path.join(self.path, version)).collect()  # one line for each bucket
        return {int(r["value"].split()[0]): r["value"].split()[1] for r in rows}

    def version(self) -> str | None:
        return (self._versions() or [None])[-1]

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or some buckets of it; None before the first write."""
        v = self.version()
        if v is None:
            return None
        folders = self._folders(v)
        schema = self.spark.read.parquet(os.path.join(self.path, next(iter(folders.values())))).schema
        chosen = [f for b, f in folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*[os.path.join(self.path, f) for f in chosen]) if chosen else self.spark.createDataFrame([], schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write(self, df: DataFrame, touched: list[int] | None = None) -> str:
        """Make `df` the table, or the named buckets of it."""
        fs, _ = file_system(self.spark, self.path)
        versions = self._versions()
        folders = self._folders(versions[-1]) if versions and touched is not None else {}
        own = f"data-{uuid.uuid4().hex}"
        df.repartition(self.buckets, self._bucket()).withColumn("__bucket", self._bucket()).write.partitionBy("__bucket").parquet(os.path.join(self.path, own))
        for s in fs.listStatus(file_system(self.spark, os.path.join(self.path, own))[1]):
            name = s.getPath().getName()
            if name.startswith("__bucket="):
                folders[int(name.split("=")[1])] = f"{own}/{name}"
        if not folders:  # an empty table still has its columns
            df.limit(0).write.parquet(os.path.join(self.path, own, "none"))
            folders[0] = f"{own}/none"
        number = int(versions[-1].split("-")[1]) + 1 if versions else 0
        name = f"version-{number:012d}"
        draft = os.path.join(self.path, f"draft-{uuid.uuid4().hex}")
        self.spark.createDataFrame([(f"{b} {f}",) for b, f in sorted(folders.items())], "value string").coalesce(1).write.text(draft)
        if not fs.rename(file_system(self.spark, draft)[1], file_system(self.spark, os.path.join(self.path, name))[1]):
            raise RuntimeError(f"another writer was first: {name}")
        self._sweep()
        return name

    def _sweep(self) -> None:
        versions = self._versions()
        kept = {f for v in versions[-2:] for f in self._folders(v).values()}
        fs, folder = file_system(self.spark, self.path)
        for v in versions[:-2]:
            for f in set(self._folders(v).values()) - kept:
                fs.delete(file_system(self.spark, os.path.join(self.path, f))[1], True)
            fs.delete(file_system(self.spark, os.path.join(self.path, v))[1], True)

    def upsert(self, batch: DataFrame, order: list[str] | None = None, now: datetime | None = None) -> None:
        """Rows of the batch by key, as `upsert` has it; without a table yet they are the table. Writes of one batch that is
        run again change nothing but its times."""
        given = batch.where(F.col(self.key).isNotNull())
        if self.version() is None:
            empty = self.spark.createDataFrame([], given.schema)
            self.write(upsert(empty, given, self.key, order, now))
            return
        touched = [r[0] for r in given.select(self._bucket()).distinct().collect()]  # at most as many as there are buckets
        last_id = self.read().agg(F.max("id")).first()[0] if now is not None and "id" in self.read().columns else None
        self.write(upsert(self.read(touched), given, self.key, order, now, last_id), touched)


def start_run(spark: SparkSession, stage: str, at: datetime) -> dict:
    return {"run_uuid": uuid.uuid4().hex, "stage": stage, "started_at": at}


def end_run(spark: SparkSession, path: str, run: dict, at: datetime, counters: dict[str, int], errors: list[dict] | None = None) -> None:
    """Append one row of run metrics."""
    counts = ("pages_fetched", "new_articles", "duplicate_articles", "failed_articles", "rate_limit_hits", "cooldown_events")
    schema = "run_uuid string, stage string, started_at timestamp, ended_at timestamp, " + ", ".join(f"{c} int" for c in counts) + ", errors array<map<string,string>>"
    row = (run["run_uuid"], run["stage"], run["started_at"], at, *[counters.get(c, 0) for c in counts], errors)
    spark.createDataFrame([row], schema).write.mode("append").parquet(path)


def ticker_index(articles: DataFrame) -> DataFrame:
    """(ticker, id): the inverted index of related tickers, upper case, each pair once."""
    return articles.select("id", F.explode("related_tickers").alias("t")).select(F.upper(F.trim("t")).alias("ticker"), "id").where(F.col("ticker") != "").distinct()


def token_index(articles: DataFrame) -> DataFrame:
    """(token, id): words of title and summary in lower case, each pair once."""
    text = F.concat_ws(" ", F.col("title"), F.col("summary"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    return articles.select("id", F.explode(words).alias("token"))
