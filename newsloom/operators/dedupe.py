"""Duplicates by address and by title with publication minute."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import title_key
from newsloom.session import stage, unstage

STEP_ROWS, MAX_ROUNDS = 100_000, 12


def minute(ts) -> Column:
    """Timestamp without seconds."""
    return F.date_trunc("minute", F.col(ts) if isinstance(ts, str) else ts)


def title_time_key(title, ts) -> Column:
    """Key text of a normalised title and a minute; NULL (never equal) without either."""
    t, m = title_key(title), minute(ts)
    return F.when((t != "") & m.isNotNull(), F.concat_ws("\u0001", t, F.unix_seconds(m).cast("string")))


def flag_known(cards: DataFrame, state: DataFrame) -> DataFrame:
    """`cards`(url, key, ...) with `in_state`: url or key occurs in state(url, key). NULLs never match.

    The OR is two equi-joins over distinct keys, so no nested loop; the planner broadcasts only below its limit.
    """
    urls = state.select(F.col("url").alias("__u")).where(F.col("__u").isNotNull()).distinct().withColumn("__by_url", F.lit(True))
    keys = state.select(F.col("key").alias("__k")).where(F.col("__k").isNotNull()).distinct().withColumn("__by_key", F.lit(True))
    joined = cards.join(urls, cards["url"] == F.col("__u"), "left").join(keys, cards["key"] == F.col("__k"), "left")
    return joined.withColumn("in_state", F.coalesce("__by_url", "__by_key", F.lit(False))).drop("__u", "__k", "__by_url", "__by_key")


def greedy_kept(rows: DataFrame, group: str, order: list[str], row_id: str, step_rows: int = STEP_ROWS) -> DataFrame:
    """Ids of the rows a sequential pass keeps: a row is skipped if its url or key was kept before it in its group;
    skipped rows register nothing. rows(group, url, key, order..., row_id); NULL keys never match, rows without a url are
    not kept.

    Rows that repeat an earlier (url, key) are dropped first, so copies cost one row. Groups of at most `step_rows` rows
    are then stepped through, each in one task (a run is capped by its pages). For larger ones the kept rows are found as
    the lexicographically first maximal matching between urls and keys: each round keeps every row that is first at both
    its ends among those left and removes what it touches. Rounds are few in any but contrived orders, and each is
    written to the shared folder. What is left after MAX_ROUNDS are chains in which each row waits for the one before;
    those are stepped through.
    """
    at = F.struct(*order).alias("at")
    left = rows.where(F.col("url").isNotNull()).select(F.col(group).alias("g"), "url", "key", at, F.col(row_id).alias("id")).groupBy("g", "url", "key").agg(F.min(F.struct("at", "id")).alias("m"))
    left = stage(left.select("g", "url", "key", F.col("m.at").alias("at"), F.col("m.id").alias("id")), "greedy")
    large = stage(left.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > step_rows).select(F.col("g").alias("large")), "large-groups")
    ids = left.select("id").schema
    if large.isEmpty():
        return left.groupBy("g").applyInPandas(_step_through, ids).withColumnRenamed("id", row_id)
    is_large = F.col("g").eqNullSafe(F.col("large"))
    kept_all = left.join(large, is_large, "left_anti").groupBy("g").applyInPandas(_step_through, ids)
    left = stage(left.join(large, is_large, "left_semi"), "greedy")
    for _ in range(MAX_ROUNDS):
        by_url = left.groupBy("g", "url").agg(F.min("at").alias("u_at"))
        by_key = left.where(F.col("key").isNotNull()).groupBy("g", "key").agg(F.min("at").alias("k_at"))
        marked = left.join(by_url, ["g", "url"]).join(by_key, ["g", "key"], "left")
        kept = stage(marked.where((F.col("at") == F.col("u_at")) & (F.col("key").isNull() | (F.col("at") == F.col("k_at")))).select("g", "url", "key", "id"), "greedy-kept")
        kept_all = kept_all.unionByName(kept.select("id"))
        rest = left.join(kept.select("g", "url").distinct(), ["g", "url"], "left_anti").join(kept.where(F.col("key").isNotNull()).select("g", "key").distinct(), ["g", "key"], "left_anti")
        last, left = left, stage(rest.select("g", "url", "key", "at", "id"), "greedy")
        unstage(last)
        if left.isEmpty():
            break
    else:
        kept_all = kept_all.unionByName(left.groupBy("g").applyInPandas(_step_through, ids))
    return kept_all.withColumnRenamed("id", row_id)


def _step_through(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sequential pass itself."""
    urls, keys, kept = set(), set(), []
    pdf = pdf.assign(at=[tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in pdf["at"]]).sort_values("at", kind="stable")
    for url, key, i in zip(pdf["url"], pdf["key"], pdf["id"]):
        if url in urls or (key is not None and key in keys):
            continue
        urls.add(url)
        if key is not None:
            keys.add(key)
        kept.append(i)
    return pd.DataFrame({"id": kept})


def near_time_matches(rows: DataFrame, articles: DataFrame, minutes: int = 1) -> DataFrame:
    """rows(row_id, title, published_at) with `match_id`: the smallest id of articles(id, title, published_at) with the
    same normalised title, published from `minutes` before the row's minute to `minutes` after it, both included.

    The range is an equi-join on title and minute: articles fall into one minute, rows ask for the minutes around.
    Articles are folded to one row for each (title, time) first, so copies meet as one.
    """
    have = (
        articles.where(F.col("published_at").isNotNull()).select(title_key("title").alias("t"), F.col("published_at").alias("old_at"), "id").where(F.col("t") != "")
        .groupBy("t", "old_at").agg(F.min("id").alias("id")).withColumn("slot", F.floor(F.unix_seconds("old_at") / 60))
    )
    asked = rows.where(F.col("published_at").isNotNull()).select("row_id", title_key("title").alias("t"), minute("published_at").alias("m")).where(F.col("t") != "")
    around = F.explode(F.array(*[F.lit(d) for d in range(-minutes, minutes + 1)])).alias("d")
    asked = asked.select("row_id", "t", "m", around).withColumn("slot", F.floor(F.unix_seconds("m") / 60) + F.col("d"))
    lo, hi = F.col("m") - F.expr(f"interval {minutes} minutes"), F.col("m") + F.expr(f"interval {minutes} minutes")
    return asked.join(have, ["t", "slot"]).where(F.col("old_at").between(lo, hi)).groupBy("row_id").agg(F.min("id").alias("match_id"))


def content_copies(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, class_id, n_copies): class_id is the smallest id with the same text. NULL texts
    are left out. Texts are compared by two independent 64-bit hashes and their length, and never shuffled."""
    h = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("2"), F.reverse("text")).alias("h2"), F.length("text").alias("n"))
    classes = h.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    return h.join(classes, ["h1", "h2", "n"]).select("doc_id", "class_id", "n_copies")
