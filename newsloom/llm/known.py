"""Problem 7: new batches against everything accepted before.

Each row is reduced to hashes. Whole contents: one of its address (all forms of a page's address hash alike) and one of
its normalised headline with the time slot. Paragraphs: the problem's content is a headline, so its pieces play their
part, again with the slot. A headline has a piece for each third of its words, for its first and last half, and, of two
words, for each way to leave a letter out of the first; any two headlines that `same_headline` accepts share one of them,
whatever was misspelt (two words leave a third untouched, one slip leaves a half untouched), so no pair is lost.

History lies in two bucketed tables, of whole contents and of pieces, with the hash as bucket key and the batch as
partition (`HashStore`). A new batch is hashed and dealt to the buckets; then every bucket joins the batch's rows with
the rows of lower batches next to them, so history is neither hashed again nor shuffled nor sorted. What shares a piece
is confirmed by comparing the headlines. Appending a batch replaces its own partition and counts from the moment a mark
is set for it, so a batch that is run again gives the same answer and the same tables.

Copies are folded before they are written or asked for: one row for each batch and address, at most two for each batch,
hash and second, so copies of one article, however many, meet a batch as few rows and a hot key fills no bucket.
"""

from __future__ import annotations

import hashlib
import html
import os
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.urls import page_key
from newsloom.llm.values import is_stand_in
from newsloom.session import file_system, stage

NEAR_US = 120_000_000  # two minutes
SLOT_US = 2 * NEAR_US  # what lies within two minutes of a time is in one or two slots
BUCKET_ROWS = 1_000_000  # accepted rows that a bucket is laid out for

# Words that a headline can lose or gain without becoming another.
SMALL_WORDS = frozenset("a an and are as at be been but by for from has have in into is it its of off on or over per percent pct so than that the their this to up was were will with after amid".split())
# What a desk puts before or after a headline.
DESK_WORDS = "breaking|exclusive|live|updated?|corrected|correction|developing|just in|watch|alert|urgent|refile|recap"
_PREFIX = regex.compile(rf"^\s*(?:(?:{DESK_WORDS})\s*\d*\s*[-–—:]\s*|[\[(](?:{DESK_WORDS})\s*\d*[\])]\s*)+", regex.I)
_SUFFIX = regex.compile(rf"\s*(?:[-–—:|]\s*(?:{DESK_WORDS})\s*\d*|[\[(](?:{DESK_WORDS})\s*\d*[\])])\s*$", regex.I)
_SECTION = regex.compile(r"^(.{12,}?)\s+(?:\||-|–|—)\s+(\p{L}[\p{L}' ]{1,40})\s*$")
_UNITS = (
    (regex.compile(r"(?<=\d)\s*(?:bn|b|billions?)\b"), " billion "),
    (regex.compile(r"(?<=\d)\s*(?:mn|mln|m|millions?)\b"), " million "),
    (regex.compile(r"(?<=\d)\s*(?:tn|trn|trillions?)\b"), " trillion "),
    (regex.compile(r"(?<=\d)[,'](?=\d{3}\b)"), ""),
)
_WORD = regex.compile(r"\d+(?:\.\d+)?|\p{L}+")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}]+")


def headline_words(title: str | None) -> list[str]:
    """The words of a headline that must agree, evenly spelt; empty for stand-ins."""
    if is_stand_in(title):
        return []
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKD", html.unescape(title) if "&" in title else title))
    t = " ".join(t.split())
    for _ in range(3):
        t = _SUFFIX.sub("", _PREFIX.sub("", t))
        m = _SECTION.match(t)
        if m and len(m[2].split()) <= 4:
            t = m[1]
    t = t.casefold()
    for pattern, by in _UNITS:
        t = pattern.sub(by, t)
    out = []
    for w in _WORD.findall(t):
        if w[0].isdigit():
            out.append(w.rstrip("0").rstrip(".") if "." in w else w)
        elif w not in SMALL_WORDS:
            out.append(w)
    return out


def one_slip(a: str, b: str) -> bool:
    """Whether one key was missed, doubled, mistaken or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) > len(b):
        return a[i + 1 :] == b[i:]
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def same_headline(a: list[str], b: list[str]) -> bool:
    """Numbers equal and words equal but for a slip of the keys, in at most two words of at least four letters."""
    if [w for w in a if w[0].isdigit()] != [w for w in b if w[0].isdigit()]:
        return False
    if a == b:
        return True
    if one_slip("".join(a), "".join(b)):
        return True
    if len(a) != len(b):
        return False
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return len(off) <= 2 and all(min(len(x), len(y)) >= 4 and one_slip(x, y) for x, y in off)


def pieces_of(words: list[str]) -> list[str]:
    """The pieces of a headline. Any two headlines that `same_headline` accepts share one.

    Words that differ in two places leave one of three stretches as it is. Two words can both differ: then the first
    ones agree once a letter is left out of either. Headlines that agree as one run of letters but for a slip agree in
    the first or in the last half; the two lengths of a half serve runs that differ by a letter.
    """
    numbers = "\x1f".join(w for w in words if w[0].isdigit())
    n, run = len(words), "".join(words)
    out = set()
    if n > 2:
        out |= {f"{n} {k}\x1e" + "\x1f".join(words[n * k // 3 : n * (k + 1) // 3]) for k in range(3)}
    elif n == 2:
        first = words[0]
        out |= {f"-\x1e{x}" for x in (first, *(first[:i] + first[i + 1 :] for i in range(len(first))))}
    for k in {(len(run) - 1) // 2, len(run) // 2}:
        out |= {f"<{k}\x1e{run[:k]}", f">{k}\x1e{run[len(run) - k :]}"}
    return sorted(f"{numbers}\x1d{x}" for x in out)


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >= 1 << 63 else h


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [headline_words(t) if at == at and t is not None else [] for t, at in zip(pdf["title"], pdf["at"])]
        yield pd.DataFrame({
            "id": pdf["id"], "batch": pdf["batch"], "page": pdf["page"].astype("Int64"), "at": pdf["at"].astype("Int64"), "words": [" ".join(w) if w else None for w in words],
            "pieces": [[_hash(x) for x in pieces_of(w)] if w else None for w in words],
        })


def fingerprints(rows: DataFrame) -> DataFrame:
    """rows(id, batch, url, title, at) as (id, batch, page, at, words, pieces).

    at: publication time in microseconds, NULL if unknown. `page` is NULL without an address, `words` and `pieces`
    without a headline or a time: such never match. Rows without an id or a batch are left out.
    """
    key = page_key("url")
    hashed = rows.where(F.col("id").isNotNull() & F.col("batch").isNotNull()).select("id", "batch", F.when(key.isNotNull(), F.xxhash64(key)).alias("page"), "title", "at")
    return hashed.mapInPandas(_words, "id bigint, batch int, page bigint, at bigint, words string, pieces array<bigint>")


def slot(at: Column) -> Column:
    return F.floor(at / SLOT_US).cast("long")


def _stored(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints as rows of the two tables: copies(h, at, batch), at NULL for addresses, and parts(h, at, words, batch)."""
    own = lambda x: F.xxhash64(x, slot(F.col("at")))
    contents = F.explode(F.array(F.struct(F.col("page").alias("h"), F.lit(None).cast("bigint").alias("at")), F.struct(F.when(F.col("words").isNotNull(), own(F.col("words"))).alias("h"), "at")))
    copies = rows.select("batch", contents.alias("x")).select("batch", "x.h", "x.at").where(F.col("h").isNotNull())
    parts = rows.select("batch", F.explode("pieces").alias("piece"), "at", "words").select("batch", own(F.col("piece")).alias("h"), "at", "words")
    # whether any row of a second is near enough is known from its first and its last
    ends = F.explode(F.when(F.col("lo").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.array_distinct(F.array("lo", "hi")))).alias("at")
    second = F.floor(F.col("at") / 1_000_000).alias("s")
    folded = lambda df, *keys: df.groupBy("batch", "h", second, *keys).agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select("h", ends, *keys, "batch")
    return folded(copies), folded(parts, "words")


def _slots() -> Column:
    """The slots that hold whatever lies within two minutes of `at`."""
    return F.array_distinct(F.array(slot(F.col("at") - NEAR_US), slot(F.col("at") + NEAR_US)))


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = [same_headline(a.split(" "), b.split(" ")) for a, b in zip(pdf["words"], pdf["old_words"])]
        yield pdf.loc[ok, ["words", "at", "batch"]]


def copies_known(rows: DataFrame, history: DataFrame, buckets: int) -> DataFrame:
    """Ids of rows whose address, or whose headline within two minutes, is in a lower batch of history(h, at, batch), a
    scan of the table.

    The rows' distinct hashes are dealt to the buckets and held there while history streams by.
    """
    headline = F.when(F.col("words").isNotNull(), F.transform(_slots(), lambda s: F.struct(F.xxhash64("words", s).alias("h"), F.col("at").alias("at"))))
    page = F.array(F.struct(F.col("page").alias("h"), F.lit(None).cast("bigint").alias("at")))
    asks = rows.select("id", "batch", F.explode(F.concat(page, F.coalesce(headline, F.array()))).alias("x")).select("id", F.col("batch").alias("ask_batch"), "x.h", F.col("x.at").alias("ask_at")).where(F.col("h").isNotNull())
    dealt = asks.select("h", "ask_at", "ask_batch").distinct().repartition(buckets, "h").hint("shuffle_hash")
    near = (F.col("at").isNull() & F.col("ask_at").isNull()) | (F.abs(F.col("at") - F.col("ask_at")) <= NEAR_US)
    met = history.join(dealt, "h").where(near & (F.col("batch") < F.col("ask_batch"))).select(F.col("h").alias("m_h"), F.col("ask_at").alias("m_at"), F.col("ask_batch").alias("m_batch")).distinct()
    same = (F.col("h") == F.col("m_h")) & F.col("ask_at").eqNullSafe(F.col("m_at")) & (F.col("ask_batch") == F.col("m_batch"))
    return asks.join(stage(met, "known-contents"), same, "left_semi").select("id")


def parts_known(rows: DataFrame, history: DataFrame, buckets: int) -> DataFrame:
    """Ids of rows that share a piece with a headline of a lower batch in history(h, at, words, batch) which is the same
    but for spelling."""
    whole = rows.where(F.col("words").isNotNull()).select("words", "at", "pieces", "batch").dropDuplicates(["words", "at", "batch"])
    asks = whole.select("words", F.col("at").alias("ask_at"), F.col("batch").alias("ask_batch"), F.explode("pieces").alias("piece"), _slots().alias("slots"))
    asks = asks.select("words", "ask_at", "ask_batch", F.explode(F.transform("slots", lambda s: F.xxhash64("piece", s))).alias("h"))
    dealt = asks.repartition(buckets, "h").hint("shuffle_hash")
    old = history.select("h", "at", F.col("words").alias("old_words"), F.col("batch").alias("old_batch"))
    near = (F.abs(F.col("at") - F.col("ask_at")) <= NEAR_US) & (F.col("old_batch") < F.col("ask_batch"))
    pairs = old.join(dealt, "h").where(near).select("words", F.col("ask_at").alias("at"), F.col("ask_batch").alias("batch"), "old_words").distinct()
    met = pairs.mapInPandas(_confirm, "words string, at bigint, batch int").distinct()
    return rows.join(met, ["words", "at", "batch"], "left_semi").select("id")


class HashStore:
    """History as two bucketed tables under `path`, partitioned by batch.

    buckets: how many each table has; fixed when the store is made. A bucket holds about seven hashes for each accepted
    row; the share of the rows asked for that falls to it is kept in memory while the bucket is read.
    """

    TABLES = {"copies": "h BIGINT, at BIGINT", "parts": "h BIGINT, at BIGINT, words STRING"}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path
        fs, folder = file_system(spark, os.path.join(path, "buckets"))
        if not fs.exists(folder):
            fs.mkdirs(file_system(spark, os.path.join(path, "buckets", str(buckets)))[1])
        self.buckets = int(fs.listStatus(folder)[0].getPath().getName())
        key = hashlib.md5(path.encode()).hexdigest()[:16]
        self.names = {t: f"newsloom_{t}_{key}" for t in self.TABLES}
        for t, columns in self.TABLES.items():
            location = os.path.join(path, t)
            old = fs.exists(file_system(spark, location)[1])
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.names[t]} ({columns}, batch INT) USING parquet PARTITIONED BY (batch) CLUSTERED BY (h) INTO {self.buckets} BUCKETS LOCATION '{location}'")
            if old:
                spark.sql(f"ALTER TABLE {self.names[t]} RECOVER PARTITIONS")

    @classmethod
    def sized(cls, spark: SparkSession, path: str, accepted: int) -> "HashStore":
        """A store laid out for so many accepted rows."""
        return cls(spark, path, max(8, 1 << (max(1, accepted) // BUCKET_ROWS).bit_length()))

    def batches(self) -> list[int]:
        """Batches that are part of history."""
        fs, folder = file_system(self.spark, os.path.join(self.path, "done"))
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def history(self, table: str, before: int) -> DataFrame:
        """Rows of batches under `before`; other partitions are not read."""
        earlier = [b for b in self.batches() if b < before]
        return self.spark.table(self.names[table]).where(F.col("batch").isin(earlier))

    def append(self, rows: DataFrame, batches: list[int]) -> None:
        """Make the fingerprints of the named batches part of history, all that `rows` holds of them.

        They replace what an earlier run of these batches has left. A batch counts from the moment its mark is set,
        after both tables are written.
        """
        mode = "spark.sql.sources.partitionOverwriteMode"
        before, view = self.spark.conf.get(mode, "STATIC"), f"newsloom_new_{uuid.uuid4().hex}"
        self.spark.conf.set(mode, "DYNAMIC")  # only partitions that are written are replaced
        try:
            for t, df in zip(self.TABLES, _stored(rows.where(F.col("batch").isin(batches)))):
                df.repartition(self.buckets, "h").createOrReplaceTempView(view)
                columns = ", ".join(c.split()[0] for c in self.TABLES[t].split(", "))
                self.spark.sql(f"INSERT OVERWRITE TABLE {self.names[t]} PARTITION (batch) SELECT {columns}, batch FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)
            self.spark.conf.set(mode, before)
        for batch in batches:
            fs, mark = file_system(self.spark, os.path.join(self.path, "done", str(int(batch))))
            fs.mkdirs(mark)

    def known(self, rows: DataFrame, last: int) -> DataFrame:
        """Distinct ids of fingerprints that report the same article as a row of a lower batch in history. `last` is the
        highest batch among `rows`, which may hold several.

        Two rows agree if their pages are equal, or if their headlines are the same and they were published within two
        minutes. Full copies are found first, shared pieces are looked for among the rest.
        """
        if not any(b < last for b in self.batches()):
            return rows.select("id").limit(0)
        full = stage(copies_known(rows, self.history("copies", last), self.buckets).distinct(), "full-copies")
        rest = rows.join(full, "id", "left_anti")
        return full.unionByName(parts_known(rest, self.history("parts", last), self.buckets)).distinct()

    def check(self, rows: DataFrame, batch: int) -> DataFrame:
        """Ids of the fingerprints of a new batch that history knows; then the batch is part of history."""
        found = stage(self.known(rows, batch), "known")
        self.append(rows, [batch])
        return found

    def drop(self) -> None:
        """Forget the tables' names; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def find_known(rows: DataFrame, path: str, first: int = 1) -> DataFrame:
    """Distinct ids of rows(id, batch, url, title, at) of batch `first` or later that a lower batch reports already.

    The batches are appended to a new store under `path` and then judged, each against the lower ones, in one reading of
    history: what `check` gives batch by batch, for batches that are all there already.
    """
    arrivals = stage(fingerprints(rows), "arrivals", partition_by="batch")
    sizes = {r["batch"]: r["n"] for r in arrivals.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # a row for each batch
    if not sizes:
        return arrivals.select("id")
    store = HashStore.sized(rows.sparkSession, path, sum(sizes.values()))
    store.append(arrivals, sorted(sizes))
    return store.known(arrivals.where(F.col("batch") >= first), max(sizes))
