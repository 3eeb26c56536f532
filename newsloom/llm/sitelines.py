"""Problem 6: lines repeated across one site's documents.

The letters of each document (case, digits, blanks and punctuation dropped) are cut into content-defined chunks: a
rolling hash over the last WINDOW letters ends a chunk where it hits a mask, so equal passages fall into equal chunks
wherever they stand. The end of a line also ends a chunk, since results are whole lines. Counting distinct documents
for each (site, chunk) shows which chunks repeat excessively. Lines that consist of such chunks only are then counted
whole, which is exact: a line found in enough documents has all its chunks in them, so none is missed, and lines put
together from repeated chunks by chance are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import stage

WINDOW, MASK = 8, 31  # letters in the rolling hash; a chunk has 32 letters more than the window on average
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_NOT_LETTER = regex.compile(r"[^\p{L}]+")


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def chunk_lines(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line keys, chunk hashes, first chunk of each line; its length is one more than the number of lines).

    `lines` are letters only. Equal lines have equal keys, whatever surrounds them. An empty line has no chunk.
    """
    lengths = np.fromiter((len(x) for x in lines), dtype=np.int64, count=len(lines))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = int(ends[-1]) if len(lines) else 0
    if n == 0:
        return np.zeros(len(lines), np.uint64), np.zeros(0, np.uint64), np.zeros(len(lines) + 1, np.int64)
    codes = _mix(np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1))
    up, down = _power_table(n, BASE), _power_table(n, INVERSE)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * up[:n], out=prefix[1:])
    span = lambda s, e: _mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
    at = np.arange(WINDOW, n + 1)
    rolling = _mix((prefix[at] - prefix[at - WINDOW]) * down[at - WINDOW])
    owner = np.repeat(np.arange(len(lines)), lengths)
    inside = at - starts[owner[at - 1]] >= WINDOW
    cut = np.zeros(n + 1, dtype=bool)
    cut[at[inside & ((rolling & np.uint64(MASK)) == 0)]] = True
    cut[ends[lengths > 0]] = True
    chunk_ends = np.flatnonzero(cut)
    chunk_starts = np.concatenate([[0], chunk_ends[:-1]])
    chunks = span(chunk_starts, chunk_ends)
    first = np.concatenate([np.searchsorted(chunk_starts, starts), [len(chunks)]])
    first = np.minimum(first, len(chunks))
    keys = np.where(lengths > 0, span(starts, ends), np.uint64(0))
    return keys, chunks, first


def letters(line: str) -> str:
    return _NOT_LETTER.sub("", line).casefold()


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [t.split("\n") for t in pdf["text"]]
        flat = [letters(x) for t in texts for x in t]
        keys, chunks, first = chunk_lines(flat)
        keys, chunks = keys.view(np.int64), chunks.view(np.int64)
        counts = np.diff(first)
        rows, k = [], 0
        for t in texts:
            m = len(t)
            rows.append((keys[k : k + m], counts[k : k + m].astype(np.int32), chunks[first[k] : first[k + m]]))
            k += m
        yield pd.DataFrame({"doc": pdf["doc"], "site": pdf["site"], "keys": [r[0] for r in rows], "sizes": [r[1] for r in rows], "chunks": [r[2] for r in rows]})


def digest(docs: DataFrame) -> DataFrame:
    """docs(doc bigint, site string, text string) as hashes: keys of the lines, chunks in each line, all chunks in turn.

    NULL documents, sites and texts are left out.
    """
    kept = docs.where(F.col("doc").isNotNull() & F.col("site").isNotNull() & F.col("text").isNotNull()).select("doc", "site", "text")
    return kept.mapInPandas(_digest, "doc bigint, site string, keys array<bigint>, sizes array<int>, chunks array<bigint>")


def hot_lines(digests: DataFrame, min_docs: int = 4, min_share: float = 0.05) -> DataFrame:
    """(site, key) of the lines whose like stands in at least `min_docs` documents of the site and in at least `min_share`
    of them. Lines without a letter never count; a line repeated within a document counts once for it.

    `digests` is read several times, so it should be a written table. What passes a threshold is at most
    1 / min_share times the chunks of an average document for each site; it is written before it is joined, so the
    planner knows its true size and broadcasts it only below its limit.
    """
    sizes = digests.groupBy("site").agg(F.countDistinct("doc").alias("n_docs"))
    enough = (F.col("n") >= min_docs) & (F.col("n") >= F.col("n_docs") * min_share)
    per_doc = digests.select("site", "doc", F.explode(F.array_distinct("chunks")).alias("chunk"))
    counts = per_doc.groupBy("site", "chunk").agg(F.count("*").alias("n"))
    hot = stage(counts.where(F.col("n") >= min_docs).join(sizes, "site").where(enough).select("site", "chunk"), "hot-chunks")
    lines = digests.select("site", "doc", F.posexplode(F.arrays_zip("keys", "sizes")).alias("at", "l"), "chunks", "sizes").where(F.col("l.sizes") > 0)
    first = F.aggregate(F.slice("sizes", F.lit(1), F.col("at")), F.lit(0), lambda a, x: a + x)
    lines = lines.select("site", "doc", "at", F.col("l.keys").alias("key"), F.col("l.sizes").alias("size"), F.slice("chunks", first + 1, F.col("l.sizes")).alias("own"))
    covered = (
        lines.select("site", "doc", "at", "key", "size", F.explode("own").alias("chunk")).join(hot, ["site", "chunk"], "left_semi")
        .groupBy("site", "doc", "at", "key", "size").agg(F.count("*").alias("n_hot")).where(F.col("n_hot") == F.col("size"))
    )
    exact = covered.select("site", "key", "doc").distinct().groupBy("site", "key").agg(F.count("*").alias("n"))
    return stage(exact.where(F.col("n") >= min_docs).join(sizes, "site").where(enough).select("site", "key"), "hot-lines")


def lines_like(digests: DataFrame, hot: DataFrame) -> DataFrame:
    """(doc, line_no) of the lines of `digests`, counted or not, that hot(site, key) names for their site."""
    lines = digests.select("site", "doc", F.posexplode(F.arrays_zip("keys", "sizes")).alias("at", "l")).where(F.col("l.sizes") > 0)
    return lines.select("site", "doc", (F.col("at") + 1).alias("line_no"), F.col("l.keys").alias("key")).join(hot, ["site", "key"], "left_semi").select("doc", "line_no")


def repeated_lines(digests: DataFrame, min_docs: int = 4, min_share: float = 0.05) -> DataFrame:
    """(doc, line_no) of the lines that `hot_lines` finds among the same documents."""
    return lines_like(digests, hot_lines(digests, min_docs, min_share))


def cut_lines(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """`docs` with the listed lines removed from `text`; documents without any stay as they are, NULL texts NULL."""
    gone = cases.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line_no").alias("__gone"))  # bounded by the lines of one document
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("__gone", (i + 1).cast("int"))), "\n")
    joined = docs.join(gone, F.col("doc") == F.col("__doc"), "left")
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).drop("__doc", "__gone")
