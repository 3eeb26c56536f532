"""Problem 9: passages of evaluation items inside a corpus.

Documents are cut into blocks of two segments of SEGMENT words, stepping by one segment, so every passage of SEGMENT
words lies whole in some block and a block's size is bounded by its partition: short documents are blocks of their own,
long ones many of the largest size. Each block gets minima of ROWS hash functions over its shingles of five words
(MinHash, one row to a band, which suits the low resemblance of a short passage to a longer block). Items are the
queries: the minima of all their windows of SEGMENT words. Documents of which a block shares a minimum with an item's
window are candidates; the items' shingles are then looked up in them exactly, and runs of them are joined over single
changed words to see whether enough consecutive words agree.

The corpus is not shuffled. What items are found by is made on the executors: a table of bits for each hash function
(whether any window of an item has that minimum) and the items' words as hashes in one flat array with an index of their
shingles. Both are numbers only, some 24 bytes a word; they are gathered for at most GROUP_WORDS words at a time and sent
to the scan, so a driver's and a task's memory has a fixed bound however many items there are. Up to that size, some ten
thousands of items, the corpus is scanned once, beyond it once for each group.
"""

from __future__ import annotations

import html
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import stage, unstage

SHINGLE, SEGMENT, ROWS = 5, 15, 64
ONE_IN = 10  # at most one word in so many may differ
NEED = SEGMENT - SHINGLE + 1 - SHINGLE  # shared shingles that one change leaves in a passage
GROUP_WORDS = 4_000_000
TABLE_BITS = 22  # of a hash, as the index of a bit table; fewer where few items need no more

_TAG = regex.compile(r"<[/!]?\p{L}[^<>]{0,300}>")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}]+")
_WORD = regex.compile(r"[^\W_]+(?:[-'’‐‑.,/:][^\W_]+)*")
_INNER = str.maketrans("", "", "-'’‐‑.,/:")


def words_of(text: str) -> list[str]:
    """Words without case, markup, punctuation inside or around them, and variants of character forms."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    words = _WORD.findall(text.lower())
    return [w if w.isalnum() else w.translate(_INNER) for w in words]


class _Hashes(dict):
    """64-bit hashes of words, kept for the words a task has met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)
_SEEDS = _mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(word_hashes: np.ndarray) -> np.ndarray:
    """Hash of each run of SHINGLE words; fewer words have none."""
    n = len(word_hashes) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += word_hashes[k : k + n] * _POWERS[k]
    return _mix(out)


def _row(shingle: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function: 32 bits are enough for minima of small sets."""
    return ((shingle * _SEEDS[k]) >> np.uint64(32)).astype(np.uint32)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = _Hashes()
    for pdf in batches:
        words = [np.fromiter(map(hashes.__getitem__, w), dtype=np.uint64, count=len(w)).view(np.int64) for w in map(words_of, pdf["text"])]
        yield pd.DataFrame({"item_id": pdf["item_id"], "words": words})


def _minima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The minima of all windows of items, by hash function."""
    for pdf in batches:
        out = [pd.DataFrame({"row": [], "v": []}).astype("int64")]
        for words in pdf["words"]:
            s = shingles(np.asarray(words, dtype=np.int64).view(np.uint64))
            if len(s) >= SEGMENT - SHINGLE + 1:
                windows = np.lib.stride_tricks.sliding_window_view(s, SEGMENT - SHINGLE + 1)
                out += [pd.DataFrame({"row": k, "v": np.unique(_row(windows, k).min(axis=1)).astype(np.int64)}) for k in range(ROWS)]
        yield pd.concat(out)


def _bits(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    v = pdf["v"].to_numpy().astype(np.uint32) >> np.uint32(32 - bits)
    np.bitwise_or.at(table, v >> np.uint32(3), np.uint8(1) << (v & np.uint32(7)).astype(np.uint8))
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "table": [table.tobytes()]})


class ItemIndex:
    """A group of items: a table of bits for each hash function, and their words with an index of shingles."""

    def __init__(self, tables: dict[int, bytes], bits: int, ids: np.ndarray, words: list[np.ndarray]):
        self.bits, self.ids = bits, ids
        empty = np.zeros(1 << (bits - 3), dtype=np.uint8)
        self.tables = [np.frombuffer(tables[k], dtype=np.uint8) if k in tables else empty for k in range(ROWS)]
        self.ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(words)), [max(0, len(w) - SHINGLE + 1) for w in words])
        at = np.concatenate([np.arange(max(0, len(w) - SHINGLE + 1)) for w in words]) if words else np.zeros(0, np.int64)
        s = np.concatenate([shingles(w) for w in words]) if words else np.zeros(0, np.uint64)
        order = np.argsort(s, kind="stable")
        self.shingles, self.of, self.at = s[order], of[order].astype(np.int32), at[order].astype(np.int32)

    def item(self, k: int) -> list[int]:
        return self.words[(self.ends[k - 1] if k else 0) : self.ends[k]].tolist()

    def hits(self, k: int, minima: np.ndarray) -> np.ndarray:
        v = minima >> np.uint32(32 - self.bits)
        return (self.tables[k][v >> np.uint32(3)] >> (v & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0

    def seeds(self, doc: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Items that share NEED shingles or more with a document's, with the places (item, document) of these."""
        lo, hi = np.searchsorted(self.shingles, doc, "left"), np.searchsorted(self.shingles, doc, "right")
        n = hi - lo
        j = np.repeat(np.arange(len(doc)), n)
        p = np.repeat(lo, n) + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(self.of[p], minlength=len(self.ids))
        kept = shared[self.of[p]] >= NEED
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, i, x in zip(self.of[p][kept].tolist(), self.at[p][kept].tolist(), j[kept].tolist()):
            out[k].append((i, x))
        return out


def _extend(item: list, doc: list, i: int, j: int, step: int, budget: int) -> list[int]:
    """Item words that can be added in one direction from (i, j), for each number of differing words up to `budget`."""
    out, gained = [], 0
    n, m = len(item), len(doc)

    def run(i: int, j: int) -> int:
        r = 0
        while 0 <= i < n and 0 <= j < m and item[i] == doc[j]:
            i, j, r = i + step, j + step, r + 1
        return r

    r = run(i, j)
    i, j, gained = i + step * r, j + step * r, r
    out.append(gained)
    for _ in range(budget):
        if not 0 <= i < n:
            out.append(gained)
            continue
        # replaced, inserted in the document, dropped from it: the one after which most words agree
        moves = [(run(i + step * a, j + step * b), a, b) for a, b in ((1, 1), (0, 1), (1, 0))]
        r, a, b = max(moves, key=lambda x: (x[0] + x[1], x[1]))
        i, j, gained = i + step * (a + r), j + step * (b + r), gained + a + r
        out.append(gained)
    return out


def contains_passage(item: list, doc: list, seeds: list[tuple[int, int]], at_least: int = SEGMENT) -> bool:
    """Whether `doc` holds `at_least` consecutive words of `item` with at most one in ONE_IN replaced, inserted or dropped.

    Words may be given as texts or as hashes. seeds: places (item, doc) of shared shingles. Every such passage holds a run of more than `at_least` / 3 exact
    words, and so a seed from which it is reached.
    """
    budget = len(item) // ONE_IN
    done: set[tuple[int, int]] = set()
    for i, j in seeds:
        if (i - 1, j - 1) in done:
            done.add((i, j))
            continue
        done.add((i, j))
        right = _extend(item, doc, i, j, 1, budget)
        if right[0] >= at_least:
            return True
        left = _extend(item, doc, i - 1, j - 1, -1, budget)
        for e, r in enumerate(right):
            for f, s in enumerate(left):
                if r + s >= max(at_least, ONE_IN * (e + f)):
                    return True
    return False


def _scan(batches: Iterator[pd.DataFrame], index: ItemIndex) -> Iterator[pd.DataFrame]:
    hashes = _Hashes()
    for pdf in batches:
        docs = [words_of(t) for t in pdf["text"]]
        counts = np.array([len(d) for d in docs])
        # documents start on a segment boundary of one long array; padding has no shingle
        blocks = np.maximum(1, -(-counts // SEGMENT))
        starts = (np.cumsum(blocks) - blocks) * SEGMENT
        flat = np.zeros(int(blocks.sum()) * SEGMENT, dtype=np.uint64)
        real = np.zeros(len(flat), dtype=bool)
        for d, s, n in zip(docs, starts, counts):
            flat[s : s + n] = np.fromiter(map(hashes.__getitem__, d), dtype=np.uint64, count=n)
            real[s : s + max(0, n - SHINGLE + 1)] = True
        s = np.zeros(len(flat), dtype=np.uint64)
        own = shingles(flat)
        s[: len(own)] = own
        rows = []
        if len(flat):
            owner = np.repeat(np.arange(len(docs)), blocks)
            last = np.concatenate([owner[1:] != owner[:-1], [True]])
            candidate = np.zeros(len(owner), dtype=bool)
            for k in range(ROWS):
                h = np.where(real, _row(s, k), np.uint32(0xFFFFFFFF)).reshape(-1, SEGMENT).min(axis=1)
                block = np.where(last, h, np.minimum(h, np.concatenate([h[1:], h[-1:]])))
                candidate |= index.hits(k, block) & (block != np.uint32(0xFFFFFFFF))
            for d in np.unique(owner[candidate]):
                a, n = starts[d], counts[d]
                words = None
                for k, found in index.seeds(s[a : a + n - SHINGLE + 1]).items():
                    words = flat[a : a + n].tolist() if words is None else words
                    if contains_passage(index.item(k), words, found):
                        rows.append((pdf["doc_id"].iloc[d], index.ids[k]))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id"])


def item_index(hashed: DataFrame) -> ItemIndex:
    """The index of hashed(item_id, words), whose size the caller bounds. A bit in eight of a table is set at most, as far
    as TABLE_BITS allows; beyond, more documents have their shingles looked up."""
    minima = stage(hashed.select("words").mapInPandas(_minima, "row bigint, v bigint").distinct(), "item-minima")
    most = minima.groupBy("row").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits = min(TABLE_BITS, max(16, (8 * most).bit_length()))
    tables = minima.groupBy("row").applyInPandas(lambda pdf: _bits(pdf, bits), "row bigint, table binary").collect()  # ROWS of fixed size
    items = hashed.toPandas()
    unstage(minima)
    return ItemIndex({r["row"]: r["table"] for r in tables}, bits, items["item_id"].to_numpy(), [np.asarray(w, dtype=np.int64).view(np.uint64) for w in items["words"]])


def leaked_items(docs: DataFrame, items: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """Distinct (doc_id, item_id): documents that hold at least SEGMENT consecutive words of an item's text.

    docs(doc_id, text) and items(item_id, text) of any size. NULL and empty texts and rows without an id match nothing;
    items under SEGMENT words match nothing; an id with several texts stands for each of them.
    """
    spark = docs.sparkSession
    held = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    hashed = stage(held.mapInPandas(_hashed, "item_id bigint, words array<bigint>").where(F.size("words") >= SEGMENT), "item-words")
    groups = max(1, -(-int(hashed.agg(F.sum(F.size("words"))).first()[0] or 0) // group_words))
    corpus = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    out = None
    for g in range(groups):
        index = spark.sparkContext.broadcast(item_index(hashed.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(groups)) == g)))
        found = corpus.mapInPandas(lambda batches, index=index: _scan(batches, index.value), "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
