"""Problem 8: items of varying length in containers of fixed capacity (best two fit).

Token counts are taken once, next to the texts, and written; packing then moves nothing but ids and sizes. Items are
dealt by hash into shards of a bounded number of rows, and each shard is packed on its own, so the work is spread and a
shard's arrays stay small whatever the corpus. Within a shard the unpacked items are a count for each size, so taking
the largest item that fits, or the best pair for a gap, costs one pass over at most `capacity` sizes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tokens import count, encoding, vocabulary_path
from newsloom.session import stage

SHARD_ROWS = 50_000
OUT = "doc_id bigint, piece_no int, bin_id bigint, token_from bigint, n_tokens bigint"


def token_sizes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens); NULL and empty texts have 0 tokens, rows without an id are left out."""
    path = path or vocabulary_path()

    def sizes(batches):
        enc = encoding(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [count(enc, t) for t in pdf["text"]]})

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(sizes, "doc_id bigint, n_tokens bigint")


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each size (0 < size <= capacity), by best two fit.

    A bin starts with the largest unpacked item and takes the largest that fits until none does. Then its smallest item
    gives way to two unpacked ones if together they fill the gap it leaves more tightly.
    """
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    stacks: dict[int, list[int]] = {}
    for i in order[::-1]:
        stacks.setdefault(int(sizes[i]), []).append(int(i))
    left = np.zeros(capacity + 1, dtype=np.int64)
    for s, x in stacks.items():
        left[s] = len(x)
    at = np.arange(capacity + 1)
    bins = np.full(len(sizes), -1, dtype=np.int64)
    todo, top, b = len(sizes), capacity, 0

    def take(s: int) -> int:
        left[s] -= 1
        return stacks[s].pop()

    while todo:
        while not left[top]:
            top -= 1
        held, gap = [(top, take(top))], capacity - top
        while gap > 0:
            fit = np.flatnonzero(left[1 : gap + 1])
            if not len(fit):
                break
            s = int(fit[-1]) + 1
            held.append((s, take(s)))
            gap -= s
        if gap > 0 and len(held) > 1:
            k = min(range(len(held)), key=lambda j: held[j][0])
            small = held[k][0]
            room = gap + small
            below = np.maximum.accumulate(np.where(left[: room + 1] > 0, at[: room + 1], 0))
            first = np.flatnonzero(left[: room // 2 + 1])
            first = first[first > 0]
            second = below[room - first]
            ok = (second > first) | ((second == first) & (left[first] > 1))
            total = np.where(ok, first + second, 0)
            if len(total) and total.max() > small:
                j = int(total.argmax())
                stacks[small].append(held[k][1])
                left[small] += 1
                held[k] = (int(first[j]), take(int(first[j])))
                held.append((int(second[j]), take(int(second[j]))))
                top = max(top, small)
        for _, i in held:
            bins[i] = b
        todo -= len(held)
        b += 1
    return bins


def _pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
    shard = int(pdf["shard"].iloc[0])
    n = pdf["n_tokens"].to_numpy()
    pieces = np.maximum(1, -(-n // capacity))  # a text over the capacity fills containers and leaves one rest
    row = np.repeat(np.arange(len(n)), pieces)
    no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(n[row] - no * capacity, capacity)
    bins = np.zeros(len(row), dtype=np.int64)
    real = size > 0
    bins[real] = pack(size[real], capacity)
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "piece_no": no.astype(np.int32), "bin_id": (shard << 32) + bins, "token_from": no * capacity, "n_tokens": size})


def fill_containers(sized: DataFrame, capacity: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """sized(doc_id, n_tokens) -> one row for each piece: its container and its place in the text.

    A text is one piece unless it is over the capacity; then all pieces but the last fill a container each. Texts
    without tokens go into the first container of their shard. The result does not depend on partitioning. Doc ids
    should be unique; rows with a repeated id are packed as items of their own.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = stage(sized.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")), "sizes")
    shards = max(1, -(-sized.count() // shard_rows))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda pdf: _pack_shard(pdf, capacity), OUT)
