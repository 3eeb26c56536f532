"""Running values over long ordered sequences, in two levels.

A window over a whole key puts a hot key into one task. Here each key's rows are cut into blocks; values run within
blocks in parallel, one summary row for each block is scanned on its own, and the carried value is added back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 10_000


def by_blocks(order: str, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a dense integer order column."""
    return F.floor(F.col(order) / rows).cast("long")


def running(df: DataFrame, keys: list[str], block: str, order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """`df` with running sums and maxima (this row included) along `block`, then `order`, within `keys`. NULL keys are a
    key of their own; NULL values add nothing."""
    sums, maxima = sums or {}, maxima or {}
    outs = {**{o: ("sum", e) for o, e in sums.items()}, **{o: ("max", e) for o, e in maxima.items()}}
    at = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = {"sum": F.sum, "max": F.max}
    inner = df.select("*", *[f[k](e).over(at).alias(f"__in_{o}") for o, (k, e) in outs.items()])
    whole = df.groupBy(*keys, block).agg(*[f[k](e).alias(f"__t_{o}") for o, (k, e) in outs.items()])
    up = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*[F.col(c).alias(f"__k_{c}") for c in [*keys, block]], *[f[k](f"__t_{o}").over(up).alias(f"__c_{o}") for o, (k, _) in outs.items()])
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*keys, block]]
    out = inner.join(carried, same, "left")
    for o, (k, _) in outs.items():
        a, b = F.col(f"__in_{o}"), F.col(f"__c_{o}")
        out = out.withColumn(o, F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if k == "sum" else F.greatest(a, b))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def since_reset(df: DataFrame, keys: list[str], block: str, order: list[str], reset: Column, add: Column, out: str) -> DataFrame:
    """`df` with `out`: the sum of `add` from the last row with `reset` (that row included) to this one."""
    marked = df.select("*", reset.cast("int").alias("__reset"), add.cast("long").alias("__add"))
    at = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("__g", F.sum("__reset").over(at))
    part = Window.partitionBy(*keys, block, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = marked.withColumn("__v", F.sum("__add").over(part))
    # a block hands on what it gathered since its last reset; without a reset it adds to what it was handed
    whole = marked.groupBy(*keys, block, "__g").agg(F.sum("__add").alias("__s")).groupBy(*keys, block).agg(F.max("__g").alias("__resets"), F.max_by("__s", "__g").alias("__tail"))
    up = Window.partitionBy(*keys).orderBy(block)
    whole = whole.withColumn("__h", F.sum((F.col("__resets") > 0).cast("int")).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    grouped = Window.partitionBy(*keys, "__h").orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = whole.withColumn("__after", F.sum("__tail").over(grouped))
    carried = whole.select(*[F.col(c).alias(f"__k_{c}") for c in [*keys, block]], F.coalesce(F.lag("__after").over(up), F.lit(0)).alias("__carry"))
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*keys, block]]
    joined = inner.join(carried, same, "left").withColumn(out, F.col("__v") + F.when(F.col("__g") == 0, F.coalesce("__carry", F.lit(0))).otherwise(F.lit(0)))
    return joined.drop(*[c for c in joined.columns if c.startswith("__")])
