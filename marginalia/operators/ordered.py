"""Running values over long sequences, block by block, so that no key's rows are sorted by one task.

A sequence (rows of the same ``keys``, in the order of a numeric position and then of further columns) is cut into blocks of
``BLOCK`` positions.  Windows run inside blocks; one summary row per block carries what the block hands on, and a window
over the summaries alone, thousands of times fewer, joins the blocks.  Summaries come back by the key and block that
the rows are distributed by already.

Defined results: rows with a null position come first, in one block of their own; equal positions are ordered by the further
columns; keys that are null are a sequence like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 4096
_FIRST = -(1 << 62)


def _blocked(rows: DataFrame, pos: str, size: int) -> DataFrame:
    return rows.withColumn("_b", F.coalesce(F.floor(F.col(pos) / size), F.lit(_FIRST)).cast("bigint"))


def _inside(keys: list[str], pos: str, ties: list[str]):
    return Window.partitionBy(*keys, "_b").orderBy(F.col(pos).asc_nulls_first(), *ties)


def _handed_on(rows: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of the summaries of their blocks; null keys meet null keys."""
    named = summaries.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_b").alias("_kb"), *(c for c in summaries.columns if c not in (*keys, "_b")))
    on = F.col("_b") == F.col("_kb")
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return rows.join(named, on).drop("_kb", *(f"_k{n}" for n in range(len(keys))))


def running_sum(rows: DataFrame, value: Column, keys: list[str], pos: str, ties: list[str], into: str, size: int = BLOCK) -> DataFrame:
    """``into``: the sum of ``value`` over all rows of the sequence before the row, the row itself not included."""
    b = _blocked(rows, pos, size).withColumn("_v", value.cast("bigint"))
    sums = b.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    local = F.coalesce(F.sum("_v").over(_inside(keys, pos, ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _handed_on(b.withColumn("_local", local), starts, keys).withColumn(into, F.col("_start") + F.col("_local")).drop("_b", "_v", "_local", "_start")


def numbered(rows: DataFrame, keys: list[str], pos: str, ties: list[str], into: str, size: int = BLOCK) -> DataFrame:
    """``into``: the place of the row in its sequence, from 0."""
    return running_sum(rows, F.lit(1), keys, pos, ties, into, size)


def carry_forward(rows: DataFrame, value: str, keys: list[str], pos: str, ties: list[str], into: str = "carried", size: int = BLOCK) -> DataFrame:
    """``into``: ``value`` of the last row that had one, up to and with the own row."""
    b = _blocked(rows, pos, size)
    place = F.struct(F.col(pos).isNotNull(), F.col(pos), *ties)
    lasts = b.groupBy(*keys, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = lasts.select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_start"))
    local = F.last(value, ignorenulls=True).over(_inside(keys, pos, ties).rowsBetween(Window.unboundedPreceding, 0))
    return _handed_on(b.withColumn("_local", local), starts, keys).withColumn(into, F.coalesce("_local", "_start")).drop("_b", "_local", "_start")


def runs(rows: DataFrame, change: list[str], keys: list[str], pos: str, ties: list[str], into: str = "run", size: int = BLOCK) -> DataFrame:
    """``into``: how often one of ``change`` has changed since the sequence began."""
    b = _blocked(rows, pos, size).withColumn("_now", F.struct(*change))
    w = _inside(keys, pos, ties)
    first = F.row_number().over(w) == 1
    flagged = b.withColumn("_first", first).withColumn("_c", F.when(first | F.col("_now").eqNullSafe(F.lag("_now").over(w)), 0).otherwise(1))
    place = F.struct(F.col(pos).isNotNull(), F.col(pos), *ties)
    ends = flagged.groupBy(*keys, "_b").agg(F.max_by("_now", F.when(F.col("_first"), F.lit(1))).alias("_head"), F.max_by("_now", place).alias("_tail"), F.sum("_c").alias("_n"))
    blocks = Window.partitionBy(*keys).orderBy("_b")
    previous = F.lag("_tail").over(blocks)
    turned = ends.withColumn("_turn", F.when(previous.isNull() | F.col("_head").eqNullSafe(previous), 0).otherwise(1))
    start = F.coalesce(F.sum(F.col("_n") + F.col("_turn")).over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_turn")
    starts = turned.select(*keys, "_b", start.alias("_start"))
    local = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _handed_on(flagged.withColumn("_local", local), starts, keys).withColumn(into, F.col("_start") + F.col("_local")).drop("_b", "_now", "_first", "_c", "_local", "_start")
