"""Running totals and row numbers that do not put a whole key into one task.

A plain window partitioned by a key sorts all rows of that key in one task. Here
rows are first cut into blocks along the sort order: blocks are counted (with
map-side combine), block offsets come from a window over one small row per
block, and only the rows of one block are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.session import settle


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all earlier rows of the key.

    ``block`` must never fall while ``order`` rises, and ``keys`` must not be null.
    """
    cut = df.withColumn("_block", block).withColumn("_value", value.cast("bigint"))
    earlier_blocks = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .select(
            *keys,
            "_block",
            F.coalesce(F.sum("_total").over(earlier_blocks), F.lit(0)).alias("_offset"),
        )
    )
    earlier_rows = (
        W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        cut.join(offsets, [*keys, "_block"])
        .withColumn(
            out,
            F.col("_offset") + F.coalesce(F.sum("_value").over(earlier_rows), F.lit(0)),
        )
        .drop("_block", "_value", "_offset")
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], block: Column, out: str
) -> DataFrame:
    """Add ``out`` = position of the row within its key, from 0."""
    return running_total(df, keys, order, block, F.lit(1), out)


def first_k(
    df: DataFrame, keys: list[str], order: list[Column | str], k: int, out: str = "position"
) -> DataFrame:
    """First ``k`` rows of every key, numbered from 1. Spark limits each group
    map-side (WindowGroupLimit) before the shuffle, so a hot key sends k rows per task."""
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= k)


def enumerated(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """All rows numbered from 0 along ``order``, without gaps. Range partitions are
    sorted and written with their places; the partitions' sizes, one row each, give
    every partition its first number."""
    at = settle(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)  # how Spark composes these numbers
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    return (
        at.withColumn("_part", part)
        .join(F.broadcast(first), "_part")  # one row a partition
        .withColumn(out, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_at", "_first")
    )
