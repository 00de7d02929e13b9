"""Order-dependent operations that hold up when one key has a third of all rows.

A plain window puts every row of its partition key into one task. The helpers here cut a key into
blocks (days, months, ranges of an ordinal), run the window inside a block, and carry one summary
row per block across the block borders. Ranks over whole tables use a range partitioning that is
written to the checkpoint folder, so a lost executor cannot shift the borders.

Key columns must not be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusaudit.session import ensure_checkpoint_dir

_ROW_BITS = (1 << 33) - 1


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], block: Column, cols: dict[str, str]
) -> DataFrame:
    """Add ``cols`` (output name -> input name) of the preceding row of the same key.

    ``block`` must be monotone in ``order``. Rows without a predecessor get NULL.
    """
    packed = F.struct(*[F.col(src) for src in cols.values()])
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    blocked = df.withColumn("_block", block)
    local = blocked.withColumn("_prev", F.lag(packed).over(inside)).withColumn(
        "_leads", F.row_number().over(inside) == 1
    )
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max_by(packed, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_block")))
        .drop("_last")
    )
    out = local.join(carried, [*keys, "_block"]).withColumn(
        "_prev", F.when(F.col("_leads"), F.col("_carry")).otherwise(F.col("_prev"))
    )
    out = out.withColumns({name: F.col("_prev").getField(src) for name, src in cols.items()})
    return out.drop("_block", "_prev", "_leads", "_carry")


def running_total(
    df: DataFrame, keys: list[str], order: list[str], block: Column, value: str, out: str
) -> DataFrame:
    """Add the sum of ``value`` over all rows of the key up to and including this row."""
    blocked = df.withColumn("_block", block)
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_total"))
        .select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    )
    return (
        blocked.withColumn("_local", F.sum(value).over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(out, F.col("_carry") + F.col("_local"))
        .drop("_block", "_local", "_carry")
    )


def _ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows sorted across range partitions, with partition and position, kept on shared storage."""
    ensure_checkpoint_dir(df.sparkSession)
    sort = [*[F.col(k) for k in keys], *order]
    return (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33))
        .withColumn("_pos", F.col("_pos").bitwiseAND(F.lit(_ROW_BITS)))
        .checkpoint()
    )


def previous_row_ranged(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str]) -> DataFrame:
    """:func:`previous_row` for keys of any size: cut by range partitions of (keys, order).

    The last row of each partition is handed to the next; there are as many of them as partitions.
    """
    ranged = _ranged(df, keys, [F.col(o) for o in order])
    packed = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(src).alias(f"c{i}") for i, src in enumerate(cols.values())])
    lasts = ranged.groupBy("_part").agg(F.max_by(packed, "_pos").alias("_last"))
    carried = lasts.select("_part", F.lag("_last").over(W.partitionBy(F.lit(0)).orderBy("_part")).alias("_carry"))
    inside = W.partitionBy("_part").orderBy("_pos")
    out = ranged.withColumn("_prev", F.lag(packed).over(inside)).join(carried, "_part", "left")
    out = out.withColumn("_prev", F.coalesce("_prev", "_carry"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_prev.k{i}"))
    out = out.withColumns({name: F.when(same, F.col(f"_prev.c{i}")) for i, name in enumerate(cols)})
    return out.drop("_part", "_pos", "_prev", "_carry")


def global_rank(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """``row_number`` per key without gathering a key in one task.

    One range shuffle; the offsets table has one row per (key, range partition).
    """
    ranged = _ranged(df, keys, order)
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*keys, "_part")
        .agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        ranged.join(offsets, [*keys, "_part"])
        .withColumn(out, F.col("_offset") + F.col("_pos") - F.col("_first") + 1)
        .drop("_part", "_pos", "_first", "_offset")
    )


def prefix_sum(
    df: DataFrame, keys: list[str], order: list[Column], value: str, out: str
) -> DataFrame:
    """Sum of ``value`` over all rows before this one in the key's order (exclusive)."""
    ranged = _ranged(df, keys, order)
    parts = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")
    inside = W.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_part")
        .agg(F.sum(value).alias("_s"))
        .withColumn(
            "_offset",
            F.coalesce(F.sum("_s").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("_s")
    )
    return (
        ranged.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [*keys, "_part"])
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_part", "_pos", "_local", "_offset")
    )


def first_n_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows of each key. Spark limits each key map-side before the shuffle."""
    name = rank or "_rank"
    numbered = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = numbered.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def share_of_total(df: DataFrame, value: str, group: list[str], out: str) -> DataFrame:
    """``value`` over the group's total; totals are pre-aggregated and joined back.

    Rows with a NULL group have no share and are dropped.
    """
    if not group:
        total = df.agg(F.sum(value).alias("_total"))
        return df.withColumn(out, F.try_divide(F.col(value), total.scalar()))
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    return (
        df.join(totals, group)
        .withColumn(out, F.try_divide(F.col(value), F.col("_total")))
        .drop("_total")
    )
