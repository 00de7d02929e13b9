"""Concentration over categories and years: Gini, bootstrap intervals, cumulative series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import dates, windows
from corpusaudit.functions import text as tx
from corpusaudit.operators import reports

EPSILON = 1e-7


def gini(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient per group (or of the whole table).

    Values are shifted to be non-negative. Equal values are counted first; the rank of a value then
    comes from a prefix sum over range partitions, so no group has to fit into one task.
    """
    return tally_gini(tally(df, value, group), group)


def tally(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, ``_x``, ``_c``): how often each value occurs."""
    return df.groupBy(*group, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_c"))


def tally_gini(tallies: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, gini, n) of distinct values ``_x`` that occur ``_c`` times."""
    group = list(group)
    ranked = windows.prefix_sum(tallies, group, [F.asc("_x")], "_c", "_p")
    # read from the ranked rows, which are on storage already
    size = (F.sum("_c").alias("_n"), F.least(F.min("_x"), F.lit(0.0)).alias("_low"))
    if group:
        joined = ranked.join(ranked.groupBy(*group).agg(*size), group)
    else:
        total = ranked.agg(F.struct(*size).alias("s")).scalar()
        joined = ranked.withColumn("_s", total).select("*", "_s._n", "_s._low")
    x = F.col("_x") - F.col("_low") + EPSILON
    # the ranks p+1 .. p+c of c equal values contribute c * (2p + c - n)
    part = F.col("_c") * (2 * F.col("_p") + F.col("_c") - F.col("_n")) * x
    return joined.groupBy(*group).agg(
        (F.sum(part) / (F.first("_n") * F.sum(F.col("_c") * x))).alias("gini"),
        F.first("_n").alias("n"),
    )


#: Counts up to this one are drawn from their exact Poisson distribution, larger ones from its normal expansion.
EXACT_COUNT = 20


def poisson_steps(mean: int) -> list[float]:
    """P(count <= k) of a Poisson count for all k that a draw can exceed."""
    term, total, steps = math.exp(-mean), 0.0, []
    while not steps or (total < 1 - 2.0**-52 and len(steps) < 10 * mean + 20):
        total += term
        steps.append(total)
        term *= mean / len(steps)
    return steps


def draw_counts(tallies: DataFrame, count: str, key: Column, replicates: int, seed: int) -> DataFrame:
    """Each tally once per replicate with ``_w``, how many of its ``count`` rows are drawn; those with none are left out.

    Bootstrap rows carry Poisson(1) weights, so ``count`` equal rows carry a Poisson(count) weight together: it is drawn once for
    the tally, and the work grows with distinct values, not with rows. The uniform numbers are the digits of an MD5 digest of seed,
    replicate and ``key`` (a string that is unique per tally), which any engine can compute alike.
    A count above EXACT_COUNT takes a normal number (Box-Muller) and the Cornish-Fisher expansion of the Poisson quantile.
    """
    rows = ["array(" + ", ".join(f"{p!r}D" for p in poisson_steps(n)) + ")" for n in range(1, EXACT_COUNT + 1)]
    steps = F.expr("array(" + ", ".join(rows) + ")")
    c = F.col(count)

    def uniform(digest, first):
        return (F.conv(F.substring(digest, first, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))

    def small(digest):
        return tx.let(uniform(digest, 1), lambda u: F.size(F.filter(F.element_at(steps, c.cast("int")), lambda s: s < u)).cast("bigint"))

    def large(digest):
        z = F.sqrt(-2 * F.ln(uniform(digest, 1))) * F.cos(2 * math.pi * uniform(digest, 14))
        drawn = tx.let(z, lambda z: F.floor(c + F.sqrt(c) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * F.sqrt(c)) + 0.5))
        return F.greatest(F.lit(0), drawn).cast("bigint")

    def weight(replicate):
        digest = F.md5(F.concat_ws("|", F.lit(seed), replicate, key))
        return tx.let(digest, lambda d: F.when(c <= EXACT_COUNT, small(d)).otherwise(large(d)))

    # one array per tally, so that nothing of the draw is computed twice by a filter that moves
    drawn = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.struct(r.alias("replicate"), weight(r).alias("_w")))
    return tallies.select("*", F.inline(F.filter(drawn, lambda d: d["_w"] > 0)))


def bootstrap_gini(
    df: DataFrame,
    value: str,
    group: Sequence[str] = (),
    replicates: int = 1000,
    alpha: float = 0.05,
    seed: int = 0,
    key: Column | None = None,
) -> DataFrame:
    """Mean and percentile interval of the Gini coefficient per group, clipped to [0, 1].

    ``key`` names a tally (group columns, ``_x``) for the draws; by default group and value as text. The size of a
    replicate varies around the number of rows.
    """
    group = list(group)
    key = F.concat_ws("|", *group, F.col("_x").cast("string")) if key is None else key
    drawn = draw_counts(tally(df, value, group), "_c", key, replicates, seed)
    per_replicate = tally_gini(drawn.select(*group, "replicate", "_x", F.col("_w").alias("_c")), [*group, "replicate"])
    return per_replicate.groupBy(*group).agg(
        F.avg("gini").alias("gini_mean"),
        F.greatest(F.lit(0.0), F.percentile("gini", F.lit(alpha / 2))).alias("gini_lower"),
        F.least(F.lit(1.0), F.percentile("gini", F.lit(1 - alpha / 2))).alias("gini_upper"),
        F.count("*").alias("replicates"),
    )


def cumulative_by_year(
    df: DataFrame, category: str, year: str, measure: str, grid: tuple[int, int] | None = None
) -> DataFrame:
    """(category, year, total, cumulative) on a complete year grid from each category's first year.

    Aggregates to one row per category and year first; the window then spans the years of a category.
    """
    sums = df.dropna(subset=[category, year]).groupBy(category, year).agg(F.sum(measure).alias("total"))
    span = sums.groupBy(category).agg(F.min(year).alias("_a"))
    last = F.lit(grid[1]) if grid else sums.agg(F.max(year).alias("m")).scalar()
    axis = span.select(category, F.explode(F.sequence("_a", last)).alias(year))
    full = axis.join(sums, [category, year], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    so_far = W.partitionBy(category).orderBy(year).rowsBetween(W.unboundedPreceding, 0)
    return full.withColumn("cumulative", F.sum("total").over(so_far))


def gini_by_year(df: DataFrame, category: str, year: str, measure: str) -> DataFrame:
    """Gini of cumulative totals over the categories seen in each year.

    A category counts in the years in which it has rows, with its running total.
    """
    sums = df.dropna(subset=[category, year]).groupBy(category, year).agg(F.sum(measure).alias("_t"))
    so_far = W.partitionBy(category).orderBy(year).rowsBetween(W.unboundedPreceding, 0)
    return gini(sums.withColumn("_cum", F.sum("_t").over(so_far)), "_cum", [year])


def bootstrap_gini_by_year(
    df: DataFrame, category: str, year: str, measure: str, replicates: int = 1000, seed: int = 0, key: Column | None = None
) -> DataFrame:
    """:func:`bootstrap_gini` of the running totals of the categories in each year."""
    sums = df.dropna(subset=[category, year]).groupBy(category, year).agg(F.sum(measure).alias("_t"))
    so_far = W.partitionBy(category).orderBy(year).rowsBetween(W.unboundedPreceding, 0)
    return bootstrap_gini(sums.withColumn("_cum", F.sum("_t").over(so_far)), "_cum", [year], replicates, seed=seed, key=key)


def cumulative_distinct(df: DataFrame, group: str, member: str, year: str) -> DataFrame:
    """(group, year, members): members seen up to each year, on a complete year grid."""
    firsts = df.dropna(subset=[group, member, year]).groupBy(group, member).agg(F.min(year).alias(year))
    new = firsts.groupBy(group, year).agg(F.count("*").alias("_new"))
    span = new.agg(F.struct(F.min(year).alias("a"), F.max(year).alias("b")).alias("s")).scalar()
    axis = new.select(group).distinct().select(
        group, F.explode(F.sequence(span["a"], span["b"])).alias(year)
    )
    so_far = W.partitionBy(group).orderBy(year).rowsBetween(W.unboundedPreceding, 0)
    return (
        axis.join(new, [group, year], "left")
        .withColumn("members", F.sum(F.coalesce("_new", F.lit(0))).over(so_far))
        .drop("_new")
    )


def cumulative_sources(
    rows: DataFrame, sources: str, year: str, measure: str, k: int, earliest: int = 2015
) -> DataFrame:
    """(year, source, cumulative) of the ``k`` most frequent sources; early years are one bucket.

    Sources get their display names, the rest and unclear ones are left out, and a year of which a
    source has no rows does not appear.
    """
    exploded = rows.select(F.explode(sources).alias("source"), F.col(year).alias("_y"), F.col(measure).alias("_m"))
    named = reports.top_or_other(exploded, "source", k).withColumn(
        "source", tx.title_with_synonyms(F.col("source"), dims.SOURCE_LABELS)
    )
    sums = (
        named.filter("source <> 'Other' AND _y IS NOT NULL")
        .groupBy("source", F.greatest("_y", F.lit(earliest - 1)).alias("_y"))
        .agg(F.sum("_m").alias("_t"))
    )
    so_far = W.partitionBy("source").orderBy("_y").rowsBetween(W.unboundedPreceding, 0)
    return sums.select(
        dates.year_bucket(F.col("_y"), earliest).alias("year"), "source", F.sum("_t").over(so_far).alias("cumulative")
    )


def year_category(year: Column, minimum: int = 2013) -> Column:
    return dates.year_bucket(year, minimum)
