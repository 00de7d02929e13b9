"""Estimates for a whole corpus from its head and a random sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.operators import inequality
from corpusaudit.session import ensure_checkpoint_dir


def long_indicators(sites: DataFrame, indicators: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, variable, value 0/1) from boolean columns; NULL indicators are left out."""
    entries = F.array(
        *[F.struct(F.lit(v).alias("variable"), F.col(v).cast("int").alias("value")) for v in indicators]
    )
    return sites.select(*keep, F.inline(entries)).filter("value IS NOT NULL")


def band_incidence(
    sites: DataFrame, indicators: Sequence[str], corpora: Sequence[str], bands: Sequence[int]
) -> DataFrame:
    """(band, variable, rate): mean over corpora of the rate among the corpus' top N, and the random rate.

    ``sites`` has ``<corpus>_rank`` columns and ``sample`` ('top' or 'random'). One scan: a row is
    repeated for the bands it is in, then rates are averaged per corpus and over corpora.
    """
    per_band = F.array(
        *[
            F.struct(
                F.lit(f"Top {n}").alias("band"), F.lit(c).alias("corpus"), (F.col(f"{c}_rank") <= n).alias("inside")
            )
            for n in bands
            for c in corpora
        ],
        F.struct(F.lit("Random").alias("band"), F.lit("all").alias("corpus"), (F.col("sample") == "random").alias("inside")),
    )
    keep = [f"{c}_rank" for c in corpora] + ["sample"]
    rows = long_indicators(sites, indicators, keep)
    placed = rows.select("variable", "value", F.inline(per_band)).filter("inside")
    rates = placed.groupBy("band", "corpus", "variable").agg(F.avg("value").alias("rate"))
    return rates.groupBy("band", "variable").agg(F.avg("rate").alias("rate"))


def population_estimate(
    sites: DataFrame,
    indicators: Sequence[str],
    magnitude: str,
    head: Column,
    random: Column,
    total_urls: int | Column,
    total_tokens: int | Column,
    head_tokens: Column,
) -> DataFrame:
    """(variable, est_url_pct, est_tokens_pct) from rates in the head and in the random sample.

    URL rates are weighted by the share of URLs in the head and outside it, token rates by the
    share of tokens.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    rows = long_indicators(
        sites.select(*indicators, F.col(magnitude).alias("_m"), head.alias("_h"), random.alias("_r")),
        indicators,
        ["_m", "_h", "_r"],
    )
    weighed = lambda cond: F.try_divide(
        F.sum(F.when(cond, F.col("_m") * F.col("value"))), F.sum(F.when(cond, F.col("_m")))
    )
    rates = rows.groupBy("variable").agg(
        F.avg(F.when(F.col("_h"), F.col("value"))).alias("_hu"),
        F.avg(F.when(F.col("_r"), F.col("value"))).alias("_ru"),
        weighed(F.col("_h")).alias("_ht"),
        weighed(F.col("_r")).alias("_rt"),
        F.count_if(F.col("_h")).alias("_hn"),
    )
    url_head = F.col("_hn") / as_col(total_urls)
    token_head = head_tokens / as_col(total_tokens)
    return rates.select(
        "variable",
        (F.col("_hu") * url_head + F.col("_ru") * (1 - url_head)).alias("est_url_pct"),
        (F.col("_ht") * token_head + F.col("_rt") * (1 - token_head)).alias("est_tokens_pct"),
    )


def bucket_estimate(buckets: DataFrame, probability: str = "probability") -> DataFrame:
    """Expected magnitude and counts over (midpoint, count, probability) buckets."""
    p, n = F.col(probability), F.col("count")
    return buckets.agg(
        F.sum(F.col("midpoint") * p * n).alias("magnitude"),
        F.sum(p * n).alias("positive"),
        F.sum((1 - p) * n).alias("negative"),
    )


#: Newton steps of the logistic regression, at most, and the longest one.
STEPS, LONGEST_STEP = 30, 4.0


def logistic_fit(rows: DataFrame, x: str = "m", label: str = "label", penalise_scaled: bool = False) -> tuple[float, float]:
    """Intercept and slope of a logistic regression of ``label`` (0 or 1) on ``x`` with an L2 penalty of 1 on the slope.

    Rows become counts per (x, label), written once. Each Newton step is one aggregate over them that returns five sums; x is
    standardised meanwhile, and the penalty is on the slope of the standardised x (``penalise_scaled``) or of x itself. Rows with a
    null are left out; without any row both numbers are 0.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    counts = rows.groupBy(F.col(x).cast("double").alias("x"), F.col(label).cast("double").alias("y")).agg(F.count("*").alias("n"))
    counts = counts.dropna().checkpoint()
    n = F.col("n")
    size, mean, square = counts.agg(F.sum("n"), F.sum(n * F.col("x")) / F.sum("n"), F.sum(n * F.col("x") * F.col("x")) / F.sum("n")).first()
    if not size:
        return 0.0, 0.0
    spread = max(square - mean * mean, 0.0) ** 0.5 or 1.0
    penalty = 1.0 if penalise_scaled else 1.0 / spread**2
    z = (F.col("x") - mean) / spread
    a = b = 0.0
    for _ in range(STEPS):
        p = 1 / (1 + F.exp(-(a + b * z)))
        miss, sharp = n * (p - F.col("y")), n * p * (1 - p)
        sums = [miss, miss * z, sharp, sharp * z, sharp * z * z]
        ga, gb, haa, hab, hbb = counts.agg(*[F.sum(v) for v in sums]).first()
        gb, hbb = gb + penalty * b, hbb + penalty
        # a whole sample of one label flattens the curve: the step stays defined
        flat = haa * hbb - hab * hab + 1e-12
        da, db = (hbb * ga - hab * gb) / flat, (haa * gb - hab * ga) / flat
        short = min(1.0, LONGEST_STEP / max((da * da + db * db) ** 0.5, 1e-300))
        a, b = a - short * da, b - short * db
        if abs(da) + abs(db) < 1e-12:
            break
    return a - b * mean / spread, b / spread


def logistic_population(
    head: DataFrame,
    random: DataFrame,
    buckets: DataFrame,
    variable: str,
    magnitude: str,
    conservative: bool = False,
    scale: bool = False,
) -> DataFrame:
    """Expected magnitude and counts of positive sites in a whole corpus.

    A logistic regression of the indicator on the magnitude (:func:`logistic_fit`) is fitted on head and random
    sample, or on the random sample alone (``conservative``). Its predictions fill the buckets (midpoint, count) of the
    unseen rest; the head's own values are added as they are.
    """
    cols = [F.col(magnitude).cast("double").alias("m"), F.col(variable).cast("double").alias("label")]
    sample = random.select(*cols)
    known = head.select(*cols)
    intercept, slope = logistic_fit(sample if conservative else sample.unionByName(known), penalise_scaled=scale)
    p = 1 / (1 + F.exp(-(intercept + slope * F.col("midpoint"))))
    rest = bucket_estimate(buckets.select("midpoint", "count", p.alias("_p")), "_p")
    seen = known.agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("m"))), F.lit(0.0)).alias("magnitude"),
        F.sum("label").alias("positive"),
        F.sum(1 - F.col("label")).alias("negative"),
    )
    return rest.unionByName(seen).agg(
        *[F.round(F.sum(c), 2).alias(c) for c in ("magnitude", "positive", "negative")]
    ).select(F.lit(variable).alias("variable"), "magnitude", "positive", "negative")


def bootstrap_rates(
    sites: DataFrame,
    indicators: Sequence[str],
    replicates: int,
    alpha: float = 0.05,
    seed: int = 0,
) -> DataFrame:
    """(variable, mean, sd, lower, upper) of resampled indicator rates.

    Rows are counted per (variable, value) first; a replicate draws for those two counts.
    """
    counts = long_indicators(sites, indicators, []).groupBy("variable", "value").agg(F.count("*").alias("n"))
    key = F.concat_ws("|", "variable", F.col("value").cast("string"))
    drawn = inequality.draw_counts(counts, "n", key, replicates, seed)
    rates = drawn.groupBy("replicate", "variable").agg(
        (F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("rate")
    )
    return rates.groupBy("variable").agg(
        F.avg("rate").alias("mean"),
        F.stddev_samp("rate").alias("sd"),
        F.percentile("rate", F.lit(alpha / 2)).alias("lower"),
        F.percentile("rate", F.lit(1 - alpha / 2)).alias("upper"),
    )


def rejected(rates: DataFrame, points: DataFrame) -> DataFrame:
    """Is the point estimate of a variable outside its interval?"""
    return rates.join(points, "variable").withColumn(
        "rejected", (F.col("point") < F.col("lower")) | (F.col("point") > F.col("upper"))
    )
