"""Queries on concentration, population estimates and bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit.checks.registry import query, table
from corpusaudit.operators import inequality as iq
from corpusaudit.operators import population as pop


def _gini(value: str, source: str, group: str = "") -> str:
    part = f"PARTITION BY {group}" if group else ""
    sel = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""
    SELECT {sel} round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS gini, max(n) AS n FROM (
      SELECT {sel} v - least(min(v) OVER ({part}), 0) + 1e-7 AS x,
             row_number() OVER ({part} ORDER BY v) AS i, count(*) OVER ({part}) AS n
      FROM (SELECT {sel} {value}::DOUBLE AS v FROM {source})) {by}"""


@query(_gini("c_acctbal", "customer"))
def gini(spark, sf_dir):
    out = iq.gini(table(spark, sf_dir, "customer").select("c_acctbal"), "c_acctbal")
    return out.withColumn("gini", F.round("gini", 6))


@query(_gini("l_quantity", "lineitem", "l_returnflag"))
def gini_by_group(spark, sf_dir):
    """Many equal values in few, very large groups."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    return iq.gini(rows, "l_quantity", ["l_returnflag"]).withColumn("gini", F.round("gini", 6))


# Totals in whole units keep sums exact whatever the order of addition.
YEARLY = """
rows AS (SELECT o_custkey % 97 AS category, year(o_orderdate)::INT AS year, floor(o_totalprice)::BIGINT AS amount FROM orders),
sums AS (SELECT category, year, sum(amount) AS t FROM rows GROUP BY ALL),
cum AS (SELECT category, year, sum(t) OVER (PARTITION BY category ORDER BY year) AS c FROM sums)"""


def yearly(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 97).alias("category"),
        F.year("o_orderdate").alias("year"),
        F.floor("o_totalprice").alias("amount"),
    )


@query(f"WITH {YEARLY} {_gini('c', 'cum', 'year')}")
def gini_by_year(spark, sf_dir):
    out = iq.gini_by_year(yearly(spark, sf_dir), "category", "year", "amount")
    return out.withColumn("gini", F.round("gini", 6))


@query(
    f"""WITH {YEARLY}, span AS (SELECT category, min(year) AS a FROM sums GROUP BY category),
    axis AS (SELECT category, unnest(range(a, (SELECT max(year) FROM sums) + 1))::INT AS year FROM span)
    SELECT category, x.year, coalesce(t, 0)::BIGINT AS total,
      (sum(coalesce(t, 0)) OVER (PARTITION BY category ORDER BY x.year))::BIGINT AS cumulative
    FROM axis x LEFT JOIN sums s USING (category, year)"""
)
def cumulative_by_year(spark, sf_dir):
    return iq.cumulative_by_year(yearly(spark, sf_dir), "category", "year", "amount")


@query(
    """WITH f AS (SELECT o_orderpriority AS modality, o_custkey, min(year(o_orderdate)) AS year FROM orders GROUP BY ALL),
    n AS (SELECT modality, year, count(*) AS k FROM f GROUP BY ALL),
    axis AS (SELECT m.modality, y.year FROM (SELECT DISTINCT modality FROM f) m
      CROSS JOIN (SELECT unnest(range((SELECT min(year) FROM f), (SELECT max(year) FROM f) + 1)) AS year) y)
    SELECT modality, axis.year::INT AS year, (sum(coalesce(k, 0)) OVER (PARTITION BY modality ORDER BY axis.year))::BIGINT AS members
    FROM axis LEFT JOIN n USING (modality, year)"""
)
def cumulative_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("modality"), "o_custkey", F.year("o_orderdate").alias("year")
    )
    return iq.cumulative_distinct(rows, "modality", "o_custkey", "year")


def _drawn(tallies: str, key: str, seed: int, replicates: int) -> str:
    """SQL of the draws: each row of ``tallies``, which stands for c equal rows, with its weight w per replicate."""
    uniform = "(('0x' || substr(h, {}, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE"
    return f"""reps AS (SELECT unnest(range(1, {replicates} + 1)) AS replicate),
    steps AS (SELECT lam, list(cdf) AS cdfs FROM (SELECT lam, sum(exp(k * ln(lam) - lam - lgamma(k + 1))) OVER (PARTITION BY lam ORDER BY k) AS cdf
        FROM range(1, {iq.EXACT_COUNT + 1}) a(lam), range(0, 10 * {iq.EXACT_COUNT} + 20) b(k)) GROUP BY lam),
    hashed AS (SELECT t.*, replicate, md5('{seed}|' || replicate || '|' || {key}) AS h FROM {tallies} t CROSS JOIN reps),
    uniforms AS (SELECT * EXCLUDE h, {uniform.format(1)} AS u, {uniform.format(14)} AS v FROM hashed),
    normals AS (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM uniforms),
    drawn AS (SELECT * FROM (SELECT n.*, CASE WHEN c <= {iq.EXACT_COUNT} THEN len(list_filter(cdfs, lambda s: s < u))
        ELSE greatest(0, floor(c + sqrt(c) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * sqrt(c)) + 0.5)) END::BIGINT AS w
        FROM normals n LEFT JOIN steps ON lam = c) WHERE w > 0)"""


def _interval(group: str) -> str:
    """SQL of the mean and percentile interval of the weighted coefficient per group over the replicates."""
    return f"""placed AS (SELECT {group}, replicate, x, w, sum(w) OVER q - w AS p, sum(w) OVER (PARTITION BY {group}, replicate) AS n,
        least(min(x) OVER (PARTITION BY {group}, replicate), 0) AS low FROM drawn WINDOW q AS (PARTITION BY {group}, replicate ORDER BY x)),
    ginis AS (SELECT {group}, replicate, sum(w * (2 * p + w - n) * (x - low + 1e-7)) / (max(n) * sum(w * (x - low + 1e-7))) AS g
        FROM placed GROUP BY ALL)
    SELECT {group}, round(avg(g), 6) AS gini_mean, round(greatest(0, quantile_cont(g, 0.025)), 6) AS gini_lower,
        round(least(1, quantile_cont(g, 0.975)), 6) AS gini_upper, count(*) AS replicates FROM ginis GROUP BY ALL"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith("gini_")})


@query(
    f"""WITH t AS (SELECT c_mktsegment, c_acctbal::DOUBLE AS x, count(*) AS c FROM customer GROUP BY ALL),
    {_drawn('t', "c_mktsegment || '|' || round(x * 100)::BIGINT", 11, 200)}, {_interval('c_mktsegment')}"""
)
def bootstrap_gini(spark, sf_dir):
    """Interval of the Gini coefficient of balances per market segment."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    key = F.concat_ws("|", "c_mktsegment", F.round(F.col("_x") * 100).cast("bigint"))
    return _rounded(iq.bootstrap_gini(rows, "c_acctbal", ["c_mktsegment"], replicates=200, seed=11, key=key))


@query(
    f"""WITH t AS (SELECT l_returnflag, l_quantity::DOUBLE AS x, count(*) AS c FROM lineitem GROUP BY ALL),
    {_drawn('t', "l_returnflag || '|' || x::BIGINT", 12, 1000)}, {_interval('l_returnflag')}"""
)
def bootstrap_gini_of_tallies(spark, sf_dir):
    """A thousand replicates of large groups with few values: the draws are as many as the values, however many rows there are."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    key = F.concat_ws("|", "l_returnflag", F.col("_x").cast("bigint"))
    return _rounded(iq.bootstrap_gini(rows, "l_quantity", ["l_returnflag"], replicates=1000, seed=12, key=key))


@query(
    f"""WITH {YEARLY}, t AS (SELECT year, c::DOUBLE AS x, count(*) AS c FROM cum GROUP BY ALL),
    {_drawn('t', "year || '|' || x::BIGINT", 11, 200)}, {_interval('year')}"""
)
def bootstrap_gini_by_year(spark, sf_dir):
    key = F.concat_ws("|", "year", F.col("_x").cast("bigint"))
    return _rounded(
        iq.bootstrap_gini_by_year(yearly(spark, sf_dir), "category", "year", "amount", replicates=200, seed=11, key=key)
    )


# --- head and random samples ---------------------------------------------------------------------

SITES = """
sites AS (
  SELECT d.doc_id, length(d.text) AS tokens, l.quality = 1 AS good, l.toxic = 1 AS toxic,
    d.lang = 'en' AS english,
    row_number() OVER (ORDER BY length(d.text) DESC, d.doc_id) AS c4_rank,
    row_number() OVER (ORDER BY d.n_chars % 1000 DESC, d.doc_id) AS rf_rank,
    CASE WHEN d.doc_id % 3 = 0 THEN 'random' ELSE 'top' END AS sample
  FROM documents d JOIN labels l USING (doc_id)),
long AS (
  SELECT *, 'good' AS variable, good::INT AS value FROM sites WHERE good IS NOT NULL
  UNION ALL SELECT *, 'toxic', toxic::INT FROM sites WHERE toxic IS NOT NULL
  UNION ALL SELECT *, 'english', english::INT FROM sites)"""
INDICATORS = ["good", "toxic", "english"]


def sites(spark, sf_dir):
    from corpusaudit.functions import windows

    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").cast("bigint").alias("tokens"), "lang", (F.col("n_chars") % 1000).alias("other")
    )
    rows = docs.join(labels, "doc_id").select(
        "doc_id",
        "tokens",
        "other",
        (F.col("quality") == 1).alias("good"),
        (F.col("toxic") == 1).alias("toxic"),
        (F.col("lang") == "en").alias("english"),
        F.when(F.col("doc_id") % 3 == 0, "random").otherwise("top").alias("sample"),
    )
    ranked = windows.global_rank(rows, [], [F.desc("tokens"), F.asc("doc_id")], "c4_rank")
    return windows.global_rank(ranked, [], [F.desc("other"), F.asc("doc_id")], "rf_rank")


@query(
    f"""WITH {SITES}, r AS (
      SELECT 'Top 50' AS band, 'c4' AS corpus, variable, avg(value) AS rate FROM long WHERE c4_rank <= 50 GROUP BY ALL
      UNION ALL SELECT 'Top 50', 'rf', variable, avg(value) FROM long WHERE rf_rank <= 50 GROUP BY ALL
      UNION ALL SELECT 'Top 200', 'c4', variable, avg(value) FROM long WHERE c4_rank <= 200 GROUP BY ALL
      UNION ALL SELECT 'Top 200', 'rf', variable, avg(value) FROM long WHERE rf_rank <= 200 GROUP BY ALL
      UNION ALL SELECT 'Random', 'all', variable, avg(value) FROM long WHERE sample = 'random' GROUP BY ALL)
    SELECT band, variable, round(avg(rate), 6) AS rate FROM r GROUP BY ALL"""
)
def band_incidence(spark, sf_dir):
    out = pop.band_incidence(sites(spark, sf_dir), INDICATORS, ["c4", "rf"], [50, 200])
    return out.withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH {SITES}, h AS (SELECT sum(tokens)::DOUBLE AS head_tokens FROM sites WHERE c4_rank <= 200),
    r AS (SELECT variable, avg(value) FILTER (c4_rank <= 200) AS hu, avg(value) FILTER (sample = 'random') AS ru,
      sum(tokens * value) FILTER (c4_rank <= 200) / sum(tokens) FILTER (c4_rank <= 200) AS ht,
      sum(tokens * value) FILTER (sample = 'random') / sum(tokens) FILTER (sample = 'random') AS rt,
      count(*) FILTER (c4_rank <= 200) AS hn FROM long GROUP BY variable)
    SELECT variable, round(hu * hn / 10000 + ru * (1 - hn / 10000), 6) AS est_url_pct,
      round(ht * head_tokens / 50000000 + rt * (1 - head_tokens / 50000000), 6) AS est_tokens_pct FROM r, h"""
)
def population_estimate(spark, sf_dir):
    rows = sites(spark, sf_dir)
    head = F.col("c4_rank") <= 200
    head_tokens = rows.filter(head).agg(F.sum("tokens").cast("double")).scalar()
    out = pop.population_estimate(
        rows, INDICATORS, "tokens", head, F.col("sample") == "random", 10_000, 50_000_000, head_tokens
    )
    return out.select(
        "variable",
        F.round("est_url_pct", 6).alias("est_url_pct"),
        F.round("est_tokens_pct", 6).alias("est_tokens_pct"),
    )


@query(
    """WITH b AS (SELECT (p_size // 10) * 10 + 5 AS midpoint, count(*) AS count, avg(p_retailprice) / 10000 AS p FROM part GROUP BY 1)
    SELECT round(sum(midpoint * p * count), 3) AS magnitude, round(sum(p * count), 3) AS positive,
      round(sum((1 - p) * count), 3) AS negative FROM b"""
)
def bucket_estimate(spark, sf_dir):
    buckets = (
        table(spark, sf_dir, "part")
        .groupBy((F.floor(F.col("p_size") / 10) * 10 + 5).alias("midpoint"))
        .agg(F.count("*").alias("count"), (F.avg("p_retailprice") / 10000).alias("probability"))
    )
    out = pop.bucket_estimate(buckets)
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


def _logistic_sql(train: str) -> str:
    """Newton steps of the penalised regression over counts per (magnitude, label), as a recursive query."""
    p = "1 / (1 + exp(-(a + b * x)))"
    return f"""
    WITH RECURSIVE {SITES},
    train AS (SELECT tokens::DOUBLE AS m, good::INT::DOUBLE AS y FROM sites WHERE sample = 'random' {train}),
    scaled AS (SELECT avg(m) AS mean, coalesce(nullif(stddev_pop(m), 0), 1) AS spread FROM train),
    counts AS (SELECT (m - mean) / spread AS x, y, count(*) AS n FROM train, scaled WHERE y IS NOT NULL GROUP BY ALL),
    newton(step, a, b) AS (
      SELECT 0, 0::DOUBLE, 0::DOUBLE
      UNION ALL
      SELECT step + 1, a - da * least(1, {pop.LONGEST_STEP} / greatest(sqrt(da * da + db * db), 1e-300)), b - db * least(1, {pop.LONGEST_STEP} / greatest(sqrt(da * da + db * db), 1e-300))
      FROM (SELECT step, a, b, (hbb * ga - hab * gb) / (haa * hbb - hab * hab + 1e-12) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab + 1e-12) AS db
        FROM (SELECT step, a, b, sum(n * (p - y)) AS ga, sum(n * (p - y) * x) + b AS gb, sum(n * p * (1 - p)) AS haa,
                sum(n * p * (1 - p) * x) AS hab, sum(n * p * (1 - p) * x * x) + 1 AS hbb
              FROM (SELECT step, a, b, n, x, y, {p} AS p FROM newton, counts WHERE step < {pop.STEPS}) GROUP BY step, a, b))),
    fitted AS (SELECT a - b * mean / spread AS a, b / spread AS b FROM newton, scaled WHERE step = {pop.STEPS}),
    buckets AS (SELECT (length(text) // 500) * 500 + 250 AS x, count(*) AS n FROM documents GROUP BY 1),
    rest AS (SELECT sum(x * p * n) AS magnitude, sum(p * n) AS positive, sum((1 - p) * n) AS negative FROM (SELECT x, n, {p} AS p FROM buckets, fitted)),
    seen AS (SELECT coalesce(sum(tokens) FILTER (good), 0) AS magnitude, sum(good::INT) AS positive, sum(1 - good::INT) AS negative FROM sites WHERE c4_rank <= 200)
    SELECT 'good' AS variable, round(rest.magnitude + seen.magnitude, 2)::DOUBLE AS magnitude, round(rest.positive + seen.positive, 2)::DOUBLE AS positive,
      round(rest.negative + seen.negative, 2)::DOUBLE AS negative FROM rest, seen"""


def logistic(spark, sf_dir, conservative):
    rows = sites(spark, sf_dir).select("tokens", "good", "sample", "c4_rank")
    buckets = (
        table(spark, sf_dir, "documents")
        .groupBy((F.floor(F.length("text") / 500) * 500 + 250).alias("midpoint"))
        .agg(F.count("*").alias("count"))
    )
    head, random = rows.filter("c4_rank <= 200"), rows.filter("sample = 'random'")
    return pop.logistic_population(head, random, buckets, "good", "tokens", conservative, scale=True)


@query(_logistic_sql("UNION ALL SELECT tokens, good::INT FROM sites WHERE c4_rank <= 200"))
def ml_population_estimate(spark, sf_dir):
    """Fitted on the head and the random sample; a site that is in both counts twice."""
    return logistic(spark, sf_dir, False)


@query(_logistic_sql(""))
def ml_population_conservative(spark, sf_dir):
    """Fitted on the random sample alone."""
    return logistic(spark, sf_dir, True)


RATES = f"""{SITES}, t AS (SELECT variable, value, count(*) AS c FROM long GROUP BY ALL),
    {_drawn('t', "variable || '|' || value", 5, 1000)},
    rates AS (SELECT replicate, variable, sum(value * w) / sum(w) AS rate FROM drawn GROUP BY ALL)"""


def rates(spark, sf_dir):
    return pop.bootstrap_rates(sites(spark, sf_dir), INDICATORS, 1000, seed=5)


@query(
    f"""WITH {RATES}
    SELECT variable, round(avg(rate), 6) AS mean, round(stddev_samp(rate), 6) AS sd,
        round(quantile_cont(rate, 0.025), 6) AS lower, round(quantile_cont(rate, 0.975), 6) AS upper FROM rates GROUP BY variable"""
)
def bootstrap_rates(spark, sf_dir):
    return rates(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("mean", "sd", "lower", "upper")})
