"""Forward fill and counts against a plain loop over the definition."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import inequality, population, temporal


def month(d):
    return d.replace(day=1)


def test_fill_and_counts_by_definition(spark):
    rng = random.Random(5)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(800), hours=3)
    snaps = [(f"u{u}", a, day(), rng.choice(["all", "some", "none"])) for u in range(12) for a in "AB" for _ in range(rng.randrange(5))]
    starts = {f"u{u}": dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(700)) for u in range(14)}
    sdf = spark.createDataFrame(snaps, "url string, agent string, ts timestamp, status string")
    sites = spark.createDataFrame(list(starts.items()), "url string, start_date timestamp")
    start, end = "2020-03-01", "2022-01-01"
    periods, p = [], dt.date(2020, 3, 1)
    while p <= dt.date(2022, 1, 1):
        periods.append(p)
        p = (p + dt.timedelta(days=32)).replace(day=1)
    want = {}
    for url, agent in {(s[0], s[1]) for s in snaps}:
        mine = sorted((t, s) for u, a, t, s in snaps if (u, a) == (url, agent))
        for p in periods:
            if dt.datetime.combine(p, dt.time()) >= starts[url]:
                stop = dt.datetime.combine((p + dt.timedelta(days=32)).replace(day=1), dt.time())
                seen = [s for t, s in mine if t < stop]
                want[(url, agent, p)] = seen[-1] if seen else "no_robots"
    filled = temporal.fill_periods(sdf, sites, start, end)
    got = {(r.url, r.agent, r.period): r.status for r in filled.collect()}
    assert got == want
    key = lambda df: sorted((r.period, r.agent, r.status, r["count"], r.tokens) for r in df.collect())
    tokens = spark.createDataFrame([(f"u{u}", 10 * u) for u in range(9)], "url string, tokens bigint")
    counted = {}
    for (url, agent, p), status in want.items():
        n, t = counted.get((p, agent, status), (0, 0))
        counted[p, agent, status] = (n + 1, t + (10 * int(url[1:]) if int(url[1:]) < 9 else 0))
    assert key(temporal.period_counts_from_changes(sdf, sites, start, end, tokens=tokens)) == sorted((*k, *v) for k, v in counted.items())
    spans = temporal.status_intervals(sdf, sites, start, end)
    both = temporal.counts_with_combined_agent(spans, tokens, end)
    assert sum(r["count"] for r in both.filter("agent = 'Combined Agent'").collect()) == len({(u, p) for u, _, p in want})
    moves = temporal.transitions_from_changes(spans, end)
    changed = sum(1 for (u, a, p), s in want.items() if (u, a, prev(p)) in want)
    assert sum(r.urls for r in moves.collect()) == changed


def prev(p):
    return (p - dt.timedelta(days=1)).replace(day=1)


def test_farthest_and_unchanged(spark):
    rows = [("u", dt.date(2020, 1, d)) for d in (1, 5, 9)] + [("v", dt.date(2020, 3, 3))]
    df = spark.createDataFrame(rows, "url string, d date")
    got = {(r.url, r.d.day) for r in temporal.farthest_per_year(df, ["url"], "d").collect()}
    assert got == {("u", 1), ("u", 9), ("v", 3)}


def gini_by_definition(values):
    xs = sorted(v - min(0, min(values)) + 1e-7 for v in values)
    n = len(xs)
    return sum((2 * i - n - 1) * x for i, x in enumerate(xs, 1)) / (n * sum(xs))


def test_gini(spark):
    rng = random.Random(2)
    values = [float(rng.choice([0, 1, 1, 5, 20, -3])) for _ in range(400)] + [1000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert abs(inequality.gini(df, "v").first().gini - gini_by_definition(values)) < 1e-9
    equal = spark.createDataFrame([(3.0,)] * 50, "v double")
    assert abs(inequality.gini(equal, "v").first().gini) < 1e-9


def test_bootstrap_brackets_the_estimate(spark):
    rng = random.Random(3)
    values = [rng.paretovariate(2) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    row = inequality.bootstrap_gini(df, "v", replicates=60, seed=1).first()
    point = gini_by_definition(values)
    assert row.gini_lower <= row.gini_mean <= row.gini_upper
    assert row.gini_lower - 0.05 < point < row.gini_upper + 0.05
    again = inequality.bootstrap_gini(df.repartition(3), "v", replicates=60, seed=1).first()
    assert abs(again.gini_mean - row.gini_mean) < 1e-9


@pytest.mark.parametrize("count", [1, 3, inequality.EXACT_COUNT, inequality.EXACT_COUNT + 1, 400, 10**9])
def test_drawn_counts_are_poisson(spark, count):
    """Mean and variance of the draws are the count; every tally has its own numbers."""
    tallies = spark.createDataFrame([("a", count), ("b", count)], "k string, c bigint")
    drawn = inequality.draw_counts(tallies, "c", F.col("k"), 4000, 3).groupBy("replicate").pivot("k", ["a", "b"]).sum("_w").fillna(0).collect()
    for got in ([r.a for r in drawn], [r.b for r in drawn]):
        got += [0] * (4000 - len(got))
        mean = sum(got) / 4000
        assert abs(mean - count) < 5 * (count / 4000) ** 0.5
        assert sum((g - mean) ** 2 for g in got) / 4000 == pytest.approx(count, rel=0.15)
    assert [r.a for r in drawn] != [r.b for r in drawn]


def test_bootstrap_work_grows_with_values_not_rows(spark):
    """The plan counts equal values before it draws: rows and replicates never meet."""
    df = spark.range(100_000).selectExpr("cast(id % 7 as double) v")
    drawn = inequality.draw_counts(inequality.tally(df, "v"), "_c", F.col("_x").cast("string"), 100, 1)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline") < plan.index("Aggregate") and drawn.count() <= 700


def test_logistic_fit_is_the_minimum(spark):
    """At the fitted numbers every small move raises the penalised loss, whatever the scale of x."""
    rng = random.Random(6)
    for unit, scaled in ((1.0, False), (1e4, False), (1e4, True)):
        rows = [(unit * rng.gauss(3, 1), None) for _ in range(300)]
        rows = [(x, int(rng.random() < 1 / (1 + math.exp(3 - x / unit)))) for x, _ in rows]
        a, b = population.logistic_fit(spark.createDataFrame([*rows, (None, 1), (1.0, None)], "m double, label int"), penalise_scaled=scaled)
        mean = sum(x for x, _ in rows) / 300
        spread = (sum((x - mean) ** 2 for x, _ in rows) / 300) ** 0.5 if scaled else 1.0

        def loss(a, b):
            return sum(math.log1p(math.exp(-(a + b * x) if y else a + b * x)) for x, y in rows) + (b * spread) ** 2 / 2

        least = loss(a, b)
        for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3 / unit), (0, -1e-3 / unit)):
            assert loss(a + da, b + db) > least


def test_logistic_fit_of_odd_samples(spark):
    made = lambda rows: population.logistic_fit(spark.createDataFrame(rows, "m double, label int"))
    assert made([]) == (0.0, 0.0)
    a, b = made([(5.0, 1), (5.0, 0), (5.0, 0), (5.0, 0)])
    assert a + 5 * b == pytest.approx(-math.log(3)) and b == pytest.approx(0)
    a, b = made([(1.0, 1), (2.0, 1)])
    assert 1 / (1 + math.exp(-(a + 1.5 * b))) > 0.99


def test_logistic_population(spark):
    rng = random.Random(4)
    rows = [(float(m), int(rng.random() < (0.9 if m > 50 else 0.1))) for m in range(100) for _ in range(5)]
    sample = spark.createDataFrame(rows, "m double, y int")
    buckets = spark.createDataFrame([(10.0, 1000), (90.0, 1000)], "midpoint double, count bigint")
    none = sample.filter("m < 0")
    row = population.logistic_population(none, sample, buckets, "y", "m", conservative=True, scale=True).first()
    assert 800 < row.positive < 1200 and abs(row.positive + row.negative - 2000) < 0.1
    assert row.magnitude > 90 * 700


def test_autoregression_follows_its_rule(spark):
    from corpusaudit.operators import forecast

    y, rows = 80.0, []
    for i in range(24):
        rows.append(("A", dt.date(2020 + i // 12, i % 12 + 1, 1), y))
        y = 0.5 * y + 10 + (0.001 if i % 2 else -0.001)
    rows += [("B", dt.date(2021, 12, 1), 7.0)]
    df = spark.createDataFrame(rows, "agent string, period date, share double")
    got = forecast.forecast(df, ["agent"], "share", steps=3, lags=(1,)).collect()
    a = sorted((r.period, r.forecast) for r in got if r.agent == "A")
    assert [p for p, _ in a] == [dt.date(2022, 1, 1), dt.date(2022, 2, 1), dt.date(2022, 3, 1)]
    assert all(abs(v - 20) < 0.1 for _, v in a)
    assert {r.forecast for r in got if r.agent == "B"} == {7.0}
    scaled = forecast.renormalise(spark.createDataFrame([("x", 1, -5.0), ("y", 1, 3.0), ("z", 1, 1.0)], "s string, g int, forecast double"), ["g"])
    assert {r.s: r.forecast for r in scaled.collect()} == {"x": 0.0, "y": 0.75, "z": 0.25}


def test_hot_site_is_reduced_before_the_shuffle(spark):
    """The aggregate over snapshots is a hash aggregate with a map-side part."""
    from pyspark.sql import functions as F

    snaps = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 50)).alias("url"),
        F.lit("A").alias("agent"),
        (F.lit("2021-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") % 9000).cast("int"))).alias("ts"),
        F.when(F.col("id") % 2 == 0, "all").otherwise("none").alias("status"),
        "id",
    )
    reduced = temporal.last_per_period(snaps, ["url", "agent"], "status", "ts", "month", "id")
    plan = reduced._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "SortAggregate" not in plan
    best = {}
    for r in snaps.collect():
        key = (r.url, r.ts.year, r.ts.month)
        best[key] = max(best.get(key, (r.ts, -1, "")), (r.ts, r.id, r.status))
    assert {(r.url, r.period.year, r.period.month): r.status for r in reduced.collect()} == {k: v[2] for k, v in best.items()}
