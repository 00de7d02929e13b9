"""Block-wise windows and ranks against plain windows, with one key holding most rows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusaudit.functions import windows


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5))
    return spark.range(3000).select(
        key.alias("k"), (F.col("id") * 7919 % 3001).alias("o"), (F.col("id") * 31 % 17).alias("v")
    ).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_previous_row(skewed):
    got = windows.previous_row(skewed, ["k"], ["o"], F.floor(F.col("o") / 100), {"p": "v"})
    want = skewed.withColumn("p", F.lag("v").over(W.partitionBy("k").orderBy("o")))
    fill = F.coalesce("p", F.lit(-1)).alias("p")
    assert rows(got, "k", "o", fill) == rows(want, "k", "o", fill)


def test_running_total(skewed):
    got = windows.running_total(skewed, ["k"], ["o"], F.floor(F.col("o") / 64), "v", "t")
    want = skewed.withColumn("t", F.sum("v").over(W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, 0)))
    assert rows(got, "k", "o", "t") == rows(want, "k", "o", "t")


@pytest.mark.parametrize("keys", [["k"], []])
def test_global_rank(skewed, keys):
    order = [F.desc("v"), F.asc("o")]
    got = windows.global_rank(skewed, keys, order)
    want = skewed.withColumn("rank", F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)))
    assert rows(got, "k", "o", "rank") == rows(want, "k", "o", "rank")


def test_prefix_sum(skewed):
    got = windows.prefix_sum(skewed, ["k"], [F.asc("o")], "v", "p")
    w = W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, -1)
    want = skewed.withColumn("p", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert rows(got, "k", "o", "p") == rows(want, "k", "o", "p")


def test_first_n_is_limited_before_the_shuffle(skewed):
    out = windows.first_n_per_key(skewed, ["k"], [F.asc("o")], 3)
    assert out.groupBy("k").count().filter("count > 3").count() == 0
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_shares_add_up(skewed):
    sums = skewed.groupBy("k", "v").agg(F.count("*").alias("n"))
    shares = windows.share_of_total(sums, "n", ["k"], "s").groupBy("k").agg(F.sum("s").alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in shares.collect())


def test_previous_row_of_a_hot_key(spark):
    rows = [("hot", i, i * 7 % 5) for i in range(500)] + [("a", 1, 3), ("b", 2, None), ("b", 3, 4)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    got = {(r.k, r.o): r.before for r in windows.previous_row_ranged(df, ["k"], ["o"], {"before": "v"}).collect()}
    want, last = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[:2]):
        want[k, o] = last.get(k)
        last[k] = v
    assert got == want
