"""What plans read and shuffle: scans of a table are counted in the planned query."""

import re

from pyspark.sql import functions as F

from corpusaudit.checks import load_queries
from corpusaudit.operators import dialogs

SF_DIR = "/root/testdata/sf0.001"


class Jobs:
    """Scans of a table by the jobs that run while a query is built, and by its own plan."""

    def __init__(self, spark, monkeypatch):
        from pyspark.sql import DataFrameWriter

        self.plans = []
        write = DataFrameWriter.parquet

        def noted(writer, *args, **kwargs):
            self.plans.append(plan_of(writer._df))
            return write(writer, *args, **kwargs)

        monkeypatch.setattr(DataFrameWriter, "parquet", noted)

    def scans(self, df, table):
        """FileScan nodes name the folder or file they read."""
        found = re.compile(r"FileScan parquet .*?Location: [^\n]*?/" + table + r"\.parquet")
        return sum(len(found.findall(p)) for p in [*self.plans, plan_of(df)])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_estimates_read_the_events_few_times(spark, monkeypatch):
    jobs, known = Jobs(spark, monkeypatch), load_queries()
    assert 1 <= jobs.scans(known["corpus_restriction_estimate"].run(spark, SF_DIR), "events") <= 3
    jobs.plans.clear()
    assert 1 <= jobs.scans(known["corpus_estimate_job"].run(spark, SF_DIR), "events") <= 4


def test_message_trees_read_their_table_twice(spark, monkeypatch):
    jobs = Jobs(spark, monkeypatch)
    assert 1 <= jobs.scans(load_queries()["message_trees"].run(spark, SF_DIR), "conversations") <= 3


def test_trees_of_any_depth_and_width(spark):
    """A chain and a star of 100,000 replies each, a tree with lost parents, a lone message and rows without a tree."""
    n = 100_000
    chain = spark.range(n).selectExpr("'chain' tree", "id", "nullif(id - 1, -1) parent", "id ord")
    star = spark.range(n).selectExpr("'star' tree", "id", "if(id = 0, null, 0L) parent", "id ord")
    odd = [("odd", 0, None, 0), ("odd", 1, 99, 1), ("odd", 2, 1, 2), ("odd", 3, 7, 3), ("odd", 4, 3, 9), ("lone", 5, None, 0), (None, 6, None, 0), (None, 7, 6, 1), ("lost", 8, None, 0), ("lost", 9, 99, 1)]
    rows = chain.union(star).union(spark.createDataFrame(odd, "tree string, id long, parent long, ord long"))
    rows = rows.withColumns({"role": F.lit("prompter"), "text": F.lit(" x "), "lang": F.lit("en")})
    placed = dialogs.tree_rows(rows, "tree", "id", "parent", "ord", "role", "text", "lang")
    good = placed.groupBy("dialog").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("parent_idx") == F.col("idx") - 1) | (F.col("idx") == 0)).alias("chained"),
        F.count_if((F.col("parent_idx") == 0) | (F.col("idx") == 0)).alias("rooted"),
        F.max("idx").alias("last"),
    )
    found = {r.dialog: tuple(r)[1:] for r in good.collect()}
    assert found.pop("chain") == (n, n, 2, n - 1) and found.pop("star") == (n, 2, n, n - 1)
    # message 1 has no parent and goes; its reply attaches to the message before it; so with message 3
    assert {(r.idx, r.parent_idx) for r in placed.filter("dialog = 'odd'").collect()} == {(0, None), (1, 0), (2, 1)}
    assert set(found) == {"odd"}
