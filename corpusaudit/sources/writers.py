"""Sinks. Everything is written by the tasks that hold the rows; nothing is collected first."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusaudit.operators import catalog as ct
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

#: How csv files spell NULL; an empty cell is an empty text.
NULL_CELL = r"\N"


def write_json_lines(df: DataFrame, path: str, compress: bool = True, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path, compression="gzip" if compress else "none")


def write_chunks(df: DataFrame, path: str, rows_per_file: int) -> None:
    """JSON lines in files of at most ``rows_per_file`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns are written as JSON texts."""
    flat = [
        F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`")
        for c, t in df.dtypes
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", '""'
    ).option("nullValue", NULL_CELL).csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


#: The folder of rows without a value, as Spark names it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_tree(df: DataFrame, by: Sequence[str], column: str, path: str) -> None:
    """Text files in folders ``<by>=<value>/..``, a line per row: the tree of Spark's partitioned text sink, for very many small files.

    On a mounted folder (``file:``) that sink starts a process per new folder and file to set its mode, which costs far more than the
    file. There the tasks write their files themselves: a file per task and folder, renamed when it is whole, so a task can be repeated.
    """
    rows = df.select(*[F.nullif(F.col(n).cast("string"), F.lit("")).alias(n) for n in by], F.col(column).cast("string"))
    if not path.startswith("file:"):
        rows.write.mode("overwrite").partitionBy(*by).text(path)
        return
    root = "/" + path.removeprefix("file:").lstrip("/")

    def run(part: Iterator[Row]) -> None:
        task = TaskContext.get()
        for values, group in groupby(part, lambda r: tuple(r[:-1])):
            folder = os.path.join(root, *[f"{n}={quote(v, safe='') if v is not None else NO_VALUE}" for n, v in zip(by, values)])
            os.makedirs(folder, exist_ok=True)
            begun = f"{folder}/_part-{task.partitionId():05d}.{task.taskAttemptId()}"
            with open(begun, "wb") as out:
                for row in group:
                    out.write((row[-1] or b"") + b"\n")
            os.replace(begun, f"{folder}/part-{task.partitionId():05d}.txt")

    # bytes pass through as they are
    rows.withColumn(column, F.col(column).cast("binary")).sortWithinPartitions(*by).foreachPartition(run)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def composition_lines(catalog: DataFrame) -> DataFrame:
    """(section, ord, line): the composition card as text lines, one short section per column."""
    sections = [
        ("Collections", "collection", None),
        ("Languages", "languages", None),
        ("Task Categories", "task_categories", None),
        ("Licenses", "licenses", "license"),
    ]
    out = None
    for i, (title, column, item) in enumerate(sections):
        rows = ct.composition(catalog, column, item)
        line = F.format_string(
            "%s  %d (%.2f %%)  %d (%.2f %%)", "item", "datasets", "pct_datasets", "dialogs", "pct_dialogs"
        )
        part = rows.select(
            F.lit(i).alias("section"), F.lit(title).alias("title"), F.col("datasets").alias("n"), line.alias("line")
        )
        out = part if out is None else out.unionByName(part)
    return out


def write_composition_card(catalog: DataFrame, path: str) -> None:
    """The composition card (title and item lines, largest first) and the attribution table."""
    lines = composition_lines(catalog)
    heads = lines.select("section", "title").distinct().select(
        "section", F.lit(None).cast("bigint").alias("n"), F.concat(F.lit("### "), "title").alias("line")
    )
    ordered = heads.unionByName(lines.select("section", "n", "line")).orderBy(
        "section", F.desc_nulls_first("n"), "line"
    )
    write_text(ordered, "line", f"{path}/card")
    write_csv(catalog, f"{path}/attribution")


def write_bibliography(catalog: DataFrame, path: str) -> None:
    """Distinct non-blank entries, a blank line after each."""
    entries = (
        catalog.select(F.trim("bibtex").alias("bibtex"))
        .filter("bibtex IS NOT NULL AND bibtex <> ''")
        .distinct()
        .orderBy("bibtex")
    )
    write_text(entries.select(F.concat("bibtex", F.lit("\n")).alias("value")), "value", path)


def statistics_per_url(statuses: DataFrame) -> DataFrame:
    """(url, split, statuses map date -> map agent -> status) from (url, split, date, agent, status).

    A URL has one entry per date and tracked agent.
    """
    by_date = statuses.groupBy("url", "split", "date").agg(
        F.map_from_entries(F.collect_list(F.struct("agent", "status"))).alias("agents")
    )
    return by_date.groupBy("url", "split").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), "agents"))).alias("statuses")
    )


def url_profiles(
    urls: DataFrame, ranks: DataFrame, purposes: DataFrame, modalities: DataFrame, robots: DataFrame, terms: DataFrame
) -> DataFrame:
    """Nested profile per URL of ``urls``: ranks by corpus, purposes, modalities, robots and terms history.

    ``purposes`` and ``modalities`` have one row per URL; ``ranks`` has one per corpus; ``robots`` and ``terms`` have one per date. The
    tables become one, tagged by the column that is filled, and meet in one aggregate: one shuffle by URL, sorting
    inside a URL only. Parts a URL has no rows of are NULL.
    """
    entries = {
        "ranks": (ranks, ("corpus", "rank", "tokens")),
        "robots": (robots, ("date", "agent", "status")),
        "terms": (terms, ("date", "verdict")),
    }
    parts = [urls.select("url", F.lit(True).alias("_listed"))]
    parts += [df.select("url", F.struct(*cols).alias(name)) for name, (df, cols) in entries.items()]
    parts += [purposes.select("url", "purposes"), modalities.select("url", "modalities")]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    gathered = {name: F.array_sort(F.collect_list(name)) for name in entries}
    profile = rows.groupBy("url").agg(
        F.bool_or("_listed").alias("_listed"),
        *[F.nullif(v, F.array().cast(rows.select(F.array(name)).schema[0].dataType)).alias(name) for name, v in gathered.items()],
        F.first("purposes", True).alias("purposes"),
        F.first("modalities", True).alias("modalities"),
    )
    return profile.filter("_listed").select("url", "ranks", "purposes", "modalities", "robots", "terms")
