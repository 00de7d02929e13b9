"""What the operators of this package share: row-wise Python in tasks, kept tables, components."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.session import ensure_checkpoint_dir, shared_folder, ship_with_tasks

ship_with_tasks(__name__)

#: A-Z to a-z. (``bytes.split()`` splits at the blank and \t \n \v \f \r, the white space meant here.)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A-Z to a-z; every other ASCII character that is no letter or digit to a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def spaced_words(text: str) -> list[bytes]:
    """Runs of anything but white space (ASCII), A-Z in lower case."""
    return text.encode().translate(LOWER).split()


def plain_words(text: str) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.encode().translate(WORD_BYTES).split()


def worker_state(key: object, make: Callable[[], object]) -> object:
    """``make()`` once per Python worker; Spark reuses workers, so later tasks find it ready."""
    home = sys.modules.setdefault("corpusaudit_worker_state", types.ModuleType("corpusaudit_worker_state"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no input name can clash with an output name."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("row"))


def map_rows(
    df: DataFrame, names: list[str], start: Callable[[], Callable[..., list[pa.Array]]], fields: list[T.StructField]
) -> DataFrame:
    """Add ``fields`` to every row with Python in the tasks; the input stays whole in the struct ``row``.

    ``start()`` runs once per task and returns a function from the named columns of a batch (Python
    lists) to one array per field. Rows stay rows, so nothing is shuffled and a lost task is redone.
    """
    rows = packed(df)
    outer = [df.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            row = batch.column(0)
            made = work(*[row.field(i).to_pylist() for i in outer])
            yield pa.RecordBatch.from_arrays([row, *made], names=["row", *[f.name for f in fields]])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *fields]))


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T.DataType.fromDDL(kind))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(tables: list[DataFrame]) -> None:
    """Delete kept tables that nothing reads any more, and let Spark drop shuffle files of finished steps.

    Spark removes shuffle files once the driver has collected the plans behind them, which an idle driver puts
    off; without this the files of all steps would lie on the disks together.
    """
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, root) per node with an edge.

    Every node points to the neighbour (or itself) whose hash is least; edges move to where their ends
    point, and the graph shrinks by a constant share per round whatever its shape. The pointers
    of all rounds are then followed. Minima combine before the shuffle, so hubs do no harm; the
    joins are plain equi-joins that AQE may split.
    """
    edges = checkpointed(edges.filter("a <> b").distinct())
    rounds = []
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(F.struct(F.xxhash64("b"), "b")).alias("m"))
        own = F.struct(F.xxhash64("a"), F.col("a").alias("b"))
        points = checkpointed(ends.select(F.col("a").alias("node"), F.least("m", own)["b"].alias("to")))
        rounds.append(points)
        ends_at = edges.join(points, edges.a == points.node).select(F.col("to").alias("a"), "b")
        ends_at = ends_at.join(points, ends_at.b == points.node).select("a", F.col("to").alias("b"))
        edges = checkpointed(ends_at.filter("a <> b").distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def follow(later: DataFrame, earlier: DataFrame) -> DataFrame:
        then = later.select(F.col("node").alias("to"), F.col("root").alias("_root"))
        return earlier.join(then, "to", "left").select("node", F.coalesce("_root", "to").alias("root"))

    last = rounds[-1].select("node", F.col("to").alias("root"))
    return reduce(follow, reversed(rounds[:-1]), last)
