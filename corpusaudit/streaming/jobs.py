"""Continuous versions of the counting and bookkeeping jobs.

Restart positions and state live in the stream checkpoint; state lies in RocksDB stores dealt by key, so a batch touches the
keys it brings and no history. Totals are kept as a table of increments (one folder per batch, overwritten
when a batch is repeated), so a lost executor or a repeated batch never counts twice; readers add the increments up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusaudit.functions import dates
from corpusaudit.operators import domains
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(
    spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def use_state_store(spark: SparkSession) -> None:
    """Keep stream state in RocksDB instead of the heap; a query that has started stays with its own store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _start(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool, mode: str = "append"
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def domain_token_stream(
    pages: DataFrame, body: Column, domain: Column, out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Token and page counts per domain, one increment per batch under ``out/batch=<id>``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        counts = domains.domain_tokens(batch, body, domain)
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(pages, step, checkpoint, once)


def domain_token_totals(spark: SparkSession, out: str) -> DataFrame:
    """Current totals: the sum over the increments."""
    return known_table(spark, out, "domain string, tokens bigint, pages bigint, batch int").groupBy("domain").agg(
        F.sum("tokens").alias("tokens"), F.sum("pages").alias("pages")
    )


def without_repeats(
    snapshots: DataFrame, ts: str, digest: str, frequency: str = "daily", delay: str = "1 day"
) -> DataFrame:
    """First arrival of each (URL, interval, digest); state is dropped behind the watermark."""
    keyed = snapshots.withColumn("interval", dates.interval_key(F.col(ts), frequency))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url", "interval", digest])


def daily_changes(snapshots: DataFrame, ts: str, digest: str, delay: str = "1 day") -> DataFrame:
    """(url, day, changes): distinct contents per closed day, in append mode.

    Two chained stateful aggregates over event-time windows: contents are made distinct per day first, then counted, so no group
    holds a set. A day is closed, and its count final, once the watermark (latest time seen in earlier
    batches, less ``delay``) has reached its end; a row of a closed day is late and dropped.
    """
    day = F.window(ts, "1 day")
    distinct = snapshots.withWatermark(ts, delay).groupBy("url", day.alias("day"), digest).agg(
        F.count("*").alias("n")
    )
    counted = distinct.groupBy("url", F.window("day", "1 day").alias("day")).agg(F.count("*").alias("changes"))
    return counted.select("url", F.to_date("day.start").alias("day"), "changes")


def closed_day_stream(
    snapshots: DataFrame, ts: str, digest: str, out: str, checkpoint: str, delay: str = "1 day", once: bool = True
) -> StreamingQuery:
    """Write :func:`daily_changes` to ``out``: every closed day exactly once."""
    use_state_store(snapshots.sparkSession)
    rows = daily_changes(snapshots, ts, digest, delay)
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def daily_change_stream(
    snapshots: DataFrame, ts: str, digest: str, out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Distinct (URL, day, content) of every batch; :func:`daily_change_totals` counts over all batches.

    Nothing waits for a watermark, so late snapshots count and the last days are there at any time.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("url", F.to_date(ts).alias("day"), digest).distinct()
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(snapshots, step, checkpoint, once)


def daily_change_totals(spark: SparkSession, out: str, digest: str) -> DataFrame:
    """(url, day, changes) so far; ``digest`` is the content column with its type."""
    rows = known_table(spark, out, f"url string, day date, {digest}, batch int").drop("batch").distinct()
    return rows.groupBy("url", "day").agg(F.count("*").alias("changes"))


def known_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table whose folder may not exist or hold no file yet. Any other fault is an error."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(files):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class FirstOfKey(StatefulProcessor):
    """Let the first row of a key through: of its first batch the least by ``order``. Known keys stay silent."""

    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "known boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((False,))
            yield min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order])

    def handleInitialState(self, key, row: Row, timers) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def new_only_stream(
    incoming: DataFrame,
    known: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    work: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    once: bool = True,
) -> StreamingQuery:
    """Apply ``work`` once to the first row of every key that is not in ``known``; results go to ``out/batch=<n>``.

    Seen keys are a value per key in the state store, filled from ``known`` when the stream first starts. A batch looks its own keys
    up there: neither ``known`` nor earlier results are read again. A repeated batch starts from the state before it
    and replaces its own results.
    """
    use_state_store(incoming.sparkSession)
    start = known.select(*keys).distinct().groupBy(*keys)
    fresh = incoming.groupBy(*keys).transformWithState(FirstOfKey(order), incoming.schema, "append", "none", initialState=start)

    def step(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(fresh, step, checkpoint, once)


def latest_status_stream(
    snapshots: DataFrame, changes: str, checkpoint: str, ts: str = "ts", once: bool = True
) -> StreamingQuery:
    """Keep the status of the latest snapshot per (URL, agent) as keyed state.

    The state is one (time, status) per key, which only a later time replaces (of equal times the last status in sort order), so
    snapshots may come in any order; keys without a time give way to any with one. Of each batch the keys it touched go to
    ``changes/batch=<n>`` with their status after it; :func:`latest_status_table` reads the whole state.
    """
    use_state_store(snapshots.sparkSession)
    last = snapshots.groupBy("url", "agent").agg(F.max(F.struct(F.col(ts).alias("ts"), "status")).alias("last"))

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("url", "agent", "last.status", F.col("last.ts").alias(ts))
        rows.write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")

    return _start(last, step, checkpoint, once, "update")


def latest_status_table(spark: SparkSession, checkpoint: str, ts: str = "ts") -> DataFrame:
    """(url, agent, status, time) of every key, read from the state store: the work grows with the keys, not with the batches."""
    state = spark.read.format("statestore").load(checkpoint)
    last = F.col("value").getField(state.schema["value"].dataType.fieldNames()[0])
    return state.select("key.url", "key.agent", last["status"].alias("status"), last["ts"].alias(ts))


def privacy_stream(
    pages: DataFrame, group: str, privacy: Column, out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Keep what decides about privacy pages, whatever batch a group's pages come in.

    Per batch: all pages with a flag (``out``), written as they come. :func:`without_privacy_pages` resolves on reading.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_privacy", privacy).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(pages, step, checkpoint, once)


def without_privacy_pages(spark: SparkSession, out: str, schema: str, group: str) -> DataFrame:
    """Pages so far, without the privacy pages of groups that have other pages."""
    pages = known_table(spark, out, f"{schema}, _privacy boolean, batch int").drop("batch")
    others = pages.filter("NOT _privacy").select(group).distinct()
    private = pages.filter("_privacy").join(others, group, "left_anti")
    return pages.filter("NOT _privacy").unionByName(private).drop("_privacy")
