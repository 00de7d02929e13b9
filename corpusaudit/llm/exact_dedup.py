"""Exact deduplication of whole texts by Grace hashing.

Each scan task first merges the copies it meets, so a text held by a third of all rows reaches the shuffle
once per task. Texts are then dealt by hash; a task fills an open-addressing table that compares complete
texts. When the table is full, texts it does not hold go to spill files, split by another hash, and every
file is treated in the same way in turn. The table takes at least one text per level, so this ends for any
input; copies of one text never add to the table.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.llm.common import col
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

TABLE_BYTES = 96 << 20
FANOUT = 16


class OpenTable:
    """Open addressing with linear probing; a slot holds the number of an entry, -1 if it is free."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[str] = []
        self.counts: list[int] = []
        self.best: list[tuple] = []
        self.bytes = 0

    def find(self, digest: int, text: str) -> tuple[int, int]:
        """(entry or -1, slot)."""
        mask = len(self.slots) - 1
        slot = digest & mask
        while (entry := self.slots[slot]) >= 0:
            if self.hashes[entry] == digest and self.texts[entry] == text:
                return entry, slot
            slot = (slot + 1) & mask
        return -1, slot

    def merge(self, entry: int, count: int, best: tuple) -> None:
        self.counts[entry] += count
        if better(best, self.best[entry]):
            self.best[entry] = best

    def add(self, slot: int, digest: int, text: str, count: int, best: tuple) -> None:
        self.slots[slot] = len(self.texts)
        self.hashes.append(digest)
        self.texts.append(text)
        self.counts.append(count)
        self.best.append(best)
        self.bytes += len(text) * 2 + 400
        if len(self.texts) * 2 > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for entry, h in enumerate(self.hashes):
                slot = h & mask
                while self.slots[slot] >= 0:
                    slot = (slot + 1) & mask
                self.slots[slot] = entry

    def rows(self) -> Iterator[tuple[str, int, tuple]]:
        return zip(self.texts, self.counts, self.best)


def better(a: tuple, b: tuple) -> bool:
    """Is row a (id, other columns) the one to keep? Largest id, null least; then the columns as text."""
    if a[0] != b[0]:
        return b[0] is None or (a[0] is not None and a[0] > b[0])
    return a[1] != b[1] and repr(a[1]) > repr(b[1])


def spill_folder() -> str | None:
    """Where Spark lets this worker spill; files are unlinked at once and vanish with the task."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


def read_back(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def grace(records: Iterable[tuple[str, int, tuple]], limit: int = TABLE_BYTES, fanout: int = FANOUT) -> Iterator[tuple]:
    """Merge (text, count, best row) records of equal texts with at most about ``limit`` bytes in memory."""
    waiting = [(0, records)]
    while waiting:
        level, source = waiting.pop()
        table, files = OpenTable(), {}
        for text, count, best in source:
            digest = xxhash.xxh64_intdigest(text.encode(), level)
            entry, slot = table.find(digest, text)
            if entry >= 0:
                table.merge(entry, count, best)
            elif table.bytes < limit or not table.texts:
                table.add(slot, digest, text, count, best)
            else:
                part = (digest >> 40) % fanout
                if part not in files:
                    files[part] = tempfile.TemporaryFile(dir=spill_folder())
                pickle.dump((text, count, best), files[part], protocol=5)
        yield from table.rows()
        del table
        waiting += [(level + 1, read_back(f)) for f in files.values()]


def local_merge(records: Iterable[tuple[str, int, tuple]], limit: int) -> Iterator[tuple]:
    """Merge what fits in memory, hand it on, start again: the combining step before a shuffle."""
    table = OpenTable()
    for text, count, best in records:
        digest = xxhash.xxh64_intdigest(text.encode())
        entry, slot = table.find(digest, text)
        if entry >= 0:
            table.merge(entry, count, best)
            continue
        table.add(slot, digest, text, count, best)
        if table.bytes >= limit:
            yield from table.rows()
            table = OpenTable()
    yield from table.rows()


def distinct_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct text: text, copies, keep_id and ``rest`` (the other columns of the kept row).

    The kept row has the largest key; null keys come last, and among rows with the same key and text the one
    whose other columns are largest when printed stays. A null text equals the empty text; the text of
    the result is empty then and ``was_null`` tells whether the kept row had none.
    """
    others = [c for c in docs.columns if c not in (key, text)]
    rest = F.struct(col(text).isNull().alias("was_null"), *[col(c).alias(f"c_{i}") for i, c in enumerate(others)])
    shaped = docs.select(F.coalesce(col(text), F.lit("")).alias("text"), F.lit(1).cast("bigint").alias("copies"), col(key).alias("keep_id"), rest.alias("rest"))
    shape = shaped.schema

    def through(merge, limit):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types: list[pa.Schema] = []

            def records():
                for batch in batches:
                    types[:] = [batch.schema]
                    rows = zip(*[c.to_pylist() for c in batch.columns])
                    yield from ((t, n, (k, r)) for t, n, k, r in rows)

            def out(rows):
                schema = types[0]
                columns = [[t for t, _, _ in rows], [n for _, n, _ in rows], [b[0] for *_, b in rows], [b[1] for *_, b in rows]]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names)

            chunk, size = [], 0
            for row in merge(records(), limit):
                chunk.append(row)
                size += len(row[0])
                if size > 8 << 20 or len(chunk) >= 10_000:
                    yield out(chunk)
                    chunk, size = [], 0
            if chunk:
                yield out(chunk)

        return run

    combined = shaped.mapInArrow(through(local_merge, table_bytes // 2), shape)
    dealt = combined.repartition(F.xxhash64("text"))
    merged = dealt.mapInArrow(through(grace, table_bytes), shape)
    return merged


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``: one of each group of equal texts."""
    found = distinct_texts(docs, key, text)
    others = [c for c in docs.columns if c not in (key, text)]
    back = {
        key: F.col("keep_id"),
        text: F.when(F.col("rest.was_null"), F.lit(None)).otherwise(F.col("text")),
        **{c: F.col(f"rest.c_{i}") for i, c in enumerate(others)},
    }
    return found.select(*[back[c].alias(c) for c in docs.columns])


def copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Rows with the same key and text (repeated rows) are listed as often as they occur and one of them is kept.
    The groups come from the comparison of complete texts, however long; rows are told their group by SHA-256. Null texts count as empty ones;
    a null key is kept only where a group has no other; an empty table gives no rows; extra columns are not read.
    """
    groups = distinct_texts(docs.select(col(key), col(text)), key, text)
    light = groups.select(F.sha2("text", 256).alias("text_sha256"), "keep_id", F.col("copies").alias("group_size"))
    rows = docs.select(col(key).alias(key), F.sha2(F.coalesce(col(text), F.lit("")), 256).alias("text_sha256"))
    counted = rows.groupBy(key, "text_sha256").agg(F.count("*").alias("_n"))
    joined = counted.join(light, "text_sha256")
    listed = joined.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_i"))
    kept_row = F.col(key).eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)
    return listed.select(key, "keep_id", "group_size", kept_row.alias("kept"), "text_sha256")
