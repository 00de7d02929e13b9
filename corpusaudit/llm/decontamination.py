"""Benchmark passages in documents: Wu-Manber search for many patterns, with words as symbols.

Patterns are the benchmark items' windows of ``window`` consecutive words (shorter items whole). A shift table over
blocks of two words says how far the search may jump; a block that ends a window leads to a bucket, divided
by the window's first block; the windows there are compared word for word.

Items reach the tasks as broadcast blocks of a bounded number of words. The documents are read once, whatever the size of the benchmark:
a task searches a batch of texts for one block after the other and holds the tables of one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import col, field, map_rows, plain_words
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

#: Words of benchmark text in one broadcast block: some 100 MB of tables in a Python worker.
BLOCK_WORDS = 200_000


class WuManber:
    """Search for word sequences of one common length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set], length: int):
        self.length = length
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self.key(pattern, end - 1)
                self.shift[key] = min(self.shift.get(key, self.furthest), length - end)
            heads = self.buckets.setdefault(self.key(pattern, length - 1), {})
            heads.setdefault(pattern[: self.block], []).append((pattern, items))

    def key(self, words, last: int):
        return words[last] if self.block == 1 else (words[last - 1], words[last])

    def occurrences(self, words: list[bytes]) -> Iterable[tuple[int, set]]:
        """(first word, items) of every place where a pattern stands."""
        last, n, shift, furthest, length = self.length - 1, len(words), self.shift, self.furthest, self.length
        single = self.block == 1
        while last < n:
            key = words[last] if single else (words[last - 1], words[last])
            jump = shift.get(key, furthest)
            if jump:
                last += jump
                continue
            first = last - length + 1
            for pattern, items in self.buckets[key].get(tuple(words[first : first + self.block]), ()):
                if tuple(words[first : last + 1]) == pattern:
                    yield first, items
            last += 1


def searchers(items: list[tuple], window: int) -> list[WuManber]:
    """One search per pattern length: ``window``, and each length of a shorter item."""
    by_length: dict[int, dict] = {}
    for item, text in items:
        words = plain_words(text or "")
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            by_length.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set()).add(item)
    return [WuManber(p, n) for n, p in sorted(by_length.items())]


def let_go(block) -> list[tuple]:
    """The rows of a broadcast block; the worker does not keep them, as it would every value it has opened."""
    rows = block.value
    vars(block).pop("_value", None)
    return rows


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every document row (struct ``row``) with n_words, hits and items.

    ``hits`` are the merged [start, end) word ranges inside an occurrence of a window, ``items`` the distinct
    ids of the items with an occurring window. Null texts have no words; an item without an id marks words but
    is not listed; items without words match nothing; without items nothing is hit. Rows stay rows,
    repeated ones too; very long texts are searched whole; an empty table gives no rows.

    Items are dealt to blocks of about ``block_words`` words, by the hash of item and text; each block is collected and broadcast, and lies
    on the workers' disks until its turn. Only an item longer than a block makes a larger one.
    """
    spark = docs.sparkSession
    wanted = benchmark.select(col(item).alias("item"), col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    # an upper bound: every word takes at least one character and a separator
    total = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 2
    number = max(1, -(-total // block_words))
    # dealt by item and text, so that copies of one text do not pile up in a block
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(number)))
    blocks = []
    for at in range(number):
        rows = dealt.filter(F.col("block") == at).select("item", "text").collect()
        blocks.append(spark.sparkContext.broadcast([(r["item"], r["text"]) for r in rows]))
    arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    arrow_items = pa.list_(pa.from_numpy_dtype("int64") if dict(benchmark.dtypes)[item] != "string" else pa.string())
    item_kind = "string" if dict(benchmark.dtypes)[item] == "string" else "bigint"
    fields = [field("n_words", "bigint"), field("hits", "array<struct<start:bigint,end:bigint>>"), field("items", f"array<{item_kind}>")]

    def start():
        only = searchers(blocks[0].value, window) if len(blocks) == 1 else None

        def work(texts):
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            counts = [0] * len(texts)
            for block in blocks:
                tables = only if only is not None else searchers(let_go(block), window)
                for i, value in enumerate(texts):
                    words = plain_words(value or "")
                    counts[i] = len(words)
                    for table in tables:
                        for first, of in table.occurrences(words):
                            spans[i].append((first, first + table.length))
                            items[i] |= of
            hits = [[{"start": a, "end": b} for a, b in merged(s)] for s in spans]
            found = [sorted(i - {None}) for i in items]
            return [pa.array(counts, pa.int64()), pa.array(hits, arrow_spans), pa.array(found, arrow_items)]

        return work

    return map_rows(docs, [text], start, fields)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = 10) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_passages(docs.select(col(key), col("text")), benchmark, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("row").getField(key).alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    return find_passages(docs, benchmark, window).filter(F.size("hits") == 0).select("row.*")
