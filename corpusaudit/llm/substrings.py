"""Removal of long word sequences that already stand in an earlier document.

The words' k-mers (``window`` consecutive words) are the edges of a de Bruijn graph. Edges are never shuffled one by
one: consecutive windows with the same anchor (the least hash among the shorter word runs inside the
window) form a path, and a document is the chain of its paths, about one per twenty words. The anchor
depends on the window's words alone, so a window that repeats has its anchor wherever it stands.

* Anchors found in one document only are dropped: none of their windows repeats.
* Equal paths are compacted: the document with the least id stands for all of them, and in the others the whole path
  repeats, however long it is.
* Where an anchor has different paths, the graph branches. There the standing-in documents' paths, one for each
  different path, are resolved into single windows. Windows of a nonbranching path never are.

Paths and windows are compared by BLAKE2 digests of their words at their source coordinates (document, first word), next
to the anchor; the rolling anchor hash alone decides nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.llm.common import col, discard, field, kept, map_rows
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

#: Words per anchor. Windows of 50 words choose among 35 anchors, one in 18 of which starts a new path.
ANCHOR = 16
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def offsets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in the blank-joined line."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return ends - lengths, ends


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def window_anchors(words: list[bytes], window: int, anchor: int) -> np.ndarray:
    """Anchor hash of every window, by a rolling hash mod 2**64 and a sliding minimum."""
    n = len(words)
    x = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    powers, inverse = (np.full(n, base, np.uint64) for base in (_BASE, _BACK))
    powers[0] = inverse[0] = 1
    powers, inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * inverse, dtype=np.uint64)])
    h = (sums[anchor:] - sums[:-anchor]) * powers[: n - anchor + 1]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return sliding_min(h, window - anchor + 1)


def paths(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Anchor, digest, first window and number of windows of each path of a document."""
    anchors = window_anchors(words, window, anchor)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    count = np.diff(np.append(first, len(anchors)))
    starts, ends = offsets(words)
    line = b" ".join(words)
    spans = zip(starts[first].tolist(), ends[first + count + window - 2].tolist())
    return anchors[first].view(np.int64), [digest(line[a:b]) for a, b in spans], first, count


def repeats(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc, version, spans): windows [pos, pos + n) of documents that also start in one with a smaller id.

    ``docs`` has doc (never null), version (tells rows with one id apart) and text.
    """
    spark = docs.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "version", "anchor", "path", "pos", "n"]
        for batch in batches:
            doc, version = (batch.column(i).to_numpy() for i in (0, 1))
            parts: list[tuple] = []
            for i, value in enumerate(batch.column(2).to_pylist()):
                words = (value or "").encode().split()
                if len(words) >= window:
                    parts.append((i, *paths(words, window, anchor)))
            if parts:
                owner = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                flat = [np.concatenate([np.asarray(p[k]) for p in parts]) for k in (1, 2, 3, 4)]
                columns = [doc[owner], version[owner], *flat]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    shape = T.StructType([field(n, "bigint") for n in ("doc", "version", "anchor", "path", "pos", "n")])
    chain = kept(docs.select("doc", "version", "text").mapInArrow(find, shape), "paths")
    # every distinct path with its least and greatest document, and how its anchor branches
    known = chain.groupBy("anchor", "path").agg(F.min("doc").alias("source"), F.max("doc").alias("_last"))
    forks = known.groupBy("anchor").agg(F.count("*").alias("_paths"), F.min("source").alias("_first"), F.max("_last").alias("_last"))
    forks = forks.filter("_first < _last").select("anchor", (F.col("_paths") > 1).alias("forks"))
    known = known.select("anchor", "path", "source").join(forks, "anchor")
    shared = chain.join(known, ["anchor", "path"]).withColumn("whole", F.col("doc") > F.col("source")).filter("whole OR forks")
    shared = kept(shared.select("doc", "version", "anchor", "pos", "n", "whole"), "shared")
    discard([chain])

    branching = shared.filter("NOT whole").groupBy("doc", "version").agg(F.collect_list(F.struct("anchor", "pos", "n")).alias("spans"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "version", "anchor", "edge", "pos"]
        for batch in batches:
            doc, version = (batch.column(i).to_numpy() for i in (0, 1))
            rows: tuple[list, ...] = ([], [], [], [])
            for i, (value, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                words = value.encode().split()
                starts, ends = offsets(words)
                line, starts, ends = b" ".join(words), starts.tolist(), ends.tolist()
                for s in spans:
                    at = range(s["pos"], s["pos"] + s["n"])
                    rows[0].extend([i] * s["n"])
                    rows[1].extend([s["anchor"]] * s["n"])
                    rows[2].extend([digest(line[starts[p] : ends[p + window - 1]]) for p in at])
                    rows[3].extend(at)
            owner = np.array(rows[0], np.int64)
            columns = [doc[owner], version[owner], *rows[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    shape = T.StructType([field(n, "bigint") for n in ("doc", "version", "anchor", "edge", "pos")])
    edges = docs.join(branching, ["doc", "version"]).select("doc", "version", "text", "spans").mapInArrow(single, shape)
    edges = kept(edges, "edges")
    first = edges.groupBy("anchor", "edge").agg(F.min("doc").alias("source"), F.max("doc").alias("_last")).filter("source < _last")
    # written, so that the join deals out both sides itself and may split a window that many documents hold
    first = kept(first.drop("_last"), "sources")
    later = edges.join(first, ["anchor", "edge"]).filter("doc > source")
    spans = shared.filter("whole").select("doc", "version", "pos", "n")
    spans = spans.union(later.select("doc", "version", "pos", F.lit(1).cast("bigint").alias("n")))
    found = spans.groupBy("doc", "version").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    found = kept(found, "repeats")
    discard([shared, edges, first])
    return found


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, n_removed, kept_text and removed ([start, end) word ranges).

    A word goes when a window of ``window`` words that covers it also starts in a document with a
    smaller key; windows are judged on the input. Kept words are joined by one blank. Null texts have no words. A null
    key is larger than any other and never a source. Rows that share a key are one document to the others and
    none to each other. Documents shorter than the window stay as they are. Very long texts are compared whole; an empty table gives no
    rows; extra columns are not read.
    """
    if window < anchor:
        raise ValueError("the window must hold at least one anchor")
    rows = docs.select(F.coalesce(col(key), F.lit(LAST)).alias("doc"), F.xxhash64(col(text)).alias("version"), col(key).alias("key"), col(text).alias("text"))
    joined = rows.join(repeats(rows, window, anchor), ["doc", "version"], "left").select("key", "text", "spans")
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def start():
        def work(texts, all_spans):
            out: tuple[list, ...] = ([], [], [], [])
            for value, spans in zip(texts, all_spans):
                words = (value or "").encode().split()
                n, removed, gone = len(words), [], 0
                for a, b in sorted((s["pos"], s["pos"] + s["n"] + window - 1) for s in spans or ()):
                    if removed and a <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], b)
                    else:
                        removed.append([a, b])
                left, at = [], 0
                for a, b in [*removed, [n, n]]:
                    left += words[at:a]
                    at = b
                    gone += b - a
                out[0].append(n)
                out[1].append(gone)
                out[2].append(b" ".join(left).decode())
                out[3].append([{"start": a, "end": b} for a, b in removed])
            return [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), ranges))]

        return work

    fields = [field("n_words", "bigint"), field("n_removed", "bigint"), field("kept_text", "string"), field("removed", "array<struct<start:bigint,end:bigint>>")]
    made = map_rows(joined, ["text", "spans"], start, fields)
    return made.select(F.col("row.key").alias(key), *[f.name for f in fields])
