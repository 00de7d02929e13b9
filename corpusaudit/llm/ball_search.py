"""Exact ranked search for whole texts: sparse ball trees over the documents, searched best-first.

The score of a document is an inner product of integers: the occurrences of each term in the query with the term's weight times its
saturated frequency in the document. Documents become sparse vectors over the terms of a bounded block of queries; all other terms
leave every score as it is. Tasks build ball trees over shards of those vectors: a node keeps the centre of its
documents, the radius of the ball around it that holds them, and how far they reach beyond the centre in each term. For a query, a node's
documents score at most query.centre + min(|query| radius, query.reach), rounded up. Subtrees are visited in the order of that bound until
it falls below the k-th best score found; documents in leaves are scored in integers, so rounding decides nothing.

One part of the documents is searched first. Its k-th best scores are a floor below which the trees of all others are cut.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.llm.common import col, discard, kept, plain_words
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

#: Query terms (with repeats) in one block; its vocabulary and queries are what is broadcast.
BLOCK_TERMS = 50_000
#: Documents and vector entries of one tree at most (a longer vector has a tree of its own).
SHARD_ROWS, SHARD_ENTRIES = 4096, 2_000_000
LEAF_ROWS = 32
#: Stands for a missing key while scores are compared.
NO_KEY = 2**63 - 1
#: One document in so many, by the hash of its key, is searched before the others.
SEEDS = 16
#: Share that float bounds are raised by: far above the rounding of the sums they come from.
RAISE = 1e-9


@dataclass
class Node:
    first: int
    end: int
    centre: np.ndarray
    reach: np.ndarray
    radius: float
    children: tuple[Node, Node] | None = None


class BallTree:
    """A tree over sparse vectors of non-negative 64-bit integers (rows of ``starts``, ``terms``, ``values``; none empty)."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.vocabulary, local = np.unique(terms, return_inverse=True)
        self.width = len(self.vocabulary)
        order = np.arange(len(starts) - 1)
        self.starts, self.terms, self.values = starts, local, values
        self.squares = self.row_sums(values.astype(np.float64) ** 2)
        self.leaf_rows = leaf_rows
        # documents are put in the order of the leaves, so that a node is a range of rows
        plan = self.split(order)
        self.order = np.concatenate(list(leaves(plan)))
        lengths = np.diff(starts)[self.order]
        picked = np.repeat(starts[self.order] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.terms, self.values, self.squares = local[picked], values[picked], self.squares[self.order]
        self.root = self.node(plan, 0)

    def row_sums(self, entries: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
        """Sums of the entries of rows first..end; ``entries`` are theirs only. No row is empty."""
        starts = self.starts[first : len(self.starts) - 1 if end is None else end]
        return np.add.reduceat(entries, starts - starts[0])

    def split(self, rows: np.ndarray):
        """Halves of the rows along the line between two far ones, down to leaves: nested pairs of row numbers."""
        if len(rows) <= self.leaf_rows:
            return rows
        far = rows[self.distances(rows, rows[0]).argmax()]
        to_far = self.distances(rows, far)
        other = rows[to_far.argmax()]
        side = to_far - self.distances(rows, other)
        middle = len(rows) // 2
        order = np.argsort(side, kind="stable")
        return self.split(rows[order[:middle]]), self.split(rows[order[middle:]])

    def distances(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        """Squared distances of rows to a row; rounding only moves documents to other leaves."""
        dense = np.zeros(self.width)
        a, b = self.starts[pivot], self.starts[pivot + 1]
        dense[self.terms[a:b]] = self.values[a:b]
        lengths = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(lengths)
        picked = np.repeat(self.starts[rows] - (ends - lengths), lengths) + np.arange(ends[-1])
        inner = np.add.reduceat(dense[self.terms[picked]] * self.values[picked], ends - lengths)
        return self.squares[rows] + self.squares[pivot] - 2 * inner

    def node(self, plan, first: int) -> Node:
        if isinstance(plan, tuple):
            left = self.node(plan[0], first)
            right = self.node(plan[1], left.end)
            end, children = right.end, (left, right)
            n_left, n = left.end - left.first, right.end - first
            centre = left.centre * np.float32(n_left / n) + right.centre * np.float32((n - n_left) / n)
            top = np.maximum(left.centre.astype(np.float64) + left.reach, right.centre.astype(np.float64) + right.reach)
        else:
            end, children = first + len(plan), None
            a, b = self.starts[first], self.starts[end]
            terms, values = self.terms[a:b], self.values[a:b].astype(np.float64)
            centre = (np.bincount(terms, values, self.width) / (end - first)).astype(np.float32)
            top = np.zeros(self.width)
            np.maximum.at(top, terms, values)
        # everything below is measured from the centre as it is stored
        stored = centre.astype(np.float64)
        reach = np.nextafter(np.maximum(top - stored, 0).astype(np.float32), np.float32(np.inf))
        a, b = self.starts[first], self.starts[end]
        inner = self.row_sums(stored[self.terms[a:b]] * self.values[a:b], first, end)
        squares, own = self.squares[first:end], float(stored @ stored)
        radius = np.sqrt(max(0.0, (squares + own - 2 * inner).max()) + RAISE * (squares.max() + own)) * (1 + RAISE)
        return Node(first, end, centre, reach, float(radius), children)

    def search(self, terms: np.ndarray, counts: np.ndarray, k: int, floor: int, keys: np.ndarray, stats: dict | None = None) -> list[tuple[int, int]]:
        """The k best (score, row) with a score above 0 and not below ``floor``; equal scores by ascending ``keys``."""
        at = np.searchsorted(self.vocabulary, terms)
        known = at < self.width
        known[known] = self.vocabulary[at[known]] == terms[known]
        at, counts = at[known], counts[known]
        if not len(at):
            return []
        weights = counts.astype(np.float64)
        norm = float(np.sqrt(weights @ weights))
        query = np.zeros(self.width, np.int64)
        query[at] = counts

        def bound(node: Node) -> float:
            from_centre = float(node.centre[at].astype(np.float64) @ weights)
            return (from_centre + min(norm * node.radius, float(node.reach[at].astype(np.float64) @ weights))) * (1 + RAISE) + 1

        best: list[tuple[int, int, int]] = []
        least = max(1, floor)
        queue, made = [(-bound(self.root), 0, self.root)], 0
        while queue:
            high, _, node = heapq.heappop(queue)
            if -high < least:
                break
            if node.children:
                for child in node.children:
                    above = min(-high, bound(child))
                    if above >= least:
                        made += 1
                        heapq.heappush(queue, (-above, made, child))
                continue
            if stats is not None:
                stats["rows"] = stats.get("rows", 0) + node.end - node.first
            a, b = self.starts[node.first], self.starts[node.end]
            scores = self.row_sums(query[self.terms[a:b]] * self.values[a:b], node.first, node.end)
            for i in np.flatnonzero(scores >= least):
                row = int(self.order[node.first + i])
                entry = (int(scores[i]), -int(keys[row]), row)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    least = max(least, best[0][0])
        return [(score, row) for score, _, row in sorted(best, reverse=True)]


def leaves(plan) -> Iterator[np.ndarray]:
    if isinstance(plan, tuple):
        for part in plan:
            yield from leaves(part)
    else:
        yield plan


def document_vectors(docs: DataFrame, key: str, text: str, terms: Callable[[str], list], vocabulary) -> DataFrame:
    """key, n (all terms), entries (number and occurrences of the terms of ``vocabulary``) of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {t: i for i, t in enumerate(vocabulary.value)}
        for batch in batches:
            ns, ids, tfs, ends, has = [], [], [], [0], []
            for value in batch.column(1):
                found = terms(value.as_py())
                has.append(bool(found))
                if not found:
                    continue
                ns.append(len(found))
                tallies = Counter(filter(numbers.__contains__, found))
                ids.extend(map(numbers.__getitem__, tallies))
                tfs.extend(tallies.values())
                ends.append(len(ids))
            keys = batch.column(0).filter(pa.array(has, pa.bool_()))
            offsets = pa.array(ends, pa.int32())
            arrays = [keys, pa.array(ns, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n", "terms", "tfs"])

    rows = docs.select(col(key).cast("bigint").alias("key"), col(text).alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "key bigint, n bigint, terms array<int>, tfs array<bigint>")


def term_weights(vectors: DataFrame, size: int, documents: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) for every term of a vocabulary: one count per term reaches the driver."""
    df = np.zeros(size, np.int64)
    found = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df[found["term"].to_numpy()] = found["count"].to_numpy()
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """keys, n, starts, terms, tfs of consecutive rows, bounded in rows and entries."""
    held, rows, entries = [], 0, 0

    def joined(parts):
        keys, ns, lengths, terms, tfs = map(np.concatenate, zip(*parts))
        return keys, ns, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), terms, tfs

    for batch in batches:
        keys = batch.column(0).fill_null(NO_KEY).to_numpy()
        ns = batch.column(1).to_numpy()
        lengths = batch.column(2).value_lengths().to_numpy()
        terms, tfs = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        first = 0
        while first < len(keys):
            fits = int(np.searchsorted(ends, ends[first] + SHARD_ENTRIES - entries, "right")) - 1
            end = min(len(keys), first + SHARD_ROWS - rows, max(fits, first))
            if end == first and not held:
                end = first + 1
            if end > first:
                held.append((keys[first:end], ns[first:end], lengths[first:end], terms[ends[first] : ends[end]], tfs[ends[first] : ends[end]]))
                rows, entries = rows + end - first, entries + int(ends[end] - ends[first])
            first = end
            if first < len(keys):
                yield joined(held)
                held, rows, entries = [], 0, 0
    if held:
        yield joined(held)


def search_shards(vectors: DataFrame, block, weights: np.ndarray, documents: int, length: int, k: int, floors: dict[int, int]) -> DataFrame:
    """(query, part, key, score): the k best of every shard of the partitions of ``vectors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ns, starts, terms, tfs in shards(batches):
            m = 100 - 75 + 75 * ns * documents // length
            values = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, np.diff(starts))))
            tree = BallTree(starts, terms, values)
            found = [(q, int(keys[row]), score) for q, ids, counts in block.value for score, row in tree.search(ids, counts, k, floors.get(q, 0), keys)]
            columns = list(zip(*found)) if found else [(), (), ()]
            arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "key", "score"])

    found = vectors.mapInArrow(run, "query int, key bigint, score bigint")
    return found.select("query", F.spark_partition_id().alias("part"), "key", "score")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query with their rank: first within 64 groups of parts, so that no query's rows meet in one task unreduced."""
    order = [F.desc("score"), F.asc("key")]
    some = Window.partitionBy("query", F.pmod("part", F.lit(64))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("rank")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).drop("part")


def ranked(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    terms: Callable[[str], list] = plain_words,
    block_terms: int = BLOCK_TERMS,
    seeds: int = SEEDS,
) -> DataFrame:
    """The k best documents of every item with a score above 0: item, rank (from 1), key, score.

    N counts the documents with a term, L all their terms. A term that df documents hold weighs floor(1000 ln((2N+2)/(2df+1))); one that a
    document of n terms holds tf times adds weight * (10^9 tf div (1000 tf + 8m)), m = 25 + (75 n N) div L, for each time it stands
    in the item. Equal scores go by ascending key.

    Keys are integers; a document without one ranks behind equal scores. Null and empty texts have no terms, as
    documents and as items; repeated document rows are documents of their own; a repeated (item, text) counts once. Very long texts are read
    whole. Without documents, or without items, there are no rows. Extra columns are not read.

    Items are searched in blocks of about ``block_terms`` terms of distinct texts, one pass over the documents each; a block is collected and
    broadcast. Only an item longer than a block makes a larger one.
    """
    items = queries.select(col(item).alias("item"), col(item_text).alias("text")).filter("text IS NOT NULL")
    texts = items.select("text").distinct()
    # every term takes a character and a separator
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 2
    blocks = max(1, -(-total // block_terms))
    results = None
    for number in range(blocks):
        part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number) if blocks > 1 else texts
        found = search_block(docs, sorted(r["text"] for r in part.collect()), k, key, text, terms, seeds)
        results = found if results is None else results.union(found)
    return items.distinct().join(results, "text").select(F.col("item").alias(item), "rank", F.nullif("key", F.lit(NO_KEY)).alias(key), "score")


def search_block(docs: DataFrame, texts: list[str], k: int, key: str, text: str, terms: Callable[[str], list], seeds: int) -> DataFrame:
    """(text, rank, key, score) for the texts of one block."""
    spark = docs.sparkSession
    tallies = [Counter(terms(t)) for t in texts]
    vocabulary = sorted(set().union(*tallies))
    numbers = {t: i for i, t in enumerate(vocabulary)}
    vectors = kept(document_vectors(docs, key, text, terms, spark.sparkContext.broadcast(vocabulary)), "vectors")
    counted = vectors.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    named = spark.createDataFrame(list(enumerate(texts)), "query int, text string")
    weights = term_weights(vectors, len(vocabulary), counted["documents"]) if counted["documents"] else np.zeros(len(vocabulary), np.int64)
    asked = []
    for q, tally in enumerate(tallies):
        ids = np.array(sorted(numbers[t] for t in tally), np.int64)
        asked.append((q, ids, np.array([tally[vocabulary[i]] for i in ids], np.int64)))
    block = spark.sparkContext.broadcast(asked)
    # by rows, not by partitions: a table may be cut up differently when it is read again
    seed = F.pmod(F.xxhash64("key"), F.lit(seeds)) == 0
    holding = vectors.filter(F.size("terms") > 0)

    def search(rows, floors):
        return search_shards(rows, block, weights, counted["documents"], max(1, counted["terms"]), k, floors)

    seeded = kept(best_of(search(holding.filter(seed), {}), k), "seeds")
    # one number per text of the block
    floors = {r["query"]: r["score"] for r in seeded.filter(F.col("rank") == k).select("query", "score").collect()}
    rest = kept(search(holding.filter(~seed), floors), "found")
    best = kept(best_of(rest.unionByName(seeded.select("query", F.lit(-1).alias("part"), "key", "score")), k), "best")
    discard([vectors, seeded, rest])
    return best.join(F.broadcast(named), "query").select("text", "rank", "key", "score")
