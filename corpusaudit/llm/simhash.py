"""Near-duplicate groups by SimHash: fingerprints, links at a small Hamming distance, components.

Links come from binary trie self-joins. Two fingerprints that differ in at most two of 64 bits agree in
one of three thirds of their bits, so each fingerprint goes into three tries that start with one third; in
one of them the pair walks down that third without an error. The third is the shuffle key; below it a task
traverses pairs of trie nodes together, adds up differing bits, and drops a pair of nodes as soon as the
budget is exceeded. A trie whose key is too common is split first: its rows are dealt again by the pairs of next-level
nodes that are still within the budget, as often as it takes.

Only distinct fingerprints enter, and a task returns the links of a spanning forest of what it found, so large
groups of copies or near copies cost no quadratic output and no connection is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.llm.common import checkpointed, col, components, field, kept, map_rows, packed, spaced_words
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

SEED = 42
#: Fixed split of the 64 bits: where each rotation starts and how many bits lead.
THIRDS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints in one trie beyond which it is split over tasks.
TRIE_LIMIT = 50_000
STEP = 6
CHUNK = 1 << 19


def fingerprint(text: str, size: int = 3) -> int:
    """Bit b is set when more than half of the shingle hashes have it; 0 for a text without words."""
    words = spaced_words(text)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < size:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - size + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    majority = counts * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint (bigint, two's complement) of every row; null texts have none of the words."""

    def start():
        return lambda texts: [pa.array(np.array([fingerprint(t or "") for t in texts], np.uint64).view(np.int64), pa.int64())]

    made = map_rows(docs.select(col(key), col(text)), [text], start, [field("fp", "bigint")])
    return made.select(F.col("row").getField(key).alias(key), "fp")


def node_pairs(values: np.ndarray, groups: tuple[np.ndarray, ...], first_bit: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matching positions (i, j) among sorted 64-bit ``values``.

    ``groups``: arrays (a_lo, a_hi, b_lo, b_hi, errors) of node pairs, nodes being ranges of ``values`` that share
    the bits before ``first_bit``; a node paired with itself means all pairs inside it.
    """
    ones: dict[int, np.ndarray] = {}

    def before(bit: int) -> np.ndarray:
        if bit not in ones:
            flags = (values >> np.uint64(63 - bit)) & np.uint64(1)
            ones[bit] = np.concatenate([[0], np.cumsum(flags.astype(np.int64))])
        return ones[bit]

    waiting = [(first_bit, groups)]
    while waiting:
        bit, (alo, ahi, blo, bhi, err) = waiting.pop()
        if len(alo) > CHUNK:
            half = len(alo) // 2
            waiting.append((bit, tuple(x[half:] for x in (alo, ahi, blo, bhi, err))))
            alo, ahi, blo, bhi, err = (x[:half] for x in (alo, ahi, blo, bhi, err))
            waiting.append((bit, (alo, ahi, blo, bhi, err)))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if bit == 64:
            single[:] = True
        if single.any():
            i, j = alo[single], blo[single]
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            rest = ~single
            alo, ahi, blo, bhi, err = (x[rest] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        count = before(bit)
        amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        same = (alo == blo) & (ahi == bhi)
        children = [
            (alo, amid, blo, bmid, err, None),
            (amid, ahi, bmid, bhi, err, None),
            (alo, amid, bmid, bhi, err + 1, None),
            (amid, ahi, blo, bmid, err + 1, ~same),
        ]
        parts = []
        for al, ah, bl, bh, e, also in children:
            ok = (ah > al) & (bh > bl) & (e <= budget) & ~((al == bl) & (ah - al == 1))
            if also is not None:
                ok &= also
            parts.append(tuple(x[ok] for x in (al, ah, bl, bh, e)))
        nxt = tuple(np.concatenate(x) for x in zip(*parts))
        if len(nxt[0]):
            waiting.append((bit + 1, nxt))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of ``n`` positions after joining all pairs."""
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs:
        while (up := parent[parent]).tolist() != parent.tolist() if n < 64 else not np.array_equal(up := parent[parent], parent):
            parent = up
        apart = parent[i] != parent[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def tries(prints: DataFrame, budget: int, limit: int) -> DataFrame:
    """Rows (trie, bit, side, errors, turn, value) of distinct fingerprints ``fp``, no trie much over ``limit``.

    ``limit`` must be at least 64. ``value`` is the fingerprint rotated left by ``turn``; bits before ``bit`` are shared within a side. Side 0: all pairs
    within; sides 1 and 2: pairs across, ``errors`` bits being different already.
    """
    rows = []
    for turn, lead in THIRDS:
        value = F.expr(f"shiftleft(fp, {turn}) | shiftrightunsigned(fp, {64 - turn})") if turn else F.col("fp")
        key = F.concat(F.lit(f"{turn}:"), F.shiftrightunsigned(value, 64 - lead).cast("string"))
        rows.append(prints.select(key.alias("trie"), F.lit(lead).alias("bit"), F.lit(0).alias("side"), F.lit(0).alias("errors"), F.lit(turn).alias("turn"), value.alias("value")))
    table = rows[0].union(rows[1]).union(rows[2])
    masks = [m for m in range(1 << STEP) if m.bit_count() <= budget]
    small = None
    while True:
        sizes = table.groupBy("trie").agg(F.count("*").alias("_n")).filter((F.col("_n") > limit)).select("trie", F.lit(True).alias("_large"))
        sizes = checkpointed(sizes)
        if sizes.isEmpty():
            return table if small is None else small.union(table)
        marked = table.join(sizes, "trie", "left")
        done = marked.filter("_large IS NULL").drop("_large")
        small = done if small is None else small.union(done)
        own = F.expr(f"shiftrightunsigned(value, 64 - bit - {STEP}) & {(1 << STEP) - 1}").cast("int")
        # a side that shares 59 bits or more has at most 32 fingerprints and is never too large
        large = marked.filter(f"_large AND bit + {STEP} <= 64").withColumn("_own", own).withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in masks])))
        large = large.withColumn("_other", F.col("_own").bitwiseXOR(F.col("_mask"))).withColumn("_errors", F.col("errors") + F.bit_count("_mask"))
        large = large.filter(F.col("_errors") <= budget)
        left = F.when(F.col("side") == 0, F.least("_own", "_other")).when(F.col("side") == 1, F.col("_own")).otherwise(F.col("_other"))
        side = (
            F.when((F.col("side") == 0) & (F.col("_mask") == 0), F.lit(0))
            .when(F.col("side") == 0, F.when(F.col("_own") < F.col("_other"), 1).otherwise(2))
            .otherwise(F.col("side"))
        )
        table = checkpointed(
            large.select(
                F.concat_ws("/", "trie", left.cast("string"), F.col("_mask").cast("string")).alias("trie"),
                (F.col("bit") + STEP).alias("bit"),
                side.alias("side"),
                F.col("_errors").alias("errors"),
                "turn",
                "value",
            )
        )


def links(prints: DataFrame, budget: int = 2, limit: int = TRIE_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints: a spanning forest of each trie's near pairs."""
    rows = tries(prints, budget, limit).repartition("trie").sortWithinPartitions("trie", "side", "value")

    def solve(trie: np.ndarray, bit, side, errors, turn, value) -> tuple[np.ndarray, np.ndarray]:
        values = value.view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], (trie[1:] != trie[:-1]) | (side[1:] != side[:-1])]))
        lo, hi = edge, np.append(edge[1:], len(values))
        sides = side[lo]
        inner = sides == 0
        alo, ahi, blo, bhi = [lo[inner]], [hi[inner]], [lo[inner]], [hi[inner]]
        left = np.flatnonzero((sides[:-1] == 1) & (sides[1:] == 2) & (trie[lo[:-1]] == trie[lo[1:]]))
        alo.append(lo[left]), ahi.append(hi[left]), blo.append(lo[left + 1]), bhi.append(hi[left + 1])
        cols = [np.concatenate(x) for x in (alo, ahi, blo, bhi)]
        depth, spent = bit[cols[0]], errors[cols[0]]
        wide = (cols[0] != cols[2]) | (cols[1] - cols[0] > 1)

        def all_pairs():
            for first in np.unique(depth[wide]):
                at = wide & (depth == first)
                yield from node_pairs(values, (*[c[at] for c in cols], spent[at]), int(first), budget)

        roots = forest(len(values), all_pairs())
        child = np.flatnonzero(roots != np.arange(len(values)))
        shift = turn.astype(np.uint64)

        def original(at):
            v, s = values[at], shift[at]
            return np.where(s == 0, v, (v >> s) | (v << ((np.uint64(64) - s) % np.uint64(64)))).view(np.int64)

        return original(child), original(roots[child])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table):
            columns = [table.column(i).to_numpy() for i in range(6)]
            a, b = solve(columns[0].astype(str), *columns[1:])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(0)[batch.num_rows - 1].as_py()
            names = batch.column(0)
            whole = int(pa.compute.index(names, last).as_py())  # rows of tries that end in this batch
            if held[0].column(0)[0].as_py() != last and sum(b.num_rows for b in held) >= 10_000:
                table = pa.Table.from_batches([*held[:-1], batch.slice(0, whole)] if whole else held[:-1])
                if table.num_rows and table.column(0)[table.num_rows - 1].as_py() != last:
                    yield out(table)
                    held = [batch.slice(whole)]
        if held:
            yield out(pa.Table.from_batches(held))

    return rows.mapInArrow(run, T.StructType([field("a", "bigint"), field("b", "bigint")]))


def classes(prints: DataFrame, budget: int) -> DataFrame:
    """Every distinct fingerprint ``fp`` with the ``root`` of its component."""
    distinct = prints.select("fp").distinct()
    roots = components(links(distinct, budget)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 2) -> DataFrame:
    """One row per document row: key, fingerprint (16 hex digits), component_id.

    component_id is the smallest key reachable over links of at most ``budget`` (0 to 2) differing bits; null
    keys are never the smallest unless a component has no other. Texts without words share
    fingerprint zero and are linked like any other. Repeated rows come back as often as they occur. Null texts have no words; very long
    texts are read whole; an empty table gives no rows; extra columns are not read.
    """
    prints = kept(fingerprints(docs, key, text), "fingerprints")
    least = prints.groupBy("fp").agg(F.min(key).alias("_least")).join(classes(prints, budget), "fp")
    smallest = least.groupBy("root").agg(F.min("_least").alias("component_id"))
    of = least.join(smallest, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of, "fp").select(key, hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 2) -> DataFrame:
    """The rows that stay, with the columns of ``docs``: of each component the row with the smallest key.

    A row without a key stays only when no row of its component has one. Among rows with that key in
    one component the text with the least hash stays, and one row of those that repeat it.
    """
    named = packed(docs).select("row", col("row").getField(key).alias("key"), F.xxhash64(col("row").getField(text)).alias("version"))
    prints = fingerprints(named.select(F.struct("key", "version").alias("id"), col("row").getField(text).alias("text")), "id", "text")
    prints = kept(prints.select("id.key", "id.version", "fp"), "fingerprints")
    order = F.struct(F.col("key").isNull().alias("last"), "key", "version")
    least = prints.groupBy("fp").agg(F.min(order).alias("_least")).join(classes(prints, budget), "fp")
    first = least.groupBy("root").agg(F.min("_least").alias("_least")).select("_least.key", "_least.version")
    same = named["key"].eqNullSafe(first["key"]) & (named["version"] == first["version"])
    stay = named.join(first, same, "left_semi").dropDuplicates(["key", "version"])
    return stay.select("row.*")
