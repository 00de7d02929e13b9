"""Spelling variants of the words of a corpus: a bit-sliced position index searched with at most one error.

Words are counted, and each word of the vocabulary looks for all words that differ by one inserted, deleted or replaced
letter. The index of a block of words has one bitset per (position, letter): the words with that letter at
that place. A search goes through the letters of a word once and carries four sets, each updated for all words of the block by
a few word-parallel operations: no error so far; one letter replaced; one letter more than the query, where the
index is read one position ahead; one letter fewer, where it is read one position behind.

Spark deals the vocabulary to groups in which near words must meet. Of two near words let a be the shorter length and h its half:
if the error lies behind the first h letters, both words start with the same h letters, else they end with the same a - h.
Every word joins the groups of its own length and of the length below. Pairs with equal starts are reported by the group of their start alone, so
each pair counts once. A group above a limit becomes a grid of cells, every part of it against every other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import col, discard, kept
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

#: One byte per code point: A-Z in lower case, a-z and U+00C0 to U+00FF as they are, everything else a blank.
RUN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
#: Characters of a text that are counted at a time (a run of letters is never cut).
SLICE = 1 << 20
#: Distinct words a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: Words in one cell of a group: some megabytes of bitsets.
CELL_WORDS = 20_000


def slices(text: str) -> Iterator[bytes]:
    """The text in RUN_BYTES, whole if short, else cut at blanks."""
    if len(text) <= SLICE:
        yield text.encode("latin-1", "replace").translate(RUN_BYTES)
        return
    rest = b""
    for at in range(0, len(text), SLICE):
        part = text[at : at + SLICE].encode("latin-1", "replace").translate(RUN_BYTES)
        cut = part.rfind(b" ")
        if cut < 0:
            rest += part
            continue
        yield rest + part[:cut]
        rest = part[cut:]
    yield rest


def document_words(key: object, text: str, least: int, divisor: int) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of one text, words of ``least`` letters and more.

    A run whose checksum with the document's key is a multiple of ``divisor`` loses one letter, which plants variants.
    """
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for part in slices(text):
        for run, n in Counter(part.split()).items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % divisor == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= least:
                yield run, n


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, divisor: int = 97) -> DataFrame:
    """(word, n) over all texts; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in document_words(k, t.as_py(), least, divisor):
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(col(key).alias("key"), col(text).alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class PositionIndex:
    """Bitsets of words by (position, letter) and by length; bit k is the word of rank k."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.everything = (1 << len(words)) - 1
        longest = max(map(len, words), default=0)
        #: one empty position before the first and two behind the last letter
        self.at: list[dict[int, int]] = [{} for _ in range(longest + 3)]
        self.of_length: dict[int, int] = {}
        for k, word in enumerate(words):
            bit = 1 << k
            self.of_length[len(word)] = self.of_length.get(len(word), 0) | bit
            for letters, letter in zip(self.at[1:], word):
                letters[letter] = letters.get(letter, 0) | bit

    def near(self, query: bytes, start: int = 0) -> tuple[int, int, int, int]:
        """Words one letter shorter, as long and one letter longer than the query, with one error; and the words with its first ``start`` letters."""
        exact = same_start = self.everything
        replaced = longer = shorter = 0
        at = self.at
        for i, letter in enumerate(query[: len(at) - 2]):
            if i == start:
                same_start = exact
            here = at[i + 1].get(letter, 0)
            replaced = replaced & here | exact & ~here
            longer = (longer | exact) & at[i + 2].get(letter, 0)
            shorter = shorter & at[i].get(letter, 0) | exact
            exact &= here
        if start >= len(query):
            same_start = exact
        length = len(query)
        if length > len(at) - 2:
            return 0, 0, 0, same_start
        sized = self.of_length.get
        return shorter & sized(length - 1, 0), replaced & sized(length, 0), (longer | exact) & sized(length + 1, 0), same_start


def search_cell(rows: list[tuple[bytes, int, bool, bool]], length: int, starts: bool) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(word, near words, largest count among them, that word) for the queries of one cell.

    Ranks go by count and then by letters, so the lowest bit of a set is the word that a form is taken from.
    """
    ranked = sorted((-n, word) for word, n, indexed, _ in rows if indexed)
    index = PositionIndex([word for _, word in ranked])
    half = length // 2
    for word, _, _, asks in rows:
        if asks:
            shorter, replaced, longer, same_start = index.near(word, half)
            found = (replaced | longer if len(word) == length else shorter) & (same_start if starts else ~same_start)
            if found:
                n, best = ranked[(found & -found).bit_length() - 1]
                yield word, found.bit_count(), -n, best


def near_words(vocabulary: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best: struct(n, word)) for the words of ``vocabulary(word, n)`` with a near word."""
    size = F.length("word")

    def groups(length):
        half = F.floor(length / 2).cast("int")
        start, end = F.substring("word", F.lit(1), half), F.substring("word", size - length + half + 1, length)
        return [F.struct(length.alias("length"), kind.alias("starts"), F.xxhash64(length, kind, part).alias("part")) for kind, part in ((F.lit(True), start), (F.lit(False), end))]

    rows = vocabulary.select("word", "n", F.explode(F.array(*groups(size), *groups(size - 1))).alias("group"))
    big = rows.groupBy("group").count().filter(F.col("count") > cell_words)
    rows = rows.join(big, "group", "left").withColumn("parts", F.ceil(F.coalesce("count", F.lit(1)) / cell_words).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))

    def cell(block, chunk, indexed, asks):
        return F.struct(block.alias("block"), chunk.alias("chunk"), indexed.alias("indexed"), asks.alias("asks"))

    # a word is indexed in the cells of its row of the grid and asks in those of its column
    mine, j, both = F.col("own"), F.col("j"), F.col("own") == F.col("j")
    cells = F.filter(F.array(cell(mine, j, F.lit(True), both), cell(j, mine, F.lit(False), ~both)), lambda c: c["indexed"] | c["asks"])
    dealt = rows.select("group.*", "word", "n", F.explode(cells).alias("cell")).select("length", "starts", "part", "cell.*", "word", "n")
    place = ["length", "starts", "part", "block", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out(found):
            words, counts, ns, best = zip(*found) if found else ((), (), (), ())
            arrays = [pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(counts, pa.int64()), pa.array(ns, pa.int64())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([w.decode("latin-1") for w in best], pa.string())], names=["word", "n_near", "best_n", "best_word"])

        for batch in batches:
            found = []
            columns = [c.to_pylist() for c in batch.columns]
            for here, word, n, indexed, asks in zip(zip(*columns[:5]), columns[7], columns[8], columns[5], columns[6]):
                if here != at:
                    if held:
                        found += search_cell(held, at[0], at[1])
                    at, held = here, []
                held.append((word.encode("latin-1"), n, indexed, asks))
            yield out(found)
        if held:
            yield out(list(search_cell(held, at[0], at[1])))

    searched = dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "word string, n_near bigint, best_n bigint, best_word string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word")))
    merged = searched.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of ``forms(word, form)`` along the forms to the last, by pointer doubling.

    Counts at least double from word to form, so a path has at most 63 steps and six rounds follow it.
    """
    paths = kept(forms.select("word", F.col("form").alias("root")), "paths")
    while True:
        then = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = paths.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        done = kept(longer, "paths")
        discard([paths])
        paths = done.select("word", "root")
        if done.filter("moved").isEmpty():
            return paths


def variant_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, occurrences: int = 3, ratio: int = 2, divisor: int = 97, cell_words: int = CELL_WORDS
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered, of ``least`` letters and ``occurrences`` or more (see ``document_words``
    for planted errors). ``form`` is the near word of largest count (equal counts: the first in code-point order) if it occurs ``ratio`` (2 or more)
    times as often as the word, else null; ``root`` is the end of the path of forms, the word itself without a form.

    Null texts have no words, like empty ones; a null key counts as an empty string; repeated rows count again; very long texts are counted
    in slices; no documents give no rows. Extra columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could run in circles")
    vocabulary = kept(word_counts(docs, key, text, least, divisor).filter(F.col("n") >= occurrences), "vocabulary")
    near = near_words(vocabulary, cell_words)
    is_form = F.col("best.n") >= ratio * F.col("n")
    formed = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")
    )
    formed = kept(formed, "forms")
    discard([vocabulary])
    roots = last_forms(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
