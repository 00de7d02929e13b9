"""Language of a text: averaged embeddings of hashed subwords and a linear softmax, with a calibrated rejection.

A word is a run of letters and their marks in lower case, with a border before and after it; its subwords are its runs
of 1 to 4 symbols, borders included. Each subword is hashed to a bucket, each bucket has an embedding, and a text is the average of the
embeddings of all its subwords. A linear layer and a softmax give the languages' shares. Both layers are trained together by
stochastic gradient descent in numpy on a bounded sample. A part of the sample sets the temperature of the
softmax and the least score at which a prediction counts as accepted.

The average is linear, so prediction needs one number per bucket and language: the texts are read once, in tasks.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import col, field, map_rows, worker_state
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

BITS = 13
BUCKETS = 1 << BITS
#: Symbols of the longest subwords.
LARGEST = 4
DIMENSIONS = 16
#: Documents the model learns from at most, spread over the languages as evenly as they allow.
SAMPLE_DOCUMENTS = 4000
#: Every so many-th document of the sample calibrates instead of training.
CALIBRATION = 5
EPOCHS, BATCH, RATE = 12, 32, 20.0
#: Share of wrong ones allowed among accepted predictions, measured on the calibration part.
ERRORS = 0.01
#: Characters turned into numbers at a time.
SLICE = 1 << 18
#: The prediction for a text without letters.
UNKNOWN = "und"


def held_out(key: str) -> Column:
    """Documents that are never learned from; one without a key is one of them."""
    return F.coalesce(F.crc32(col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def letter_kinds() -> np.ndarray:
    """For every code point 2 for a letter, 1 for a mark, else 0."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


def symbols(text: str) -> tuple[np.ndarray, bool]:
    """Code points of the words with single zeros between, before and after them; and whether there is a letter."""
    kinds = worker_state("letter kinds", letter_kinds)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kind = kinds[points]
    made = np.zeros(len(points) + 2, np.uint32)
    made[1:-1] = np.where(kind > 0, points, 0)
    border = made == 0
    keep = np.ones(len(made), bool)
    keep[1:] = ~(border[1:] & border[:-1])
    return made[keep], bool((kind == 2).any())


def bucket_of(grams: np.ndarray, size: int) -> np.ndarray:
    mixed = (grams + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def subword_counts(text: str) -> tuple[np.ndarray, bool]:
    """How many subwords of the text fall into each bucket, and whether the text has a letter.

    Long texts are taken in slices that end between words where they can; a word longer than a slice is taken in parts.
    """
    total, lettered, at = np.zeros(BUCKETS, np.int64), False, 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            blank = text.rfind(" ", at + 1, end)
            end = blank if blank > 0 else end
        made, has_letter = symbols(text[at:end])
        lettered |= has_letter
        at = end
        word, one = made != 0, made.astype(np.uint64)
        grams = np.zeros(len(one), np.uint64)
        for size in range(1, LARGEST + 1):
            n = len(one) - size + 1
            if n <= 0:
                break
            grams = grams[:n] * np.uint64(1_000_003) + one[size - 1 :]
            # a border may be the first or the last symbol of a subword, not one inside
            whole = word if size == 1 else np.logical_and.reduce([word[k : k + n] for k in range(1, size - 1)]) if size > 2 else slice(None)
            total += np.bincount(bucket_of(grams[whole], size), minlength=BUCKETS)
    return total, lettered


@dataclass
class Model:
    languages: list[str]
    #: logits of a text that is one bucket only, buckets x languages, and what every text adds
    layer: np.ndarray
    bias: np.ndarray
    #: least score of an accepted prediction
    accept: float

    def shares(self, counts: np.ndarray) -> np.ndarray:
        logits = counts @ self.layer / max(1, counts.sum()) + self.bias
        shares = np.exp(logits - logits.max())
        return shares / shares.sum()


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def sgd(features: np.ndarray, wanted: np.ndarray, classes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax layer and bias from averaged counts; the step falls in a line to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (features.shape[1], DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, classes), np.float32)
    bias = np.zeros(classes, np.float32)
    # every language weighs the same
    share = len(wanted) / classes / np.maximum(1, np.bincount(wanted, minlength=classes))
    steps = EPOCHS * -(-len(wanted) // BATCH)
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(wanted))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            x, y = features[some].astype(np.float32), wanted[some]
            x /= np.maximum(1, x.sum(axis=1, keepdims=True))
            hidden = x @ vectors
            slope = softmax(hidden @ layer + bias)
            slope[np.arange(len(y)), y] -= 1
            slope *= (share[y] / len(y))[:, None]
            rate = RATE * (1 - done / steps)
            back = slope @ layer.T
            layer -= np.float32(rate) * (hidden.T @ slope)
            vectors -= np.float32(rate) * (x.T @ back)
            bias -= np.float32(0.01 * rate) * slope.sum(axis=0)
            done += 1
    return vectors, layer, bias


def temperature(logits: np.ndarray, wanted: np.ndarray) -> float:
    """The factor on the logits that gives the wanted languages the largest likelihood (golden section on its logarithm)."""

    def loss(t):
        return -np.log(softmax(logits * np.exp(t))[np.arange(len(wanted)), wanted] + 1e-30).mean()

    low, high, golden = -3.0, 3.0, (5**0.5 - 1) / 2
    while high - low > 1e-4:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def least_accepted(scores: np.ndarray, right: np.ndarray, errors: float) -> float:
    """The least score so that among predictions with that score or more at most ``errors`` are wrong; 1 if there is none."""
    order = np.argsort(-scores, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    # predictions of equal score are accepted together
    last = np.append(scores[order][1:] != scores[order][:-1], True)
    good = np.flatnonzero((wrong <= errors) & last)
    return float(scores[order][good[-1]]) if len(good) else 1.0


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCUMENTS, errors: float = ERRORS) -> Model | None:
    """Learn from at most ``sample`` documents with a language that are not held out; None without any.

    Documents are drawn by the hash of their key, rarer languages with a higher chance; what reaches the driver are their bucket
    counts, at most BUCKETS numbers a document.
    """
    known = docs.select(col(key).alias("key"), col(text).alias("text"), col(lang).cast("string").alias("lang"))
    known = known.filter(~held_out("key") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").count()
    # u x (rows of the language): the smallest values hold about as many rows of every language
    u = F.pmod(F.xxhash64("key", F.lit(12)), F.lit(1 << 30)) + 1
    chosen = known.select("key", "lang").join(F.broadcast(sizes), "lang").select("key", "lang", (u * F.col("count")).alias("place"))
    chosen = chosen.orderBy("place", "key", "lang").limit(sample)
    # at most ``sample`` rows of two short values
    rows = known.join(F.broadcast(chosen.select("key", "lang")), ["key", "lang"]).withColumn("h", F.xxhash64("text"))
    rows = rows.dropDuplicates(["key", "lang", "h"])

    def start():
        def work(texts):
            made = [subword_counts(t) for t in texts]
            places = [np.flatnonzero(m[0]) for m in made]
            return [
                pa.array([p.astype(np.int16) for p in places], pa.list_(pa.int16())),
                pa.array([m[0][p].astype(np.float32) for m, p in zip(made, places)], pa.list_(pa.float32())),
                pa.array([m[1] for m in made], pa.bool_()),
            ]

        return work

    made = map_rows(rows.select("key", "lang", "h", "text"), ["text"], start, [field("buckets", "array<smallint>"), field("counts", "array<float>"), field("lettered", "boolean")])
    made = made.filter("lettered").select("row.key", "row.lang", "row.h", "buckets", "counts").orderBy(F.xxhash64("key"), "key", "lang", "h").limit(sample)
    table = made.toArrow().combine_chunks()
    n = table.num_rows
    if not n:
        return None
    languages = sorted(set(table["lang"].to_pylist()))
    wanted = np.searchsorted(np.array(languages), np.array(table["lang"].to_pylist()))
    lengths = table["buckets"].combine_chunks().value_lengths().to_numpy()
    places = table["buckets"].combine_chunks().flatten().to_numpy()
    values = table["counts"].combine_chunks().flatten().to_numpy()
    features = np.zeros((n, BUCKETS), np.float32)
    features[np.repeat(np.arange(n), lengths), places] = values
    return fit(features, wanted, languages, errors)


def fit(features: np.ndarray, wanted: np.ndarray, languages: list[str], errors: float = ERRORS) -> Model:
    n = len(wanted)
    calibrates = np.arange(n) % CALIBRATION == CALIBRATION - 1
    # too few to set a part aside: the same rows do both
    learns = ~calibrates if n >= 10 * CALIBRATION else np.ones(n, bool)
    calibrates = calibrates if n >= 10 * CALIBRATION else learns
    vectors, layer, bias = sgd(features[learns], wanted[learns], len(languages))
    flat, bias = vectors.astype(np.float64) @ layer, bias.astype(np.float64)
    x = features[calibrates].astype(np.float64)
    logits = x @ flat / np.maximum(1, x.sum(axis=1, keepdims=True)) + bias
    factor = temperature(logits, wanted[calibrates])
    shares = softmax(logits * factor)
    accept = least_accepted(shares.max(axis=1), shares.argmax(axis=1) == wanted[calibrates], errors)
    return Model(languages, flat * factor, bias * factor, accept)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Every row (struct ``row``) with lang_pred, score (its calibrated share, 0 to 1) and accepted.

    A null text, one without a letter, and any text without a model are ``und`` with score 0, not accepted. Empty texts have no letter;
    very long ones are read whole, in slices; equal texts get equal predictions; of equal shares the first language counts.
    """

    def start():
        def work(texts):
            langs, scores = [], []
            for t in texts:
                counts, lettered = subword_counts(t or "")
                if model is None or not lettered:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                shares = model.shares(counts)
                langs.append(model.languages[int(shares.argmax())])
                scores.append(float(shares.max()))
            accepted = [s > 0 and s >= model.accept if model else False for s in scores]
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]

        return work

    return map_rows(docs, [text], start, [field("lang_pred", "string"), field("score", "double"), field("accepted", "boolean")])


def document_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """One row per document: key, held_out, lang_pred, score, accepted.

    Learns from the documents with a language that are not held out (see ``train``); predictions depend on the text alone. An empty table
    gives no rows; repeated rows stay; null keys are held out; columns besides the three named are not read.
    """
    model = train(docs, key, text, lang, sample)
    made = predict(docs.select(col(key), col(text)), model, text)
    made = made.select(F.col("row").getField(key).alias(key), "lang_pred", "score", "accepted")
    return made.select(key, held_out(key).alias("held_out"), "lang_pred", "score", "accepted")
