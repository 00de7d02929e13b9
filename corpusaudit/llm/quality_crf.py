"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features are shares and counts of the line and of both neighbours.
Forward-backward gives each line's marginal; the document's quality is their mean weighted by line length, set
to the scale of probabilities by a logistic fit. Training lines take their document's label. The
fit uses a sample of labelled documents whose lines stay in the tasks: each round adds up one gradient per task.
Scoring is row by row over all documents. Features are built for a bounded number of lines at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import col, discard, field, kept, map_rows
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

#: Labelled documents used for fitting, chosen by a hash of their ids.
SAMPLE_DOCUMENTS = 6_000
#: Of these, documents a task of the fit holds.
TASK_DOCUMENTS = 500
#: Lines whose features are built at once.
LINES = 1 << 15
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_MARKS = b"!#$%&*|+=<>@^~\\/_{}[]`"
_STEPS = (0.02, 0.1, 0.3, 0.6)
#: Shares that also enter as steps: upper case, marks, pipes, bangs, repeated words, equal neighbours.
_STEPPED = (1, 2, 4, 5, 6, 7)
N_RAW = 12
N_LINE = N_RAW + len(_STEPPED) * len(_STEPS)
N_FEATURES = 3 * N_LINE + 3


def raw_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One row of numbers per line, and the lines' lengths. An empty text is one empty line."""
    lines = text.encode().split(b"\n")
    times: dict[bytes, int] = {}
    for line in lines:
        times[line] = times.get(line, 0) + 1
    out = np.zeros((len(lines), N_RAW), np.float32)
    for i, line in enumerate(lines):
        size = len(line)
        if not size:
            continue
        tokens = line.split()
        n = max(1, len(tokens))
        upper = size - len(line.translate(None, _UPPER))
        lower = size - len(line.translate(None, _LOWER))
        out[i] = (
            np.log1p(size) / 10,
            upper / max(1, upper + lower),
            (size - len(line.translate(None, _MARKS))) / size,
            (size - len(line.translate(None, _DIGITS))) / size,
            line.count(b"|") / n,
            line.count(b"!") / n,
            1 - len(set(tokens)) / n,
            sum(map(bytes.__eq__, tokens, tokens[1:])) / n,
            size / n / 10,
            float(line[-1] in b".?!"),
            float(65 <= line[0] <= 90 or line[0] >= 128),
            float(times[line] > 1),
        )
    return out, np.array([len(line) + 1 for line in lines], np.float64)


def feature_slices(raw: np.ndarray, counts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Own, previous and next line's features, ``LINES`` lines at a time, of documents with ``counts`` lines each."""
    n = len(raw)
    first = np.zeros(n, bool)
    last = np.zeros(n, bool)
    ends = np.cumsum(counts)
    first[ends - counts] = True
    last[ends - 1] = True
    for a in range(0, n, LINES):
        b = min(a + LINES, n)
        # one line more on both sides; what stands there at the ends is masked
        around = raw[np.clip(np.arange(a - 1, b + 1), 0, n - 1)]
        around = np.hstack([around, *[around[:, [c]] > s for c in _STEPPED for s in _STEPS]]).astype(np.float32)
        begins, closes = first[a:b, None], last[a:b, None]
        before, after = np.where(begins, 0, around[:-2]), np.where(closes, 0, around[2:])
        yield slice(a, b), np.hstack([around[1:-1], before, after, np.ones((b - a, 1)), begins, closes]).astype(np.float32)


def document_slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive whole documents of at most ``LINES`` lines together, or one longer document: [start, end)."""
    start = lines = 0
    for i, n in enumerate(counts):
        if i > start and lines + n > LINES:
            yield start, i
            start, lines = i, 0
        lines += n
    if start < len(counts):
        yield start, len(counts)


def padded(counts: np.ndarray, width: int = 512) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of similar length together: (documents, line numbers padded with -1, lengths)."""
    order = np.argsort(counts, kind="stable")
    starts = np.cumsum(counts) - counts
    groups, at = [], 0
    while at < len(order):
        take = order[at : at + width]
        longest = int(counts[take[-1]])
        if longest * len(take) > 1 << 20:
            take = take[: max(1, (1 << 20) // longest)]
            longest = int(counts[take[-1]])
        grid = starts[take][:, None] + np.arange(longest)[None, :]
        grid[np.arange(longest)[None, :] >= counts[take][:, None]] = -1
        groups.append((take, grid, counts[take]))
        at += len(take)
    return groups


#: Lines from which on a chain is taken in blocks.
LONG_CHAIN = 256


def passed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Product of 2 x 2 matrices (or of rows of two) in the log domain, over all leading places."""
    return np.logaddexp(left[..., 0, None] + right[..., 0, :], left[..., 1, None] + right[..., 1, :])


def line_by_line(node: np.ndarray, here: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of documents x lines, one step per line for all documents."""
    longest = node.shape[1]
    forward, backward = np.empty_like(node), np.zeros_like(node)
    forward[:, 0] = node[:, 0]
    for t in range(1, longest):
        step = forward[:, t - 1]
        forward[:, t] = np.where(here[:, t, None], passed(step, moves) + node[:, t], step)
    for t in range(longest - 2, -1, -1):
        moved = passed(backward[:, t + 1] + node[:, t + 1], moves.T)
        backward[:, t] = np.where(here[:, t + 1, None], moved, 0)
    return forward, backward


def in_blocks(node: np.ndarray, here: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for long chains: a chain of n lines takes some 5 sqrt(n) steps instead of 2 n.

    The step into a line is a 2 x 2 matrix. Blocks of consecutive steps are multiplied for all blocks at once, messages go from
    block to block, and then through all blocks at once.
    """
    docs, longest = here.shape
    size = max(1, int(np.sqrt(longest / 2)))
    blocks = -(-(longest - 1) // size)
    into = np.full((docs, blocks * size, 2, 2), -np.inf)
    # where a document has no line, nothing changes
    into[..., 0, 0] = into[..., 1, 1] = 0
    into[:, : longest - 1] = np.where(here[:, 1:, None, None], moves + node[:, 1:, None, :], into[:, : longest - 1])
    into = into.reshape(docs, blocks, size, 2, 2)
    whole = into[:, :, 0]
    for i in range(1, size):
        whole = passed(whole, into[:, :, i][:, :, None])
    enters, leaves = np.empty((docs, blocks, 2)), np.zeros((docs, blocks, 2))
    enters[:, 0] = node[:, 0]
    for i in range(1, blocks):
        enters[:, i] = passed(enters[:, i - 1], whole[:, i - 1])
    turned = whole.swapaxes(-1, -2)
    for i in range(blocks - 2, -1, -1):
        leaves[:, i] = passed(leaves[:, i + 1], turned[:, i + 1])
    forward, backward = np.empty((docs, blocks, size, 2)), np.empty((docs, blocks, size, 2))
    step = enters
    for i in range(size):
        forward[:, :, i] = step = passed(step, into[:, :, i])
    step = leaves
    for i in range(size - 1, -1, -1):
        # the message behind a step, then the one before it
        backward[:, :, i] = step
        step = passed(step, into[:, :, i].swapaxes(-1, -2))
    ahead, behind = forward.reshape(docs, -1, 2)[:, : longest - 1], backward.reshape(docs, -1, 2)[:, : longest - 1]
    return np.concatenate([node[:, :1], ahead], axis=1), np.concatenate([step[:, :1], behind], axis=1)


def marginals(potential: np.ndarray, moves: np.ndarray, counts: np.ndarray, groups=None, pairs: bool = False):
    """P(line is good) by forward-backward; with ``pairs`` also the expected moves, each document weighing 1 / lines."""
    good = np.empty(len(potential))
    expected = np.zeros((2, 2))
    for _, grid, sizes in groups or padded(counts):
        docs, longest = grid.shape
        here = grid >= 0
        node = np.zeros((docs, longest, 2))
        node[:, :, 1] = np.where(here, potential[grid], 0)
        forward, backward = (in_blocks if longest > LONG_CHAIN else line_by_line)(node, here, moves)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
        good[grid[here]] = p[here]
        if pairs and longest > 1:
            ahead = (backward + node)[:, 1:]
            for a in (0, 1):
                for b in (0, 1):
                    both = np.exp(forward[:, :-1, a] + moves[a, b] + ahead[:, :, b] - total[:, None])
                    expected[a, b] += (both * here[:, 1:] / sizes[:, None]).sum()
    return (good, expected) if pairs else good


def potentials(slices, n: int, weights: np.ndarray) -> np.ndarray:
    out = np.empty(n)
    for at, x in slices:
        out[at] = x @ weights
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def line_marginals(self, raw: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return marginals(potentials(feature_slices(raw, counts), len(raw), self.weights), self.moves, counts)

    def quality(self, good: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)
        return 1 / (1 + np.exp(-(self.slope * logit(mean) + self.shift)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def slope_of(theta: np.ndarray, raw: np.ndarray, counts: np.ndarray, labels: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Sum of the documents' slopes of the conditional likelihood; ``share`` is the weight of a document of each class."""
    weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
    # of one slice of lines the features are used twice; of a longer document they are made twice
    once = list(feature_slices(raw, counts)) if len(raw) <= LINES else None
    potential = potentials(once or feature_slices(raw, counts), len(raw), weights)
    good, moved = np.zeros(len(raw)), np.zeros((2, 2))
    for c in (0, 1):
        docs = np.flatnonzero(labels == c)
        if len(docs):
            groups = padded_subset(counts, docs)
            part, expected = marginals(potential, moves, counts, groups, pairs=True)
            lines = np.concatenate([g[g >= 0] for _, g, _ in groups])
            good[lines] = part[lines]
            # a document's own moves less the model's; the class weights enter as copies of documents would
            moved[c, c] += ((counts[docs] - 1) / counts[docs]).sum() * share[c]
            moved -= expected * share[c]
    error = (np.repeat(labels, counts) - good) * np.repeat(share[(labels == 1).astype(int)] / counts, counts)
    slope = np.zeros(len(weights))
    for at, x in once or feature_slices(raw, counts):
        slope += x.T @ error[at]
    return np.concatenate([slope, moved.ravel()])


def fit(slope: Callable[[np.ndarray], np.ndarray], n: int, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Conditional likelihood of ``n`` documents by Adam; ``slope`` gives the sum of their slopes."""
    theta = np.zeros(N_FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        step = slope(theta) / n - penalty * theta
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step**2
        theta = theta + rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-9)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def padded_subset(counts: np.ndarray, docs: np.ndarray) -> list:
    starts = np.cumsum(counts) - counts
    out = []
    for take, grid, sizes in padded(counts[docs]):
        local = np.cumsum(counts[docs]) - counts[docs]
        moved = np.where(grid >= 0, grid - local[take][:, None] + starts[docs[take]][:, None], -1)
        out.append((docs[take], moved, sizes))
    return out


def scale(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the labels on ``z``, slightly held towards (1, 0); slope stays positive."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    theta, prior, hold = np.array([1.0, 0.0]), np.array([1.0, 0.0]), 1.0
    design = np.column_stack([z, np.ones_like(z)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -500, 500)))
        slope = design.T @ (labels - p) - hold * (theta - prior)
        curve = (design * (p * (1 - p))[:, None]).T @ design + hold * np.eye(2)
        move = np.linalg.solve(curve, slope)
        theta = theta + np.clip(move, -1, 1)
    return float(max(theta[0], 1e-3)), float(theta[1])


def held_out(key: str = "doc_id"):
    """Rows never used for fitting: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCUMENTS) -> Model | None:
    """Fit on at most ``sample`` labelled documents that are not held out; None without any.

    A document labelled more than once takes the lower label; null labels are left out.
    """
    wanted = labels.filter(~held_out(key)).filter(col("quality").isNotNull() & col(key).isNotNull())
    wanted = wanted.groupBy(col(key).alias("key")).agg(F.min("quality").cast("int").alias("label"))
    chosen = wanted.orderBy(F.xxhash64("key"), "key").limit(sample)
    tasks = max(1, -(-chosen.count() // TASK_DOCUMENTS))
    rows = docs.select(col(key).alias("key"), F.coalesce(col(text), F.lit("")).alias("text"))
    # at most ``sample`` rows of two numbers
    rows = rows.join(F.broadcast(chosen), "key").withColumn("h", F.xxhash64("text")).dropDuplicates(["key", "h"])
    rows = rows.repartition(tasks).sortWithinPartitions("key", "h")

    def start():
        def work(texts):
            made = [raw_features(t) for t in texts]
            return [pa.array([m[0].ravel() for m in made], pa.list_(pa.float32())), pa.array([m[1] for m in made], pa.list_(pa.float64()))]

        return work

    made = map_rows(rows, ["text"], start, [field("raw", "array<float>"), field("lengths", "array<double>")])
    made = kept(made.select("row.label", "raw", "lengths"), "lines")
    share = np.zeros(2)
    for r in made.groupBy("label").count().collect():
        share[int(r["label"] == 1)] += r["count"]
    n = int(share.sum())
    if not n:
        discard([made])
        return None
    # both classes weigh the same
    share = n * 0.5 / np.maximum(1, share)
    model = fit(lambda theta: total_slope(made, theta, share), n)
    model = Model(model.weights, model.moves, *scale(*unscaled(made, model)))
    discard([made])
    return model


def sample_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, raw features, lengths and line counts of the sample's rows, whole documents of a bounded number of lines."""
    for batch in batches:
        labels, raw, lengths = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
        counts = batch.column(2).value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        for i, j in document_slices(counts):
            a, b = ends[i], ends[j]
            yield labels[i:j], raw[a * N_RAW : b * N_RAW].reshape(-1, N_RAW), lengths[a:b], counts[i:j]


def total_slope(sample: DataFrame, theta: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The slopes of all documents of the sample, summed up by its tasks: one row per task comes back."""

    def run(batches):
        total = np.zeros(len(theta))
        for labels, raw, _, counts in sample_slices(batches):
            total += slope_of(theta, raw, counts, labels, share)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["slope"])

    return np.sum([r["slope"] for r in sample.mapInArrow(run, "slope array<double>").collect()], axis=0)


def unscaled(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the sample's qualities, and labels: two numbers per document."""

    def run(batches):
        for labels, raw, lengths, counts in sample_slices(batches):
            quality = model.quality(model.line_marginals(raw, counts), lengths, counts)
            yield pa.RecordBatch.from_arrays([pa.array(logit(quality)), pa.array(labels)], names=["z", "label"])

    table = sample.mapInArrow(run, "z double, label int").toArrow()
    return table["z"].to_numpy(), table["label"].to_numpy()


def score_lines(texts: list[str], model: Model) -> tuple[np.ndarray, list[np.ndarray]]:
    values, lines = [], []
    for i, j in document_slices([t.count("\n") + 1 for t in texts]):
        made = [raw_features(t) for t in texts[i:j]]
        counts = np.array([len(m[1]) for m in made])
        raw, lengths = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
        good = model.line_marginals(raw, counts)
        values.append(model.quality(good, lengths, counts))
        lines += np.split(good, np.cumsum(counts)[:-1])
    return np.concatenate(values), lines


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Every row (struct ``row``) with score (0 to 1), predicted (1 from the threshold on) and line_good (marginals).

    Null texts count as empty: one empty line, scored like any other. Without a model (no labels) every
    score is 0.5. Scores depend on the text alone. Very long texts are scored whole, in memory that grows with their lines. An empty table gives no rows.
    """

    def start():
        def work(texts):
            if model is None:
                values, lines = np.full(len(texts), 0.5), [np.full((t or "").count("\n") + 1, 0.5) for t in texts]
            elif texts:
                values, lines = score_lines([t or "" for t in texts], model)
            else:
                values, lines = np.zeros(0), []
            return [pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32), pa.int32()), pa.array(lines, pa.list_(pa.float64()))]

        return work

    return map_rows(docs, [text], start, [field("score", "double"), field("predicted", "int"), field("line_good", "array<double>")])


def document_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, score, predicted.

    Rows are documents: repeated rows stay and get equal scores. See :func:`train` and :func:`score` for nulls, empty and very long texts.
    """
    docs = docs.select(col(key), col(text))
    made = score(docs, train(docs, labels, key, text), text)
    return made.select(F.col("row").getField(key).alias(key), "score", "predicted").select(
        key, held_out(key).alias("held_out"), "score", "predicted"
    )
