"""Token counts under a unigram vocabulary without building the tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; a Viterbi pass carries the best score and
the number of pieces of the best path, nothing else. Ties are decided as the unigram tokenizers do: of paths with equal scores
the one whose last piece starts first wins, and a character outside the vocabulary is taken on its own only if that
is strictly better. Scores are added exactly, as integers.

The file's own text rules (character map, white space, a mark before the first or behind the last word) are applied by its library.

When no piece holds a word start after another character, the best path is the best paths of the words in turn, so
words are solved once and remembered up to a fixed number.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field as default

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as model_file

from corpusaudit.llm.common import col, field, map_rows, worker_state
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

START = "▁"
#: Words remembered per worker, and the longest that is.
MEMORY_WORDS = 400_000
MEMORY_CHARS = 48
#: Fixed values of the format: kinds of pieces that take part, and the penalty of unknown characters.
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
#: Fixed value of the format: the kind of a unigram file.
UNIGRAM = 1
#: Fixed value of the format: what a user's piece gets below its length in bytes times the best score.
USER_BONUS = 0.1
UNKNOWN_PENALTY = 10


@dataclass
class Unigram:
    """Pieces with integer scores (``scale`` units each), and how text is prepared."""

    pieces: dict[str, int]
    scale: int = 1
    bytes_known: bool = False
    prefix: bool = True
    #: the text's rules, when they are more than the prefix: the whole line with its marks
    line: Callable[[str], str] | None = None
    known: dict[str, tuple[int, int]] = default(default_factory=dict)

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if self.pieces:
            self.automaton.make_automaton()
        self.unknown = min(self.pieces.values(), default=0) - UNKNOWN_PENALTY * self.scale
        self.by_word = START in self.pieces and not any(START in p.lstrip(START) for p in self.pieces)

    def viterbi(self, chars: str) -> tuple[int, int]:
        """(score, pieces) of the best path. An unknown character is its bytes, or joins a run that is one piece."""
        n = len(chars)
        score: list = [0] + [None] * n
        count = [0] * (n + 1)
        lone = [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(chars) if self.pieces else ():
            ends[end].append(match)
        for end in range(1, n + 1):
            best, pieces, single = None, 0, False
            for length, value in sorted(ends[end - 1], reverse=True) if len(ends[end - 1]) > 1 else ends[end - 1]:
                single |= length == 1
                at = end - length
                total = score[at] + value
                if best is None or total > best:
                    best, pieces = total, count[at] + 1
            if not single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best = total
                    if self.bytes_known:
                        pieces = count[end - 1] + len(chars[end - 1].encode())
                    else:
                        pieces = count[end - 1] + (not lone[end - 1])
                        lone[end] = True
            score[end], count[end] = best, pieces
        return score[n], count[n]

    def count(self, text: str) -> tuple[int, int]:
        """(score, pieces) of a text."""
        if not text:
            return 0, 0
        line = self.line(text) if self.line else (START if self.prefix else "") + text.replace(" ", START)
        if not line:
            return 0, 0
        if not self.by_word:
            return self.viterbi(line)
        score = pieces = 0
        known = self.known
        for word in re.findall(f"{START}+[^{START}]*|[^{START}]+", line):
            solved = known.get(word)
            if solved is None:
                solved = self.viterbi(word)
                if len(word) <= MEMORY_CHARS:
                    if len(known) >= MEMORY_WORDS:
                        known.clear()
                    known[word] = solved
            score += solved[0]
            pieces += solved[1]
        return score, pieces


def exact(scores: list[float]) -> tuple[list[int], int]:
    """Scores as integers over a common power of two."""
    ratios = [s.as_integer_ratio() for s in scores]
    scale = max((d for _, d in ratios), default=1)
    return [n * (scale // d) for n, d in ratios], scale


def read_model(path: str, as_unigram: bool = False) -> Unigram:
    """The vocabulary, scores and text rules of a sentencepiece file.

    A file of another kind (merges) is refused, unless its pieces and scores are to be used ``as_unigram`` vocabulary as they are. A
    user-defined piece has the score its library gives it: its bytes times the best score, less a tenth.
    """
    model = model_file.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    if model.trainer_spec.model_type != UNIGRAM and not as_unigram:
        raise ValueError(f"{path} is no unigram file")
    spec = model.normalizer_spec
    normal = [p for p in model.pieces if p.type in (NORMAL, USER_DEFINED)]
    top = max((p.score for p in normal if p.type == NORMAL), default=0.0)
    scores, scale = exact([p.score if p.type == NORMAL else len(p.piece.encode()) * top - USER_BONUS for p in normal])
    bytes_known = sum(p.type == BYTE for p in model.pieces) == 256
    plain = not (spec.precompiled_charsmap or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces)
    plain &= not any(p.type == USER_DEFINED for p in normal)
    line = None if plain else SentencePieceProcessor(model_proto=model.SerializeToString()).Normalize
    made = Unigram(dict(zip((p.piece for p in normal), scores)), scale, bytes_known, spec.add_dummy_prefix, line)
    # unknown characters count from the worst score of a normal piece
    made.unknown = min((s for p, s in zip(normal, scores) if p.type == NORMAL), default=0) - UNKNOWN_PENALTY * scale
    return made


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", as_unigram: bool = False) -> DataFrame:
    """One row per input row: key, n_tokens, score (of the best path). Null and empty texts have no tokens.

    Row by row, so repeated rows are counted alike and nothing is shuffled; very long texts are counted whole; an empty table gives no
    rows; null keys stay null; other columns are not read.
    """

    def start():
        vocabulary = worker_state(("unigram", model, as_unigram), lambda: read_model(model, as_unigram))

        def work(texts):
            made = [vocabulary.count(t or "") for t in texts]
            return [pa.array([m[1] for m in made], pa.int64()), pa.array([m[0] / vocabulary.scale for m in made], pa.float64())]

        return work

    made = map_rows(docs.select(col(key), col(text)), [text], start, [field("n_tokens", "bigint"), field("score", "double")])
    return made.select(F.col("row").getField(key).alias(key), "n_tokens", "score")
