"""Conversations as token sequences with a loss mask.

Every turn is encoded on its own: a reserved id opens it, the ids of its escaped text follow, a reserved id closes it, so
no text can produce or blur a mark. Control strings inside texts are broken by a backslash (and backslashes are
doubled), so that the sequence printed as text is unambiguous too. Encoding runs row by row; turns are then put in order
per conversation as a stream, where prefix sums of their lengths give offsets.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.llm.common import col, field, map_rows
from corpusaudit.llm.encoding import decoder, encoder
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

#: The marks of the template, in the order of their reserved ids, and other control strings to escape.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[OUT]", "[/OUT]", "[ROLE]", "[/ROLE]")
ALSO_ESCAPED = ("<|endoftext|>",)
#: Opening and closing mark of the known roles; any other role is spelled out between [ROLE] and [/ROLE].
ROLES = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[OUT]", "[/OUT]")}
#: First reserved id: the size of the vocabulary.
FIRST_ID = 50_257
_BREAK = re.compile(r"\\|" + "|".join(map(re.escape, sorted(MARKS + ALSO_ESCAPED, key=len, reverse=True))))
_JOIN = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _JOIN.sub(r"\1", text)


def mark_id(mark: str, first_id: int) -> int:
    return first_id + MARKS.index(mark)


def turn_ids(role: str, text: str, encode, first_id: int) -> tuple[array, int, int]:
    """Ids of a turn, and where its text starts and ends in them."""
    ids = array("i")
    opening, closing = ROLES.get(role, ("[ROLE]", "</s>"))
    ids.append(mark_id(opening, first_id))
    if role not in ROLES:
        ids.extend(encode(escape(role)))
        ids.append(mark_id("[/ROLE]", first_id))
    start = len(ids)
    ids.extend(encode(escape(text)))
    end = len(ids)
    ids.append(mark_id(closing, first_id))
    return ids, start, end


def lists(parts: list[np.ndarray], lengths: list[int] | np.ndarray) -> pa.ListArray:
    """A list column from the values of all rows one after the other."""
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), np.asarray(lengths, np.int64)])).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def rows_of(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column without nulls, as views."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encoded_turns(turns: DataFrame, tokenizer: str, first_id: int = FIRST_ID) -> DataFrame:
    """Rows conv_id, turn, role, text and ids, text_start, text_end of each turn. Null roles and texts are empty."""
    rows = turns.select(
        col("conv_id").alias("conv_id"), col("turn").alias("turn"), F.coalesce(col("role"), F.lit("")).alias("role"), F.coalesce(col("text"), F.lit("")).alias("text")
    )

    def start():
        encode = encoder(tokenizer, special=False)

        def work(roles, texts):
            made = [turn_ids(r, t, encode, first_id) for r, t in zip(roles, texts)]
            ids = [np.frombuffer(m[0], np.int32) for m in made]
            return [lists(ids, [len(i) for i in ids]), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int32())]

        return work

    fields = [field("ids", "array<int>"), field("text_start", "int"), field("text_end", "int")]
    return map_rows(rows, ["role", "text"], start, fields).select("row.*", "ids", "text_start", "text_end")


def format_conversations(turns: DataFrame, tokenizer: str, first_id: int = FIRST_ID) -> DataFrame:
    """One row per turn: conv_id, position, token_offset, ids, loss_mask.

    A conversation's sequence is the ids of its rows by position. The first row starts with <s>. The mask is 1 on the ids of
    assistant texts and 0 on all else: +1 and -1 where they start and end, added up. Rows go by turn, null turns first, ties by
    role and text. Rows without a conversation id form one conversation. However long a conversation is, it passes
    through its task as a stream. Null roles and texts count as empty; repeated rows are turns of their own; an empty table gives no rows; extra
    columns are not read.
    """
    made = encoded_turns(turns, tokenizer, first_id).repartition("conv_id")
    made = made.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "ids", "text_start", "text_end")
    names = ["conv_id", "position", "token_offset", "ids", "loss_mask"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, offset = object(), 0, 0
        begin = np.array([mark_id("<s>", first_id)], np.int32)
        for batch in batches:
            convs, roles, starts, ends = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            parts, lengths, positions, offsets, up, down, at = [], [], [], [], [], [], 0
            for conv, role, ids, a, b in zip(convs, roles, rows_of(batch.column(2)), starts, ends):
                first = conv != now
                if first:
                    now, position, offset = conv, 0, 0
                    parts.append(begin)
                parts.append(ids)
                if role == "assistant":
                    up.append(at + a + first)
                    down.append(at + b + first)
                lengths.append(len(ids) + first)
                positions.append(position)
                offsets.append(offset)
                position, offset, at = position + 1, offset + lengths[-1], at + lengths[-1]
            edges = np.zeros(at + 1, np.int8)
            np.add.at(edges, up, 1)
            np.subtract.at(edges, down, 1)
            mask = np.cumsum(edges[:-1], dtype=np.int8)
            places = [pa.array(positions, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *places, lists(parts, lengths), lists([mask], lengths)], names=names)

    kinds = ["bigint", "bigint", "array<int>", "array<tinyint>"]
    shape = T.StructType([made.schema["conv_id"], *[field(n, k) for n, k in zip(names[1:], kinds)]])
    return made.mapInArrow(run, shape)


def read_turn(ids: np.ndarray, decode, first_id: int) -> tuple[str, str, int]:
    """Role, text and printed length of one row of ``format_conversations``."""
    at = np.flatnonzero(ids >= first_id).tolist()
    marks = [MARKS[ids[i] - first_id] for i in at]
    plain = [decode(ids[i + 1 : j].tolist()).decode() for i, j in zip(at, at[1:])]
    printed = sum(map(len, marks)) + sum(map(len, plain))
    if marks[0] == "<s>":
        marks, plain = marks[1:], plain[1:]
    opening = marks[0]
    role = next((r for r, (o, _) in ROLES.items() if o == opening), None)
    return (unescape(plain[0]) if role is None else role), unescape(plain[-1]), printed


def conversation_digests(formatted: DataFrame, tokenizer: str, first_id: int = FIRST_ID) -> DataFrame:
    """What the sequences say, one row per conversation, from their ids and masks alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (all text
    under the mask), formatted_chars (the printed sequence).
    """
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "ids", "loss_mask")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    shape = T.StructType([rows.schema["conv_id"], *[field(n, "string" if "sha" in n else "bigint") for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(tokenizer)
        done: list[tuple] = []
        state = None

        def close():
            conv, turns, said, n_loss, loss, chars = state
            done.append((conv, turns, said.hexdigest(), n_loss, loss.hexdigest(), chars))

        def out(kind):
            columns = list(zip(*done))
            types = [kind] + [pa.string() if "sha" in n else pa.int64() for n in names[1:]]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            done.clear()
            return made

        kind = None
        for batch in batches:
            kind = batch.schema[0].type
            for conv, ids, mask in zip(batch.column(0).to_pylist(), rows_of(batch.column(1)), rows_of(batch.column(2))):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, printed = read_turn(ids, decode, first_id)
                learned = unescape(decode(ids[(mask == 1) & (ids < first_id)].tolist()).decode())
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += printed
            if len(done) >= 10_000:
                yield out(kind)
        if state is not None:
            close()
            yield out(kind)

    return rows.mapInArrow(run, shape)
