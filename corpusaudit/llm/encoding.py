"""Byte-level BPE ids from a tokenizer file, exactly those of its own library."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache

import tiktoken
from tokenizers import Tokenizer

from corpusaudit.llm.common import worker_state
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

#: Fixed value: the pattern of the byte-level pre-tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space in a row from which on a text is left to the library: the pattern's look-ahead keeps one state for each
#: of these characters and panics at a million.
LONG_RUN = 100_000
_LONG_RUN = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")


def byte_of_letter() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def in_merge_order(model: dict, added: set[str]) -> bool:
    """Do the merges make exactly the vocabulary's longer tokens, in the order of their ids?"""
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(pair), -1) for pair in pairs]
    longer = sorted(i for token, i in model["vocab"].items() if len(token) > 1 and token not in added)
    return made == longer


def load(path: str, special: bool) -> Callable[[str], list[int]]:
    """Text to ids. ``special``: do the file's added tokens in a text count as tokens?

    A plain byte-level BPE file whose merges are in the order of their ids is run by the merge ranks it implies, which gives the
    same ids several times faster (tested over all code points); any other file, and any text with a very long
    run of white space, is run whole by the tokenizers library.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

    @cache
    def library() -> Tokenizer:
        made = Tokenizer.from_file(path)
        made.encode_special_tokens = not special
        return made

    def encode_by_library(text: str) -> list[int]:
        return library().encode(text, add_special_tokens=False).ids

    model = {k: v for k, v in spec["model"].items() if v}
    if spec["normalizer"] or spec["pre_tokenizer"] != byte_level or set(model) != {"type", "vocab", "merges"}:
        return encode_by_library
    if not in_merge_order(model, set(added)):
        return encode_by_library
    letters = byte_of_letter()
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and _LONG_RUN.search(text):
            return encode_by_library(text)
        if special and any(t in text for t in added):
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    return encode


def encoder(path: str, special: bool = True) -> Callable[[str], list[int]]:
    return worker_state(("encoder", path, special), lambda: load(path, special))


def decoder(path: str) -> Callable[[list[int]], bytes]:
    """Ids to bytes, without the library's repair of broken characters."""

    def build() -> Callable[[list[int]], bytes]:
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        letters = byte_of_letter()
        table = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        return lambda ids: b"".join(map(table.__getitem__, ids))

    return worker_state(("decoder", path), build)
