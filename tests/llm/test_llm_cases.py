"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; and the methods on their own."""

import gzip
import hashlib
import io
import random
import textwrap
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_file
from tokenizers import Tokenizer, models

from corpusaudit.llm import (
    chat,
    common,
    decontamination,
    encoding,
    exact_dedup,
    license_scan,
    packing,
    quality_crf,
    simhash,
    substrings,
    unigram,
    warc,
)
from corpusaudit.session import shared_folder

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Columns of documents, and some whose names operators use themselves.
DOCS = "doc_id long, text string, lang string, row string, score double, version long, key string, spans string, n_words int"
LONG = "one two three four five six seven eight nine ten eleven twelve " * 30_000
TEXTS = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (5, LONG), (5, LONG), (5, "other"), (None, "a b"), (None, None), (7, "x" * 300_000), (8, " \n\t ")]


def frame(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return frame(spark, [])


def by_id(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- token counts --------------------------------------------------------------------------------------


def plain_unigram(pieces, text, unknown, known_bytes):
    """All segmentations by plain dynamic programming over starts, ties to the earlier start."""
    best = {0: (0, 0)}
    for start in range(len(text)):
        score, count = best[start]
        single = False
        for end in range(start + 1, len(text) + 1):
            if (piece := text[start:end]) in pieces:
                single |= end == start + 1
                total = score + pieces[piece]
                if end not in best or total > best[end][0]:
                    best[end] = (total, count + 1)
        if not single:
            total = score + unknown
            if start + 1 not in best or total > best[start + 1][0]:
                best[start + 1] = (total, count + (len(text[start].encode()) if known_bytes else 1))
    return best[len(text)]


def test_unigram_matches_brute_force_with_ties():
    rng = random.Random(3)
    for _ in range(300):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))): -rng.randint(0, 3) for _ in range(8)}
        vocabulary = unigram.Unigram(pieces, bytes_known=True)
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 12))) + "é" * rng.randint(0, 1)
        line = "▁" + text.replace(" ", "▁") if text else ""
        want = plain_unigram(pieces, line, vocabulary.unknown, True) if text else (0, 0)
        assert vocabulary.count(text) == want, (pieces, text)


def test_unigram_counts_as_the_tokenizers_do(spark):
    """The same pieces and scores in both tokenizer libraries, as a unigram model."""
    vocabulary = unigram.read_model(PIECES, as_unigram=True)
    model = model_file.ModelProto()
    with open(PIECES, "rb") as file:
        model.ParseFromString(file.read())
    library = Tokenizer(models.Unigram([(p.piece, p.score) for p in model.pieces], 0, True))
    plain = {p.piece: int(p.score) for p in model.pieces if p.type == 1}
    # sentencepiece adds in single precision; without the scores of -1e9 all sums of these texts are exact
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -32_000)
    mild = unigram.Unigram({p.piece: int(p.score) for p in model.pieces if p.type == 1}, bytes_known=True)
    flipped = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    for text in ["plain words", "Zwölf  Bögen\n\tund 漢字 😀!!", *[r["text"][:400] for r in rows]]:
        line = "▁" + text.replace(" ", "▁")
        assert vocabulary.count(text) == plain_unigram(plain, line, vocabulary.unknown, True)
        assert vocabulary.count(text)[1] == len(library.encode(line).ids)
        assert mild.count(text)[1] == len(flipped.encode(text))


def test_unigram_files_with_text_rules(tmp_path):
    """Character maps, white space rules and user-defined pieces, as the library counts them."""
    model = model_file.ModelProto()
    with open(PIECES, "rb") as file:
        model.ParseFromString(file.read())
    with pytest.raises(ValueError):
        unigram.read_model(PIECES)
    model.trainer_spec.model_type = 1
    # whole numbers, so that the library's sums in single precision are exact
    for p in model.pieces:
        p.score = max(p.score, -4_000) - 1
    rules = model_file.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    texts = ["plain  words ", " ﬁne Ａ\u3000b　ｃ", "", "   ", "x\ty\n\nz", "Zwölf 漢字 😀!!", "a​b", "12 ½ ①", "zzqz wörds Bögen Bogen zzq"]
    for case in range(5):
        made = model_file.ModelProto()
        made.CopyFrom(model)
        for own in ["wörd", "zzq", "Bögen"] if case == 4 else []:
            made.pieces.add(piece=own, score=0, type=4)
        spec = made.normalizer_spec
        if case in (0, 3):
            spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
        spec.remove_extra_whitespaces = case in (0, 1)
        made.trainer_spec.treat_whitespace_as_suffix = case == 2
        path = tmp_path / f"{case}.model"
        path.write_bytes(made.SerializeToString())
        vocabulary, library = unigram.read_model(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
        for text in texts:
            assert vocabulary.count(text)[1] == len(library.encode(text)), (case, text)


def test_unigram_long_and_missing(spark, docs, no_docs):
    got = {(r[0], r[1]) for r in unigram.token_counts(docs, PIECES, as_unigram=True).collect()}
    assert {(2, 0), (3, 0), (None, 0)} <= got and len(got) >= 8
    assert unigram.token_counts(docs, PIECES, as_unigram=True).count() == len(TEXTS)
    assert unigram.token_counts(no_docs, PIECES, as_unigram=True).collect() == []
    small = unigram.Unigram({"▁": -1, "a": -1}, bytes_known=False)
    assert small.count("axxa a") == (small.count("a")[0] + small.unknown * 2 - 1 - 2, 6)


# -- decontamination -----------------------------------------------------------------------------------


def test_wu_manber_matches_a_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        letters = [b"a", b"b", b"c"]
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for i in range(5)]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        got = set()
        for table in decontamination.searchers(items, 4):
            for first, ids in table.occurrences(words):
                got |= {(first, table.length, i) for i in ids}
        want = set()
        for item, text in items:
            w = text.encode().split()
            n = min(4, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                want |= {(p, n, item) for p in range(len(words) - n + 1) if words[p : p + n] == w[i : i + n]}
        assert got == want


def test_contamination_cases(spark, docs, no_docs):
    items = frame(spark, [(1, "Three FOUR, five"), (2, None), (3, "..."), (None, "a b"), (1, "three four five"), (10, "other"), (9, "other")], "item_id long, text string")
    got = by_id(decontamination.contamination(docs, items))
    assert len(got) == len(TEXTS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (1, 2, 2, 0, sha(""), True) in got and (2, 0, 0, 0, sha(""), False) in got
    assert (5, 1, 1, 2, sha("10,9"), True) in got
    assert got.count((5, 360_000, 90_000, 1, sha("1"), True)) == 2
    assert decontamination.contamination(no_docs, items).collect() == []
    assert all(not r[-1] for r in decontamination.contamination(docs, items.limit(0)).collect())
    assert decontamination.clean_documents(docs, items).columns == docs.columns


def test_larger_benchmarks_take_several_passes(spark, docs):
    items = frame(spark, [(i, f"w{i} three four five") for i in range(40)] + [(99, "three four five")], "item_id long, text string")
    once = decontamination.find_passages(docs, items).select("n_words", "hits", "items")
    split = decontamination.find_passages(docs, items, block_words=150).select("n_words", "hits", "items")
    assert by_id(once) == by_id(split)


# -- substring dedup -----------------------------------------------------------------------------------


def plain_removal(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, float("inf")), order(i))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < order(i):
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=repr)


def test_repeats_match_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 80))]
        if rows and rng.random() < 0.7:
            other = (rng.choice(rows)[1] or "").split()
            at, n = rng.randint(0, len(other)), rng.randint(0, 60)
            base[len(base) // 2 : len(base) // 2] = other[at : at + n]
        rows.append((rng.choice([i, i, i, None]), " ".join(base)))
    rows += [(90, "a " * 100), (91, "a " * 40), (91, "a " * 40), (92, None), (93, "")]
    for window, anchor in ((8, 3), (5, 5), (20, 4)):
        made = substrings.remove_repeats(frame(spark, rows), window, anchor).select("doc_id", "n_words", "n_removed", "kept_text")
        assert by_id(made) == plain_removal(rows, window), (window, anchor)


def test_window_anchors_depend_on_the_window_alone():
    rng = random.Random(9)
    words = [rng.choice("abcdefgh").encode() for _ in range(400)]
    whole = substrings.window_anchors(words, 12, 4)
    assert len(whole) == 389 and len(set(whole.tolist())) > 30
    for at in rng.sample(range(389), 40):
        assert substrings.window_anchors(words[at : at + 12], 12, 4).tolist() == [whole[at]]


def test_repeats_cases(spark, docs, no_docs):
    got = by_id(substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text"))
    assert len(got) == len(TEXTS) and (8, 0, 0, "") in got and (2, 0, 0, "") in got
    assert got.count((5, 360_000, 0, LONG.strip())) == 2
    assert substrings.remove_repeats(no_docs).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, window=5)


# -- license scan --------------------------------------------------------------------------------------


def test_license_cases(spark, docs, no_docs):
    rows = [
        (1, "x CC-BY cc by, éCC BY cc bya cc\nby 4.0"),
        (2, "All rights\n reserved. all RIGHTS reserved"),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "licensed under the apache" + " license" * 3),
        (5, "Kcc by"),
        (6, None),
        (7, "licensed under the\napache license"),
        (3, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r[0]: tuple(r)[1:] for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1] == (13, 3, 1, 9, "cc-by", "cc-by", 1.0)
    assert got[2] == (6, 2, 0, 3, "reserved", "reserved", 1.0)
    assert got[3][1:] == (1, 2, 2, "cc-by", "cc-by,cc-by-nc", 1.0)
    assert got[4] == (7, 0, None, None, "", "apache-2.0", 1.0)
    assert got[5] == (2, 0, None, None, "", "", 0.0)
    assert got[6] == (0, 0, None, None, "", "", 0.0)
    assert got[7] == (5, 0, None, None, "", "apache-2.0", 1.0)
    assert license_scan.scan(frame(spark, rows)).count() == len(rows)
    found = by_id(license_scan.scan(docs))
    assert len(found) == len(TEXTS) and max(r[1] for r in found) == 360_000 and {r[2:] for r in found} == {(0, None, None, "", "", 0.0)}
    assert license_scan.scan(no_docs).collect() == []


def wrapped(notice, width, mark=""):
    lines = textwrap.wrap(notice, width, break_long_words=False)
    return "".join(f"{mark}{line}\n" for line in lines)


#: How the notices stand in files.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction"""
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
LGPL = "This library is licensed under the GNU Lesser General Public License as published by the Free Software Foundation"


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark):
    filler = ["lorem", "ipsum", "dolor", "sit", "amet"]
    rows, want = [], {}
    for label, notice in (("mit", MIT), ("bsd", BSD), ("apache-2.0", APACHE), ("lgpl", LGPL)):
        words = notice.split()
        for width, mark in ((72, ""), (40, " * "), (20, "# "), (9, "// "), (10_000, "")):
            want[len(rows)] = label
            rows.append((len(rows), "x y z\n" * 40 + wrapped(notice, width, mark) + "and more\n" * 30))
        # the words of a notice, twelve others between each two: on one line, and one a line
        for gap in (" ", "\n"):
            want[len(rows)] = ""
            rows.append((len(rows), gap.join(w + gap + gap.join(filler * 3) for w in words)))
        # words of the notice far away from its rest do not help
        want[len(rows)] = ""
        rows.append((len(rows), " ".join([*words[:4], *filler * 40, *words[4:8], *filler * 40, *words[8:10]])))
    far = " ".join(w + " " + "word " * 300 for w in ("licensed", "under", "cc", "by"))
    want[len(rows)] = ""
    rows.append((len(rows), far))
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(frame(spark, rows)).collect()}
    assert {i: g for i, g in got.items() if want[i] not in (g, *g.split(","))} == {}
    assert all(got[i] == "" for i, w in want.items() if not w)


def test_similar_blocks_match_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(14)]
    templates = [(f"t{i}", " ".join(rng.sample(vocabulary, rng.randint(1, 9)))) for i in range(6)]
    rows = [(i, "\n".join(" ".join(rng.choice(vocabulary + ["zz"] * 12) for _ in range(rng.randint(0, 40))) for _ in range(4))) for i in range(60)]
    for threshold in (0.5, 0.75, 1.0):
        found = license_scan.similar_blocks(frame(spark, rows), templates, threshold)
        got = {(r["doc_id"], r["label"]): r["c"] for r in found.groupBy("doc_id", "label").agg(F.max("containment").alias("c")).collect()}
        want = {}
        for i, text in rows:
            words = text.split()
            for label, notice in templates:
                t = set(notice.split())
                best = max((len(t & set(words[j : j + 2 * len(t)])) / len(t) for j in range(len(words))), default=0)
                if best >= threshold - 1e-9:
                    want[i, label] = best
        assert got == want and len(got) > 20


# -- packing -------------------------------------------------------------------------------------------


def test_best_fit():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 5, 8)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    # two open bins (5 and 8): neither fits, the fuller one closes
    assert bins.place(9) == (4, 0) and bins.place(2) == (2, 5)
    assert bins.closed == 1
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_bounded_bins_close_and_still_fill():
    """Far more pieces than may be open: bins close, and sequences stay within 1 % of the least number."""
    rng = random.Random(5)
    lengths = [n for _ in range(60_000) for _, n in packing.cut(min(40_000, int(rng.lognormvariate(6.5, 1.0)) + 1), 2048)]
    bins = packing.BestFit(2048, packing.OPEN_BINS)
    placed = packing.place_runs(bins, lengths)
    assert bins.closed > 100 and bins.open <= packing.OPEN_BINS
    assert bins.made <= 1.01 * -(-sum(lengths) // 2048)
    filled = {}
    for (number, offset), n in zip(placed, lengths):
        filled.setdefault(number, []).append((offset, n))
    for parts in filled.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 2048


def test_tasks_pack_millions_of_pieces(spark):
    """One task takes a long stream; the bound on open bins holds whatever its length."""
    pieces = spark.range(300_000).selectExpr("id", "cast(1 + pmod(xxhash64(id), 1500) as bigint) length")
    made = packing.assign(pieces, least=1_000_000)
    sums = made.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    row = sums.agg(F.count("*").alias("made"), F.max("end").alias("end"), F.sum("n").alias("n"), F.count_if(F.col("n") != F.col("end")).alias("gaps")).first()
    assert row.end <= 2048 and row.gaps == 0 and row.made <= 1.01 * row.n / 2048
    assert made.select(F.shiftright("sequence_id", 40)).distinct().count() == 1


def test_ids_are_those_of_the_library():
    library = Tokenizer.from_file(BPE)
    encode = encoding.load(BPE, special=True)
    rng = random.Random(0)
    texts = ["", " ", "a<|endoftext|>b", "\u0085᠎  x", "it's  I'LL\n\n\n we'll", " " * 5000, "é" * 5000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD7FF), rng.randrange(0xE000, 0x110000)])) for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = True
    assert encoding.load(BPE, special=False)("a<|endoftext|>b") == library.encode("a<|endoftext|>b", add_special_tokens=False).ids
    other = public_tokenizers.path("word_bpe_49k.json")
    assert encoding.load(other, True)("Some Words") == Tokenizer.from_file(other).encode("Some Words", add_special_tokens=False).ids


def test_files_with_other_merge_orders_go_to_the_library():
    vocab = {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4}
    assert encoding.in_merge_order({"vocab": vocab, "merges": ["a b", "b c"]}, set())
    assert encoding.in_merge_order({"vocab": vocab | {"<x>": 5}, "merges": [["a", "b"], ["b", "c"]]}, {"<x>"})
    assert not encoding.in_merge_order({"vocab": vocab, "merges": ["b c", "a b"]}, set())
    assert not encoding.in_merge_order({"vocab": vocab | {"ca": 5}, "merges": ["a b", "b c"]}, set())


def test_other_merge_orders_keep_the_ids_of_the_library(tmp_path):
    """A plain byte-level file whose ids are not in the order of its merges."""
    import json

    with open(BPE, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    library, encode = Tokenizer.from_file(str(tmp_path / "other.json")), encoding.load(str(tmp_path / "other.json"), special=True)
    for text in ("the other merges", "naïve 日本"):
        assert encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_white_space_keeps_its_ids(spark):
    library = Tokenizer.from_file(BPE)
    texts = [f"a{c * 1_000_001}{end}" for c, end in ((" ", "b"), ("\n", ""), ("\t", "<|endoftext|>"), ("\u00a0", "b"), (" \n", "b"))]
    for special in (True, False):
        library.encode_special_tokens = not special
        for text in texts:
            assert encoding.load(BPE, special)(text) == library.encode(text, add_special_tokens=False).ids
    packed = packing.pack(frame(spark, [(1, texts[0]), (2, "a b")]), BPE).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 1) == len(library.encode(texts[0]).ids) + 1
    assert {r["doc_id"] for r in packed} == {1, 2}
    turns = spark.createDataFrame([(1, 0, "user", texts[0]), (1, 1, "assistant", texts[1])], "conv_id long, turn int, role string, text string")
    said = chat.conversation_digests(chat.format_conversations(turns, BPE), BPE).collect()
    assert [(r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in said] == [(2, len(texts[1]), hashlib.sha256(texts[1].encode()).hexdigest())]


def test_packing_cases(spark, docs, no_docs):
    rows = packing.pack(docs, BPE).collect()
    empty = [r for r in rows if r["doc_id"] in (2, 3)]
    assert [(r["length"], r["piece"]) for r in empty] == [(1, 0)] * 2
    assert sum(r["doc_id"] == 5 and r["piece"] == 1 for r in rows) == 2
    assert packing.pack(no_docs, BPE).collect() == []
    pieces = packing.token_pieces(docs.filter("doc_id = 4 OR doc_id IS NULL"), BPE, with_ids=True)
    whole = packing.sequences(packing.assign(pieces)).collect()
    assert [r["length"] for r in whole] == [sum(len(encoding.load(BPE, True)(t)) + 1 for t in ("a b", "a b", ""))]
    assert len(whole[0]["ids"]) == whole[0]["length"]


# -- archives ------------------------------------------------------------------------------------------


def test_archive_cases(spark):
    big, trap = "é" * 600, "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40
    rows = [(1, "u1", big), (2, "u\r\nX: y", big), (3, None, big), (4, "", None), (5, "u", ""), (6, "u", trap), (7, "u", trap), (7, "u", trap), (None, "u", big), (None, None, None), (8, "s", "x" * 999), (9, "s", "x" * 999)]
    pages = frame(spark, rows, "page_id long, url string, html string, digest string, revisit string")
    path = shared_folder(spark, "archives")
    warc.write_archives(pages, path, per_file=3)
    read = warc.with_referred_page(warc.read_archives(spark, path))
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read.collect()), key=repr)
    want = [(1, "revisit", 3, 1200), (2, "revisit", 3, 1200), (3, "response", None, 1200), (4, "response", None, 0), (5, "response", None, 0)]
    want += [(6, "revisit", 7, len(trap)), *[(7, "response", None, len(trap))] * 2, (8, "response", None, 999), (9, "response", None, 999)]
    want += [(None, "response", None, 0), (None, "revisit", 3, 1200)]
    assert got == sorted(want, key=repr)
    payloads = {r["page_id"]: r["payload"] for r in read.filter("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert payloads == {3: big, 4: "", 5: "", 7: trap, 8: "x" * 999, 9: "x" * 999}
    path = shared_folder(spark, "archives")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).collect() == []


def test_damaged_archives_are_refused(spark):
    record = warc.records(frame(spark, [(1, "u", "abc")], "page_id long, url string, html string")).first()[0]
    data = (record + warc.END).encode()
    assert next(warc.parse(io.BytesIO(data)))["payload"] == "abc"
    for broken in (data.replace(b"abc", b"abd"), data[:-1], b"x" + data, data[:30]):
        with pytest.raises(ValueError):
            list(warc.parse(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(broken)))))


# -- exact dedup ---------------------------------------------------------------------------------------


def test_grace_with_little_memory():
    rng = random.Random(1)
    rows = [(f"{rng.randrange(300)}" * 20, 1, (rng.choice([None, rng.randrange(10**6)]), {"x": i})) for i in range(3000)]
    for limit, merge in ((10**9, exact_dedup.grace), (3000, exact_dedup.grace), (1, exact_dedup.grace)):
        got = {t: (n, b[0]) for t, n, b in merge(rows, limit)}
        want = {}
        for t, n, (k, _) in rows:
            count, best = want.get(t, (0, None))
            want[t] = (count + 1, k if best is None or (k is not None and k > best) else best)
        assert got == want
    parts = list(exact_dedup.local_merge(rows, 3000))
    assert sum(n for _, n, _ in parts) == len(rows) and len(parts) < len(rows)


def test_copy_group_cases(spark, docs, no_docs):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = by_id(exact_dedup.copy_groups(docs))
    want = [(1, 4, 3, False, sha("a b")), (4, 4, 3, True, sha("a b")), (None, 4, 3, False, sha("a b"))]
    want += [(2, 3, 3, False, sha("")), (3, 3, 3, True, sha("")), (None, 3, 3, False, sha(""))]
    want += [(5, 5, 2, True, sha(LONG)), (5, 5, 2, False, sha(LONG)), (5, 5, 1, True, sha("other"))]
    want += [(7, 7, 1, True, sha("x" * 300_000)), (8, 8, 1, True, sha(" \n\t "))]
    assert got == sorted(want, key=repr)
    assert exact_dedup.copy_groups(no_docs).collect() == []
    one = exact_dedup.keep_one(docs)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == [3, 4, 5, 5, 7, 8]
    only_null = exact_dedup.keep_one(docs.filter("doc_id = 2")).collect()
    assert only_null[0]["text"] is None


# -- quality -------------------------------------------------------------------------------------------


def test_long_chains_in_blocks_are_line_by_line():
    rng = np.random.default_rng(3)
    for docs, longest in ((1, 2), (3, 7), (2, 300), (4, 1001)):
        node = np.zeros((docs, longest, 2))
        counts = rng.integers(1, longest + 1, docs)
        counts[0] = longest
        here = np.arange(longest)[None, :] < counts[:, None]
        node[:, :, 1] = np.where(here, rng.normal(0, 4, (docs, longest)), 0)
        moves = rng.normal(0, 2, (2, 2))
        for got, want in zip(quality_crf.in_blocks(node, here, moves), quality_crf.line_by_line(node, here, moves)):
            assert np.allclose(got[here], want[here], rtol=1e-9, atol=1e-9)


def test_a_document_of_very_many_lines():
    """A hundred thousand lines in well under the time that a step per line takes."""
    rng = np.random.default_rng(4)
    potential, moves = rng.normal(0, 2, 100_000), rng.normal(0, 1, (2, 2))
    start = time.process_time()
    good = quality_crf.marginals(potential, moves, np.array([100_000]))
    assert time.process_time() - start < 1 and ((good > 0) & (good < 1)).all()
    # far from its ends a chain does not feel them
    assert np.allclose(good[200:300], quality_crf.marginals(potential[:500], moves, np.array([500]))[200:300])


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([1, 4, 3])
    potential, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    got = quality_crf.marginals(potential, moves, counts)
    at = 0
    for n in counts:
        weights = np.zeros(2**n)
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weights[code] = np.exp(sum(potential[at + i] for i in range(n) if y[i]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        for i in range(n):
            assert np.isclose(got[at + i], weights[[c for c in range(2**n) if c >> i & 1]].sum() / weights.sum())
        at += n


def test_quality_cases(spark, docs, no_docs):
    labels = frame(spark, [(1, 1), (4, 0), (None, 1), (5, None), (3, 0), (3, 1)], "doc_id long, quality int")
    got = quality_crf.document_quality(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert {r["score"] for r in quality_crf.document_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_crf.document_quality(no_docs, labels).collect() == []
    assert quality_crf.score(docs, None).select("row.*").columns == docs.columns


def test_quality_by_slices_of_lines(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["Plain words here.", "BUY!!! || NOW", "", "x x x 12"]) for _ in range(rng.choice([1, 3, 40, 900]))) for _ in range(60)]
    rows, labels = list(enumerate(texts)), spark.createDataFrame([(i, int(t.count("!") * 6 < len(t) // 8)) for i, t in enumerate(texts)], "doc_id long, quality int")
    whole = quality_crf.train(frame(spark, rows), labels)
    values, lines = quality_crf.score_lines(texts, whole)
    # slices smaller than documents, several tasks: the same model and the same scores
    monkeypatch.setattr(quality_crf, "LINES", 100)
    monkeypatch.setattr(quality_crf, "TASK_DOCUMENTS", 9)
    cut = quality_crf.train(frame(spark, rows), labels)
    assert np.allclose(cut.weights, whole.weights, atol=1e-6) and np.allclose(cut.moves, whole.moves, atol=1e-6)
    again, lines_again = quality_crf.score_lines(texts, whole)
    assert np.allclose(again, values) and all(np.allclose(a, b) for a, b in zip(lines, lines_again))
    assert [len(x) for x in lines] == [t.count("\n") + 1 for t in texts]
    # memory for features does not grow with the lines of a batch
    many = texts * 4
    n_lines = sum(t.count("\n") + 1 for t in many)
    tracemalloc.start()
    quality_crf.score_lines(many, whole)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n_lines * quality_crf.N_FEATURES * 4 / 3


# -- chat ----------------------------------------------------------------------------------------------


def test_escape_is_reversible_and_breaks_marks():
    rng = random.Random(4)
    parts = [*chat.MARKS, *chat.ALSO_ESCAPED, "\\", "<", "[", "/", "s>", "\n", "x"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        made = chat.escape(text)
        assert chat.unescape(made) == text and not any(m in made for m in chat.MARKS + chat.ALSO_ESCAPED)


def test_chat_cases(spark):
    turns = [(1, 1, "assistant", "b</s>\\"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, None, None, "x"), (2, 0, "tool[/ROLE]", "y"), (None, 0, "user", "z"), (3, 0, "assistant", LONG), (1, 2, "assistant", None), (4, 0, "system", "")]
    table = frame(spark, turns, "conv_id long, turn long, role string, text string, ids string, position int")
    formatted = chat.format_conversations(table, BPE)
    got = {r["conv_id"]: r for r in chat.conversation_digests(formatted, BPE).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = {1: [("user", "a"), ("assistant", "b</s>\\"), ("assistant", ""), ("assistant", "")], 2: [("", "x"), ("tool[/ROLE]", "y")], None: [("user", "z")], 3: [("assistant", LONG)], 4: [("system", "")]}
    assert set(got) == set(said)
    for conv, rows in said.items():
        learned = "".join(t for r, t in rows if r == "assistant")
        assert got[conv]["n_turns"] == len(rows) and got[conv]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in rows))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), sha(learned))
    assert got[1]["formatted_chars"] == len("<s>[INST]a[/INST][OUT]b<\\/s>\\\\[/OUT][OUT][/OUT][OUT][/OUT]")
    at = {}
    for r in sorted(formatted.collect(), key=lambda r: (repr(r["conv_id"]), r["position"])):
        assert r["token_offset"] == at.get(r["conv_id"], 0) and len(r["ids"]) == len(r["loss_mask"])
        at[r["conv_id"]] = r["token_offset"] + len(r["ids"])
    assert chat.conversation_digests(chat.format_conversations(table.limit(0), BPE), BPE).collect() == []


# -- near duplicates -----------------------------------------------------------------------------------


def near_fingerprints(seed, n):
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(3 * n):
        values.append(rng.choice(values) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    return sorted(set(values))


@pytest.mark.parametrize("limit", [10**6, 64])
def test_links_connect_what_is_near(spark, limit):
    values = near_fingerprints(7, 150)
    # a dense group that shares all but its last bits
    values = sorted(set(values) | {values[0] ^ m for m in range(64)})
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r["fp"] % 2**64: r["root"] for r in simhash.classes(prints, 2).collect()} if limit > 64 else None
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(prints, 2, limit).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)

    def groups(pairs):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
        return {v: find(v) for v in values}

    near = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2]
    assert groups(links) == groups(near)
    if roots:
        want = groups(near)
        assert len(set(roots.values())) == len(set(want.values()))
        assert len({(roots[v], want[v]) for v in values}) == len(set(want.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1 and got[0] != got[1000]
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_group_cases(spark, docs, no_docs):
    got = by_id(simhash.near_groups(docs))
    assert len(got) == len(TEXTS)
    assert (2, "0" * 16, 2) in got and (3, "0" * 16, 2) in got and (8, "0" * 16, 2) in got and (None, "0" * 16, 2) in got
    assert sum(r[0] == 5 and r[2] == 5 for r in got) == 3
    assert simhash.near_groups(no_docs).collect() == []
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 5, 7]
    assert simhash.keep_first(no_docs).collect() == []


def test_map_rows_keeps_clashing_columns(spark, docs):
    made = common.map_rows(docs, ["text"], lambda: lambda t: [__import__("pyarrow").array([len(x or "") for x in t])], [common.field("n", "bigint")])
    assert made.select("row.*").columns == docs.columns and made.filter(F.col("n") > 0).count() == 8


# -- pipeline ------------------------------------------------------------------------------------------


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns, empty tables."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, hits string, piece int"
    rows = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (5, LONG), (5, LONG), (5, "other"), (None, "a b"), (None, None), (8, " \n\t ")]
    want = {"exact_dedup": [3, 4, 5, 5, 8], "near_dedup": [1, 2, 5, 5], "decontamination": [1, 2, 3, 4, 5, 5, 5, 8, None, None]}
    for name, stage in corpus_pipeline.STAGES:
        docs = frame(spark, rows, schema)
        made = stage(spark, docs, "/root/testdata/sf0.001")
        got = made.collect()
        if name != "packing":
            assert made.columns == docs.columns, name
            assert {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()}, name
        if name in want:
            assert sorted((r["doc_id"] for r in got), key=repr) == sorted(want[name], key=repr), name
        if name == "packing":
            assert sum(r["piece"] == 0 for r in got) == len(rows)
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").collect() == [], name
