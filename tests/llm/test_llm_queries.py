"""The package's queries against SQL, or against plain Python where SQL cannot say it, on the smallest tables."""

import importlib
import zlib

import public_tokenizers
import pytest
import xxhash
from compare import connect, difference
from tokenizers import Tokenizer

from corpusaudit.llm.queries import load_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = load_queries()


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, name):
    assert difference(QUERIES[name].run(spark, SF_DIR), connect(SF_DIR), QUERIES[name].sql) is None


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def check_packing(rows, texts, tokenizer, capacity=2048):
    """Pieces rebuild every document, sequences are gapless and within capacity, and few are used."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r["start"] == at and (r["length"] == capacity or r["piece"] == 0)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    least = -(-sum(r["length"] for r in rows) // capacity)
    assert len(by_seq) <= least * 1.005 + 1


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(QUERIES["op5_packing"].run(spark, SF_DIR).collect(), texts, tokenizer)


def plain_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words, word = [], ""
    for c in text.translate(table) + " ":
        if c in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, budget=2):
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {d: find(d) for d in ids}


def test_simhash(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op10_simhash"].run(spark, SF_DIR).collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == plain_components(prints)


def test_quality_on_held_out_documents(spark):
    made = QUERIES["op8_quality"].run(spark, "/root/testdata/sf0.01")
    rows = made.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.7)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95


def test_pipeline_stages_against_plain_python(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(pipeline.STAGES)
    kept = stages["quality"](spark, docs, SF_DIR)
    assert kept.columns == columns
    good = {r["doc_id"]: r for r in kept.collect()}
    predicted = {r["doc_id"] for r in QUERIES["op8_quality"].run(spark, SF_DIR).filter("predicted = 1").collect()}
    assert set(good) == predicted and all(good[d] == before[d] for d in good)

    kept = stages["exact_dedup"](spark, kept, SF_DIR)
    assert kept.columns == columns
    last = {}
    for d, r in good.items():
        last[r["text"]] = max(d, last.get(r["text"], -1))
    distinct = {r["doc_id"]: r for r in kept.collect()}
    assert set(distinct) == set(last.values()) and all(distinct[d] == before[d] for d in distinct)

    kept = stages["near_dedup"](spark, kept, SF_DIR)
    assert kept.columns == columns
    component = plain_components({d: plain_fingerprint(r["text"]) for d, r in distinct.items()})
    single = {r["doc_id"]: r for r in kept.collect()}
    assert set(single) == set(component.values()) and all(single[d] == before[d] for d in single)

    kept = stages["decontamination"](spark, kept, SF_DIR)
    assert kept.columns == columns
    hit = {r["doc_id"] for r in QUERIES["op2_decontamination"].run(spark, SF_DIR).filter("contaminated").collect()}
    clean = {r["doc_id"]: r for r in kept.collect()}
    assert set(clean) == set(single) - hit and all(clean[d] == before[d] for d in clean)

    rows = stages["packing"](spark, kept, SF_DIR).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(rows, {d: r["text"] for d, r in clean.items()}, tokenizer)
    whole = pipeline.load_queries()["pipeline"].run(spark, SF_DIR).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows}


def test_language_of_held_out_documents(spark, texts):
    """No SQL for it: the languages of documents the model has not seen."""
    rows = QUERIES["op12_language"].run(spark, SF_DIR).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").collect()}
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(unseen) > 20 and sum(unseen) >= 0.95 * len(unseen)
