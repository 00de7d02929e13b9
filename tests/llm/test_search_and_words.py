"""Ranked search, language identification and spelling variants: the methods on their own, and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusaudit.llm import ball_search, language_id, spelling
from corpusaudit.llm.common import plain_words

#: Columns of documents, and some whose names operators use themselves.
DOCS = "doc_id long, text string, lang string, row string, score double, rank int, key string, n long, word string, query int, part int, best string"
ITEMS = "item_id long, text string, key string, rank int, score double, query int"


def frame(spark, rows, schema):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


# -- ranked search -------------------------------------------------------------------------------------


def random_vectors(rng, rows, vocabulary, copies=0.3):
    made = []
    for _ in range(rows):
        if made and rng.random() < copies:
            made.append(made[rng.randrange(len(made))])
        else:
            made.append({t: rng.randrange(1, 10**rng.randrange(1, 10)) for t in rng.sample(range(vocabulary), rng.randrange(1, 12))})
    starts = np.cumsum([0] + [len(m) for m in made])
    terms = np.array([t for m in made for t in sorted(m)], np.int64)
    values = np.array([m[t] for m in made for t in sorted(m)], np.int64)
    return made, starts, terms, values


def nodes(node):
    yield node
    for child in node.children or ():
        yield from nodes(child)


@pytest.mark.parametrize("seed", range(8))
def test_tree_finds_what_scoring_everything_finds(seed):
    rng = random.Random(seed)
    made, starts, terms, values = random_vectors(rng, rng.choice([1, 5, 40, 300]), rng.choice([12, 60]))
    keys = np.array([rng.randrange(50) for _ in made])
    tree = ball_search.BallTree(starts, terms, values, leaf_rows=rng.choice([1, 4, 16]))
    assert sorted(tree.order) == list(range(len(made)))
    for _ in range(20):
        query = {t: rng.randrange(1, 4) for t in rng.sample(range(80), rng.randrange(1, 9))}
        scores = [sum(c * m.get(t, 0) for t, c in query.items()) for m in made]
        k, floor = rng.choice([1, 3, 10]), rng.choice([0, 0, sorted(scores)[len(scores) // 2]])
        ids = np.array(sorted(query), np.int64)
        found = tree.search(ids, np.array([query[t] for t in ids], np.int64), k, floor, keys)
        want = sorted(((-s, int(keys[i])) for i, s in enumerate(scores) if s >= max(1, floor)))[:k]
        assert [(-s, int(keys[r])) for s, r in found] == want
        assert all(scores[r] == s for s, r in found)


def test_balls_hold_their_documents():
    made, starts, terms, values = random_vectors(random.Random(5), 200, 40)
    tree = ball_search.BallTree(starts, terms, values, leaf_rows=4)
    dense = np.zeros((len(made), 40))
    for i, m in enumerate(made):
        dense[i, list(m)] = list(m.values())
    dense = dense[:, tree.vocabulary]
    for node in nodes(tree.root):
        rows = dense[tree.order[node.first : node.end]]
        centre = node.centre.astype(np.float64)
        assert (np.sqrt(((rows - centre) ** 2).sum(axis=1)) <= node.radius).all()
        assert (rows <= centre + node.reach.astype(np.float64)).all()


def test_search_leaves_subtrees_out():
    """Two kinds of documents that share no term: a query for one kind does not score the other."""
    rng = random.Random(1)
    made = [{t: rng.randrange(900, 1000) for t in rng.sample(range(k * 50, k * 50 + 50), 30)} for k in (0, 1) for _ in range(256)]
    starts = np.cumsum([0] + [len(m) for m in made])
    tree = ball_search.BallTree(starts, np.array([t for m in made for t in m]), np.array([v for m in made for v in m.values()]), leaf_rows=8)
    stats = {}
    assert len(tree.search(np.arange(5), np.ones(5, np.int64), 3, 0, np.arange(512), stats)) == 3
    assert stats["rows"] <= 256


def plain_ranking(docs, items, k):
    """docs: rows (id, text) in any number, items: distinct (id, text)."""
    counts = [(d, Counter(plain_words(t or ""))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // total
            score = 0
            for t in plain_words(text or ""):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, math.inf if d is None else d))
        for rank, (score, d) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if d == math.inf else d, -score))
    return sorted(out, key=repr)


LETTERS = ["Ab", "b", "c", "d", "e-f", "g", "h", "ä", "Ä", "9"]


@pytest.mark.parametrize("block_terms, seeds", [(50_000, 16), (4, 2)])
def test_ranking_of_odd_rows(spark, block_terms, seeds):
    rng = random.Random(3)
    said = [" ".join(rng.choices(LETTERS, k=rng.randrange(1, 9))) for _ in range(120)]
    docs = [(i, t) for i, t in enumerate(said)] + [(7, said[7]), (500, said[0]), (501, said[0]), (None, said[0]), (None, None), (502, None), (503, ""), (504, "!?"), (505, "c " * 200_000 + "Ab")]
    items = [(1, "Ab c"), (2, "ab  C c"), (3, None), (4, ""), (5, "nowhere"), (6, "b"), (7, "b"), (None, "d g"), (8, "h " * 40)]
    found = ball_search.ranked(
        frame(spark, docs, DOCS), frame(spark, [*items, (6, "b")], ITEMS), k=6, block_terms=block_terms, seeds=seeds
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_ranking(docs, items, 6)


def test_ranking_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")], DOCS), frame(spark, [(1, "a")], ITEMS)
    assert ball_search.ranked(docs.limit(0), items).collect() == []
    assert ball_search.ranked(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in ball_search.ranked(docs, items).collect()] == [(1, 1, 1)]


# -- languages -----------------------------------------------------------------------------------------


def plain_subwords(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return [g for w in words for size in range(1, 5) for g in grams(f" {w} ", size)]


def grams(word, size):
    made = [word[i : i + size] for i in range(len(word) - size + 1)]
    return [g for g in made if g != " "]


def test_subwords():
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choices("abÄé1 .,\n_ß日", k=rng.randrange(0, 60)))
        counts, lettered = language_id.subword_counts(text)
        want = Counter()
        # a border between two words is the last symbol of one and the first of the next
        for g in plain_subwords(text):
            made = 0
            for c in g:
                made = (made * 1_000_003 + (0 if c == " " else ord(c))) % 2**64
            want[int(language_id.bucket_of(np.array([made], np.uint64), len(g))[0])] += 1
        assert lettered == bool(re.search(r"[^\W\d_]", text))
        assert {b: n for b, n in enumerate(counts) if n} == want


def test_long_texts_are_read_whole(monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 9))) for _ in range(2000))
    whole = language_id.subword_counts(text)[0]
    monkeypatch.setattr(language_id, "SLICE", 64)
    assert (language_id.subword_counts(text)[0] == whole).all()


def test_rejection_threshold():
    scores, right = np.array([0.9, 0.8, 0.8, 0.7, 0.6, 0.5]), np.array([True, True, True, False, True, False])
    assert language_id.least_accepted(scores, right, 0.0) == 0.8
    assert language_id.least_accepted(scores, right, 0.2) == 0.6
    assert language_id.least_accepted(scores, right, 0.25) == 0.6
    assert language_id.least_accepted(scores, ~right, 0.0) == 1.0


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, (4000, 3))
    shares = language_id.softmax(z)
    wanted = np.array([rng.choice(3, p=p) for p in shares])
    assert language_id.temperature(z * 4, wanted) == pytest.approx(0.25, rel=0.15)


def test_languages_of_odd_rows(spark):
    rng = random.Random(8)
    made = {"xx": "aeiou", "yy": "krstp"}
    docs = [(i, " ".join("".join(rng.choices(made[lang], k=4)) for _ in range(20)), lang) for i in range(60) for lang in (["xx", "yy"][i % 2],)]
    odd = [(100, None, "xx"), (101, "", "yy"), (102, "12 !?", "xx"), (103, "aeio ouie", None), (None, "krst tsr", "xx"), (104, "rstp " * 100_000, None), (104, "rstp", None)]
    rows = language_id.document_languages(frame(spark, docs + odd, DOCS), sample=50).collect()
    assert len(rows) == len(docs) + len(odd)
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert all(found[i] == [lang] for i, _, lang in docs)
    assert found[100] == found[101] == found[102] == ["und"]
    assert found[103] == ["xx"] and found[None] == ["yy"] and found[104] == ["yy", "yy"]
    held = {r["doc_id"]: r["held_out"] for r in rows}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items() if i is not None) and held[None]
    assert all(r["score"] == 0 and not r["accepted"] for r in rows if r["lang_pred"] == "und")


def test_languages_without_anything_to_learn(spark):
    docs = frame(spark, [(1, "abc", None), (2, None, "en")], DOCS)
    assert {r["lang_pred"] for r in language_id.document_languages(docs).collect()} == {"und"}
    assert language_id.document_languages(docs.limit(0)).collect() == []
    one = frame(spark, [(i, "abc def", "en") for i in range(20)], DOCS)
    assert {r["lang_pred"] for r in language_id.document_languages(one).collect()} == {"en"}


# -- spelling variants ---------------------------------------------------------------------------------


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", range(4))
def test_position_index(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 7))).encode() for _ in range(rng.choice([3, 90, 400]))})
    index = spelling.PositionIndex(words)

    def at(bits):
        return [w for k, w in enumerate(words) if bits >> k & 1]

    for query in [*words, b"", b"abcabcabcabc", b"x", b"aaaaaaaa"]:
        for start in (0, 2, len(query)):
            shorter, replaced, longer, same = index.near(query, start)
            want = [w for w in words if one_error(w, query)]
            assert sorted(at(shorter) + at(replaced) + at(longer)) == want
            assert all(len(w) == len(query) - 1 for w in at(shorter)) and all(len(w) == len(query) for w in at(replaced))
            if want:
                assert [w for w in want if same >> words.index(w) & 1] == [w for w in want if w.startswith(query[:start])]


def plain_variants(texts, least=5, occurrences=3, ratio=2, divisor=97):
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lowered)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % divisor == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least
    words = {w: n for w, n in counts.items() if n >= occurrences}
    near = {w: [v for v in words if one_error(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell_words", [20_000, 7])
def test_variants_against_all_pairs(spark, cell_words):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abÉ", k=rng.randrange(4, 8))) for _ in range(150)]
    texts = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(150)], k=200))) for i in range(12)]
    texts += [(None, "abbab, ABBAB-abbab"), (None, None), (70, None), (71, ""), (72, "×÷×÷× ×÷×÷× ×÷×÷× ÷÷×÷×"), (72, "q" * 3000 + " " + ("q" * 3000 + "z ") * 3)]
    texts += [(73, "日本abbab日 abbab́ abb\tab")]
    found = spelling.variant_groups(frame(spark, texts, DOCS), divisor=11, cell_words=cell_words)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_variants(texts, divisor=11)


def test_forms_are_followed_to_the_last(spark):
    steps = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    texts = [(1, " ".join(w for k, w in enumerate(steps) for _ in range(3 * 2**k)))]
    rows = spelling.variant_groups(frame(spark, texts, DOCS), divisor=10**12).collect()
    assert {r["root"] for r in rows} == {steps[-1]} and len(rows) == len(steps)


def test_words_of_long_texts(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abé .", [5, 5, 2, 2, 1], k=5000))

    def counted():
        total = Counter()
        for word, n in spelling.document_words(5, text, 2, 7):
            total[word] += n
        return total

    whole = counted()
    monkeypatch.setattr(spelling, "SLICE", 50)
    assert counted() == whole and len(whole) > 100


def test_variants_of_empty_tables(spark):
    docs = frame(spark, [(1, "abc")], DOCS)
    assert spelling.variant_groups(docs.limit(0)).collect() == []
    assert spelling.variant_groups(docs).collect() == []
    with pytest.raises(ValueError):
        spelling.variant_groups(docs, ratio=1)
