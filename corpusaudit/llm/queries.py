"""The registered queries of this package, and the SQL they must equal where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.checks.registry import Query, Runner, table
from corpusaudit.llm import (
    ball_search,
    chat,
    decontamination,
    exact_dedup,
    language_id,
    license_scan,
    packing,
    quality_crf,
    simhash,
    spelling,
    substrings,
    unigram,
    warc,
)
from corpusaudit.llm.common import kept
from corpusaudit.session import shared_folder

QUERIES: dict[str, Query] = {}

#: A-Z and what they become, and words of letters, digits and non-ASCII characters.
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = r"regexp_extract_all(" + LOWERED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Fixed value: what the chat template escapes with one character more.
ESCAPED = r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[OUT\]|\[/OUT\]|\[ROLE\]|\[/ROLE\]|<\|endoftext\|>"


def query(sql: str | None = None):
    def register(fn: Runner) -> Runner:
        QUERIES[fn.__name__] = Query(fn.__name__, fn, sql)
        return fn

    return register


def load_queries() -> dict[str, Query]:
    return dict(QUERIES)


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under a unigram vocabulary of 32,000: the pieces and scores of a file of merges."""
    return unigram.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), as_unigram=True)


@query(
    f"""
    WITH item_words AS (SELECT item_id, {PLAIN_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
    windows AS (
        SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
        FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
              FROM item_words WHERE len(w) > 0)
    ),
    doc_words AS (SELECT doc_id, {PLAIN_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    places AS (
        SELECT d.doc_id, d.i, l.n, array_to_string(list_slice(d.w, d.i, d.i + l.n - 1), ' ') AS win
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc_words) d
        JOIN (SELECT DISTINCT n FROM windows) l ON d.i + l.n - 1 <= len(d.w)
    ),
    found AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN windows w ON w.n = p.n AND w.win = p.win),
    hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY 1),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY 1
    )
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a 10-word window of a benchmark item."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""
    WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 49, 0) + 1)) AS i FROM words)
    ),
    later AS (SELECT w.doc_id, w.i FROM windows w JOIN (SELECT h, min(doc_id) AS source FROM windows GROUP BY h) m USING (h)
              WHERE w.doc_id > m.source),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM later),
    placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
    left_over AS (
        SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS t
        FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY 1
    ),
    n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(l.t, '')) AS kept_sha256
    FROM words d LEFT JOIN n USING (doc_id) LEFT JOIN left_over l USING (doc_id)
    """
)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that an earlier document also holds."""
    made = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _license_sql() -> str:
    """Base phrases by word position; templates by the share of their n words in the best 2n consecutive words, pair by pair."""
    sets = ", ".join(
        f"('{label}', {license_scan.template_words(notice)!r})" for label, notice in license_scan.TEMPLATES
    )
    phrases = ", ".join(f"({p.split(' ')!r}, '{label}')" for p, label in license_scan.PHRASES.items())
    return f"""
    WITH phrases(p, label) AS (VALUES {phrases}),
    templates(label, t) AS (VALUES {sets}),
    words AS (SELECT doc_id, {PLAIN_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    places AS (
        SELECT d.doc_id, d.i - 1 AS pos, p.label
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) d
        JOIN phrases p ON d.w[d.i] = p.p[1] AND list_slice(d.w, d.i, d.i + len(p.p) - 1) = p.p
    ),
    base AS (
        SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
        FROM places GROUP BY 1
    ),
    starts AS (
        SELECT d.doc_id, label, t, list_intersect(list_slice(d.w, i, i + {license_scan.STRETCH} * len(t) - 1), t) AS held
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) d JOIN templates ON list_contains(t, d.w[i])
    ),
    near AS (SELECT doc_id, label, max(len(held) / len(t)) AS c FROM starts WHERE len(held) >= ceil(0.9 * len(t) - 1e-9) GROUP BY ALL),
    named AS (SELECT doc_id, label FROM near UNION SELECT doc_id, label FROM places),
    all_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY 1),
    best AS (SELECT doc_id, max(c) AS c FROM near GROUP BY 1)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
           last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
    FROM words d LEFT JOIN base USING (doc_id) LEFT JOIN all_labels USING (doc_id) LEFT JOIN best USING (doc_id)
    """


@query(_license_sql())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    g AS (SELECT html, max(page_id) AS original, count(*) AS n FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY 1)
    SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
           CASE WHEN p.page_id < g.original THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN p.page_id < g.original THEN g.original END AS refers_to
    FROM p LEFT JOIN g USING (html)
    """
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives without repeated payloads, and read back."""
    path = shared_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc.with_referred_page(warc.read_archives(spark, path, payloads=False))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    """
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
    FROM documents d
    JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g
      ON coalesce(d.text, '') = g.t
    """
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by line labels of a conditional random field."""
    return quality_crf.document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    rf"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ),
    sized AS (
        SELECT *, regexp_replace(text, '({ESCAPED})', '\\\1', 'g') AS escaped, regexp_replace(role, '({ESCAPED})', '\\\1', 'g') AS name FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           (3 + sum(length(escaped) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 11 ELSE 17 + length(name) END))::BIGINT
               AS formatted_chars
    FROM sized GROUP BY conv_id
    """
)
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as masked token sequences, read back from the sequences."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    turns = turns.union(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema))
    formatted = kept(chat.format_conversations(turns, tokenizer), "formatted")
    return chat.conversation_digests(formatted, tokenizer)


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most two bits."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query(
    f"""
    WITH docs AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM (SELECT doc_id, {PLAIN_WORDS.format("text")} AS w FROM documents) WHERE len(w) > 0),
    total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
    asked AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({PLAIN_WORDS.format("text")}) AS t FROM benchmark) GROUP BY ALL),
    tf AS (
        SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM docs)
        WHERE t IN (SELECT t FROM asked) GROUP BY ALL
    ),
    weights AS (
        SELECT t, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS weight
        FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total
    ),
    parts AS (
        SELECT doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))) AS part
        FROM tf JOIN weights USING (t), total
    ),
    scores AS (SELECT item_id, doc_id, sum(c * part)::BIGINT AS score FROM asked JOIN parts USING (t) GROUP BY ALL)
    SELECT item_id, rank, doc_id, score
    FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scores WHERE score > 0)
    WHERE rank <= 10
    """
)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ball_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_id.document_languages(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH RECURSIVE crc_table AS (
        SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
    ),
    runs AS (
        SELECT doc_id, run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
        GROUP BY ALL
    ),
    hashed AS (
        SELECT run, n, xor(list_reduce(
            list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
            lambda c, b: xor(c // 256, (t)[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS h
        FROM (SELECT run, n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM runs), crc_table
    ),
    words AS (
        SELECT word, sum(n)::BIGINT AS n
        FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
        WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
    ),
    cut AS (
        SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
    ),
    pairs AS (
        SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
    ),
    best AS (
        SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs GROUP BY word
    ),
    forms AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
        FROM words w LEFT JOIN best USING (word)
    ),
    paths AS (
        SELECT word, word AS root, form AS next FROM forms
        UNION ALL SELECT p.word, f.word, f.form FROM paths p JOIN forms f ON p.next = f.word
    )
    SELECT f.word, f.form, p.root, f.n, f.n_near::BIGINT AS n_near, f.form_n
    FROM forms f JOIN paths p ON p.word = f.word AND p.next IS NULL
    """
)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent words they are variants of."""
    return spelling.variant_groups(table(spark, sf_dir, "documents"))
