"""Queries on dialogs: normalising, pairs, metrics, sampling, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit.checks.registry import query, table
from corpusaudit.operators import dialogs as dg
from corpusaudit.operators import quality

STRIPPED = r"regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')"
MESSAGES = f"""
messages AS (
  SELECT conv_id AS dialog, row_number() OVER w - 1 AS idx, role AS "from", {STRIPPED} AS text,
         CASE WHEN row_number() OVER w > 1 THEN row_number() OVER w - 2 END AS parent_idx,
         'set' || (conv_id % 5) AS dataset
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)"""


def messages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return dg.chain_rows(turns, "conv_id", "turn", "role", "text").withColumn(
        "dataset", F.concat(F.lit("set"), F.col("dialog") % 5)
    )


@query(
    f"""WITH {MESSAGES} SELECT dialog, idx, "from", text, coalesce(parent_idx, -1) AS parent_idx
    FROM messages"""
)
def dialog_messages(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "dialog", "idx", "from", "text", F.coalesce("parent_idx", F.lit(-1)).alias("parent_idx")
    )


@query(
    f"""WITH {MESSAGES}
    SELECT c.dialog, c.idx, p.text AS inputs, c.text AS targets
    FROM messages c JOIN messages p ON c.dialog = p.dialog AND c.parent_idx = p.idx
    WHERE c."from" = 'assistant' AND p."from" = 'user'"""
)
def supervised_pairs(spark, sf_dir):
    return dg.supervised_pairs_rows(messages(spark, sf_dir))


@query(
    f"""WITH {MESSAGES}
    SELECT c.dataset, c.dialog, c.idx, p.text AS inputs, c.text AS targets
    FROM messages c JOIN messages p ON c.dialog = p.dialog AND c.parent_idx = p.idx
    WHERE c."from" = 'assistant' AND p."from" = 'user'"""
)
def supervised_pairs_nested(spark, sf_dir):
    """The same pairs from dialogs stored as arrays."""
    folded = dg.fold_rows(
        messages(spark, sf_dir), F.concat(F.lit("set"), F.col("dialog") % 5)
    )
    return dg.supervised_pairs(folded, keep=("dataset", "dialog"))


@query(
    f"""WITH {MESSAGES}, sizes AS (SELECT dataset, dialog, count(*) AS turns FROM messages GROUP BY ALL),
    lens AS (
      SELECT dataset,
        round(sum(length(text)) FILTER ("from" = 'user') / count(*) FILTER ("from" = 'user'), 4) AS mean_inputs_length,
        round(sum(length(text)) FILTER ("from" <> 'user') / count(*) FILTER ("from" <> 'user'), 4) AS mean_targets_length,
        max(length(text)) FILTER ("from" = 'user') AS max_inputs_length,
        max(length(text)) FILTER ("from" <> 'user') AS max_targets_length,
        min(length(text)) FILTER ("from" = 'user') AS min_inputs_length,
        min(length(text)) FILTER ("from" <> 'user') AS min_targets_length
      FROM messages GROUP BY dataset),
    turns AS (
      SELECT dataset, count(*) AS num_dialogs, min(turns) AS min_dialog_turns,
             max(turns) AS max_dialog_turns, round(sum(turns) / count(*), 4) AS mean_dialog_turns
      FROM sizes GROUP BY dataset)
    SELECT * FROM lens JOIN turns USING (dataset)"""
)
def dialog_text_metrics(spark, sf_dir):
    return dg.text_metrics(messages(spark, sf_dir))


@query(
    """SELECT count(DISTINCT conv_id) AS dialogs, count(*) AS messages FROM conversations"""
)
def dialog_counts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id")
    return dg.dialog_counts(turns, "conv_id")


@query(
    """WITH d AS (SELECT DISTINCT conv_id AS dialog, 'set' || (conv_id % 5) AS dataset FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('7:' || dialog)) AS n FROM d)
    SELECT dialog, dataset FROM r WHERE n <= 6"""
)
def dialog_sample(spark, sf_dir):
    dialogs = (
        table(spark, sf_dir, "conversations")
        .select(F.col("conv_id").alias("dialog"))
        .distinct()
        .withColumn("dataset", F.concat(F.lit("set"), F.col("dialog") % 5))
    )
    return dg.sample_dialogs(dialogs, ["dataset"], F.col("dialog"), 6, seed=7)


@query(
    """WITH t AS (SELECT conv_id AS dialog, turn, text,
        CASE WHEN (turn + conv_id) % 3 = 0 THEN 'user' ELSE 'assistant' END AS "from" FROM conversations),
    l AS (SELECT *, coalesce(("from" <> lag("from") OVER w)::INT, 1) AS new FROM t
          WINDOW w AS (PARTITION BY dialog ORDER BY turn)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY dialog ORDER BY turn) AS run FROM l),
    m AS (SELECT dialog, run, "from", string_agg(text, chr(10) ORDER BY turn) AS text
          FROM r GROUP BY ALL)
    SELECT dialog, run::BIGINT AS run, "from", text,
           (sum(("from" = 'user')::INT) OVER (PARTITION BY dialog ORDER BY run))::BIGINT AS round
    FROM m"""
)
def dialog_chain_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn(
        "speaker",
        F.when((F.col("turn") + F.col("conv_id")) % 3 == 0, "user").otherwise("assistant"),
    )
    return dg.merge_speaker_runs(turns, "conv_id", "turn", "speaker", "text")


TREES = """
base AS (
  SELECT conv_id AS dialog, conv_id * 100 + turn AS id, turn, role AS "from", text,
         CASE WHEN turn = 0 THEN NULL
              WHEN (conv_id + turn) % 7 = 0 THEN conv_id * 100 + 99
              WHEN turn % 2 = 0 AND turn > 1 THEN conv_id * 100 + turn - 2
              ELSE conv_id * 100 + turn - 1 END AS parent
  FROM conversations
),
flags AS (
  SELECT b.*, (b.turn = 0 OR EXISTS (SELECT 1 FROM base p
          WHERE p.dialog = b.dialog AND p.id = b.parent AND p.turn < b.turn)) AS kept
  FROM base b
),
placed AS (
  SELECT *, sum(kept::INT) OVER (PARTITION BY dialog ORDER BY turn) - 1 AS idx,
         sum(kept::INT) OVER (PARTITION BY dialog) AS size
  FROM flags
)"""


@query(
    f"""WITH {TREES}
    SELECT c.dialog, c.idx::BIGINT AS idx,
           CASE WHEN c."from" = 'user' THEN 'user' ELSE 'assistant' END AS "from",
           coalesce(p.idx, -1)::BIGINT AS parent_idx
    FROM placed c LEFT JOIN placed p ON c.dialog = p.dialog AND c.parent = p.id
    WHERE c.kept AND c.size > 1"""
)
def message_trees(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    parent = (
        F.when(turn == 0, None)
        .when((conv + turn) % 7 == 0, conv * 100 + 99)
        .when((turn % 2 == 0) & (turn > 1), conv * 100 + turn - 2)
        .otherwise(conv * 100 + turn - 1)
    )
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        "text",
        (conv * 100 + turn).alias("id"),
        parent.alias("parent"),
        F.lit("en").alias("lang"),
    )
    return dg.tree_rows(rows, "conv_id", "id", "parent", "turn", "role", "text", "lang").select(
        "dialog", "idx", "from", F.coalesce("parent_idx", F.lit(-1)).alias("parent_idx")
    )


LINES = """
lines AS (
  SELECT doc_id AS file, unnest(range(len(parts))) AS line_no, unnest(parts) AS raw
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
),
marked AS (
  SELECT file, line_no, CASE WHEN line_no % 4 = 3 THEN ' ' WHEN line_no % 4 = 1 THEN 'Story: ' || raw
                             ELSE raw END AS line FROM lines
)"""


def story_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select(
        F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw")
    )
    kind = F.col("line_no") % 4
    return lines.withColumn(
        "line",
        F.when(kind == 3, " ").when(kind == 1, F.concat(F.lit("Story: "), "raw")).otherwise(F.col("raw")),
    )


@query(
    rf"""WITH {LINES}, cut AS (
      SELECT *, regexp_matches(line, '^\s*$') AS blank,
             sum(regexp_matches(line, '^\s*$')::INT) OVER (PARTITION BY file ORDER BY line_no) AS record
      FROM marked)
    SELECT file, record::BIGINT AS record, string_agg(line, chr(10) ORDER BY line_no) AS text
    FROM cut WHERE NOT blank GROUP BY file, record"""
)
def blank_line_records(spark, sf_dir):
    return dg.records_between_blanks(story_lines(spark, sf_dir), "file", "line_no", "line", block=64)


@query(
    f"""WITH {MESSAGES}, sized AS (SELECT *, count(*) OVER (PARTITION BY dialog) AS n,
       max((parent_idx = 0)::INT) OVER (PARTITION BY dialog) AS answered FROM messages),
    found AS (
      SELECT 'role' AS rule, dialog, idx::VARCHAR AS detail FROM messages WHERE "from" NOT IN ('user', 'assistant')
      UNION ALL SELECT 'empty text', dialog, idx::VARCHAR FROM messages WHERE length(text) = 0
      UNION ALL SELECT 'no reply to first message', dialog, n::VARCHAR FROM sized
        WHERE idx = 0 AND coalesce(answered, 0) = 0)
    SELECT * FROM found"""
)
def dialog_quality(spark, sf_dir):
    return quality.message_violations(messages(spark, sf_dir))


@query(
    """SELECT CASE WHEN conv_id % 5 = 4 THEN NULL ELSE 'uid' || (conv_id % 5) END AS uid,
              count(DISTINCT conv_id) AS dialogs
       FROM conversations WHERE conv_id % 5 <> 4 GROUP BY 1"""
)
def root_to_uid(spark, sf_dir):
    """Filter ids of dialogs become dataset uids; id ``set4`` belongs to no dataset."""
    dialogs = (
        table(spark, sf_dir, "conversations")
        .select(F.col("conv_id").alias("dialog"))
        .distinct()
        .withColumn("dataset", F.concat(F.lit("set"), F.col("dialog") % 5))
    )
    catalog = (
        dialogs.select("dataset")
        .distinct()
        .filter("dataset <> 'set4'")
        .select(
            F.lit("chat").alias("collection"),
            F.replace("dataset", F.lit("set"), F.lit("uid")).alias("uid"),
            F.array("dataset").alias("filter_ids"),
        )
    )
    known, _ = dg.root_to_uid(dialogs, dg.filter_id_map(catalog))
    return known.groupBy(F.col("dataset").alias("uid")).agg(F.count("*").alias("dialogs"))


@query(
    """SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src3', 'src5')
       AND lang IN (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 2)"""
)
def accepted_rows(spark, sf_dir):
    """Rows with an accepted filter id: a pushed-down IN on one column, a semi-join on another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    accepted = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2)
    chosen = docs.filter(F.col("source").isin("src1", "src3", "src5"))
    return dg.keep_filter_ids(chosen, "lang", accepted).select("doc_id", "source", "lang")


@query(
    """SELECT _source, count(*) AS n, count(DISTINCT body) AS texts FROM (
         SELECT 'documents' AS _source, text AS body FROM documents
         UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY _source"""
)
def tagged_union(spark, sf_dir):
    sources = {
        name: table(spark, sf_dir, name).select(F.col("text").alias("body"))
        for name in ("documents", "benchmark", "conversations")
    }
    union = dg.tagged_union(sources, accepted=["documents", "benchmark"])
    return union.groupBy("_source").agg(
        F.count("*").alias("n"), F.count_distinct("body").alias("texts")
    )
