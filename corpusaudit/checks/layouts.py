"""Queries on raw dialog layouts: each spec applied to rows of the shared tables, message by message."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit.checks.conversations import MESSAGES, STRIPPED
from corpusaudit.checks.registry import query, table
from corpusaudit.operators import dialogs as dg
from corpusaudit.operators import presets

DOC = "cast(doc_id as string)"
CONV = "cast(conv_id as string)"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def gathered(spark, sf_dir):
    """Conversations as one row with arrays, the layout most published dialog sets have."""
    turn = F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.withColumns({"texts": F.col("turns.value"), "humans": F.transform("turns.from", lambda r: r == "user")})


def messages_of(raw, spec):
    """All messages, one row each, without NULLs."""
    rows = dg.normalise(raw, spec).select("dataset", F.inline("messages"))
    return rows.select(
        "dataset", "idx", "from", "text", F.coalesce("parent_idx", F.lit(-1)).alias("parent_idx"), F.coalesce("score", F.lit(-1.0)).alias("score")
    )


def said(*messages: tuple[str, str, str, int, str], key: str = "doc_id", source: str = "documents") -> str:
    """SQL of fixed message lists: (condition, role, text expression, parent index, score) in order per row."""
    parts = [
        f"""SELECT {key}::VARCHAR AS dataset, {i}::INT AS idx, '{role}' AS "from", {text} AS text, {parent}::INT AS parent_idx,
            {score}::DOUBLE AS score FROM {source} WHERE {where}"""
        for i, (where, role, text, parent, score) in enumerate(messages)
    ]
    return " UNION ALL ".join(parts)


PAIR = dg.Pair("concat(' ', text, '\\n')", "concat(lang, '\\t')", DOC)


@query(said(("true", "user", STRIPPED, -1, "-1"), ("true", "assistant", "lang", 0, "-1")))
def layout_pair(spark, sf_dir):
    return messages_of(documents(spark, sf_dir), PAIR)


@query(
    """SELECT 0 AS idx, 'user' AS "from", source || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || lang END AS text, -1 AS parent_idx FROM documents
    UNION ALL SELECT 1, 'assistant', n_chars::VARCHAR, 0 FROM documents"""
)
def layout_templated_pair(spark, sf_dir):
    """A preset that joins an instruction and an optional input."""
    raw = documents(spark, sf_dir).select(
        F.concat("source", "doc_id", F.lit(" ")).alias("instruction"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("input"),
        F.col("n_chars").cast("string").alias("output"),
    )
    return messages_of(raw, presets.PRESETS["Code Alpaca"].spec).select("idx", "from", "text", "parent_idx")


@query(
    f"""WITH {MESSAGES} SELECT dialog::VARCHAR AS dataset, idx::INT AS idx, "from", text, coalesce(parent_idx, -1)::INT AS parent_idx, -1.0::DOUBLE AS score
    FROM messages"""
)
def layout_turns(spark, sf_dir):
    return messages_of(gathered(spark, sf_dir), dg.Turns("turns", CONV, body="value", role="from"))


@query(
    f"""WITH {MESSAGES} SELECT dialog::VARCHAR AS dataset, idx::INT AS idx, CASE "from" WHEN 'user' THEN 'user' ELSE 'assistant' END AS "from", text,
    coalesce(parent_idx, -1)::INT AS parent_idx, -1.0::DOUBLE AS score FROM messages"""
)
def layout_flagged_turns(spark, sf_dir):
    return messages_of(gathered(spark, sf_dir), dg.FlaggedTurns("texts", "humans", CONV))


EXCHANGES = dg.Exchanges("turns", "q", "a", DOC, preface="concat(lang, ': ')", second_answer="b", rating="r")


@query(
    said(
        ("true", "user", "lang || ': ' || source", -1, "-1"),
        ("true", "assistant", STRIPPED, 0, "-1"),
        ("true", "assistant", "'other'", 1, "doc_id % 5"),
        ("true", "user", "'again ' || doc_id", 2, "-1"),
        ("true", "assistant", "'done'", 3, "-1"),
    )
)
def layout_exchanges(spark, sf_dir):
    """Questions with one or two answers; blank answers are left out."""
    turn = lambda q, a, b: F.struct(q.alias("q"), a.alias("a"), b.alias("b"), (F.col("doc_id") % 5).alias("r"))
    first = turn(F.col("source"), F.col("text"), F.lit("other"))
    second = turn(F.concat(F.lit("again "), "doc_id"), F.lit("done "), F.lit(""))
    return messages_of(documents(spark, sf_dir).withColumn("turns", F.array(first, second)), EXCHANGES)


TRANSCRIPT = dg.Transcript(
    "concat('<human>: ', source, '\\n<bot>: ', text, '\\n<human>: \\n<bot>: bye')",
    DOC,
    turn_start=r"(?=<human>:|<bot>:)",
    user_mark="^<human>:",
    mark="^<(human|bot)>:",
)


@query(said(("true", "user", "source", -1, "-1"), ("true", "assistant", STRIPPED, 0, "-1"), ("true", "assistant", "'bye'", 1, "-1")))
def layout_transcript(spark, sf_dir):
    return messages_of(documents(spark, sf_dir), TRANSCRIPT)


RANKED = dg.Ranked("concat(source, ' ? ')", (("text", "1.0"), ("''", "0.0"), ("lang", "doc_id % 3 / 2")), DOC)


@query(said(("true", "user", "source || ' ?'", -1, "-1"), ("true", "assistant", STRIPPED, 0, "1"), ("true", "assistant", "lang", 0, "(doc_id % 3) / 2")))
def layout_ranked(spark, sf_dir):
    """Scored replies to one prompt; the blank one is left out."""
    return messages_of(documents(spark, sf_dir), RANKED)


RANKED_PROMPTS = dg.RankedPrompts(("source", "lang"), (("text", "1.0"), ("concat(lang, doc_id)", "0.0")), DOC)


@query(
    said(
        ("true", "user", "source", -1, "-1"),
        ("true", "user", "lang", -1, "-1"),
        ("true", "assistant", STRIPPED, 0, "1"),
        ("true", "assistant", "lang || doc_id", 1, "0"),
    )
)
def layout_ranked_prompts(spark, sf_dir):
    return messages_of(documents(spark, sf_dir), RANKED_PROMPTS)


ARENA = dg.Arena((("one", "'m1'"), ("two", "'m2'")), "if(doc_id % 2 = 0, 'm1', 'm2')", DOC)


@query(
    said(
        ("true", "user", "source", -1, "-1"),
        ("true", "assistant", "text", 0, "1 - doc_id % 2"),
        ("true", "user", "source", -1, "-1"),
        ("true", "assistant", "lang", 2, "doc_id % 2"),
    )
)
def layout_arena(spark, sf_dir):
    """Two conversations; the winner's turns score 1."""
    turn = lambda role, body: F.struct(F.lit(role).alias("role"), F.col(body).alias("content"))
    sides = {n: F.array(turn("user", "source"), turn("assistant", b)) for n, b in (("one", "text"), ("two", "lang"))}
    return messages_of(documents(spark, sf_dir).withColumns(sides), ARENA)


BRANCHED = dg.Branched("chosen", "rejected", DOC)


@query(
    said(
        ("true", "user", "source", -1, "-1"),
        ("true", "assistant", "lang", 0, "1"),
        ("true", "user", "'more ' || doc_id", 1, "-1"),
        ("true", "assistant", "'good ' || lang", 2, "1"),
        ("doc_id % 4 <> 0", "assistant", "'bad'", 2, "0"),
    )
)
def layout_branched(spark, sf_dir):
    """Two transcripts with a common beginning; equal ones have no fork."""
    shared = F.concat(F.lit("\n\nHuman: "), "source", F.lit("\n\nAssistant: "), "lang", F.lit("\n\nHuman: more "), "doc_id", F.lit("\n\nAssistant: "))
    good = F.concat(shared, F.lit("good "), "lang")
    bad = F.when(F.col("doc_id") % 4 == 0, good).otherwise(F.concat(shared, F.lit("bad")))
    return messages_of(documents(spark, sf_dir).withColumns({"chosen": good, "rejected": bad}), BRANCHED)


NUMBERED = dg.NumberedColumns(("message_1", "message_2", "message_3"), DOC)


@query(
    """SELECT doc_id::VARCHAR AS dataset, 0 AS idx, 'user' AS "from", text, -1 AS parent_idx, -1.0::DOUBLE AS score FROM documents
    UNION ALL SELECT doc_id::VARCHAR, 1, 'user', lang, 0, -1.0 FROM documents WHERE doc_id % 2 = 1
    UNION ALL SELECT doc_id::VARCHAR, 1 + doc_id % 2, 'assistant', source, doc_id % 2, -1.0 FROM documents"""
)
def layout_numbered_columns(spark, sf_dir):
    """Wide columns, the empty ones skipped."""
    message = lambda role, body: F.struct(body.alias("content"), F.lit(role).alias("role_type"))
    second = F.when(F.col("doc_id") % 2 == 1, F.col("lang")).otherwise("")
    wide = {"message_1": message("USER", F.col("text")), "message_2": message("USER", second), "message_3": message("ASSISTANT", F.col("source"))}
    return messages_of(documents(spark, sf_dir).withColumns(wide), NUMBERED)


EITHER = dg.Either((("doc_id % 2 = 0", PAIR), ("true", dg.Pair("source", "text", "concat('odd ', doc_id)"))))


@query(
    said(("doc_id % 2 = 0", "user", STRIPPED, -1, "-1"), ("doc_id % 2 = 0", "assistant", "lang", 0, "-1"))
    + " UNION ALL "
    + said(("doc_id % 2 = 1", "user", "source", -1, "-1"), ("doc_id % 2 = 1", "assistant", STRIPPED, 0, "-1"), key="('odd ' || doc_id)")
)
def layout_either(spark, sf_dir):
    return messages_of(documents(spark, sf_dir), EITHER)


def _whole(raw):
    chained = dg.chain_rows(raw, "conv_id", "turn", "role", "text")
    return dg.fold_rows(chained, F.col("dialog").cast("string")).select("dataset", "messages")


WHOLE = dg.WholeTable(_whole)


@query(
    f"""WITH {MESSAGES} SELECT dialog::VARCHAR AS dataset, idx::INT AS idx, "from", text, coalesce(parent_idx, -1)::INT AS parent_idx, -1.0::DOUBLE AS score
    FROM messages"""
)
def layout_whole_table(spark, sf_dir):
    """A function of the whole table: one dialog spans several rows."""
    return messages_of(table(spark, sf_dir, "conversations"), WHOLE)
