"""Data-quality rules. Each check returns violations as rows, empty when the data is clean."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = "rule string, key string, detail string"


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _found(df: DataFrame, rule: str, key: str, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.col(key).alias(key), detail.cast("string").alias("detail")
    )


def message_violations(messages: DataFrame, ranked: Column | None = None) -> DataFrame:
    """(rule, dialog, detail) for one row per message.

    Roles are user or assistant, texts are not empty, a parent is between 0 and the message itself,
    the first message is a root, ranked replies carry a score, and some message answers the first.
    """
    bad = [
        ("role", ~F.coalesce(F.col("from"), F.lit("")).isin("user", "assistant")),
        ("empty text", F.coalesce(F.length("text"), F.lit(0)) == 0),
        ("parent out of range", (F.col("parent_idx") < 0) | (F.col("parent_idx") > F.col("idx"))),
        ("first message is not a root", (F.col("idx") == 0) & F.col("parent_idx").isNotNull()),
    ]
    if ranked is not None:
        bad.append(
            ("missing score", ranked & (F.col("from") == "assistant") & F.col("score").isNull())
        )
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in bad]))
    per_message = messages.select(
        F.explode(hits).alias("rule"), "dialog", F.col("idx").cast("string").alias("detail")
    )
    unanswered = (
        messages.groupBy("dialog")
        .agg(F.count("*").alias("n"), F.count_if(F.col("parent_idx") == 0).alias("answers"))
        .filter("answers = 0")
    )
    return per_message.unionByName(
        _found(unanswered, "no reply to first message", "dialog", F.col("n"))
    )


def nested_message_violations(dialogs: DataFrame, key: str) -> DataFrame:
    """The same rules on dialogs stored as arrays, without exploding clean dialogs."""
    m = F.col("messages")
    rules = {
        "role": F.exists(m, lambda x: ~F.coalesce(x["from"], F.lit("")).isin("user", "assistant")),
        "empty text": F.exists(m, lambda x: F.coalesce(F.length(x["text"]), F.lit(0)) == 0),
        "parent out of range": F.exists(
            m, lambda x: F.coalesce((x["parent_idx"] < 0) | (x["parent_idx"] > x["idx"]), F.lit(False))
        ),
        "first message is not a root": F.get(m, F.lit(0))["parent_idx"].isNotNull(),
        "no reply to first message": ~F.exists(m, lambda x: F.coalesce(x["parent_idx"] == 0, F.lit(False))),
    }
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return dialogs.select(
        F.explode(hits).alias("rule"), F.col(key), F.size(m).cast("string").alias("detail")
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    repeated = df.groupBy(key).count().filter("count > 1")
    return _found(repeated, f"duplicate {key}", key, F.col("count"))


def required_fields(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fields that are missing or empty (text '' or an empty list)."""
    kinds = dict(df.dtypes)

    def empty(name: str) -> Column:
        col = F.col(f"`{name}`")
        if kinds[name].startswith("array"):
            return F.coalesce(F.size(col), F.lit(0)) <= 0
        return F.coalesce(F.trim(col.cast("string")), F.lit("")) == ""

    hits = F.array_compact(F.array(*[F.when(empty(c), F.lit(c)) for c in columns]))
    return df.select(
        F.lit("required field is empty").alias("rule"), F.col(key), F.explode(hits).alias("detail")
    )


def numeric_fields(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Texts that should hold a number or be empty."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.coalesce(F.trim(c), F.lit("")) != "") & F.col(c).try_cast("double").isNull(),
                    F.concat_ws("=", F.lit(c), F.col(c)),
                )
                for c in columns
            ]
        )
    )
    return df.select(
        F.lit("not a number").alias("rule"), F.col(key), F.explode(hits).alias("detail")
    )


def pattern_fields(df: DataFrame, key: str, patterns: dict[str, str]) -> DataFrame:
    """Texts that are present but do not match their pattern (URLs, ids)."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.coalesce(F.col(c), F.lit("")) != "") & ~F.col(c).rlike(p),
                    F.concat_ws("=", F.lit(c), F.col(c)),
                )
                for c, p in patterns.items()
            ]
        )
    )
    return df.select(
        F.lit("pattern").alias("rule"), F.col(key), F.explode(hits).alias("detail")
    )


def allowed_values(
    df: DataFrame, key: str, column: str, dictionary: DataFrame, member: str = "member"
) -> DataFrame:
    """List values that the dictionary does not know."""
    kind = dict(df.dtypes)[column]
    value = F.explode(column) if kind.startswith("array") else F.col(column)
    values = df.select(F.col(key), value.alias("_value")).filter(F.col("_value").isNotNull())
    unknown = values.join(
        dictionary.select(F.col(member).alias("_value")).distinct(), "_value", "left_anti"
    )
    return _found(unknown.distinct(), f"unknown {column}", key, F.col("_value"))


def extra_columns(df: DataFrame, key: str, expected: Sequence[str]) -> DataFrame:
    """Rows with a value in a column that the layout does not have, one violation per such column."""
    extra = sorted(set(df.columns) - set(expected) - {key})
    hits = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in extra]).cast("array<string>"))
    return df.select(F.lit("extra column").alias("rule"), F.col(key), F.explode(hits).alias("detail"))


def unused_filter_ids(ids: DataFrame, dialogs: DataFrame) -> DataFrame:
    """(uid, filter_id) without a single dialog of that uid."""
    seen = dialogs.select(F.col("dataset").alias("uid")).distinct()
    return ids.join(seen, "uid", "left_anti")
