"""Tokens and pages per web domain; top lists, ranks and complements by corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import text, urls, windows


def domain_tokens(pages: DataFrame, body: Column, domain: Column) -> DataFrame:
    """(domain, tokens, pages). Partial sums are built map-side, so a hot domain costs one row per task."""
    return (
        pages.select(domain.alias("domain"), text.word_count(body).alias("tokens"))
        .groupBy("domain")
        .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pages"))
    )


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Add up per-file or per-corpus domain counts."""
    merged = counts[0]
    for other in counts[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("domain").agg(
        F.sum("tokens").alias("tokens"), F.sum("pages").alias("pages")
    )


def url_tokens(table: DataFrame, url: str, token_cols: list[str]) -> DataFrame:
    """Token sums per canonical host, one column per corpus."""
    return (
        table.withColumn("url", urls.with_www(F.col(url)))
        .groupBy("url")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in token_cols])
    )


def long_tokens(wide: DataFrame, corpora: dict[str, str]) -> DataFrame:
    """(url, corpus, tokens) from one token column per corpus (corpus name -> column)."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("corpus"), F.col(col).alias("tokens"))
            for name, col in corpora.items()
        ]
    )
    return wide.select("url", F.inline(entries))


def corpus_url_tokens(tokens: DataFrame, corpus: str) -> DataFrame:
    return tokens.filter(F.col("corpus") == corpus).select("url", "tokens")


def corpus_totals(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("corpus").agg(
        F.sum("tokens").alias("total_tokens"), F.count("*").alias("total_urls")
    )


def top_urls(tokens: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """The ``k`` largest URLs (per corpus when ``keys`` names it), ties by URL."""
    order = [F.desc("tokens"), F.asc("url")]
    if not keys:
        return tokens.orderBy(*order).limit(k)
    return windows.first_n_per_key(tokens, keys, order, k, rank="rank")


def coverage(top: DataFrame, total_tokens: int | None = None, all_tokens: DataFrame | None = None) -> DataFrame:
    """Tokens of a top list and its share of the corpus in percent."""
    if total_tokens is None:
        total = all_tokens.agg(F.sum("tokens").alias("t")).scalar()
    else:
        total = F.lit(total_tokens)
    return top.agg(F.sum("tokens").alias("top_tokens"), F.count("*").alias("n_urls")).withColumn(
        "pct", F.round(100 * F.try_divide(F.col("top_tokens"), total), 2)
    )


def outside_top(tokens: DataFrame, k: int) -> DataFrame:
    """URLs that are in none of the corpora's top ``k`` lists."""
    tops = top_urls(tokens, k, keys=["corpus"]).select("url").distinct()
    return tokens.select("url").distinct().join(tops, "url", "left_anti")


def rank_urls(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Position of every URL in its corpus by tokens (largest first, ties by URL)."""
    return windows.global_rank(tokens, keys, [F.desc("tokens"), F.asc("url")])


def attach_size(annotations: DataFrame, ranked: DataFrame, corpora: list[str]) -> DataFrame:
    """Per-corpus tokens and rank next to each annotated URL: one join, then a pivot by condition."""
    sizes = ranked.groupBy("url").agg(
        *[
            F.max(F.when(F.col("corpus") == c, F.col(field))).alias(f"{c}_{field}")
            for c in corpora
            for field in ("tokens", "rank")
        ]
    )
    return annotations.join(sizes, "url", "left")
