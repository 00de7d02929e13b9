"""From robots and terms snapshots to restriction estimates per corpus and service."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import urls
from corpusaudit.operators import domains, robots, temporal
from corpusaudit.session import written


@dataclass(frozen=True)
class ConsentSettings:
    start: str
    end: str
    unit: str = "month"
    companies: tuple[str, ...] = ("OpenAI", "Google", "Common Crawl", "Anthropic", "Meta")
    head_size: int = 2000
    grouping: str = "leading"


def status_facts(snapshots: DataFrame, settings: ConsentSettings) -> DataFrame:
    """(url, snap_date, agent group, status) from (url, snap_date, robots_txt).

    Parsing, judging and grouping happen in the row of the snapshot: no shuffle.
    """
    groups = {
        name: agents
        for name, agents in robots.lead_agents().items()
        if name in settings.companies or name in ("*", dims.ALL_AGENTS)
    }
    judged = robots.with_judgements(
        snapshots.withColumn("url", urls.with_www(F.col("url"))), "robots_txt", settings.grouping
    )
    entries = []
    for name, agents in groups.items():
        ranks = [robots.strictness(robots.status_of(F.col("judgements"), a)) for a in agents]
        rank = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
        entries.append(
            F.struct(F.lit(name).alias("agent"), robots.status_at(F.greatest(rank, F.lit(1))).alias("status"))
        )
    return judged.select("url", "snap_date", F.inline(F.array(*entries)))


def period_table(
    facts: DataFrame, sites: DataFrame, settings: ConsentSettings, tokens: DataFrame | None = None
) -> DataFrame:
    """(period, agent, status, count, tokens) without building sites x periods."""
    return temporal.period_counts_from_changes(
        facts, sites, settings.start, settings.end, settings.unit, ts="snap_date", tokens=tokens
    )


def corpus_urls(
    sites: DataFrame, all_tokens: DataFrame, corpus: str, k: int
) -> DataFrame:
    """(url, split, tokens, start_date, services): a corpus' top URLs, and those in no corpus' top list.

    ``sites`` is (url, start_date, services). Written once; the estimate reads it for its intervals and for its fractions.
    """
    # k URLs per corpus; Spark broadcasts them while they are small
    tops = domains.top_urls(all_tokens, k, keys=["corpus"]).select("url", "corpus", F.lit(True).alias("_top"))
    marked = all_tokens.join(tops, ["url", "corpus"], "left").groupBy("url").agg(
        F.max(F.when(F.col("corpus") == corpus, F.col("tokens"))).alias("tokens"),
        F.bool_or(F.col("_top").isNotNull() & (F.col("corpus") == corpus)).alias("_head"),
        F.bool_or(F.col("_top").isNotNull()).alias("_any"),
    )
    split = F.when(F.col("_head"), "head").when(~F.col("_any"), "rand")
    chosen = marked.select("url", split.alias("split"), "tokens").filter("split IS NOT NULL")
    return written(chosen.join(sites.select("url", "start_date", "services"), "url"), "corpus-urls")


def corpus_estimate(
    facts: DataFrame,
    sites: DataFrame,
    all_tokens: DataFrame,
    corpus: str,
    agent: str,
    settings: ConsentSettings,
    restrictive: tuple[str, ...] = ("all",),
) -> DataFrame:
    """Restricted part of a corpus per (service, period): facts are read once, for the URLs of head and random sample only."""
    members = corpus_urls(sites, all_tokens, corpus, settings.head_size)
    wanted = facts.filter(F.col("agent") == agent)
    intervals = temporal.status_intervals(
        wanted, members, settings.start, settings.end, settings.unit, ts="snap_date", carry=("split", "services", "tokens")
    )
    total = F.lit(dims.CORPUS_TOKENS[corpus])
    return temporal.restriction_estimate(intervals, members, total, list(restrictive), settings.end, settings.unit)
