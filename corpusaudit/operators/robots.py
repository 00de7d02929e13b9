"""robots.txt: parsing, per-agent judgement, agent statistics.

A file is parsed inside its row with array expressions, so parsing and judging need no shuffle; only
statistics over many files do. Agents are compared in lower case. The result of judging one file is
a map from agent to ``all`` / ``some`` / ``none``; agents it does not mention inherit ``*``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import text as tx
from corpusaudit.session import written

# Line kinds of the format.
AGENT_LINE = "(?i)^user-agent:"
RULE_LINE = "(?i)^(allow|disallow|crawl-delay):"
SITEMAP_LINE = "(?i)^sitemap:"
KNOWN_LINE = "(?i)^(user-agent|allow|disallow|crawl-delay|sitemap):"
RULE_OR_SITEMAP = "(?im)^(allow|disallow|crawl-delay|sitemap):"


def _value(line: Column) -> Column:
    """Text after the first colon."""
    return tx.strip(F.regexp_replace(line, "^[^:]*:", ""))


def _directive(line: Column) -> Column:
    return F.regexp_replace(F.initcap(F.replace(F.lower(F.regexp_extract(line, "^([^:]*):", 1)), F.lit("-"), F.lit(" "))), " ", "-")


def clean_lines(body: Column) -> Column:
    """Lines without comments and surrounding white space, blank ones dropped."""
    lines = F.transform(
        tx.split_lines(F.coalesce(body, F.lit(""))),
        lambda x: tx.strip(F.regexp_replace(x, "(?s)#.*", "")),
    )
    return F.filter(lines, lambda x: x != "")


def _group(agents: Column, rules: Column) -> Column:
    return tx.let(
        agents,
        lambda a: F.struct(
            a.alias("agents"), F.transform(a, lambda name: F.lower(name)).alias("keys"), rules.alias("rules")
        ),
    )


def rule_groups(body: Column, grouping: str = "leading") -> Column:
    """``array<struct<agents, keys, rules>>``: agents with the rule lines that follow them.

    ``rfc9309``: agent lines directly after each other share the rules below them.
    ``leading``: that holds only up to the first rule or sitemap line of the file; afterwards
    every agent line opens a group of its own.
    """
    lines = clean_lines(body)
    agents_in = lambda ls: F.transform(F.filter(ls, lambda x: x.rlike(AGENT_LINE)), _value)
    rules_in = lambda ls: F.filter(ls, lambda x: x.rlike(RULE_LINE))
    if grouping == "rfc9309":
        relevant = F.filter(lines, lambda x: x.rlike(AGENT_LINE) | x.rlike(RULE_LINE))
        marked = F.regexp_replace(
            F.array_join(relevant, "\n"), "(?im)^((?!user-agent:)[^\n]*)\n(?=user-agent:)", "$1\u0001"
        )
        return F.transform(
            F.split(marked, "\u0001"),
            lambda piece: tx.let(F.split(piece, "\n"), lambda ls: _group(agents_in(ls), rules_in(ls))),
        )
    if grouping != "leading":
        raise ValueError("grouping must be 'leading' or 'rfc9309'")

    def grouped(joined: Column) -> Column:
        return tx.let(F.length(F.get(F.split(joined, RULE_OR_SITEMAP, 2), F.lit(0))), lambda cut: halves(joined, cut))

    def halves(joined: Column, cut: Column) -> Column:
        head = F.split(joined.substr(F.lit(1), cut), "\n")
        tail = F.split(joined.substr(cut + 1, F.length(joined)), "(?im)\n(?=user-agent:)")
        return tx.let(
            tail,
            lambda pieces: F.concat(
                F.array(_group(agents_in(head), rules_in(F.split(F.get(pieces, F.lit(0)), "\n")))),
                F.transform(
                    F.slice(pieces, F.lit(2), F.size(pieces)),
                    lambda p: tx.let(F.split(p, "\n"), lambda ls: _group(agents_in(ls), rules_in(ls))),
                ),
            ),
        )

    return tx.let(F.array_join(lines, "\n"), grouped)


def parse(snapshots: DataFrame, keys: Sequence[str], body: str, grouping: str = "leading") -> DataFrame:
    """Long rule table (keys, agent, directive, value, ord); ``agent`` is spelled as first seen."""
    grouped = snapshots.select(*keys, rule_groups(F.col(body), grouping).alias("_groups"))
    spellings = F.flatten(F.col("_groups.agents"))
    named = grouped.withColumn("_names", spellings)
    rows = named.select(*keys, "_names", F.posexplode("_groups").alias("_g", "_group"))
    rows = rows.select(*keys, "_names", "_g", F.col("_group.rules").alias("_rules"), F.explode("_group.keys").alias("_key"))
    rows = rows.select(*keys, "_names", "_key", "_g", F.posexplode("_rules").alias("_r", "_line"))
    agent = F.get(F.filter("_names", lambda n: F.lower(n) == F.col("_key")), F.lit(0))
    return rows.select(
        *keys,
        agent.alias("agent"),
        _directive(F.col("_line")).alias("directive"),
        _value(F.col("_line")).alias("value"),
        F.struct(F.col("_g").alias("group"), F.col("_r").alias("line")).alias("ord"),
    )


def sitemaps(snapshots: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    lines = F.filter(clean_lines(F.col(body)), lambda x: x.rlike(SITEMAP_LINE))
    return snapshots.select(*keys, F.explode(lines).alias("_l")).select(
        *keys, _value(F.col("_l")).alias("sitemap")
    )


def parse_errors(snapshots: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """(keys, error): lines of no known kind, and allow/disallow lines before any agent."""
    raw = tx.split_lines(F.coalesce(F.col(body), F.lit("")))
    bare = lambda x: tx.strip(F.regexp_replace(x, "(?s)#.*", ""))
    unmatched = F.transform(
        F.filter(raw, lambda x: (bare(x) != "") & ~bare(x).rlike(KNOWN_LINE)),
        lambda x: F.concat(F.lit("Unmatched line: "), x),
    )
    before = F.split(
        F.get(F.split(F.array_join(clean_lines(F.col(body)), "\n"), "(?im)^user-agent:", 2), F.lit(0)), "\n"
    )
    orphans = F.transform(
        F.filter(before, lambda x: x.rlike("(?i)^(allow|disallow):")),
        lambda x: F.concat(F.lit("Directive '"), x, F.lit("' found with no preceding user-agent.")),
    )
    return snapshots.select(*keys, F.explode(F.concat(unmatched, orphans)).alias("error"))


def judge_rules(disallow: Column, allow: Column) -> Column:
    """``all`` / ``some`` / ``none`` from the ordered paths of one agent; paths with ``?`` are ignored."""
    plain = lambda paths: F.filter(paths, lambda p: ~F.contains(p, F.lit("?")))

    def verdict(paths: Column) -> Column:
        denied, granted = paths["denied"], paths["granted"]
        nothing = (F.size(denied) == 0) | (denied == F.array(F.lit(""))) | (denied == granted)
        everything = F.exists(denied, lambda p: tx.strip(p) == "/") & (F.size(granted) == 0)
        return F.when(nothing, F.lit("none")).when(everything, F.lit("all")).otherwise(F.lit("some"))

    return tx.let(F.struct(plain(disallow).alias("denied"), plain(allow).alias("granted")), verdict)


def judgements(body: Column, grouping: str = "leading") -> Column:
    """Map from lower-case agent to judgement, for the agents the file mentions."""
    groups = rule_groups(body, grouping)

    def judged(gs: Column) -> Column:
        keys = F.array_distinct(F.flatten(gs["keys"]))

        def status(key: Column) -> Column:
            mine = F.flatten(
                F.transform(
                    F.filter(gs, lambda g: F.array_contains(g["keys"], key)), lambda g: g["rules"]
                )
            )
            paths = lambda lines, kind: F.transform(
                F.filter(lines, lambda x: x.rlike(f"(?i)^{kind}:")), _value
            )
            return tx.let(mine, lambda ls: judge_rules(paths(ls, "disallow"), paths(ls, "allow")))

        return F.transform(keys, lambda k: F.struct(k.alias("key"), status(k).alias("value")))

    return F.map_from_entries(tx.let(groups, judged))


def with_judgements(
    snapshots: DataFrame, body: str, grouping: str = "leading", out: str = "judgements"
) -> DataFrame:
    return snapshots.withColumn(out, judgements(F.col(body), grouping))


def star(judged: Column) -> Column:
    return F.coalesce(F.try_element_at(judged, F.lit("*")), F.lit("none"))


def all_agents_status(judged: Column) -> Column:
    """``all`` if every agent and ``*`` are shut out, ``some`` if any is restricted, else ``none``."""
    values = F.array_append(F.map_values(judged), star(judged))
    return (
        F.when(F.forall(values, lambda v: v == "all"), F.lit("all"))
        .when(F.exists(values, lambda v: v != "none"), F.lit("some"))
        .otherwise(F.lit("none"))
    )


def status_of(judged: Column, agent: Column | str) -> Column:
    """Judgement for one agent, mentioned or not."""
    name = F.lower(F.lit(agent)) if isinstance(agent, str) else F.lower(agent)
    return F.when(name == dims.ALL_AGENTS.lower(), all_agents_status(judged)).otherwise(
        F.coalesce(F.try_element_at(judged, name), star(judged))
    )


def agent_statuses(judged: DataFrame, keys: Sequence[str], agents: Sequence[str]) -> DataFrame:
    """(keys, agent, status) for a fixed list of tracked agents."""
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("agent"), status_of(F.col("judgements"), a).alias("status"))
            for a in agents
        ]
    )
    return judged.select(*keys, F.inline(entries))


def mentioned_statuses(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, agent, status) of the agents a file mentions, and of all agents together."""
    entries = F.map_concat(
        F.col("judgements"),
        F.create_map(F.lit(dims.ALL_AGENTS), all_agents_status(F.col("judgements"))),
    )
    return judged.select(*keys, F.explode(entries).alias("agent", "status"))


def detailed_status(status: Column, body: Column) -> Column:
    """Sub-classes of ``some`` and ``none`` from the text of the whole file."""
    some = (
        F.when(body.rlike(r"Disallow:\s+/.*\?"), F.lit("some_pattern_restrictions"))
        .when(
            body.rlike(r"Disallow:\s*/(?:admin|private|confidential)"),
            F.lit("some_disallow_important_dir"),
        )
        .otherwise(F.lit("some_other"))
    )
    none = (
        F.when(body.rlike("Crawl-delay:"), F.lit("none_crawl_delay"))
        .when(body.rlike("[Ss]itemap"), F.lit("none_sitemap"))
        .otherwise(F.lit("none"))
    )
    return F.when(status == "some", some).when(status == "none", none).otherwise(status)


def agent_statuses_detailed(
    judged: DataFrame, keys: Sequence[str], agents: Sequence[str], body: str
) -> DataFrame:
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("agent"),
                detailed_status(
                    status_of(F.col("judgements"), a), F.coalesce(F.col(body), F.lit(""))
                ).alias("status"),
            )
            for a in agents
        ]
    )
    return judged.select(*keys, F.inline(entries))


def agent_statistics(judged: DataFrame) -> DataFrame:
    """(agent, observed, all, some, none) over files, with ``*`` and all agents together.

    A file that does not mention an agent counts with its ``*`` judgement. Instead of pairing every
    file with every agent, the files that do mention it are counted and the ``*`` judgements of the
    rest follow by subtraction.
    """
    statuses = ("all", "some", "none")
    judged_map = F.col("judgements")
    common = F.struct(star(judged_map).alias("star"), all_agents_status(judged_map).alias("together"))

    def entry(agent: Column, status: Column, observed: Column) -> Column:
        return F.struct(
            agent.alias("agent"), status.alias("status"), observed.cast("bigint").alias("observed")
        )

    named = F.transform(
        F.filter(F.map_entries("judgements"), lambda e: e["key"] != "*"),
        lambda e: entry(e["key"], e["value"], F.lit(1)),
    )
    per_file = F.array(
        entry(F.lit("*"), F.col("_c.star"), F.map_contains_key("judgements", F.lit("*"))),
        entry(F.lit(dims.ALL_AGENTS), F.col("_c.together"), F.lit(1)),
    )
    counts = (
        judged.select("judgements", common.alias("_c"))
        .select(F.col("_c.star").alias("_star"), F.inline(F.concat(named, per_file)))
        .groupBy("agent")
        .agg(
            F.sum("observed").alias("observed"),
            *[F.count_if(F.col("status") == s).alias(f"own_{s}") for s in statuses],
            *[F.count_if(F.col("_star") == s).alias(f"star_{s}") for s in statuses],
        )
    )
    # the row of * holds the totals over all files; agents may be any number of strings, so it is read back as one value
    counts = written(counts, "agents")
    totals = counts.filter("agent = '*'").select(F.struct(*[F.col(f"own_{s}") for s in statuses])).scalar()
    counts = counts.withColumn("_totals", totals)
    whole = F.col("agent").isin("*", dims.ALL_AGENTS)
    return counts.select(
        "agent",
        "observed",
        *[
            F.when(whole, F.col(f"own_{s}"))
            .otherwise(F.col(f"own_{s}") + F.col(f"_totals.own_{s}") - F.col(f"star_{s}"))
            .alias(s)
            for s in statuses
        ],
    )


def statistics_percent(stats: DataFrame) -> DataFrame:
    """Shares of all / some / none of an agent in percent of the files that mention it."""
    return stats.select(
        "agent",
        "observed",
        *[
            F.round(100 * F.try_divide(F.col(s), F.col("observed")), 2).alias(f"pct_{s}")
            for s in ("all", "some", "none")
        ],
    )


def top_agents(stats: DataFrame, n: int, always: Sequence[str] = ()) -> DataFrame:
    """The ``n`` most observed agents together with some that are always listed.

    Every task keeps its ``n`` best, and only those meet.
    """
    top = stats.orderBy(F.desc("observed"), "agent").limit(n)
    return top.unionByName(stats.filter(F.col("agent").isin(list(always)))).distinct()


def first_spellings(snapshots: DataFrame, keys: Sequence[str], body: str, grouping: str = "leading") -> DataFrame:
    """(keys, agent_key, agent): each agent of a file as it is spelled first."""
    names = F.flatten(F.transform(rule_groups(F.col(body), grouping), lambda g: g["agents"]))
    return (
        snapshots.select(*keys, F.posexplode(names).alias("_i", "agent"))
        .groupBy(*keys, F.lower("agent").alias("agent_key"))
        .agg(F.min_by("agent", "_i").alias("agent"))
    )


def common_spelling(spellings: DataFrame) -> DataFrame:
    """Most frequent spelling per agent, ties by the smallest spelling."""
    counts = spellings.groupBy("agent_key", "agent").count()
    return counts.groupBy("agent_key").agg(
        F.min_by("agent", F.struct(-F.col("count"), F.col("agent"))).alias("agent")
    )


# --- agents of companies -------------------------------------------------------------------------


def agents_of(company: str | None = None, purpose: str | None = None) -> list[str]:
    """Agent names of a company, a purpose, both, or all."""
    return sorted(
        {
            a
            for c, p, a in dims.AGENTS
            if (company is None or c == company) and (purpose is None or p == purpose)
        }
    )


def lead_agents(companies: Sequence[str] | None = None) -> dict[str, list[str]]:
    """First agent per purpose of each company."""
    first: dict[tuple[str, str], str] = {}
    for company, purpose, agent in dims.AGENTS:
        if companies is None or company in companies:
            first.setdefault((company, purpose), agent)
    out: dict[str, list[str]] = {}
    for (company, _), agent in first.items():
        if agent not in out.setdefault(company, []):
            out[company].append(agent)
    return out


# --- strictness ----------------------------------------------------------------------------------


def strictness(status: Column, order: Sequence[str] = tuple(dims.STRICTNESS)) -> Column:
    """1-based position in the order, 0 for an unknown status."""
    return F.array_position(F.array(*[F.lit(s) for s in order]), status)


def status_at(rank: Column, order: Sequence[str] = tuple(dims.STRICTNESS)) -> Column:
    return F.get(F.array(*[F.lit(s) for s in order]), (rank - 1).cast("int"))


def strictest(status: Column, order: Sequence[str] = tuple(dims.STRICTNESS)) -> Column:
    """Aggregate: the strictest status of a group."""
    return status_at(F.greatest(F.max(strictness(status, order)), F.lit(1)), order)


def group_statuses(
    statuses: DataFrame,
    keys: Sequence[str],
    groups: dict[str, Sequence[str]],
    order: Sequence[str] = tuple(dims.STRICTNESS),
) -> DataFrame:
    """Strictest status per agent group (keys, agent = group name, status); one pass for all groups."""
    ranks = statuses.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("agent").isin(list(agents)), strictness(F.col("status"), order))).alias(f"g{i}")
            for i, agents in enumerate(groups.values())
        ]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("agent"),
                status_at(F.coalesce(F.greatest(F.col(f"g{i}"), F.lit(1)), F.lit(1)), order).alias("status"),
            )
            for i, name in enumerate(groups)
        ]
    )
    return ranks.select(*keys, F.inline(entries))
