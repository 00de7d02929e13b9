"""Terms of service: relevance of pages, verdict codes, roll-ups per domain and over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import text as tx
from corpusaudit.functions import windows
from corpusaudit.operators import temporal

OPEN = "Unrestricted Use"
VERDICT_LABELS = tuple(
    dict.fromkeys(
        [dims.NO_TERMS]
        + list(dims.SCRAPING_VERDICTS.values())
        + list(dims.LICENSE_VERDICTS.values())
        + list(dims.COMPETE_VERDICTS.values())
    )
)


def mentions_topic(body: Column, topic: str) -> Column:
    """Does the text contain a keyword of the topic as a whole word, in any case?"""
    every = [k for words in dims.TOPIC_KEYWORDS.values() for k in words]
    return F.coalesce(tx.has_whole_word(tx.fold_case(body), dims.TOPIC_KEYWORDS[topic], every), F.lit(False))


def without_privacy_pages(pages: DataFrame, domain: str, is_privacy: Column) -> DataFrame:
    """Drop privacy pages of domains that have other pages too; flag domains that have nothing else.

    The flag per domain is an aggregate joined back, so a large domain is not one window group.
    """
    marked = pages.withColumn("_privacy", is_privacy)
    only = marked.groupBy(domain).agg(F.bool_and("_privacy").alias("only_privacy"))
    return marked.join(only, domain).filter(~F.col("_privacy") | F.col("only_privacy")).drop("_privacy")


def _label(code: Column, labels: dict[int, str]) -> Column:
    return tx.lookup(code.cast("string"), {str(k): v for k, v in labels.items()}, F.lit(None).cast("string"))


def merge_policies(scraping: Column, license_: Column, compete: Column) -> Column:
    """One label from the three policies.

    A ban on scraping or AI, and missing pages, come first, then a non-commercial license, then a
    ban on competing use; otherwise the scraping policy stands. Equal labels pass unchanged.
    """
    return (
        F.when(scraping.startswith("No"), scraping)
        .when((scraping == license_) & (scraping == compete), scraping)
        .when(license_ == "NC Only", license_)
        .when(compete.isin("Non-Compete", "No Re-Distribution"), compete)
        .otherwise(scraping)
    )


def time_verdicts(verdicts: DataFrame) -> DataFrame:
    """(url, date, verdict) where all three policies were judged at that date.

    ``verdicts`` is (url, date, subpage, policy, verdict code); the lowest code over a date's
    subpages counts. A missing code is the most open one for license and compete.
    """
    code = F.coalesce(
        F.nullif(F.col("verdict"), F.lit(0)),
        F.when(F.col("policy") == "license", dims.DEFAULT_VERDICT_CODE["license"]).when(
            F.col("policy") == "compete", dims.DEFAULT_VERDICT_CODE["compete"]
        ),
    )
    per_date = verdicts.groupBy("url", "date").agg(
        *[
            F.min(F.when(F.col("policy") == p, code)).alias(p)
            for p in ("ai_scraping", "license", "compete")
        ]
    )
    complete = per_date.dropna(subset=["ai_scraping", "license", "compete"])
    return complete.select(
        "url",
        "date",
        merge_policies(
            _label(F.col("ai_scraping"), dims.SCRAPING_VERDICTS),
            _label(F.col("license"), dims.LICENSE_VERDICTS),
            _label(F.col("compete"), dims.COMPETE_VERDICTS),
        ).alias("verdict"),
    )


def add_sites_without_terms(verdicts: DataFrame, annotated: DataFrame, sites: DataFrame) -> DataFrame:
    """Annotated sites without any verdict count as 'No Terms Pages' from their start date."""
    missing = (
        annotated.select("url")
        .distinct()
        .join(verdicts.select("url").distinct(), "url", "left_anti")
        .join(sites.select("url", "start_date"), "url")
        .select("url", F.to_date("start_date").alias("date"), F.lit(dims.NO_TERMS).alias("verdict"))
    )
    return verdicts.unionByName(missing)


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("url").agg(F.max_by("verdict", "date").alias("verdict"))


def period_counts_from_changes(
    verdicts: DataFrame, members: DataFrame, sites: DataFrame, tokens: DataFrame, start: str, end: str, unit: str = "month"
) -> DataFrame:
    """(period, status, count, tokens) of the URLs in a set: the set is applied first, and nothing is filled."""
    chosen = members.select("url").distinct()
    intervals = temporal.status_intervals(
        verdicts.join(chosen, "url", "left_semi"),
        sites,
        start,
        end,
        unit,
        keys=("url",),
        ts="date",
        status="verdict",
        default=dims.NO_TERMS,
        labels=VERDICT_LABELS,
    )
    weighted = intervals.join(tokens.select("url", "tokens"), "url", "left")
    return temporal.interval_counts(weighted, ["status"], end, unit, "tokens")


def robots_and_terms(
    catalog: DataFrame, robots_latest: DataFrame, terms_latest: DataFrame
) -> DataFrame:
    """Latest robots status and terms verdict next to each URL; absent ones count as open."""
    return (
        catalog.join(robots_latest.select("url", F.col("status").alias("robots")), "url", "left")
        .join(terms_latest.select("url", F.col("verdict").alias("terms")), "url", "left")
        .withColumn("robots", F.coalesce("robots", F.lit("none")))
        .withColumn("terms", F.coalesce("terms", F.lit(OPEN)))
    )


# --- answers per page rolled up per domain -------------------------------------------------------


def complete_answers(answers: DataFrame) -> DataFrame:
    """Answers that have domain, link, date, verdict and evidence."""
    return answers.dropna(subset=["domain", "link", "date", "verdict", "evidence"])


def domain_links(answers: DataFrame) -> DataFrame:
    """(domain, link): all distinct links of a domain, one row each."""
    return answers.select("domain", "link").filter("link IS NOT NULL").distinct()


def roll_up_flags(answers: DataFrame) -> DataFrame:
    """(domain, link, verdict): true when any page of the domain is; one row per link."""
    verdicts = answers.groupBy("domain").agg(F.bool_or(F.col("verdict") == "True").alias("verdict"))
    return domain_links(answers).join(verdicts, "domain")


def roll_up_codes(answers: DataFrame, codes: Sequence[int] = (1, 2, 3, 4), otherwise: int = 5) -> DataFrame:
    """(domain, link, verdict), one row per link: all codes 1-4 joined by `` | `` in ascending order, else '5'.

    Codes are counted, and the text is written out from the counts.
    """
    counted = answers.groupBy("domain").agg(
        *[F.count_if(F.col("verdict") == c).alias(f"_{c}") for c in codes]
    )
    listed = F.flatten(
        F.array(*[F.array_repeat(F.lit(str(c)), F.col(f"_{c}").cast("int")) for c in codes])
    )
    joined = F.when(F.size(listed) > 0, F.array_join(listed, " | ")).otherwise(str(otherwise))
    return domain_links(answers).join(counted.select("domain", joined.alias("verdict")), "domain")


def evidence(answers: DataFrame, restrictive: Column) -> DataFrame:
    """The evidence behind restrictive answers, one row each (domain, link, date, evidence)."""
    return answers.filter(restrictive).select("domain", "link", "date", "evidence")


def evidence_text(answers: DataFrame, restrictive: Column) -> DataFrame:
    """(domain, link, text): evidence of one page joined over its dates."""
    return (
        evidence(answers, restrictive)
        .groupBy("domain", "link")
        .agg(F.array_sort(F.collect_list(F.struct("date", "evidence"))).alias("_e"))
        .select("domain", "link", F.array_join(F.col("_e.evidence"), " | ").alias("text"))
    )


def nested_answers(answers: DataFrame) -> DataFrame:
    """(domain, link, answers map date -> (verdict, evidence)): one row per page for the JSON sink."""
    entry = F.struct(
        F.col("date").cast("string").alias("key"),
        F.struct("verdict", "evidence").alias("value"),
    )
    return (
        complete_answers(answers)
        .groupBy("domain", "link")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("answers"))
    )
