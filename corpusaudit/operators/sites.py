"""Annotated web sites: hygiene, indicators, domain categories, market shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import urls, windows
from corpusaudit.operators import reports

# Names of annotation fields.
MODALITIES = ["Text", "Images", "Video", "Audio"]
LEVELS = ["High", "Medium", "Low"]
TERMS_LINKS = [f"Terms of Use Link {i}" for i in range(1, 6)]


def _present(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit("")) != ""


def merge_annotations(rows: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """One row per canonical domain; the latest row's values win, a reported issue sticks."""
    keyed = rows.withColumn("url", urls.with_www(F.col("domain")))
    return keyed.groupBy("url").agg(
        F.bool_or(_present("website_issue")).alias("issue"),
        *[F.max_by(F.col(f"`{c}`"), order).alias(c) for c in columns],
    )


def split_annotations(
    merged: DataFrame, required: Sequence[str] = ("description", "paywall")
) -> tuple[DataFrame, DataFrame]:
    """(usable, unannotated) sites; sites with an issue are in neither."""
    filled = F.lit(True)
    for c in required:
        filled = filled & _present(c)
    clean = merged.filter(~F.col("issue"))
    return clean.filter(filled), clean.filter(~filled)


def categories(values: Column, dictionary: dict[str, str]) -> Column:
    """Distinct sorted categories of annotated values; unknown values are 'Other'."""
    cleaned = F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v != "")
    mapping = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    return F.array_sort(
        F.array_distinct(
            F.transform(cleaned, lambda v: F.coalesce(F.try_element_at(mapping, v), F.lit("Other")))
        )
    )


def category_rows(rows: DataFrame, key: str, values: str, dictionary: DataFrame) -> DataFrame:
    """(key, category) with a dictionary table (member in lower case, group), for large dictionaries."""
    exploded = rows.select(key, F.explode(values).alias("_v")).select(
        key, F.lower(F.trim("_v")).alias("member")
    )
    return (
        exploded.filter("member <> ''")
        .join(dictionary.select("member", "group"), "member", "left")
        .select(key, F.coalesce("group", F.lit("Other")).alias("category"))
        .distinct()
    )


def unmatched_values(rows: DataFrame, values: str, dictionary: DataFrame) -> DataFrame:
    """(value, count) of annotated values the dictionary does not know."""
    exploded = rows.select(F.explode(values).alias("_v")).select(F.lower(F.trim("_v")).alias("member"))
    return (
        exploded.filter("member <> ''")
        .groupBy("member")
        .agg(F.count("*").alias("count"))
        .join(dictionary.select("member"), "member", "left_anti")
        .select(F.col("member").alias("value"), "count")
    )


def share_labels(mine: Column, theirs: Column) -> Column:
    """Add the labels both vocabularies know from the other set."""
    common = F.array(*[F.lit(v) for v in dims.SHARED_LABELS])
    return F.array_union(mine, F.array_intersect(theirs, common))


def compress_domains(values: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in dims.DOMAIN_CATEGORY.items() for x in kv])
    return F.array_distinct(F.transform(values, lambda v: F.try_element_at(mapping, v)))


def indicators(sites: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    """Boolean columns per site from its annotations."""
    has = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("", "None", "False", "false")
    any_sensitive = F.lit(False)
    for c in sensitive:
        any_sensitive = any_sensitive | has(c)
    return sites.select(
        "url",
        (F.coalesce("user_content", F.lit("None")) == "Weak Moderation").alias("user_content"),
        (F.col("paywall") != "No").alias("paywall"),
        (F.coalesce("ads", F.lit("")) == "Yes").alias("ads"),
        has("images").alias("modality_image"),
        has("video").alias("modality_video"),
        has("audio").alias("modality_audio"),
        any_sensitive.alias("sensitive_content"),
    )


def modalities_label(levels: dict[str, Column], accepted: Sequence[str] = tuple(LEVELS)) -> Column:
    """``Text, Video``: names of the modalities present at an accepted level."""
    return F.concat_ws(
        ", ", *[F.when(level.isin(list(accepted)), F.lit(name)) for name, level in levels.items()]
    )


def modality_list(flags: dict[str, Column]) -> Column:
    """Array of the modalities annotated as TRUE."""
    return F.array_compact(
        F.array(*[F.when(F.upper(flag) == "TRUE", F.lit(name)) for name, flag in flags.items()])
    )


def paywall_ads_class(paywall: Column, ads: Column) -> Column:
    return (
        F.when(paywall & ads, "Both Paywall & Ads")
        .when(paywall, "Paywall")
        .when(ads, "Ads")
        .otherwise("No Ads or Paywall")
    )


def name_category(host: Column) -> Column:
    """Category of a domain by keywords in its registered name, the first matching list wins."""
    labels = F.split(F.lower(host), "[.]")
    name = F.coalesce(F.get(labels, F.size(labels) - 2), F.lower(host))
    out = None
    for category, words in dims.DOMAIN_NAME_KEYWORDS:
        hit = name.rlike("|".join(words))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("Other")


def class_by_service(sites: DataFrame, services: str, label: str, tokens: str) -> DataFrame:
    """(service, label, instances, tokens, shares): a site counts once per service it offers.

    ``share`` is the label's part of the service's sites, ``token_share`` its part of all tokens.
    """
    rows = sites.select(F.explode(services).alias("service"), label, tokens)
    cells = rows.groupBy("service", label).agg(
        F.count("*").alias("instances"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")
    )
    inside = windows.share_of_total(cells, "instances", ["service"], "share")
    return windows.share_of_total(inside, "tokens", [], "token_share")


def category_counts(rows: DataFrame, values: str, classes: DataFrame) -> DataFrame:
    """(category, class, count, pct) of exploded categories with their class."""
    counted = reports.value_counts(rows.select(F.explode(values).alias("category")), "category")
    return counted.join(
        classes.select(F.col("member").alias("category"), F.col("group").alias("class")), "category", "left"
    )


def share_with(rows: DataFrame, group: str, values: str, wanted: str) -> DataFrame:
    """Share of rows per group whose list contains a value."""
    return rows.groupBy(group).agg(
        F.avg(F.array_contains(values, wanted).cast("int")).alias("share")
    )


def domain_links(rows: DataFrame, domain: str, columns: Sequence[str]) -> DataFrame:
    """(domain, link): all distinct links of a domain from several columns and rows, one row each."""
    links = F.array_compact(F.array(*[F.col(f"`{c}`") for c in columns]))
    return rows.select(F.col(domain).alias("domain"), F.explode(links).alias("link")).distinct()


def annotated_urls(rows: DataFrame, site_type: str) -> DataFrame:
    """Distinct URLs to fetch: terms pages, robots files or main pages."""
    if site_type == "tos":
        links = F.array_compact(F.array(*[F.col(f"`{c}`") for c in TERMS_LINKS]))
        long = rows.select(F.explode(links).alias("url")).filter("url <> ''")
        return long.select(urls.https_prefixed(F.col("url")).alias("url")).distinct()
    given = rows.select(F.col("URL").alias("url")).filter("url <> ''")
    form = {"robots": urls.robots_url, "main": urls.https_prefixed}.get(site_type, lambda c: c)
    return given.select(form(F.col("url")).alias("url")).distinct()


def purposes(sites: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(url, purposes): the distinct annotated content domains of a site."""
    listed = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.col(c), F.lit("")) for c in columns])))
    return sites.select("url", listed.alias("purposes"))
