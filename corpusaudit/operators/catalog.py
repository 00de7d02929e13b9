"""Catalog filters and summaries over one row per dataset.

Columns: uid, collection, dataset_name, languages, task_categories, text_sources, model_generated,
creators, licenses, num_dialogs, filter_ids, bibtex, hub_date, paper_date, repo_date and, after
:func:`corpusaudit.operators.licenses.license_criteria`, the license columns.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import dates
from corpusaudit.functions import text as tx
from corpusaudit.operators import licenses as lic
from corpusaudit.operators import quality


def members_of(dictionary: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Members of the chosen groups of a (member, group) dictionary."""
    return dictionary.filter(F.col("group").isin(list(groups))).select("member").distinct()


def listed_values(catalog: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """(keep, column, value) of several list or text columns in one pass over the catalog."""
    kinds = dict(catalog.dtypes)
    lists = [
        F.struct(F.lit(c).alias("column"), (F.col(c) if kinds[c].startswith("array") else F.array(c)).alias("_values"))
        for c in columns
    ]
    rows = catalog.select(*keep, F.inline(F.array(*lists)))
    return rows.select(*keep, "column", F.explode("_values").alias("value")).filter("value IS NOT NULL")


def long_dictionary(dictionaries: dict[str, DataFrame]) -> DataFrame:
    """(column, value) of all dictionaries."""
    return quality.union_all(
        d.select(F.lit(c).alias("column"), F.col("member").alias("value")) for c, d in dictionaries.items()
    ).distinct()


@dataclass(frozen=True)
class CatalogFilter:
    """What a user may select. Empty fields do not restrict."""

    collection: str | None = None
    uids: tuple[str, ...] = ()
    licenses: tuple[str, ...] = ()
    license_use: str | None = None
    license_sources: tuple[str, ...] = (dims.ANNOTATED,)
    combine_sources: str = "any"
    ignore_model_terms: bool = False
    repo_fallback: bool = False
    max_attribution: int | None = None
    max_share_alike: int | None = None
    languages: tuple[str, ...] = ()
    tasks: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    no_synthetic: bool = False
    allowed_sources: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None

    def validated(self) -> CatalogFilter:
        """Check the arguments on the driver."""
        if self.license_use and self.license_use not in dims.USE_LADDER:
            raise ValueError(f"license_use must be one of {dims.USE_LADDER}")
        unknown = set(self.license_sources) - set(dims.LICENSE_SOURCES)
        if unknown:
            raise ValueError(f"unknown license sources: {sorted(unknown)}")
        parsed = {}
        for name in ("start", "end"):
            value = getattr(self, name)
            if value:
                parsed[name] = datetime.date.fromisoformat(value)
        if len(parsed) == 2 and parsed["start"] >= parsed["end"]:
            raise ValueError("start must be before end")
        return self

    def effective_sources(self) -> list[str]:
        sources = list(self.license_sources)
        return lic.without_model_terms(sources) if self.ignore_model_terms else sources

    def predicate(self) -> Column:
        """One conjunction of all that can be told from a row alone."""
        sources = self.effective_sources()
        tests = [F.lit(True)]
        if self.collection:
            tests.append(F.col("collection") == self.collection)
        if self.uids:
            tests.append(F.col("uid").isin(list(self.uids)))
        if self.licenses:
            tests.append(F.forall("licenses", lambda x: x["license"].isin(list(self.licenses))))
        if self.license_use:
            tests.append(lic.use_allowed(self.license_use, sources, self.combine_sources))
        if self.max_attribution is not None:
            tests.append(lic.flag_at_most("attribution", self.max_attribution, sources))
        if self.max_share_alike is not None:
            tests.append(lic.flag_at_most("share_alike", self.max_share_alike, sources))
        if self.no_synthetic:
            tests.append(F.coalesce(F.size("model_generated"), F.lit(0)) <= 0)
        if self.allowed_sources:
            allowed = F.array(*[F.lit(s) for s in self.allowed_sources])
            tests.append(F.size(F.array_except("text_sources", allowed)) <= 0)
        if self.start or self.end:
            made = creation_date()
            if self.start:
                tests.append(made >= F.lit(self.start).cast("date"))
            if self.end:
                tests.append(made <= F.lit(self.end).cast("date"))
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out

    def apply(
        self,
        criteria: DataFrame,
        dictionaries: dict[str, DataFrame] | None = None,
        allowed_uids: DataFrame | None = None,
    ) -> DataFrame:
        """Selected rows.

        ``dictionaries`` maps languages / tasks / domains to (member, group) tables and ``allowed_uids`` is an allow
        list with column ``uid``; both may have any size. Groups select by uid: a dataset stays when one of its values
        is a member of a chosen group.
        """
        checked = self.validated()
        rows = lic.with_repo_fallback(criteria) if checked.repo_fallback else criteria
        kept = rows.filter(checked.predicate())
        for name, column, groups in (
            ("languages", "languages", self.languages),
            ("tasks", "task_categories", self.tasks),
            ("domains", "text_sources", self.domains),
        ):
            if groups:
                values = kept.select("uid", F.explode(column).alias("member"))
                inside = values.join(members_of(dictionaries[name], groups), "member", "left_semi")
                kept = kept.join(inside.select("uid").distinct(), "uid", "left_semi")
        return kept if allowed_uids is None else kept.join(allowed_uids.select("uid"), "uid", "left_semi")

    def but(self, **changes) -> CatalogFilter:
        return replace(self, **changes)


# The shipped selections. All allow attribution and share-alike duties.
DEFAULT = CatalogFilter(license_use="academic-only", max_attribution=1, max_share_alike=1)
FILTER_PRESETS = {
    "default": DEFAULT,
    "commercial_licenses": DEFAULT.but(license_use="commercial", ignore_model_terms=True),
    "commercial_licenses_and_terms": DEFAULT.but(license_use="commercial"),
    "commercial_or_unspecified_licenses": DEFAULT.but(
        license_use="unspecified", ignore_model_terms=True
    ),
    "commercial_or_unspecified_licenses_and_terms": DEFAULT.but(license_use="unspecified"),
    # takes its list of dataset uids from an allow-list file
    "ultra_permissive": DEFAULT,
}


def creation_date() -> Column:
    return dates.earliest_date(F.col("paper_date"), F.col("hub_date"), F.col("repo_date"))


def unknown_members(catalog: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """(rule, uid, detail) of list values the dictionaries do not know; keys are column names."""
    values = listed_values(catalog, list(dictionaries), "uid").distinct()
    unknown = values.join(long_dictionary(dictionaries), ["column", "value"], "left_anti")
    return unknown.select(F.concat(F.lit("unknown "), "column").alias("rule"), "uid", F.col("value").cast("string").alias("detail"))


def composition(catalog: DataFrame, column: str, item: str | None = None) -> DataFrame:
    """Datasets and dialogs per item of a column, largest first, with shares in percent.

    A dataset's dialogs are split evenly over its items and truncated; ``item`` names a field when
    the column holds structs.
    """
    kind = dict(catalog.dtypes)[column]
    if kind.startswith("array"):
        values = F.col(f"{column}.{item}") if item else F.col(column)
        rows = catalog.select(
            F.explode(values).alias("item"),
            F.floor(F.col("num_dialogs") / F.size(column)).cast("bigint").alias("_dialogs"),
        )
    else:
        rows = catalog.select(F.col(column).alias("item"), F.col("num_dialogs").alias("_dialogs"))
    counts = rows.groupBy("item").agg(
        F.count("*").alias("datasets"), F.coalesce(F.sum("_dialogs"), F.lit(0)).alias("dialogs")
    )
    totals = counts.agg(
        F.sum("datasets").alias("d"), F.sum("dialogs").alias("e")
    ).select(F.struct("d", "e").alias("t"))
    total = totals.scalar()
    return counts.select(
        "item",
        "datasets",
        F.round(100 * F.try_divide(F.col("datasets"), total["d"]), 2).alias("pct_datasets"),
        "dialogs",
        F.coalesce(F.round(100 * F.try_divide(F.col("dialogs"), total["e"]), 2), F.lit(0.0)).alias(
            "pct_dialogs"
        ),
    ).orderBy(F.desc("datasets"), "item")


def catalog_totals(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count("*").alias("datasets"),
        F.sum("num_dialogs").alias("dialogs"),
        F.count_distinct("collection").alias("collections"),
    )


def missing_metrics(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("num_dialogs").isNull()).select("collection").distinct()


def map_values(catalog: DataFrame, column: str, dictionary: DataFrame, out: str) -> DataFrame:
    """(uid, value, group) of a list column; unknown values get NULL (lenient lookup)."""
    values = catalog.select("uid", F.explode(column).alias("member"))
    return values.join(dictionary.select("member", "group"), "member", "left").select(
        "uid", F.col("member").alias(column), F.col("group").alias(out)
    )


def map_strict(values: DataFrame, column: str, dictionary: DataFrame, out: str) -> DataFrame:
    """The same lookup where an unknown value is an error."""
    lookup = dictionary.select(F.col("member").alias(column), F.col("group").alias("_group"))
    missing = F.raise_error(F.concat(F.lit(f"no {out} for "), F.col(column))).cast("string")
    return (
        values.join(lookup, column, "left")
        .withColumn(out, F.coalesce("_group", missing))
        .drop("_group")
    )


def coverage_gaps(catalog: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """(category, value, collections) of values missing in the dictionaries.

    Collections are de-duplicated before they are listed, so the list is as long as the number of
    collections, not of datasets.
    """
    values = listed_values(catalog, list(dictionaries), "collection").distinct()
    missing = values.join(long_dictionary(dictionaries), ["column", "value"], "left_anti")
    return missing.groupBy(F.col("column").alias("category"), "value").agg(
        F.array_join(F.sort_array(F.collect_set("collection")), ", ").alias("collections")
    )


def merge_duplicates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge catalog rows of one uid; also return the uids whose license uses disagree.

    List values are united by exploding and de-duplicating before they are collected.
    """
    lists = [c for c, t in rows.dtypes if t == "array<string>" and c != "filter_ids"]
    flags = [c for c in rows.columns if c.startswith(("use_", "attribution_", "share_alike_"))]
    scalars = rows.groupBy("uid").agg(
        F.min("dataset_name").alias("dataset_name"),
        F.sum("num_dialogs").alias("num_dialogs"),
        F.bool_or(F.coalesce(F.size("model_generated"), F.lit(0)) > 0).alias("synthetic"),
        F.min(creation_date()).alias("created"),
        *[F.max(c).alias(c) for c in flags],
    )
    out = scalars
    if lists:
        members = F.array(
            *[F.struct(F.lit(c).alias("field"), F.col(c).alias("items")) for c in lists]
        )
        united = (
            rows.select("uid", F.inline(members))
            .select("uid", "field", F.explode("items").alias("item"))
            .distinct()
            .groupBy("uid")
            .agg(
                *[
                    F.sort_array(F.collect_set(F.when(F.col("field") == c, F.col("item")))).alias(c)
                    for c in lists
                ]
            )
        )
        out = scalars.join(united, "uid", "left")
    disagreement = [F.min(c) != F.max(c) for c in flags]
    if not disagreement:
        return out, rows.select("uid").limit(0)
    conflict = rows.groupBy("uid").agg(
        F.array_compact(
            F.array(*[F.when(d, F.lit(c)) for d, c in zip(disagreement, flags, strict=True)])
        ).alias("fields")
    )
    return out, conflict.filter(F.size("fields") > 0)


def source_groups(catalog: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(uid, source_group): 'Synthetic' for generated data, mapped groups otherwise, 'Other' if unknown."""
    generated = F.coalesce(F.size("model_generated"), F.lit(0)) > 0
    rows = catalog.select(
        "uid",
        F.explode_outer(F.when(generated, F.array(F.lit("Synthetic"))).otherwise(F.col("text_sources"))).alias("member"),
        generated.alias("_generated"),
    )
    group = F.when(F.col("_generated"), F.lit("Synthetic")).otherwise(
        F.coalesce(F.col("group"), F.lit("Other"))
    )
    return (
        rows.join(dictionary.select("member", "group"), "member", "left")
        .select("uid", group.alias("source_group"))
        .distinct()
    )


def with_synthetic_source(sources: Column, models: Column) -> Column:
    """Add 'Synthetic' to the sources unless the data comes from templates or other means."""
    models = F.coalesce(models, F.array().cast("array<string>"))
    generated = (F.size(models) > 0) & ~F.exists(models, lambda m: F.lower(m).isin("templates", "other"))
    added = F.when(generated, F.array_append(sources, F.lit("Synthetic"))).otherwise(sources)
    return F.filter(added, lambda s: s != "Unsure")


def mentions_any(values: Column, needles: Sequence[str]) -> Column:
    """Does any list value contain one of the texts?"""
    def hit(value: Column) -> Column:
        out = F.lit(False)
        for n in needles:
            out = out | F.contains(F.lower(value), F.lit(n.lower()))
        return out

    return F.coalesce(F.exists(values, hit), F.lit(False))


def clean_name(name: Column) -> Column:
    """Dataset name without trailing slashes, known mistakes replaced."""
    return tx.lookup(F.regexp_replace(name, "/+$", ""), dims.NAME_FIXES)


def clean_dataset_url(url: Column) -> Column:
    """Address of a dataset without the viewer part."""
    return F.get(F.split(url, "/viewer/[?]", 2), F.lit(0))


def clean_hub_url(url: Column) -> Column:
    return F.replace(url, F.lit("viewer/?dataset="), F.lit(""))


def repo_license(name: Column) -> Column:
    """License name of a code host in the vocabulary of the license table, '' when it says nothing."""
    return tx.lookup(name, dims.REPO_LICENSE_NAMES)


def total_tokens(
    num_dialogs: Column, mean_turns: Column, mean_inputs: Column, mean_targets: Column
) -> Column:
    """Size of a dataset from its text metrics: dialogs x turns x lengths of one exchange."""
    return num_dialogs * mean_turns * (mean_inputs + mean_targets)
