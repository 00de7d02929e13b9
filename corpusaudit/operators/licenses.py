"""License classes per dataset and source: paraphrases, classes, most restrictive resolution.

Everything runs on a long table ``(uid, source, license, license_url)``. Resolution is one
aggregation of a rank, so a dataset with very many licenses is combined map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import text


def remap_names(licenses: Column, paraphrases: Mapping[str, str]) -> Column:
    """Canonical names inside ``array<struct<license, license_url>>``."""
    return F.transform(
        licenses, lambda x: x.withField("license", text.lookup(x["license"], paraphrases))
    )


def remap_long(feeds: DataFrame, paraphrases: DataFrame) -> DataFrame:
    """Canonical names in a long table; ``paraphrases`` is (member, group)."""
    lookup = paraphrases.select(F.col("member").alias("license"), F.col("group").alias("_name"))
    return (
        feeds.join(lookup, "license", "left")
        .withColumn("license", F.coalesce("_name", "license"))
        .drop("_name")
    )


def license_feeds(catalog: DataFrame, annotated_only: bool = False) -> DataFrame:
    """(uid, source, license, license_url) from the license fields of a catalog.

    ``licenses`` is the annotated list; ``hub_licenses``, ``repo_license`` and ``papers_license``
    come from elsewhere. The feed without model-provider terms gets 'Unspecified' when nothing is
    left of it.
    """
    entry = "array<struct<source:string,license:string,license_url:string>>"
    annotated = F.coalesce(F.col("licenses"), F.array().cast("array<struct<license:string,license_url:string>>"))

    def named(source: str, items: Column) -> Column:
        return F.transform(
            items,
            lambda x: F.struct(
                F.lit(source).alias("source"),
                x["license"].alias("license"),
                x["license_url"].alias("license_url"),
            ),
        )

    def plain(name: Column) -> Column:
        return F.struct(name.alias("license"), F.lit(None).cast("string").alias("license_url"))

    kept = F.filter(annotated, lambda x: x["license"] != dims.MODEL_TERMS_LICENSE)
    unspecified = F.array(plain(F.lit("Unspecified")))
    parts = [
        named(dims.ANNOTATED, annotated),
        named(dims.ANNOTATED_NO_MODEL_TERMS, F.when(F.size(kept) > 0, kept).otherwise(unspecified)),
    ]
    if not annotated_only:
        for source, names in (
            (dims.HUB, F.col("hub_licenses")),
            (dims.REPO, F.array("repo_license")),
            (dims.PAPERS, F.array("papers_license")),
        ):
            given = F.filter(
                F.coalesce(names, F.array().cast("array<string>")),
                lambda n: F.coalesce(n, F.lit("")) != "",
            )
            parts.append(named(source, F.transform(given, plain)))
    return catalog.select("uid", F.inline(F.concat(*[p.cast(entry) for p in parts])))


def _flag(value: Column) -> Column:
    """Flags are '0' or '1'; anything else counts as required."""
    return F.coalesce(value.try_cast("int"), F.lit(1))


def classify(feeds: DataFrame, classes: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Add use, attribution, share_alike. ``custom`` holds classes by URL of licenses named 'Custom'.

    An unknown custom URL is '?'; an unknown name leaves NULLs (see :func:`unknown_licenses`).
    """
    by_name = classes.select(
        "license",
        F.col("use").alias("_use"),
        F.col("attribution").alias("_attribution"),
        F.col("share_alike").alias("_share_alike"),
    )
    joined = feeds.join(by_name, "license", "left")
    fields = ("use", "attribution", "share_alike")
    is_custom = F.col("license") == dims.CUSTOM_LICENSE
    if custom is not None:
        by_url = custom.select("license_url", *[F.col(f).alias(f"_c_{f}") for f in fields])
        joined = joined.join(by_url, "license_url", "left")
        special = {f: F.coalesce(F.col(f"_c_{f}"), F.lit("?")) for f in fields}
    else:
        special = {f: F.lit("?") for f in fields}
    value = {f: F.when(is_custom, special[f]).otherwise(F.col(f"_{f}")) for f in fields}
    known = value["use"].isNotNull()
    return joined.select(
        "uid",
        "source",
        "license",
        "license_url",
        value["use"].alias("use"),
        F.when(known, _flag(value["attribution"])).alias("attribution"),
        F.when(known, _flag(value["share_alike"])).alias("share_alike"),
    )


def unknown_licenses(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("use").isNull()).select("uid", "source", "license").distinct()


def resolve(classified: DataFrame) -> DataFrame:
    """Most restrictive use and the highest flags per (uid, source)."""
    rank = text_rank(F.col("use"))
    resolved = classified.filter(F.col("use").isNotNull()).groupBy("uid", "source").agg(
        F.min(rank).alias("_rank"),
        F.max("attribution").alias("attribution"),
        F.max("share_alike").alias("share_alike"),
    )
    names = F.array(*[F.lit(u) for u in dims.USE_BY_RANK])
    return resolved.select(
        "uid", "source", F.get(names, F.col("_rank")).alias("use"), "attribution", "share_alike"
    )


def text_rank(use: Column) -> Column:
    """Restrictiveness of a use code; any other code counts as unrestricted."""
    out = None
    for code, rank in dims.USE_RANK.items():
        hit = use == code
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return out.otherwise(len(dims.USE_BY_RANK) - 1)


def widen(resolved: DataFrame, sources: Sequence[str] = tuple(dims.LICENSE_SOURCES)) -> DataFrame:
    """One row per dataset with ``use_<source>``, ``attribution_<source>``, ``share_alike_<source>``."""
    return resolved.groupBy("uid").agg(
        *[
            F.max(F.when(F.col("source") == s, F.col(f))).alias(f"{f}_{s}")
            for s in sources
            for f in ("use", "attribution", "share_alike")
        ]
    )


def license_criteria(
    catalog: DataFrame,
    classes: DataFrame,
    custom: DataFrame | None = None,
    annotated_only: bool = False,
) -> DataFrame:
    """The catalog with its resolved license columns. Datasets without licenses keep NULLs."""
    sources = dims.LICENSE_SOURCES[:2] if annotated_only else dims.LICENSE_SOURCES
    feeds = license_feeds(catalog, annotated_only)
    return catalog.join(widen(resolve(classify(feeds, classes, custom)), sources), "uid", "left")


def with_repo_fallback(criteria: DataFrame) -> DataFrame:
    """Unspecified annotated uses take the repository's use when there is one."""
    repo = F.col(f"use_{dims.REPO}")
    return criteria.withColumns(
        {
            f"use_{s}": F.when(
                (F.col(f"use_{s}") == "unspecified") & repo.isNotNull(), repo
            ).otherwise(F.col(f"use_{s}"))
            for s in (dims.ANNOTATED, dims.ANNOTATED_NO_MODEL_TERMS)
        }
    )


def without_model_terms(sources: Sequence[str]) -> list[str]:
    """Source list with the annotated source swapped for its variant without model-provider terms."""
    return [dims.ANNOTATED_NO_MODEL_TERMS if s == dims.ANNOTATED else s for s in sources]


def use_allowed(use: str, sources: Sequence[str], combine: str = "any") -> Column:
    """True when the use of any (or all) of the sources is at or below a step of the ladder."""
    accepted = dims.USE_LADDER[: dims.USE_LADDER.index(use) + 1]
    checks = [F.coalesce(F.col(f"use_{s}").isin(accepted), F.lit(False)) for s in sources]
    out = checks[0]
    for check in checks[1:]:
        out = (out | check) if combine == "any" else (out & check)
    return out


def flag_at_most(flag: str, cap: int, sources: Sequence[str]) -> Column:
    """True when the flag of every source that has information is at most ``cap``."""
    out = F.lit(True)
    for s in sources:
        out = out & F.coalesce(F.col(f"{flag}_{s}") <= cap, F.lit(True))
    return out


def license_type(use: Column) -> Column:
    return text.lookup(use, dims.LICENSE_TYPE, F.lit(None).cast("string"))


def license_terms(use: Column, terms: Column) -> Column:
    """``Commercial | Unrestricted`` style label."""
    return F.concat_ws(" | ", license_type(use), terms)


def merge_closed_terms(label: Column) -> Column:
    """Closed by source and closed by model both become 'Restricted' (at the end of a label)."""
    return F.regexp_replace(label, "(Source|Model) Closed$", "Restricted")


def terms_verdict(source_answers: Sequence[Column], model_answers: Sequence[Column]) -> Column:
    """Verdict on data terms from free-text answers about the sources and the generating model."""

    def starts(answers: Sequence[Column], prefixes: Sequence[str]) -> Column:
        out = F.lit(False)
        for answer in answers:
            low = F.lower(F.coalesce(answer, F.lit("")))
            for p in prefixes:
                out = out | low.startswith(p)
        return out

    return (
        F.when(starts(source_answers, dims.TERMS_CLOSED), F.lit("Source Closed"))
        .when(starts(model_answers, dims.TERMS_CLOSED), F.lit("Model Closed"))
        .when(starts(source_answers, dims.TERMS_OPEN), F.lit("Unrestricted"))
        .otherwise(F.lit("Unspecified"))
    )
