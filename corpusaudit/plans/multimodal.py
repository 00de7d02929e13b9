"""One table over text, speech and video catalogs with license types, terms and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import dates
from corpusaudit.functions import text as tx
from corpusaudit.operators import catalog as ct
from corpusaudit.operators import licenses as lic
from corpusaudit.operators import reports


def _licenses(column: str = "Licenses"):
    return F.transform(
        column, lambda x: F.struct(x["License"].alias("license"), x["License URL"].alias("license_url"))
    )


def unify(text: DataFrame, speech: DataFrame, video: DataFrame) -> DataFrame:
    """Common columns of the three catalogs: uid, modality, collection, hours, year, lists."""
    id_ = F.col("`Unique Dataset Identifier`").alias("uid")
    meta = lambda n: F.col(f"`Inferred Metadata`.`{n}`")
    metrics = lambda n: F.col(f"`Text Metrics`.`{n}`")
    tokens = ct.total_tokens(
        metrics("Num Dialogs"), metrics("Mean Dialog Turns"), metrics("Mean Inputs Length"), metrics("Mean Targets Length")
    )
    parts = {
        "Text": text.select(
            id_,
            F.col("Collection").alias("collection"),
            F.col("Languages").alias("languages"),
            F.col("`Task Categories`").alias("tasks"),
            F.col("Creators").alias("creators"),
            F.col("`Text Sources`").alias("sources"),
            F.col("`Model Generated`").alias("model_generated"),
            _licenses().alias("licenses"),
            tokens.alias("total_tokens"),
            dates.earliest_year(meta("S2 Date"), meta("HF Date"), meta("GitHub Date")).alias("year"),
        ),
        "Speech": speech.select(
            id_,
            F.col("Collection").alias("collection"),
            F.col("`Languages (ISO)`").alias("languages"),
            F.col("Tasks").alias("tasks"),
            F.col("Creators").alias("creators"),
            F.col("`Source Category`").alias("sources"),
            F.col("Location").alias("countries"),
            _licenses().alias("licenses"),
            tx.number_or_null(F.col("Hours")).alias("hours"),
            F.col("`Year Released`").alias("year"),
        ),
        "Video": video.select(
            id_,
            F.coalesce("Collection", "`Dataset Name`").alias("collection"),
            F.col("`Task Categories`").alias("tasks"),
            F.col("Creators").alias("creators"),
            F.col("`Video Sources`").alias("sources"),
            F.col("Countries").alias("countries"),
            _licenses().alias("licenses"),
            tx.number_or_null(F.col("`Video Hours`")).alias("hours"),
            F.col("`Year Released`").alias("year"),
        ),
    }
    return reports.stack_modalities(parts)


def multimodal_table(
    unified: DataFrame, classes: DataFrame, terms: DataFrame, paraphrases: DataFrame | None = None
) -> DataFrame:
    """Unified rows with license type, terms, their label and the year bucket.

    ``terms`` is (collection, terms). Licenses are classified on the long table, so paraphrases and
    classes are joins.
    """
    feeds = lic.license_feeds(unified, annotated_only=True)
    if paraphrases is not None:
        feeds = lic.remap_long(feeds, paraphrases)
    resolved = lic.resolve(lic.classify(feeds, classes))
    use = resolved.filter(F.col("source") == dims.ANNOTATED_NO_MODEL_TERMS).select("uid", "use")
    joined = unified.join(use, "uid", "left").join(terms, "collection", "left")
    return joined.select(
        "*",
        lic.license_type(F.col("use")).alias("license_type"),
        lic.merge_closed_terms(lic.license_terms(F.col("use"), F.coalesce("terms", F.lit("Unspecified")))).alias(
            "license_terms"
        ),
        dates.year_bucket(F.col("year").try_cast("int"), 2013).alias("year_category"),
        ct.with_synthetic_source(F.col("sources"), F.col("model_generated")).alias("source_category"),
    )
