"""Catalog selection and corpus preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.operators import catalog as ct
from corpusaudit.operators import dialogs as dg
from corpusaudit.operators import licenses as lic
from corpusaudit.operators import presets
from corpusaudit.session import written
from corpusaudit.sources import readers, writers


def select_catalog(
    spark: SparkSession,
    summaries: str,
    selection: ct.CatalogFilter,
    custom_classes: str | None = None,
    dictionaries: dict[str, DataFrame] | None = None,
    pattern: str = "*.json",
    lines: bool = False,
) -> DataFrame:
    """Read summaries, classify their licenses and keep the selected datasets."""
    catalog = readers.catalog_columns(readers.read_summaries(spark, summaries, pattern=pattern, lines=lines))
    custom = readers.read_license_classes(spark, custom_classes, "license_url") if custom_classes else None
    criteria = lic.license_criteria(catalog, dims.license_table(spark), custom)
    return selection.apply(criteria, dictionaries)


def prepare_collection(
    name: str, raw: DataFrame, selected: DataFrame, limit: int | None = None, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(dialogs, unknown ids) of one collection: filtered rows, one message format, dataset uids.

    Filter ids of the selected datasets reach the scan of the raw rows as a semi-join.
    """
    ids = dg.filter_id_map(selected.filter(F.col("collection") == name))
    preset = presets.PRESETS[name]
    rows = raw
    if preset.column:
        if preset.column not in raw.columns:
            raise ValueError(f"{name}: the rows have no column {preset.column!r} to select by")
        accepted = ids.select(F.col("filter_id").alias(preset.column)).distinct()
        rows = raw.join(accepted, preset.column, "left_semi")
    # read for the dialogs and for the unknown ids: normalised once
    normalised = written(presets.normalise_collection(name, rows), "normalised")
    dialogs, unknown = dg.root_to_uid(normalised, ids)
    if limit:
        # the key is the content, so the same dialogs are drawn on every run
        key = F.sha2(F.to_json("messages"), 256)
        dialogs = dg.sample_dialogs(dialogs.withColumn("_all", F.lit(name)), ["_all"], key, limit, seed)
        dialogs = dialogs.drop("_all")
    return dialogs, unknown


def write_corpus(
    dialogs: DataFrame, out: str, form: str = "messages", partition_by: Sequence[str] = ()
) -> None:
    if form == "supervised":
        writers.write_json_lines(dg.supervised_pairs(dialogs), out, partition_by=partition_by)
    elif form == "messages":
        writers.write_json_lines(dialogs, out, partition_by=partition_by)
    else:
        raise ValueError("form must be 'messages' or 'supervised'")
