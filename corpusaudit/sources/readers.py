"""Readers: catalogs, dictionaries, JSON, CSV, text lists, encoded and snapshot files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit import schemas
from corpusaudit.functions import dates
from corpusaudit.functions import text as tx

# Files of a catalog folder that describe the layout, not datasets.
TEMPLATE_FILES = "_template"


def read_summaries(
    spark: SparkSession, folder: str, schema: T.StructType = schemas.TEXT_SUMMARY, pattern: str = "*.json", lines: bool = False
) -> DataFrame:
    """One row per dataset from files that hold ``{uid: record}``; template files are skipped.

    A file is one object, or with ``lines`` one object per line, so that no value grows with the file.
    """
    files = spark.read.text(f"{folder}/{pattern}", wholetext=not lines).select(
        F.col("_metadata.file_name").alias("file"), "value"
    )
    # the key of the repository date occurs in two spellings; column names ignore case
    one_spelling = F.regexp_replace("value", '"Github Date"', '"GitHub Date"')
    records = F.from_json(one_spelling, T.MapType(T.StringType(), schema))
    return (
        files.filter(~F.contains("file", F.lit(TEMPLATE_FILES)))
        .select(F.explode(records).alias("_uid", "record"))
        .select("record.*")
    )


def catalog_columns(summaries: DataFrame) -> DataFrame:
    """The short column names the catalog operators use; '' becomes NULL."""
    c = lambda name: F.nullif(F.col(name), F.lit(""))
    meta = lambda name: F.nullif(F.col(f"`Inferred Metadata`.`{name}`"), F.lit(""))
    licenses = F.transform(
        "Licenses", lambda x: F.struct(x["License"].alias("license"), x["License URL"].alias("license_url"))
    )
    metrics = lambda name: F.col(f"`Text Metrics`.`{name}`")
    return summaries.select(
        c("`Unique Dataset Identifier`").alias("uid"),
        c("Collection").alias("collection"),
        c("`Dataset Name`").alias("dataset_name"),
        F.col("Languages").alias("languages"),
        F.col("`Task Categories`").alias("task_categories"),
        F.col("`Text Sources`").alias("text_sources"),
        F.col("`Model Generated`").alias("model_generated"),
        F.col("Creators").alias("creators"),
        F.col("Format").alias("format"),
        licenses.alias("licenses"),
        metrics("Num Dialogs").alias("num_dialogs"),
        metrics("Mean Inputs Length").alias("mean_inputs_length"),
        metrics("Mean Targets Length").alias("mean_targets_length"),
        metrics("Mean Dialog Turns").alias("mean_dialog_turns"),
        F.col("`Dataset Filter IDs`").alias("filter_ids"),
        c("Bibtex").alias("bibtex"),
        F.array_compact(F.array(meta("HF Yaml License"), meta("HF Config License"))).alias("hub_licenses"),
        meta("GitHub License").alias("repo_license"),
        meta("PwC License Name").alias("papers_license"),
        meta("HF Date").alias("hub_date"),
        meta("S2 Date").alias("paper_date"),
        meta("GitHub Date").alias("repo_date"),
    )


def read_dictionaries(spark: SparkSession, folder: str, pattern: str = "*.json", lines: bool = False) -> DataFrame:
    """(dictionary, group, member) from files that hold ``{group: [members]}``, once or with ``lines`` on every line."""
    files = spark.read.text(f"{folder}/{pattern}", wholetext=not lines)
    groups = F.from_json("value", "map<string,array<string>>")
    return files.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("dictionary"),
        F.explode(groups).alias("group", "members"),
    ).select("dictionary", "group", F.explode("members").alias("member"))


def read_license_classes(spark: SparkSession, file: str, key: str = "license") -> DataFrame:
    """(license, use, attribution, share_alike) from ``{name: [use, attribution, share_alike]}``."""
    entries = F.from_json("value", "map<string,array<string>>")
    return (
        spark.read.text(file, wholetext=True)
        .select(F.explode(entries).alias(key, "v"))
        .select(
            key,
            F.get("v", F.lit(0)).alias("use"),
            F.get("v", F.lit(1)).alias("attribution"),
            F.get("v", F.lit(2)).alias("share_alike"),
        )
    )


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON document per file, plain or gzip."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema else reader).json(path)


def read_items(spark: SparkSession, path: str, name: str = "item") -> DataFrame:
    """One trimmed item per line, blank lines dropped."""
    item = tx.strip(F.col("value"))
    return spark.read.text(path).select(item.alias(name)).filter(F.col(name) != "")


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    sep: str = ",",
    date_format: str | None = None,
    multi_line: bool = False,
    null_cell: str = "",
) -> DataFrame:
    """CSV or tab-separated files with a header.

    Files are split over tasks; with ``multi_line`` quoted fields may span lines and a file is one task.
    ``null_cell`` is how NULL is spelled; any other cell, an empty one too, is kept as it is.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"')
    reader = reader.option("nullValue", null_cell).option("emptyValue", "")
    if date_format:
        reader = reader.option("dateFormat", date_format)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_named_tables(
    spark: SparkSession, glob: str, names: Sequence[str], schema: T.StructType | str | None = None, sep: str = "_"
) -> DataFrame:
    """CSV files whose name carries columns, e.g. ``<corpus>_<service>_estimates.csv``."""
    parts = F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""), sep)
    return read_table(spark, glob, schema).select(
        "*", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


# What windows-1252 has at 0x80 to 0x9F; the five unused places stay as they are.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
C1 = "".join(map(chr, range(0x80, 0xA0)))

#: Bytes that are looked at for a pattern of zeros.
LOOK = 200


def charset_of(content: Column) -> Column:
    """The character set of a text's bytes: by its byte-order mark, by zeros at every other place, or by being valid UTF-8.

    Anything else has one byte per character: windows-1252, which is ISO-8859-1 where no bytes 0x80 to 0x9F occur. No bytes are UTF-8.
    """
    marked = lambda *bom: F.startswith(content, F.lit(bytes(bom)))
    start = F.hex(F.substring(content, 1, LOOK))
    zeros = lambda first: F.size(F.filter(F.regexp_extract_all(start, F.lit("...."), F.lit(0)), lambda p: F.substring(p, first, 2) == "00"))
    pairs = F.length(start) / 4
    return (
        F.when(marked(0xEF, 0xBB, 0xBF), "UTF-8")
        .when(marked(0xFF, 0xFE) | marked(0xFE, 0xFF), "UTF-16")
        .when((zeros(3) > 0.5 * pairs) & (zeros(1) == 0), "UTF-16LE")
        .when((zeros(1) > 0.5 * pairs) & (zeros(3) == 0), "UTF-16BE")
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8")
        .otherwise("windows-1252")
    )


def decoded(content: Column, charset: Column | str) -> Column:
    """Text of bytes in a character set, without a byte-order mark."""
    charset = F.lit(charset) if isinstance(charset, str) else charset
    wide = [F.when(charset == c, F.decode(content, c)) for c in ("UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE", "ISO-8859-1")]
    western = F.translate(F.decode(content, "ISO-8859-1"), C1, CP1252)
    return F.regexp_replace(F.coalesce(*wide, F.when(charset == "windows-1252", western)), "^\ufeff", "")


def read_encoded(spark: SparkSession, glob: str | Sequence[str], charset: str | None = None) -> DataFrame:
    """(path, charset, text) of files of any character set, or of a given one.

    Small files share a task up to the size of a split; empty files have no row.
    """
    content = F.col("content")
    named = charset_of(content) if charset is None else F.lit(charset)
    files = spark.read.format("binaryFile").load(glob).select("path", "content", named.alias("charset"))
    return files.select("path", "charset", decoded(content, F.col("charset")).alias("text"))


#: Tasks per core that list folders.
LISTERS = 4

#: (folder of the URL)/(14 digits of the time).html
SNAPSHOT_TREE = r"/([^/]+)/(\d{14})[^/]*\.html$"


def read_snapshots(
    spark: SparkSession, folder: str, since: str | None = None, until: str | None = None, pattern: str = SNAPSHOT_TREE
) -> DataFrame:
    """(url_key, ts, charset, html) from trees of snapshot files whose paths match ``pattern`` with key and time.

    ``since`` and ``until`` bound the time (14 digits, ``until`` exclusive). They and the pattern apply to the path, so the files of other
    paths are not opened; those that are share tasks by their size. Folders are listed by a few tasks per core: by itself Spark starts one
    per folder, up to thousands, each at a fixed cost far above that of listing.
    """
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), LISTERS * spark.sparkContext.defaultParallelism))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    finally:
        spark.conf.set(setting, before)
    path = F.col("_metadata.file_path")
    stamp = F.regexp_extract(path, pattern, 2)
    files = files.filter(path.rlike(pattern))
    if since:
        files = files.filter(stamp >= since)
    if until:
        files = files.filter(stamp < until)
    key = F.url_decode(F.replace(F.regexp_extract(path, pattern, 1), F.lit("+"), F.lit("%2B")))
    found = files.select(key.alias("url_key"), dates.snapshot_time(stamp).alias("ts"), "content", charset_of(F.col("content")).alias("charset"))
    return found.select("url_key", "ts", "charset", decoded(F.col("content"), F.col("charset")).alias("html"))


def read_url_texts(spark: SparkSession, path: str) -> DataFrame:
    """(url, text) from JSON lines, plain or gzip: ``{"url": .., "text": ..}`` or an object ``{url: text}`` per line.

    A map of the whole corpus belongs into one line per entry, so that files can be split.
    """
    entry = F.from_json("value", "url string, text string")
    entries = F.when(entry["url"].isNotNull() & entry["text"].isNotNull(), F.create_map(entry["url"], entry["text"]))
    return spark.read.text(path).select(
        F.explode(F.coalesce(entries, F.from_json("value", "map<string,string>"))).alias("url", "text")
    )


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs from a text file, or from the first column of a CSV file."""
    if path.endswith(".csv"):
        table = read_table(spark, path)
        return table.select(F.col(table.columns[0]).alias("url")).filter("url IS NOT NULL AND url <> ''")
    return read_items(spark, path, "url")


def read_dated_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(url, date, text) from JSON lines; later paths replace earlier ones.

    A line is one entry ``{"url": .., "date": .., "text": ..}`` or an object ``{url: {date: text}}``.
    """
    out = None
    for i, path in enumerate(paths):
        entry = F.from_json("value", "url string, date string, text string")
        single = F.create_map(entry["url"], F.create_map(entry["date"], entry["text"]))
        entries = F.when(entry["date"].isNotNull() & entry["url"].isNotNull(), single)
        part = (
            spark.read.text(path)
            .select(F.explode(F.coalesce(entries, F.from_json("value", "map<string,map<string,string>>"))).alias("url", "by_date"))
            .select("url", F.explode("by_date").alias("date", "text"), F.lit(i).alias("_source"))
        )
        out = part if out is None else out.unionByName(part)
    return out.groupBy("url", "date").agg(F.max_by("text", "_source").alias("text"))


def read_hours(spark: SparkSession, path: str, dataset: str, language: str, hours: Column) -> DataFrame:
    """(dataset, language_code, hours) from one per-language side table."""
    return read_table(spark, path).select(
        F.lit(dataset).alias("dataset"), F.col(language).alias("language_code"), hours.alias("hours")
    )
