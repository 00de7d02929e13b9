"""Queries on reading catalogs and files, on the shipped selections, and on the job that prepares a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit import dims, schemas
from corpusaudit.checks.catalogs import CATALOG, FEEDS, catalog, criteria, custom_classes
from corpusaudit.checks.conversations import STRIPPED
from corpusaudit.checks.registry import query, table
from corpusaudit.operators import catalog as ct
from corpusaudit.operators import licenses as lic
from corpusaudit.plans import corpus_prep, multimodal
from corpusaudit.session import shared_folder
from corpusaudit.sources import readers, writers

def summary_records(rows, uid, **values):
    """Summaries as rows of text: one JSON object {uid: record} per line."""
    record = F.struct(uid.alias("Unique Dataset Identifier"), *[c.alias(n) for n, c in values.items()])
    return rows.select(F.to_json(F.create_map(uid, record)).alias("value"))


def written_summaries(spark, rows, uid, **values):
    folder = shared_folder(spark, "summaries")
    summary_records(rows, uid, **values).write.text(folder)
    return folder


def written_dictionary(spark, pairs):
    """Pairs of a group and a member as files, one JSON object {group: [member]} per line."""
    folder = shared_folder(spark, "dictionaries")
    group, member = pairs.columns
    pairs.select(F.to_json(F.create_map(group, F.array(member))).alias("value")).write.text(folder)
    return folder


@query(
    f"""WITH {CATALOG}, x AS (SELECT 'u' || uid AS uid, collection, dataset_name, num_dialogs, unnest(languages) AS language, license_names, hub_date, repo_license FROM cat)
    SELECT uid, collection, dataset_name, language, num_dialogs,
      replace(replace(array_to_string(license_names, '|'), 'License, Version 2.0', 'License 2.0'), 'License, version 3', 'License v3.0') AS licenses, hub_date, coalesce(repo_license, '-') AS repo FROM x"""
)
def summary_files(spark, sf_dir):
    """Summaries written as files, read back and flattened; absent and empty values are NULL."""
    rows = catalog(spark, sf_dir)
    folder = written_summaries(
        spark,
        rows,
        F.concat(F.lit("u"), "uid"),
        **{
            "Collection": F.col("collection"),
            "Dataset Name": F.col("dataset_name"),
            "Languages": F.col("languages"),
            "Text Metrics": F.struct(F.col("num_dialogs").alias("Num Dialogs")),
            "Licenses": F.transform("licenses", lambda x: F.struct(x["license"].alias("License"), x["license_url"].alias("License URL"))),
            "Inferred Metadata": F.struct(F.col("hub_date").alias("HF Date"), F.coalesce("repo_license", F.lit("")).alias("GitHub License")),
        },
    )
    read = readers.catalog_columns(readers.read_summaries(spark, folder, pattern="*.txt", lines=True))
    return read.select(
        "uid",
        "collection",
        "dataset_name",
        F.explode("languages").alias("language"),
        "num_dialogs",
        F.array_join("licenses.license", "|").alias("licenses"),
        "hub_date",
        F.coalesce("repo_license", F.lit("-")).alias("repo"),
    )


@query(
    f"""WITH {FEEDS}, r AS (SELECT uid, source, use, coalesce(attribution <= 1, true) AND coalesce(share_alike <= 1, true) AS mild FROM resolved),
    p(preset, source, step) AS (VALUES ('default', 'annotated', 4), ('commercial_licenses', 'annotated_no_model_terms', 1),
      ('commercial_licenses_and_terms', 'annotated', 1), ('commercial_or_unspecified_licenses', 'annotated_no_model_terms', 2),
      ('commercial_or_unspecified_licenses_and_terms', 'annotated', 2), ('ultra_permissive', 'annotated', 4)),
    l(use, step) AS (VALUES ('commercial', 1), ('unspecified', 2), ('non-commercial', 3), ('academic-only', 4))
    SELECT preset, r.uid FROM p JOIN r ON r.source = p.source JOIN l ON l.use = r.use AND l.step <= p.step
    WHERE mild AND (preset <> 'ultra_permissive' OR r.uid IN (SELECT uid FROM cat WHERE list_contains(languages, 'en')))"""
)
def filter_presets(spark, sf_dir):
    """All shipped selections; the permissive one takes its uids from an allow-list file."""
    rows = criteria(spark, sf_dir)
    folder = shared_folder(spark, "allowed")
    writers.write_text(catalog(spark, sf_dir).filter(F.array_contains("languages", "en")), "uid", folder)
    allowed = readers.read_items(spark, folder, "uid").select(F.col("uid").cast("bigint").alias("uid"))
    out = None
    for name, chosen in ct.FILTER_PRESETS.items():
        kept = chosen.apply(rows, allowed_uids=allowed if name == "ultra_permissive" else None)
        part = kept.select(F.lit(name).alias("preset"), "uid")
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {CATALOG} SELECT uid FROM cat WHERE collection = 'src3'")
def collection_filter(spark, sf_dir):
    return ct.CatalogFilter(collection="src3").apply(catalog(spark, sf_dir)).select("uid")


@query(f"WITH {FEEDS} SELECT uid, coalesce(use_a, '-') AS annotated, coalesce(use_b, '-') AS no_model_terms FROM wide")
def license_criteria_annotated(spark, sf_dir):
    """Criteria from the annotated licenses alone."""
    made = lic.license_criteria(catalog(spark, sf_dir), dims.license_table(spark), custom_classes(spark), annotated_only=True)
    assert f"use_{dims.HUB}" not in made.columns
    dash = F.lit("-")
    return made.select(
        "uid", F.coalesce("use_annotated", dash).alias("annotated"), F.coalesce("use_annotated_no_model_terms", dash).alias("no_model_terms")
    )


@query("SELECT DISTINCT lang AS \"group\", source AS member FROM documents")
def dictionary_files(spark, sf_dir):
    """Group dictionaries written as files and read back, one row per member."""
    pairs = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    folder = written_dictionary(spark, pairs)
    return readers.read_dictionaries(spark, folder, pattern="*.txt", lines=True).select("group", "member")


@query("SELECT o_orderkey, o_orderpriority AS priority, 'part' AS kind FROM orders")
def named_tables(spark, sf_dir):
    """Files whose name carries columns; here its first part."""
    folder = shared_folder(spark, "named")
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority")).write.option("header", True).csv(folder)
    read = readers.read_named_tables(spark, folder, ["kind"], "o_orderkey bigint, priority string", sep="-")
    return read.select("o_orderkey", "priority", "kind")


#: Character sets by the last digit of the id; the third has characters of its own in every text.
CHARSETS = ("UTF-8", "ISO-8859-1", "windows-1252", "UTF-16LE", "UTF-16BE")


def in_charset(text, number):
    """Text that a character set can hold."""
    western = F.regexp_replace(text, r"[^\x00-\xFF]", "?")
    return F.when(number == 1, western).when(number == 2, F.concat(F.lit("€ „"), western)).otherwise(text)


@query(
    r"""SELECT doc_id, length(t)::BIGINT AS size, sha256(t) AS digest FROM (
    SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN regexp_replace(text, '[^\x00-\xFF]', '?', 'g') WHEN 2 THEN '€ „' || regexp_replace(text, '[^\x00-\xFF]', '?', 'g')
        ELSE text END AS t FROM documents)""".replace("\\\\", "\\")
)
def encoded_files(spark, sf_dir):
    """Whole texts in many small files of five character sets, read as bytes, recognised and decoded."""
    folder = shared_folder(spark, "encoded")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for number, charset in enumerate(CHARSETS):
        part = docs.filter(F.col("doc_id") % 5 == number)
        text = in_charset(F.col("text"), F.lit(number)).alias("text")
        if charset == "windows-1252":
            # the sink has no such set: its characters at 0x80 to 0x9F go to those places first
            text, charset = F.translate(text, readers.CP1252, readers.C1).alias("text"), "ISO-8859-1"
        lines = part.select("doc_id", text).write.option("encoding", charset).option("lineSep", "\n").option("maxRecordsPerFile", 20)
        lines.json(f"{folder}/{number}")
    read = readers.read_encoded(spark, f"{folder}/*/*.json")
    rows = read.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    found = rows.select(F.from_json("line", "doc_id bigint, text string").alias("r")).select("r.*")
    return found.select("doc_id", F.length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("digest"))


@query(
    """SELECT page_id, (TIMESTAMP '2020-01-01 00:00:00' + INTERVAL 1 MINUTE * page_id)::VARCHAR AS ts, sha256(html) AS digest FROM pages
    WHERE page_id % 3 <> 0"""
)
def snapshot_tree(spark, sf_dir):
    """Pages as one file per URL key and time, in a tree; the files of the wanted months are read back whole."""
    folder = shared_folder(spark, "snapshots")
    at = F.timestamp_add("MINUTE", F.col("page_id"), F.lit("2020-01-01").cast("timestamp"))
    # a third of the snapshots is of another year, and not opened
    at = F.when(F.col("page_id") % 3 == 0, F.timestamp_add("YEAR", F.lit(-2), at)).otherwise(at)
    pages = table(spark, sf_dir, "pages").select("page_id", F.date_format(at, "yyyyMMddHHmmss").alias("time"), "html")
    writers.write_tree(pages.withColumn("key", F.concat(F.lit("site_"), "page_id")), ["key", "time"], "html", folder)
    read = readers.read_snapshots(spark, folder, "20200101000000", pattern=r"/key=([^/]+)/time=(\d{14})/part-[^/]*$")
    page = F.replace("url_key", F.lit("site_"), F.lit("")).cast("bigint").alias("page_id")
    # every record ends with a line break
    html = F.substring("html", F.lit(1), F.length("html") - 1)
    return read.select(page, F.col("ts").cast("string").alias("ts"), F.sha2(html, 256).alias("digest"))


@query(
    """SELECT n_name AS nation, r_name AS region, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers,
    (SELECT string_agg(s_name, '|' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS names
    FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def json_documents(spark, sf_dir):
    """One JSON document of many lines per nation, half of them compressed, read back with its nested records."""
    folder = shared_folder(spark, "documents")
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("balance")))).alias("suppliers")
    )
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.join(suppliers, "n_nationkey", "left")
    body = F.struct(F.col("n_name").alias("nation"), F.struct(F.col("r_name").alias("region")).alias("place"), "suppliers")
    rows = nations.select("n_nationkey", F.to_json(body, {"pretty": "true"}).alias("value"))
    for rest, codec in ((0, "none"), (1, "gzip")):
        part = rows.filter(F.col("n_nationkey") % 2 == rest).select("value")
        part.write.option("maxRecordsPerFile", 1).option("compression", codec).text(f"{folder}/{codec}")
    schema = "nation string, place struct<region: string>, suppliers array<struct<name: string, balance: double>>"
    read = readers.read_json(spark, f"{folder}/*/*", schema)
    names = F.col("suppliers.name")
    return read.select(
        "nation", "place.region", F.coalesce(F.size("suppliers"), F.lit(0)).cast("bigint").alias("suppliers"), F.array_join(names, "|").alias("names")
    )


@query("SELECT DISTINCT 'set-' || source AS uid, source AS dataset_name FROM documents")
def summary_documents(spark, sf_dir):
    """Summaries in the one-document-per-file layout, a template among them."""
    folder = shared_folder(spark, "summaries")
    rows = table(spark, sf_dir, "documents").select("source").distinct()
    records = summary_records(rows, F.concat(F.lit("set-"), "source"), **{"Dataset Name": F.col("source")})
    records.write.option("maxRecordsPerFile", 1).text(f"{folder}/sets")
    read = readers.read_summaries(spark, f"{folder}/sets", pattern="*.txt")
    return readers.catalog_columns(read).select("uid", "dataset_name")


@query("SELECT DISTINCT url FROM pages WHERE url <> ''")
def url_list_of_table(spark, sf_dir):
    """URLs from the first column of a CSV file, quoted where they hold commas or quotes."""
    folder = shared_folder(spark, "urls") + ".csv"
    rows = table(spark, sf_dir, "pages").groupBy("url").agg(F.count("*").alias("pages"))
    writers.write_csv(rows, folder)
    return readers.read_url_list(spark, folder)


@query("SELECT o_orderkey, true AS small FROM orders")
def json_chunks(spark, sf_dir):
    """JSON lines in files of bounded size: every row comes back and no file holds more than 500."""
    folder = shared_folder(spark, "chunks")
    writers.write_chunks(table(spark, sf_dir, "orders").select("o_orderkey"), folder, 500)
    rows = spark.read.schema("o_orderkey bigint").json(folder).select("o_orderkey", F.col("_metadata.file_name").alias("file"))
    sizes = rows.groupBy("file").agg((F.count("*") <= 500).alias("small"))
    return rows.join(sizes, "file").select("o_orderkey", "small")


@query("SELECT DISTINCT trim(url) AS url FROM pages WHERE trim(url) <> ''")
def url_list(spark, sf_dir):
    """A list of URLs as text lines."""
    folder = shared_folder(spark, "urls")
    writers.write_text(table(spark, sf_dir, "pages").select("url").distinct(), "url", folder)
    return readers.read_url_list(spark, folder)


@query("SELECT url, max(html) AS text FROM pages GROUP BY url")
def url_texts(spark, sf_dir):
    """Texts by URL, one record per line."""
    folder = shared_folder(spark, "texts")
    texts = table(spark, sf_dir, "pages").groupBy("url").agg(F.max("html").alias("text"))
    writers.write_json_lines(texts, folder)
    return readers.read_url_texts(spark, folder)


@query("SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS orders, o_orderpriority AS priority FROM orders GROUP BY ALL")
def partitioned_sheet(spark, sf_dir):
    """A summary table written in partitions and read back."""
    folder = shared_folder(spark, "sheet")
    day = F.to_date("o_orderdate").cast("string").alias("day")
    counts = table(spark, sf_dir, "orders").groupBy(day, F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"))
    writers.write_parquet(counts, folder, partition_by=["priority"])
    return spark.read.schema("day string, orders bigint, priority string").parquet(folder)


@query(
    f"""SELECT 'set-' || source AS dataset, lang || doc_id AS inputs, {STRIPPED} AS targets FROM documents
    WHERE length(source) % 2 = 0 AND {STRIPPED} <> ''"""
)
def prepared_corpus(spark, sf_dir):
    """Summaries -> selection -> one collection's rows -> pairs, written and read back."""
    docs = table(spark, sf_dir, "documents")
    free = F.when(F.length("source") % 2 == 0, "MIT License").otherwise("CC BY-NC 4.0")
    folder = written_summaries(
        spark,
        docs.select("source").distinct(),
        F.concat(F.lit("set-"), "source"),
        **{
            "Collection": F.lit("InstAr"),
            "Dataset Name": F.col("source"),
            "Licenses": F.array(F.struct(free.alias("License"), F.lit("").alias("License URL"))),
            "Dataset Filter IDs": F.array("source"),
        },
    )
    selected = corpus_prep.select_catalog(spark, folder, ct.FILTER_PRESETS["commercial_licenses"], pattern="*.txt", lines=True)
    raw = docs.select(F.concat("lang", "doc_id").alias("instruction"), F.col("text").alias("output"), "source")
    dialogs, _ = corpus_prep.prepare_collection("InstAr", raw, selected)
    out = shared_folder(spark, "corpus")
    corpus_prep.write_corpus(dialogs, out, "supervised")
    return readers.read_json_lines(spark, out, "dataset string, inputs string, targets string")


#: Licenses by the remainder of the id; the third has a model's terms beside its own license.
SPOKEN = (("MIT License",), ("CC BY-NC 4.0",), ("OpenAI", "MIT License"), ("Unspecified",), ("Academic Research Purposes Only",))


@query(
    """WITH d AS (SELECT doc_id, lang, source, doc_id % 5 AS k, doc_id % 3 AS m, n_chars, 2010 + (doc_id % 12) AS y,
        CASE WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN 'Video ' || doc_id ELSE 'Set ' || (doc_id % 7) END AS collection FROM documents),
    t AS (SELECT *, CASE k WHEN 0 THEN 'Commercial' WHEN 2 THEN 'Commercial' WHEN 3 THEN 'Unspecified' ELSE 'NC/Acad' END AS license_type,
        CASE collection WHEN 'Set 0' THEN 'Unrestricted' WHEN 'Set 1' THEN 'Restricted' WHEN 'Set 2' THEN 'Restricted' ELSE 'Unspecified' END AS terms FROM d)
    SELECT 'u' || doc_id AS uid, CASE m WHEN 0 THEN 'Text' WHEN 1 THEN 'Speech' ELSE 'Video' END AS modality, collection,
      CASE WHEN m = 2 THEN NULL ELSE lang END AS languages, license_type, license_type || ' | ' || terms AS license_terms,
      CASE WHEN m = 1 AND y = 2015 THEN 'Unknown' WHEN y < 2013 THEN '<2013' ELSE y::VARCHAR END AS year_category,
      CASE WHEN m = 0 AND doc_id % 2 = 0 THEN source || '|Synthetic' ELSE source END AS sources,
      CASE WHEN m = 0 THEN (3.0 * 2 * n_chars)::DOUBLE END AS total_tokens,
      CASE WHEN m = 1 AND doc_id % 2 = 0 THEN NULL WHEN m > 0 THEN doc_id / 4 END AS hours FROM t"""
)
def multimodal_summaries(spark, sf_dir):
    """Text, speech and video summaries written as files, read with their layouts, united, classified and labelled."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    names = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in SPOKEN]), (d % 5 + 1).cast("int"))
    shared = {
        "Collection": F.when((d % 3 == 2) & (d % 2 == 0), F.lit(None)).otherwise(F.concat(F.lit("Set "), d % 7)),
        "Licenses": F.transform(names, lambda n: F.struct(n.alias("License"), F.lit("").alias("License URL"))),
    }
    year = (2010 + d % 12).cast("string")
    dates = F.struct(F.concat(year, F.lit("-05-01")).alias("HF Date"), F.lit("2024-01-01").alias("GitHub Date"))
    metrics = F.struct(F.lit(3).alias("Num Dialogs"), F.lit(2.0).alias("Mean Dialog Turns"), F.col("n_chars").cast("double").alias("Mean Inputs Length"), F.lit(0.0).alias("Mean Targets Length"))
    own = {
        0: {
            "Languages": F.array("lang"), "Text Sources": F.array("source", F.lit("Unsure")), "Text Metrics": metrics, "Inferred Metadata": dates,
            "Model Generated": F.when(d % 2 == 0, F.array(F.lit("A Model"))).otherwise(F.array(F.lit("Templates"))),
        },
        1: {
            "Languages (ISO)": F.array("lang"), "Source Category": F.array("source"),
            "Hours": F.when(d % 2 == 0, "Unclear").otherwise((d / 4).cast("string")), "Year Released": F.when(d % 12 == 5, "").otherwise(year),
        },
        2: {"Dataset Name": F.concat(F.lit("Video "), "doc_id"), "Video Sources": F.array("source"), "Video Hours": (d / 4).cast("string"), "Year Released": year},
    }
    layouts = (schemas.TEXT_SUMMARY, schemas.SPEECH_SUMMARY, schemas.VIDEO_SUMMARY)
    parts = [
        readers.read_summaries(spark, written_summaries(spark, docs.filter(d % 3 == m), F.concat(F.lit("u"), "doc_id"), **shared, **own[m]), layout, "*.txt", True)
        for m, layout in enumerate(layouts)
    ]
    terms = dims.literal_table(spark, [("Set 0", "Unrestricted"), ("Set 1", "Source Closed"), ("Set 2", "Model Closed")], "collection string, terms string")
    made = multimodal.multimodal_table(multimodal.unify(*parts), dims.license_table(spark), terms)
    return made.select(
        "uid", "modality", "collection", F.array_join("languages", "|").alias("languages"), "license_type", "license_terms", "year_category",
        F.array_join("source_category", "|").alias("sources"), F.col("total_tokens").cast("double").alias("total_tokens"), "hours",
    )
