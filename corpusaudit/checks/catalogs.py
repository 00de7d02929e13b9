"""Queries on a dataset catalog. Every document stands for a dataset, its source for a collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.checks.registry import query, table
from corpusaudit.functions import dates
from corpusaudit.operators import catalog as ct
from corpusaudit.operators import licenses as lic
from corpusaudit.operators import quality

LICENSE_TEXT = (
    r"Apache License, Version 2\.0|MIT License|GNU General Public License, version 3|CC BY-NC 4\.0"
)
PARAPHRASES = {
    "Apache License, Version 2.0": "Apache License 2.0",
    "GNU General Public License, version 3": "GNU General Public License v3.0",
}
CUSTOM = [("https://example.org/terms", "NC", "1", "?")]

CATALOG = f"""
cat AS (
  SELECT doc_id AS uid, source AS collection, 'set ' || (doc_id % 50) AS dataset_name,
    list_distinct([lang, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END]) AS languages,
    [ 'task' || (doc_id % 4), 'task' || (doc_id % 3 + 4) ] AS task_categories,
    CASE WHEN doc_id % 6 = 0 THEN [] ELSE [source, 'web' || (doc_id % 2)] END AS text_sources,
    CASE WHEN doc_id % 5 = 0 THEN ['GPT-4'] WHEN doc_id % 7 = 0 THEN ['templates'] ELSE [] END AS model_generated,
    n_chars AS num_dialogs,
    list_sort(list_distinct(regexp_extract_all(text, '{LICENSE_TEXT}')))
      || CASE WHEN doc_id % 8 = 0 THEN ['OpenAI'] ELSE [] END
      || CASE WHEN doc_id % 11 = 0 THEN ['Custom'] ELSE [] END AS license_names,
    CASE lang WHEN 'en' THEN ['CC BY 4.0'] WHEN 'fr' THEN ['CC BY-SA 4.0', 'Request Form'] ELSE [] END AS hub_licenses,
    CASE doc_id % 4 WHEN 0 THEN 'MIT License' WHEN 1 THEN 'Home Made License' END AS repo_license,
    CASE WHEN doc_id % 5 = 0 THEN 'CC BY-NC 4.0' END AS papers_license,
    strftime(DATE '2012-01-01' + (doc_id * 37 % 4000)::INT, '%Y-%m-%d') AS hub_date,
    CASE WHEN doc_id % 2 = 0 THEN strftime(DATE '2011-06-01' + (doc_id * 91 % 4000)::INT, '%Y-%m-%d') END AS paper_date,
    CASE WHEN doc_id % 3 = 0 THEN 'soon' END AS repo_date
  FROM documents
)"""

CLASS_VALUES = ", ".join(
    f"('{n}', '{u}', {a if a.isdigit() else 1}, {s if s.isdigit() else 1})"
    for n, (u, a, s) in dims.LICENSE_CLASSES.items()
)
FEEDS = f"""{CATALOG},
raw AS (
  SELECT uid, 'annotated' AS source, unnest(license_names) AS license FROM cat
  UNION ALL
  SELECT uid, 'annotated_no_model_terms', unnest(
    CASE WHEN len(list_filter(license_names, lambda x: x <> 'OpenAI')) = 0 THEN ['Unspecified']
         ELSE list_filter(license_names, lambda x: x <> 'OpenAI') END) FROM cat
  UNION ALL SELECT uid, 'hub', unnest(hub_licenses) FROM cat
  UNION ALL SELECT uid, 'repo', repo_license FROM cat WHERE repo_license IS NOT NULL
  UNION ALL SELECT uid, 'papers', papers_license FROM cat WHERE papers_license IS NOT NULL
),
named AS (
  SELECT uid, source, CASE license WHEN 'Apache License, Version 2.0' THEN 'Apache License 2.0'
    WHEN 'GNU General Public License, version 3' THEN 'GNU General Public License v3.0'
    ELSE license END AS license FROM raw
),
classes(license, use, attribution, share_alike) AS (VALUES {CLASS_VALUES}),
classified AS (
  SELECT n.uid, n.source, n.license,
    CASE WHEN n.license = 'Custom' THEN CASE WHEN n.uid % 2 = 0 THEN 'NC' ELSE '?' END ELSE c.use END AS use,
    CASE WHEN n.license = 'Custom' THEN 1 ELSE c.attribution END AS attribution,
    CASE WHEN n.license = 'Custom' THEN 1 ELSE c.share_alike END AS share_alike
  FROM named n LEFT JOIN classes c ON n.license = c.license
),
resolved AS (
  SELECT uid, source,
    CASE min(CASE use WHEN '?' THEN 0 WHEN 'Acad' THEN 0 WHEN 'NC' THEN 1 WHEN 'Unspecified' THEN 2 ELSE 3 END)
      WHEN 0 THEN 'academic-only' WHEN 1 THEN 'non-commercial' WHEN 2 THEN 'unspecified' ELSE 'commercial' END AS use,
    max(attribution) AS attribution, max(share_alike) AS share_alike
  FROM classified WHERE use IS NOT NULL GROUP BY uid, source
),
wide AS (
  SELECT c.*, a.use AS use_a, a.attribution AS att_a, a.share_alike AS sa_a, b.use AS use_b,
         h.use AS use_h, h.attribution AS att_h, h.share_alike AS sa_h, r.use AS use_r, p.use AS use_p,
         least(try_cast(paper_date AS DATE), try_cast(hub_date AS DATE), try_cast(repo_date AS DATE)) AS created
  FROM cat c
  LEFT JOIN resolved a ON c.uid = a.uid AND a.source = 'annotated'
  LEFT JOIN resolved b ON c.uid = b.uid AND b.source = 'annotated_no_model_terms'
  LEFT JOIN resolved h ON c.uid = h.uid AND h.source = 'hub'
  LEFT JOIN resolved r ON c.uid = r.uid AND r.source = 'repo'
  LEFT JOIN resolved p ON c.uid = p.uid AND p.source = 'papers'
)"""


def catalog(spark, sf_dir):
    uid, lang = F.col("doc_id"), F.col("lang")
    names = F.concat(
        F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit(LICENSE_TEXT), F.lit(0)))),
        F.when(uid % 8 == 0, F.array(F.lit("OpenAI"))).otherwise(F.array().cast("array<string>")),
        F.when(uid % 11 == 0, F.array(F.lit("Custom"))).otherwise(F.array().cast("array<string>")),
    )
    urls = F.when(uid % 2 == 0, F.lit("https://example.org/terms"))
    licenses = F.transform(
        names, lambda n: F.struct(n.alias("license"), F.when(n == "Custom", urls).alias("license_url"))
    )
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        uid.alias("uid"),
        F.col("source").alias("collection"),
        F.concat(F.lit("set "), uid % 50).alias("dataset_name"),
        F.array_distinct(F.array(lang, F.when(uid % 3 == 0, "en").otherwise(lang))).alias("languages"),
        F.array(
            F.concat(F.lit("task"), uid % 4), F.concat(F.lit("task"), uid % 3 + 4)
        ).alias("task_categories"),
        F.when(uid % 6 == 0, empty)
        .otherwise(F.array(F.col("source"), F.concat(F.lit("web"), uid % 2)))
        .alias("text_sources"),
        F.when(uid % 5 == 0, F.array(F.lit("GPT-4")))
        .when(uid % 7 == 0, F.array(F.lit("templates")))
        .otherwise(empty)
        .alias("model_generated"),
        F.col("n_chars").alias("num_dialogs"),
        lic.remap_names(licenses, PARAPHRASES).alias("licenses"),
        F.when(lang == "en", F.array(F.lit("CC BY 4.0")))
        .when(lang == "fr", F.array(F.lit("CC BY-SA 4.0"), F.lit("Request Form")))
        .otherwise(empty)
        .alias("hub_licenses"),
        F.when(uid % 4 == 0, "MIT License").when(uid % 4 == 1, "Home Made License").alias("repo_license"),
        F.when(uid % 5 == 0, "CC BY-NC 4.0").alias("papers_license"),
        F.date_add(F.lit("2012-01-01").cast("date"), (uid * 37 % 4000).cast("int")).cast("string").alias("hub_date"),
        F.when(
            uid % 2 == 0,
            F.date_add(F.lit("2011-06-01").cast("date"), (uid * 91 % 4000).cast("int")).cast("string"),
        ).alias("paper_date"),
        F.when(uid % 3 == 0, "soon").alias("repo_date"),
    )


def custom_classes(spark):
    return dims.literal_table(
        spark, CUSTOM, "license_url string, use string, attribution string, share_alike string"
    )


def classified(spark, sf_dir):
    feeds = lic.license_feeds(catalog(spark, sf_dir))
    return lic.classify(feeds, dims.license_table(spark), custom_classes(spark))


def criteria(spark, sf_dir):
    return lic.license_criteria(
        catalog(spark, sf_dir), dims.license_table(spark), custom_classes(spark)
    )


@query(
    f"""WITH {FEEDS} SELECT uid, source, license, coalesce(use, 'none') AS use,
       coalesce(attribution, -1)::INT AS attribution, coalesce(share_alike, -1)::INT AS share_alike
       FROM classified"""
)
def license_extract_classify(spark, sf_dir):
    return classified(spark, sf_dir).select(
        "uid",
        "source",
        "license",
        F.coalesce("use", F.lit("none")).alias("use"),
        F.coalesce("attribution", F.lit(-1)).alias("attribution"),
        F.coalesce("share_alike", F.lit(-1)).alias("share_alike"),
    )


@query(f"WITH {FEEDS} SELECT uid, source, use, attribution::INT AS attribution, share_alike::INT AS share_alike FROM resolved")
def license_resolve(spark, sf_dir):
    return lic.resolve(classified(spark, sf_dir))


@query(
    f"""WITH {FEEDS} SELECT uid, coalesce(use_a, '-') AS annotated, use_b AS no_model_terms,
        coalesce(use_h, '-') AS hub, coalesce(use_r, '-') AS repo, coalesce(use_p, '-') AS papers FROM wide"""
)
def license_criteria(spark, sf_dir):
    dash = F.lit("-")
    return criteria(spark, sf_dir).select(
        "uid",
        F.coalesce("use_annotated", dash).alias("annotated"),
        F.col("use_annotated_no_model_terms").alias("no_model_terms"),
        F.coalesce("use_hub", dash).alias("hub"),
        F.coalesce("use_repo", dash).alias("repo"),
        F.coalesce("use_papers", dash).alias("papers"),
    )


@query(f"WITH {FEEDS} SELECT DISTINCT uid, source, license FROM classified WHERE use IS NULL")
def license_unknown(spark, sf_dir):
    return lic.unknown_licenses(classified(spark, sf_dir))


@query(
    f"""WITH {FEEDS} SELECT uid FROM wide
    WHERE use_b IN ('commercial', 'unspecified') OR use_h IN ('commercial', 'unspecified')"""
)
def license_use_filter(spark, sf_dir):
    chosen = ct.CatalogFilter(
        license_use="unspecified",
        license_sources=(dims.ANNOTATED, dims.HUB),
        ignore_model_terms=True,
    )
    return chosen.apply(criteria(spark, sf_dir)).select("uid")


@query(
    f"""WITH {FEEDS} SELECT uid FROM wide
    WHERE (use_a = 'commercial' OR use_h = 'commercial')
      AND coalesce(att_a <= 1, true) AND coalesce(att_h <= 1, true)
      AND coalesce(sa_a <= 0, true) AND coalesce(sa_h <= 0, true)"""
)
def license_flag_caps(spark, sf_dir):
    chosen = ct.CatalogFilter(
        license_use="commercial",
        license_sources=(dims.ANNOTATED, dims.HUB),
        max_attribution=1,
        max_share_alike=0,
    )
    return chosen.apply(criteria(spark, sf_dir)).select("uid")


@query(
    f"""WITH {FEEDS} SELECT uid FROM wide
    WHERE CASE WHEN use_b = 'unspecified' AND use_r IS NOT NULL THEN use_r ELSE use_b END = 'commercial'"""
)
def license_fallback(spark, sf_dir):
    chosen = ct.CatalogFilter(license_use="commercial", ignore_model_terms=True, repo_fallback=True)
    return chosen.apply(criteria(spark, sf_dir)).select("uid")


@query(
    f"""WITH {FEEDS}, lists AS (SELECT uid, list(license) AS names FROM named WHERE source = 'annotated' GROUP BY uid)
    SELECT c.uid FROM cat c LEFT JOIN lists l ON c.uid = l.uid
    WHERE names IS NULL OR len(list_filter(names, lambda x: x NOT IN ('MIT License', 'Apache License 2.0'))) = 0"""
)
def license_name_filter(spark, sf_dir):
    chosen = ct.CatalogFilter(licenses=("MIT License", "Apache License 2.0"))
    return chosen.apply(catalog(spark, sf_dir)).select("uid")


@query(
    f"""WITH {CATALOG} SELECT uid FROM cat
    WHERE (list_contains(languages, 'fr') OR list_contains(languages, 'es'))
      AND (list_contains(task_categories, 'task1') OR list_contains(task_categories, 'task5'))"""
)
def catalog_overlap_filter(spark, sf_dir):
    """Language and task groups are expanded through dictionaries kept as tables."""
    rows = catalog(spark, sf_dir)
    languages = (
        rows.select(F.explode("languages").alias("member"))
        .distinct()
        .withColumn("group", F.when(F.col("member").isin("fr", "es"), "Romance").otherwise("Germanic"))
    )
    tasks = (
        rows.select(F.explode("task_categories").alias("member"))
        .distinct()
        .withColumn("group", F.when(F.col("member").isin("task1", "task5"), "A").otherwise("B"))
    )
    chosen = ct.CatalogFilter(languages=("Romance",), tasks=("A",))
    return chosen.apply(rows, {"languages": languages, "tasks": tasks}).select("uid")


@query(
    f"""WITH {CATALOG} SELECT uid FROM cat WHERE len(model_generated) = 0
    AND (len(text_sources) = 0 OR list_has_all(['src1', 'src2', 'src3', 'web0', 'web1'], text_sources))"""
)
def catalog_subset_filter(spark, sf_dir):
    chosen = ct.CatalogFilter(
        no_synthetic=True, allowed_sources=("src1", "src2", "src3", "web0", "web1")
    )
    return chosen.apply(catalog(spark, sf_dir)).select("uid")


@query(
    f"""WITH {FEEDS} SELECT uid, strftime(created, '%Y-%m-%d') AS created FROM wide
    WHERE created >= DATE '2014-03-01' AND created <= DATE '2018-09-30' AND collection = 'src4'"""
)
def catalog_date_window(spark, sf_dir):
    chosen = ct.CatalogFilter(collection="src4", start="2014-03-01", end="2018-09-30")
    kept = chosen.apply(catalog(spark, sf_dir))
    return kept.select("uid", ct.creation_date().cast("string").alias("created"))


@query(
    f"""WITH {CATALOG}, r AS (SELECT unnest(languages) AS item, num_dialogs // len(languages) AS d FROM cat),
    t AS (SELECT item, count(*) AS datasets, sum(d)::BIGINT AS dialogs FROM r GROUP BY item)
    SELECT item, datasets, round(100 * datasets / sum(datasets) OVER (), 2) AS pct_datasets,
           dialogs, round(100 * dialogs / sum(dialogs) OVER (), 2) AS pct_dialogs FROM t"""
)
def composition_card(spark, sf_dir):
    return ct.composition(catalog(spark, sf_dir), "languages")


@query(
    f"""WITH {FEEDS}, n AS (SELECT uid, count(*) AS k FROM named WHERE source = 'annotated' GROUP BY uid),
    r AS (SELECT license AS item, num_dialogs // k AS d FROM named JOIN n USING (uid) JOIN cat USING (uid)
          WHERE source = 'annotated'),
    t AS (SELECT item, count(*) AS datasets, sum(d)::BIGINT AS dialogs FROM r GROUP BY item)
    SELECT item, datasets, round(100 * datasets / sum(datasets) OVER (), 2) AS pct_datasets,
           dialogs, round(100 * dialogs / sum(dialogs) OVER (), 2) AS pct_dialogs FROM t"""
)
def composition_licenses(spark, sf_dir):
    return ct.composition(catalog(spark, sf_dir), "licenses", "license")


@query(
    f"""WITH {CATALOG} SELECT count(*) AS datasets, sum(num_dialogs)::BIGINT AS dialogs,
        count(DISTINCT collection) AS collections FROM cat"""
)
def catalog_totals(spark, sf_dir):
    return ct.catalog_totals(catalog(spark, sf_dir))


@query(
    f"""WITH {CATALOG} SELECT DISTINCT collection FROM cat WHERE uid % 13 = 0"""
)
def missing_metrics(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn(
        "num_dialogs", F.when(F.col("uid") % 13 != 0, F.col("num_dialogs"))
    )
    return ct.missing_metrics(rows)


@query(
    f"""WITH {CATALOG}, v AS (SELECT DISTINCT unnest(task_categories) AS value, collection FROM cat)
    SELECT 'task_categories' AS category, value, string_agg(collection, ', ' ORDER BY collection) AS collections
    FROM v WHERE value IN ('task2', 'task6') GROUP BY value"""
)
def dict_coverage(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    known = (
        rows.select(F.explode("task_categories").alias("member"))
        .distinct()
        .filter(~F.col("member").isin("task2", "task6"))
    )
    return ct.coverage_gaps(rows, {"task_categories": known})


@query(
    f"""WITH {CATALOG}, v AS (SELECT DISTINCT uid, unnest(languages) AS detail FROM cat)
    SELECT 'unknown languages' AS rule, uid, detail FROM v WHERE detail = 'es'"""
)
def unknown_members(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    known = rows.select(F.explode("languages").alias("member")).distinct().filter("member <> 'es'")
    return ct.unknown_members(rows, {"languages": known})


@query(
    """SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def strict_map(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(
        "n_name", F.col("n_regionkey").cast("string").alias("key")
    )
    regions = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("string").alias("member"), F.col("r_name").alias("group")
    )
    return ct.map_strict(nation, "key", regions, "r_name").select("n_name", "r_name")


@query(
    """SELECT c_mktsegment, coalesce(n_name, 'none') AS country, count(*) AS n
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey
    GROUP BY ALL"""
)
def lenient_map(spark, sf_dir):
    countries = (
        table(spark, sf_dir, "nation")
        .filter("n_regionkey < 3")
        .select(F.col("n_nationkey").alias("member"), F.col("n_name").alias("group"))
    )
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("uid"), F.array("c_nationkey").alias("country_key")
    )
    mapped = ct.map_values(rows, "country_key", countries, "country")
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), "c_mktsegment")
    return (
        mapped.join(segments, "uid")
        .groupBy("c_mktsegment", F.coalesce("country", F.lit("none")).alias("country"))
        .agg(F.count("*").alias("n"))
    )


MERGED = f"""{FEEDS},
dup AS (SELECT uid % 40 AS uid, dataset_name, num_dialogs, languages, text_sources, model_generated, use_b, created FROM wide)"""


@query(
    f"""WITH {MERGED}, l AS (SELECT uid, string_agg(x, ',' ORDER BY x) AS languages FROM
        (SELECT DISTINCT uid, unnest(languages) AS x FROM dup) GROUP BY uid)
    SELECT uid, min(dataset_name) AS dataset_name, sum(num_dialogs)::BIGINT AS num_dialogs,
       bool_or(len(model_generated) > 0) AS synthetic, strftime(min(created), '%Y-%m-%d') AS created,
       any_value(l.languages) AS languages, count(DISTINCT use_b) > 1 AS conflict
    FROM dup JOIN l USING (uid) GROUP BY uid"""
)
def merge_duplicates(spark, sf_dir):
    rows = criteria(spark, sf_dir).withColumn("uid", F.col("uid") % 40)
    rows = rows.drop("licenses", "hub_licenses", "repo_license", "papers_license")
    merged, conflicts = ct.merge_duplicates(
        rows.drop(*[c for c in rows.columns if c.startswith(("use_", "attribution_", "share_alike_"))
                    and c != "use_annotated_no_model_terms"])
    )
    return merged.join(conflicts, "uid", "left").select(
        "uid",
        "dataset_name",
        "num_dialogs",
        "synthetic",
        F.col("created").cast("string").alias("created"),
        F.array_join("languages", ",").alias("languages"),
        F.col("fields").isNotNull().alias("conflict"),
    )


@query(
    f"""WITH {CATALOG}, r AS (
      SELECT uid, unnest(CASE WHEN len(model_generated) > 0 THEN ['Synthetic'] WHEN len(text_sources) = 0
        THEN ['Other'] ELSE list_transform(text_sources, lambda x: CASE WHEN x LIKE 'web%' THEN 'Web' ELSE 'Other' END) END) AS source_group
      FROM cat)
    SELECT source_group, count(DISTINCT uid) AS datasets FROM r GROUP BY source_group"""
)
def source_groups(spark, sf_dir):
    known = dims.mapping_table(spark, {"web0": "Web", "web1": "Web"})
    return (
        ct.source_groups(catalog(spark, sf_dir), known)
        .groupBy("source_group")
        .agg(F.count("*").alias("datasets"))
    )


@query(
    f"""WITH {CATALOG} SELECT uid,
      array_to_string(text_sources || CASE WHEN len(model_generated) > 0 AND NOT list_contains(model_generated, 'templates')
        THEN ['Synthetic'] ELSE [] END, ',') AS sources,
      len(list_filter(text_sources, lambda x: x LIKE '%web1%')) > 0 AS from_web1,
      CASE WHEN year(try_cast(hub_date AS DATE)) < 2014 THEN '<2014' ELSE year(try_cast(hub_date AS DATE))::VARCHAR END AS bucket
    FROM cat"""
)
def source_labels(spark, sf_dir):
    return catalog(spark, sf_dir).select(
        "uid",
        F.array_join(
            ct.with_synthetic_source(F.col("text_sources"), F.col("model_generated")), ","
        ).alias("sources"),
        ct.mentions_any(F.col("text_sources"), ["web1"]).alias("from_web1"),
        dates.year_bucket(F.year(dates.lenient_date(F.col("hub_date"))), 2014).alias("bucket"),
    )


@query(
    f"""WITH {FEEDS}, t AS (SELECT uid, use_b,
       CASE uid % 6 WHEN 0 THEN 'Source Closed' WHEN 1 THEN 'Source Closed' WHEN 2 THEN 'Model Closed'
                    WHEN 3 THEN 'Unrestricted' ELSE 'Unspecified' END AS terms FROM wide)
    SELECT uid, CASE WHEN use_b IN ('academic-only', 'non-commercial') THEN 'NC/Acad'
       WHEN use_b = 'unspecified' THEN 'Unspecified' ELSE 'Commercial' END || ' | ' ||
       CASE WHEN terms LIKE '%Closed' THEN 'Restricted' ELSE terms END AS label FROM t"""
)
def license_terms_label(spark, sf_dir):
    kind = F.col("uid") % 6
    source = F.when(kind == 0, "Prohibited by the site").when(kind == 1, "Likely prohibited").when(
        kind == 3, "Not prohibited"
    ).when(kind == 4, "Cannot find website")
    model = F.when(kind == 2, "Non-compete clause").when(kind == 3, "unrestricted")
    verdict = lic.terms_verdict([source], [model])
    return criteria(spark, sf_dir).select(
        "uid",
        lic.merge_closed_terms(
            lic.license_terms(F.col("use_annotated_no_model_terms"), verdict)
        ).alias("label"),
    )


@query(
    f"""WITH {CATALOG} SELECT 'duplicate dataset_name' AS rule, dataset_name, count(*)::VARCHAR AS detail
    FROM cat GROUP BY dataset_name HAVING count(*) > 1"""
)
def duplicate_names(spark, sf_dir):
    return quality.duplicate_keys(catalog(spark, sf_dir), "dataset_name")


@query(
    f"""WITH {CATALOG}
    SELECT 'required field is empty' AS rule, uid, 'text_sources' AS detail FROM cat WHERE len(text_sources) = 0
    UNION ALL SELECT 'required field is empty', uid, 'repo_license' FROM cat WHERE repo_license IS NULL
    UNION ALL SELECT 'pattern', uid, 'repo_date=' || repo_date FROM cat WHERE repo_date IS NOT NULL"""
)
def catalog_quality(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    return quality.union_all(
        [
            quality.required_fields(rows, "uid", ["dataset_name", "text_sources", "repo_license"]),
            quality.pattern_fields(
                rows, "uid", {"hub_date": r"^\d{4}-\d\d-\d\d$", "repo_date": r"^\d{4}-\d\d-\d\d$"}
            ),
        ]
    )
