"""Queries for report tables and the joins behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.checks import catalogs, consent
from corpusaudit.checks.registry import query, table
from corpusaudit.operators import quality
from corpusaudit.operators import reports as rp


@query(
    """WITH c AS (SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1)
    SELECT o_orderstatus, count, round(100 * count / sum(count) OVER (), 6) AS pct FROM c"""
)
def value_counts(spark, sf_dir):
    out = rp.value_counts(table(spark, sf_dir, "orders").select("o_orderstatus"), "o_orderstatus")
    return out.withColumn("pct", F.round("pct", 6))


@query(
    """WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, count, round(100 * count / sum(count) OVER (PARTITION BY l_returnflag), 6) AS pct FROM c"""
)
def share_of_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    out = rp.counts_with_share(rows, ["l_returnflag"], "l_linestatus")
    return out.withColumn("pct", F.round("pct", 6))


@query(
    """WITH m AS (SELECT l_returnflag AS modality, l_linestatus AS label,
      CASE WHEN l_returnflag IN ('A', 'N') THEN l_quantity::BIGINT ELSE l_linenumber::BIGINT END AS size FROM lineitem),
    c AS (SELECT modality, label, sum(size)::BIGINT AS count FROM m GROUP BY ALL)
    SELECT modality, label, count, round(100 * count / sum(count) OVER (PARTITION BY modality), 6) AS pct FROM c"""
)
def weighted_share(spark, sf_dir):
    """The measure depends on the modality: hours for some, tokens for the rest."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("modality"),
        F.col("l_linestatus").alias("label"),
        rp.modality_measure(
            F.col("l_returnflag"),
            F.col("l_quantity").cast("bigint"),
            F.col("l_linenumber").cast("bigint"),
            ["A", "N"],
        ).alias("size"),
    )
    out = rp.counts_with_share(rows, ["modality"], "label", "size")
    return out.withColumn("pct", F.round("pct", 6))


@query(
    """WITH g AS (SELECT * FROM (SELECT DISTINCT o_orderstatus FROM orders) CROSS JOIN
      (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('9-NEVER')) v(o_orderpriority)),
    c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderstatus, o_orderpriority, coalesce(n, 0) AS value,
       round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY o_orderstatus), 6) AS share
    FROM g LEFT JOIN c USING (o_orderstatus, o_orderpriority)"""
)
def crosstab_share(spark, sf_dir):
    labels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NEVER"]
    out = rp.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", labels)
    return out.withColumn("share", F.round("share", 6))


@query(
    """WITH g AS (SELECT * FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (VALUES ('low'), ('high'), ('none')) v(band)),
    c AS (SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM customer GROUP BY ALL)
    SELECT c_mktsegment, band, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (c_mktsegment, band)"""
)
def grid_complete(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_mktsegment", F.when(F.col("c_acctbal") < 0, "low").otherwise("high").alias("band")
    )
    sums = rows.groupBy("c_mktsegment", "band").agg(F.count("*").alias("n"))
    return rp.complete_grid(sums, "c_mktsegment", "band", ["low", "high", "none"], "n")


@query(
    """SELECT coalesce(lang, 'Total') AS lang, coalesce(q, 'Total') AS q, count(*) AS count
    FROM (SELECT lang, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS q FROM documents JOIN labels USING (doc_id))
    GROUP BY CUBE (lang, q)"""
)
def license_terms_cube(spark, sf_dir):
    rows = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "lang")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select("lang", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("q"))
    )
    return rp.cube_totals(rows, "lang", "q")


@query(
    """WITH t AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 4)
    SELECT CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'Other' END AS p_brand, count(*) AS n
    FROM part GROUP BY 1"""
)
def topk_other(spark, sf_dir):
    rows = rp.top_or_other(table(spark, sf_dir, "part").select("p_brand"), "p_brand", 4)
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    """WITH b(bin, lo, hi) AS (VALUES ('0-1000', 0, 1000), ('1000-50000', 1000, 50000), ('50000-200000', 50000, 200000), ('200000-', 200000, 1e18))
    SELECT bin, count(o_orderkey) AS count FROM b LEFT JOIN orders ON o_totalprice >= lo AND o_totalprice < hi GROUP BY bin"""
)
def size_bins(spark, sf_dir):
    return rp.bin_counts(
        table(spark, sf_dir, "orders"), F.col("o_totalprice"), [0, 1000, 50000, 200000, None]
    )


@query(
    """WITH b(bin, lo, hi) AS (VALUES ('0-100000', 0, 100000), ('100000-300000', 100000, 300000), ('300000-', 300000, 1e18))
    SELECT bin, count(DISTINCT o_custkey) AS count FROM b LEFT JOIN orders ON o_totalprice >= lo AND o_totalprice < hi GROUP BY bin"""
)
def size_bins_by_collection(spark, sf_dir):
    return rp.bin_counts(
        table(spark, sf_dir, "orders"),
        F.col("o_totalprice"),
        [0, 100000, 300000, None],
        by=F.col("o_custkey"),
    )


@query(
    """SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT), 6) AS share FROM orders GROUP BY 1"""
)
def permissiveness(spark, sf_dir):
    out = rp.group_permissiveness(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F"]
    )
    return out.withColumn("share", F.round("share", 6))


@query(
    """WITH w AS (SELECT p_brand, count(*) FILTER (p_size < 10) AS small, count(*) FILTER (p_size >= 10 AND p_size < 30) AS middle,
        count(*) FILTER (p_size >= 30) AS big FROM part GROUP BY p_brand),
    s AS (SELECT *, small + middle + big AS total, small / (small + middle + big) AS first_share FROM w),
    r AS (SELECT *, row_number() OVER (ORDER BY first_share DESC, p_brand) AS a,
                    row_number() OVER (ORDER BY first_share, p_brand DESC) AS b FROM s)
    SELECT p_brand, small, middle, big, total, round(first_share, 6) AS first_share FROM r WHERE a <= 3 OR b <= 3"""
)
def extreme_groups(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_brand", F.when(size < 10, "small").when(size < 30, "middle").otherwise("big").alias("class")
    )
    out = rp.label_shares_extremes(rows, "p_brand", "class", ["small", "middle", "big"], 3)
    return out.withColumn("first_share", F.round("first_share", 6))


@query(
    """WITH f AS (SELECT p_name, arg_min(p_size, (p_size, p_partkey)) AS size FROM part GROUP BY p_name)
    SELECT CASE WHEN size < 13 THEN '<13' ELSE size::VARCHAR END AS bucket, count(*) AS n FROM f GROUP BY 1"""
)
def first_name_only(spark, sf_dir):
    from corpusaudit.functions import dates

    rows = table(spark, sf_dir, "part").select("p_name", "p_size", "p_partkey")
    kept = rp.first_by_class(rows, "p_name", F.struct("p_size", "p_partkey"))
    return kept.groupBy(dates.year_bucket(F.col("p_size"), 13).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {consent.SNAPSHOTS}, f AS (SELECT url, agent, bool_or(status = 'all') AS r FROM snaps GROUP BY ALL)
    SELECT a.agent AS first, b.agent AS second, count(*) FILTER (a.r) AS given, count(*) FILTER (a.r AND b.r) AS both,
      round(count(*) FILTER (a.r AND b.r) / count(*) FILTER (a.r), 6) AS probability
    FROM f a JOIN f b ON a.url = b.url AND a.agent <> b.agent GROUP BY ALL"""
)
def pairwise_conditional(spark, sf_dir):
    snaps = consent.snapshots(spark, sf_dir)
    out = rp.conditional_pairs(snaps, "agent", F.col("status") == "all", ["GPTBot", "CCBot", "*"])
    return out.withColumn("probability", F.round("probability", 6))


@query(
    """WITH n AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderkey, o_totalprice / n AS part FROM orders JOIN n ON orders.o_custkey = n.o_custkey AND year(o_orderdate) = y"""
)
def even_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice"
    )
    out = rp.split_measure(rows, ["o_custkey", "y"], "o_totalprice", "part")
    return out.select("o_orderkey", "part")


@query(
    """WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY l_returnflag) AS share FROM c)
    SELECT l_returnflag, l_linestatus, round(coalesce(sum(share) OVER (PARTITION BY l_returnflag ORDER BY l_linestatus
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + share / 2, 6) AS midpoint FROM s"""
)
def stack_midpoints(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    shares = rp.counts_with_share(rows, ["l_returnflag"], "l_linestatus").withColumn("share", F.col("pct") / 100)
    out = rp.midpoints(shares, ["l_returnflag"], ["l_linestatus"], "share")
    return out.select("l_returnflag", "l_linestatus", F.round("midpoint", 6).alias("midpoint"))


@query(
    """WITH m AS (SELECT o_custkey, min(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END) AS r
      FROM orders GROUP BY 1)
    SELECT o_orderkey, coalesce(CASE r WHEN 1 THEN '5-LOW' WHEN 2 THEN '2-HIGH' WHEN 3 THEN '1-URGENT' END, 'none') AS label
    FROM orders JOIN m USING (o_custkey)"""
)
def group_restrictive_label(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("label"))
    out = rp.most_restrictive_in_group(rows, "o_custkey", "label", ["5-LOW", "2-HIGH", "1-URGENT"])
    return out.select("o_orderkey", F.coalesce("label", F.lit("none")).alias("label"))


@query(
    """WITH c AS (SELECT o_custkey, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL),
    m AS (SELECT o_custkey, arg_min(label, (-n, label)) AS label FROM c GROUP BY 1)
    SELECT o_orderkey, m.label FROM orders JOIN m USING (o_custkey)"""
)
def group_common_label(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("label"))
    return rp.most_common_in_group(rows, "o_custkey", "label").select("o_orderkey", "label")


@query(
    """SELECT o_custkey, arg_min(o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 END) AS o_orderpriority
    FROM orders GROUP BY 1"""
)
def min_label(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    return rp.restrictive_label(rows, "o_custkey", "o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"])


@query(
    f"""WITH {catalogs.FEEDS}, l AS (SELECT collection, count(DISTINCT x) AS n_languages FROM (SELECT collection, unnest(languages) AS x FROM cat) GROUP BY 1),
    k AS (SELECT collection, count(DISTINCT x) AS n_task_categories FROM (SELECT collection, unnest(task_categories) AS x FROM cat) GROUP BY 1)
    SELECT collection, count(*) AS datasets,
      CASE WHEN min(year(created)) = max(year(created)) THEN min(year(created))::VARCHAR ELSE 'Mult.' END AS year,
      bool_or(use_b = 'commercial') AS has_commercial, bool_or(use_b = 'academic-only') AS has_academic_only,
      CASE avg((len(model_generated) > 0)::INT) WHEN 1 THEN 'all' WHEN 0 THEN 'none' ELSE 'some' END AS synthetic,
      any_value(n_languages) AS n_languages, any_value(n_task_categories) AS n_task_categories
    FROM wide JOIN l USING (collection) JOIN k USING (collection) GROUP BY collection"""
)
def collection_table(spark, sf_dir):
    from corpusaudit.operators import catalog as ct

    rows = catalogs.criteria(spark, sf_dir).withColumn("year", F.year(ct.creation_date()))
    return rp.collection_table(
        rows,
        ["languages", "task_categories"],
        ["commercial", "academic-only"],
        "use_annotated_no_model_terms",
        "year",
    )


@query(
    """SELECT source, round(sum(n_chars * length(lang)) / sum(n_chars), 6) AS a, round(sum(n_chars * (doc_id % 10)) / sum(n_chars), 6) AS b
    FROM documents GROUP BY source"""
)
def weighted_means(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "source", "n_chars", F.length("lang").alias("a"), (F.col("doc_id") % 10).alias("b")
    )
    out = rp.weighted_means(rows, "source", "n_chars", ["a", "b"])
    return out.select("source", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(
    f"""WITH {catalogs.FEEDS}, p AS (SELECT collection, uid % 60 AS g, license FROM cat LEFT JOIN named USING (uid)
        WHERE coalesce(source, 'annotated') = 'annotated'),
    d AS (SELECT DISTINCT g, license FROM p WHERE license <> 'Custom'),
    n AS (SELECT g, count(*) AS k, string_agg(license, ', ' ORDER BY license) AS ls FROM d GROUP BY g)
    SELECT g, coalesce(ls, '') AS licenses, CASE WHEN k IS NULL THEN 'Unspecified' WHEN k > 2 THEN 'Various' ELSE ls END AS label
    FROM (SELECT DISTINCT uid % 60 AS g FROM cat) LEFT JOIN n USING (g)"""
)
def license_list(spark, sf_dir):
    rows = catalogs.catalog(spark, sf_dir).select(
        (F.col("uid") % 60).alias("g"), F.explode_outer("licenses.license").alias("license")
    )
    return rp.license_list(rows, "g", drop=["Custom"], many=2)


@query(
    f"""WITH {catalogs.FEEDS}, u AS (SELECT license, count(DISTINCT dataset_name) AS count FROM named JOIN cat USING (uid)
        WHERE source = 'annotated' GROUP BY license)
    SELECT license, count, coalesce(use, 'none') AS use FROM u LEFT JOIN classes USING (license) ORDER BY count DESC, license LIMIT 4"""
)
def license_frequency(spark, sf_dir):
    pairs = catalogs.catalog(spark, sf_dir).select(
        F.col("dataset_name").alias("name"), F.explode("licenses.license").alias("license")
    )
    out = rp.license_frequency(pairs, dims.license_table(spark), 4)
    return out.select("license", "count", F.coalesce("use", F.lit("none")).alias("use"))


@query(
    f"""WITH {catalogs.FEEDS}, p AS (SELECT DISTINCT dataset_name, license FROM named JOIN cat USING (uid) WHERE source = 'annotated')
    SELECT round(100 * avg(attribution), 2) AS pct_attribution, round(100 * avg(share_alike), 2) AS pct_share_alike
    FROM p JOIN classes USING (license)"""
)
def license_requirements(spark, sf_dir):
    pairs = catalogs.catalog(spark, sf_dir).select(
        F.col("dataset_name").alias("name"), F.explode("licenses.license").alias("license")
    )
    return rp.flag_requirements(pairs, dims.license_table(spark))


@query(
    f"""WITH {catalogs.CATALOG} SELECT 'languages' AS field, count(DISTINCT x) AS "values" FROM (SELECT unnest(languages) AS x FROM cat)
    UNION ALL SELECT 'text_sources', count(DISTINCT x) FROM (SELECT unnest(text_sources) AS x FROM cat)"""
)
def key_statistics(spark, sf_dir):
    return rp.key_statistics(catalogs.catalog(spark, sf_dir), ["languages", "text_sources"])


@query(
    """WITH c AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'py' ELSE lang END AS code FROM documents),
    d(code, language, kind) AS (VALUES ('py', 'Python', 'programming'), ('en', 'English', 'natural'), ('de', 'German', 'natural'))
    SELECT coalesce(kind, 'natural') AS kind, count(DISTINCT coalesce(language, c.code)) AS languages FROM c LEFT JOIN d USING (code) GROUP BY 1"""
)
def language_kinds(spark, sf_dir):
    codes = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 9 == 0, "py").otherwise(F.col("lang")).alias("code")
    )
    known = dims.literal_table(
        spark,
        [("py", "Python", "programming"), ("en", "English", "natural"), ("de", "German", "natural")],
        "code string, language string, kind string",
    )
    return rp.language_kinds(codes, known)


@query(
    """WITH s AS (SELECT s_suppkey, [s_nationkey, (s_nationkey + 7) % 25] AS names FROM supplier),
    m AS (SELECT DISTINCT s_suppkey, r.r_name AS id FROM (SELECT s_suppkey, unnest(names) AS k FROM s)
      JOIN nation ON n_nationkey = k JOIN region r ON n_regionkey = r_regionkey)
    SELECT s_suppkey, string_agg(id, ',' ORDER BY id) AS ids FROM m GROUP BY 1"""
)
def country_ids(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    ids = nation.join(region, "n_regionkey").select(
        F.col("n_nationkey").alias("member"), F.col("r_name").alias("group")
    )
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 7) % 25).alias("countries")
    )
    return rp.expand_members(rows, "s_suppkey", "countries", ids).select(
        "s_suppkey", F.array_join("ids", ",").alias("ids")
    )


@query(
    f"""WITH {catalogs.CATALOG} SELECT uid, list_contains(task_categories, 'task1') AS is_task1,
       list_contains(task_categories, 'task4') AS is_task4 FROM cat"""
)
def one_hot(spark, sf_dir):
    return rp.one_hot(catalogs.catalog(spark, sf_dir), "uid", "task_categories", ["task1", "task4"], "is_")


@query(
    """SELECT modality, count(*) AS n, count(url) AS urls, count(lang) AS langs FROM (
      SELECT 'Text' AS modality, NULL AS url, lang FROM documents UNION ALL SELECT 'Web', url, NULL FROM pages
      UNION ALL SELECT 'Chat', NULL, NULL FROM conversations) GROUP BY modality"""
)
def multimodal_union(spark, sf_dir):
    stacked = rp.stack_modalities(
        {
            "Text": table(spark, sf_dir, "documents").select("doc_id", "lang"),
            "Web": table(spark, sf_dir, "pages").select("page_id", "url"),
            "Chat": table(spark, sf_dir, "conversations").select("conv_id"),
        }
    )
    return stacked.groupBy("modality").agg(
        F.count("*").alias("n"), F.count("url").alias("urls"), F.count("lang").alias("langs")
    )


OUTER = """
d AS (SELECT doc_id AS uid, lang FROM documents WHERE doc_id % 3 <> 0),
l AS (SELECT doc_id AS uid, quality FROM labels),
p AS (SELECT page_id AS uid, url FROM pages)"""


def outer_parts(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("uid"), "lang"),
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("uid"), "quality"),
        table(spark, sf_dir, "pages").select(F.col("page_id").alias("uid"), "url"),
    )


@query(
    f"""WITH {OUTER} SELECT uid, coalesce(lang, '-') AS lang, coalesce(quality, -1) AS quality, coalesce(url, '-') AS url
    FROM d FULL JOIN l USING (uid) FULL JOIN p USING (uid)"""
)
def multimodal_outer(spark, sf_dir):
    joined = rp.outer_on_key("uid", *outer_parts(spark, sf_dir))
    return joined.select(
        "uid",
        F.coalesce("lang", F.lit("-")).alias("lang"),
        F.coalesce("quality", F.lit(-1)).alias("quality"),
        F.coalesce("url", F.lit("-")).alias("url"),
    )


@query(
    f"""WITH {OUTER}, k AS (SELECT uid FROM d UNION SELECT uid FROM l UNION SELECT uid FROM p)
    SELECT uid, lang IS NOT NULL AS has_text, quality IS NOT NULL AS has_label, url IS NOT NULL AS has_page
    FROM k LEFT JOIN d USING (uid) LEFT JOIN l USING (uid) LEFT JOIN p USING (uid)"""
)
def web_profile(spark, sf_dir):
    out = rp.profile("uid", *outer_parts(spark, sf_dir))
    return out.select(
        "uid",
        F.col("lang").isNotNull().alias("has_text"),
        F.col("quality").isNotNull().alias("has_label"),
        F.col("url").isNotNull().alias("has_page"),
    )


@query(
    """WITH c AS (SELECT s_suppkey, unnest([p.p_partkey, p.p_partkey + 1]) AS partkey
      FROM supplier JOIN part p ON p.p_partkey = s_suppkey * 2)
    SELECT s_suppkey, p_brand FROM c JOIN part ON p_partkey = partkey"""
)
def delimited_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat_ws("|", F.col("s_suppkey") * 2, F.col("s_suppkey") * 2 + 1).alias("keys"),
    )
    exploded = rp.split_keys(rows, "keys", "p_partkey").withColumn("p_partkey", F.col("p_partkey").cast("bigint"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return exploded.join(parts, "p_partkey").select("s_suppkey", "p_brand")


@query(
    """WITH RECURSIVE tree AS (SELECT o_orderkey AS member, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent FROM orders),
    walk AS (SELECT member, member AS cur FROM tree
      UNION ALL SELECT w.member, t.parent FROM walk w JOIN tree t ON t.member = w.cur WHERE t.parent IS NOT NULL
        AND t.parent IN (SELECT member FROM tree))
    SELECT member, min(cur) AS top FROM walk GROUP BY member"""
)
def top_ancestor(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("member"))
    parents = keys.withColumn("parent", F.when(F.col("member") % 6 != 0, F.col("member") - 1))
    known = keys.withColumnRenamed("member", "parent")
    linked = parents.join(known.withColumn("_k", F.lit(True)), "parent", "left").select(
        "member", F.when(F.col("_k"), F.col("parent")).alias("parent")
    )
    return rp.top_ancestor(linked)


@query(
    """SELECT c_custkey, c_nationkey, coalesce(o.hours, c_acctbal) AS hours FROM customer
    LEFT JOIN (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS hours FROM supplier) o ON o.k = c_custkey AND o.n = c_nationkey % 25"""
)
def override_values(spark, sf_dir):
    even = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("hours"))
    side = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("hours")
    )
    return rp.override_values(even, side, ["c_custkey", "c_nationkey"], "hours")


@query(
    """WITH r AS (SELECT s_suppkey AS country, s_suppkey * 37 AS lo, s_suppkey * 37 + CASE WHEN s_suppkey % 9 = 0 THEN 5000000 ELSE 20 END AS hi FROM supplier)
    SELECT p_partkey, (p_retailprice * 2)::BIGINT AS ip, coalesce(country, -1) AS country
    FROM part LEFT JOIN r ON (p_retailprice * 2)::BIGINT BETWEEN lo AND hi"""
)
def ip_range_join(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(
        "p_partkey", F.rint(F.col("p_retailprice") * 2).cast("bigint").alias("ip")
    )
    ranges = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("country"),
        (F.col("s_suppkey") * 37).alias("lo"),
        (F.col("s_suppkey") * 37 + F.when(F.col("s_suppkey") % 9 == 0, 5_000_000).otherwise(20)).alias("hi"),
    )
    out = rp.range_lookup(points, ranges, "ip", "lo", "hi")
    return out.select("p_partkey", "ip", F.coalesce("country", F.lit(-1)).alias("country"))


@query(
    r"""WITH w AS (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS bare FROM pages),
    v AS (SELECT page_id, unnest([url, regexp_replace(url, '/+$', ''), bare, regexp_replace(bare, '/+$', ''),
       regexp_replace(bare, '^www\.', ''), 'www.' || regexp_replace(bare, '^www\.', '')]) AS variant, unnest(range(6)) AS priority FROM w),
    known AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '')
       ELSE 'www.' || regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', '') END AS variant FROM pages WHERE page_id % 5 <> 0)
    SELECT page_id, arg_min(variant, priority) AS variant, min(priority)::INT AS priority FROM v JOIN known USING (variant) GROUP BY page_id"""
)
def spelling_variants(spark, sf_dir):
    from corpusaudit.functions import urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bare = F.regexp_replace("url", "^https?://", "")
    stored = (
        F.when(F.col("page_id") % 3 == 0, F.col("url"))
        .when(F.col("page_id") % 3 == 1, bare)
        .otherwise(F.concat(F.lit("www."), F.regexp_replace(bare, r"^www\.", "")))
    )
    known = pages.filter("page_id % 5 <> 0").select(stored.alias("variant")).distinct()
    return rp.first_variant(pages, known, urls.spelling_variants(F.col("url")), "page_id")


@query(
    """WITH s AS (SELECT o_orderpriority AS name, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
    SELECT name, arg_max(n, y) AS last_value, row_number() OVER (ORDER BY arg_max(n, y) DESC, name) AS place FROM s GROUP BY name"""
)
def last_point_order(spark, sf_dir):
    """Names in the order of their last point; the place is taken from the order of the rows."""
    series = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("y")
    ).agg(F.count("*").alias("n"))
    ordered = rp.by_last_point(series, "name", "y", "n")
    # five names in one sorted partition: their numbers follow its order
    return ordered.coalesce(1).select("name", "last_value", (F.monotonically_increasing_id() + 1).alias("place"))


EXPANDED = """
raw AS (SELECT doc_id,
    CASE doc_id % 6 WHEN 0 THEN '[''News, press (all)'', "Editor''s pick"]' WHEN 1 THEN lang WHEN 2 THEN '[]' WHEN 3 THEN NULL
      WHEN 4 THEN ' [ ''x y'' , ''z'' ] ' ELSE 'Science (see also: maths) and art' END AS a,
    CASE doc_id % 5 WHEN 0 THEN '["chat", "search (web)", "chat"]' WHEN 1 THEN source ELSE 'chat' END AS b,
    CASE doc_id % 4 WHEN 0 THEN '[EU, UK, US]' ELSE 'EU' END AS c FROM documents),
items AS (SELECT doc_id, a, b, c,
    CASE doc_id % 6 WHEN 0 THEN ['News, press', 'Editor''s pick'] WHEN 1 THEN [a] WHEN 2 THEN [] WHEN 3 THEN [NULL]
      WHEN 4 THEN ['x y', 'z'] ELSE ['Scienceand art'] END AS la,
    CASE doc_id % 5 WHEN 0 THEN ['chat', 'search', 'chat'] ELSE [b] END AS lb,
    CASE doc_id % 4 WHEN 0 THEN ['EU', 'UK', 'US'] ELSE ['EU'] END AS lc FROM raw),
one AS (SELECT doc_id, unnest(la) AS a, lb, lc FROM items),
two AS (SELECT doc_id, a, unnest(lb) AS b, lc FROM one),
expanded AS (SELECT doc_id, a, b, unnest(lc) AS c FROM two
    UNION ALL SELECT doc_id, a, b, c FROM raw WHERE doc_id % 6 NOT IN (0, 2, 4) AND doc_id % 5 <> 0)"""


def listed(spark, sf_dir):
    """Documents with three columns of list literals, plain labels, empty lists and NULLs."""
    d = F.col("doc_id")
    a = (
        F.when(d % 6 == 0, """['News, press (all)', "Editor's pick"]""").when(d % 6 == 1, F.col("lang")).when(d % 6 == 2, "[]")
        .when(d % 6 == 4, " [ 'x y' , 'z' ] ").when(d % 6 == 5, "Science (see also: maths) and art")
    )
    b = F.when(d % 5 == 0, '["chat", "search (web)", "chat"]').when(d % 5 == 1, F.col("source")).otherwise("chat")
    c = F.when(d % 4 == 0, "[EU, UK, US]").otherwise("EU")
    return table(spark, sf_dir, "documents").select("doc_id", a.alias("a"), b.alias("b"), c.alias("c"))


@query(f"WITH {EXPANDED} SELECT doc_id, a, b, c FROM expanded")
def expanded_lists(spark, sf_dir):
    """Every combination of three list columns; rows without a list in the first two come twice, as published."""
    return rp.expand_lists(listed(spark, sf_dir), ["a", "b", "c"], plain_again=["a", "b"])


@query(
    f"""WITH {EXPANDED} SELECT 'a' AS "column", a AS item, count(*) AS count FROM expanded GROUP BY a
    UNION ALL SELECT 'b', b, count(*) FROM expanded GROUP BY b UNION ALL SELECT 'c', c, count(*) FROM expanded GROUP BY c"""
)
def expanded_list_counts(spark, sf_dir):
    """The counts of the expanded rows, without expanding them."""
    return rp.expanded_counts(listed(spark, sf_dir), ["a", "b", "c"], plain_again=["a", "b"])


@query(
    """SELECT 'unknown lang' AS rule, doc_id::VARCHAR AS key, lang AS detail FROM documents WHERE lang NOT IN ('en', 'de')
    UNION ALL SELECT 'unknown tags', doc_id::VARCHAR, lang FROM documents WHERE lang NOT IN ('en', 'de')
    UNION ALL SELECT 'extra column', doc_id::VARCHAR, 'note' FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT 'extra column', doc_id::VARCHAR, 'odd.name' FROM documents"""
)
def column_rules(spark, sf_dir):
    """Values outside a dictionary, in a plain and in a list column, and values in columns the layout does not have."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.array("lang", F.lit("en")).alias("tags"),
        F.when(F.col("doc_id") % 3 == 0, "x").alias("note"), F.lit(1).alias("odd.name"), F.lit(None).cast("string").alias("empty"),
    )
    known = dims.literal_table(spark, [("en",), ("de",), (None,)], "member string")
    found = [
        quality.allowed_values(docs, "doc_id", "lang", known),
        quality.allowed_values(docs, "doc_id", "tags", known),
        quality.extra_columns(docs, "doc_id", ["lang", "tags"]),
    ]
    return quality.union_all(found).select("rule", F.col("doc_id").cast("string").alias("key"), "detail")
