"""Queries on smaller operators: merged counts, link lists, field rules, ordered tables, interval tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.checks import consent, measures
from corpusaudit.checks.catalogs import CATALOG, catalog, criteria
from corpusaudit.checks.conversations import MESSAGES, messages
from corpusaudit.checks.registry import query, table
from corpusaudit.functions import text as tx
from corpusaudit.functions import urls
from corpusaudit.operators import catalog as ct
from corpusaudit.operators import dialogs as dg
from corpusaudit.operators import domains, forecast, quality
from corpusaudit.operators import population as pop
from corpusaudit.operators import reports as rp
from corpusaudit.operators import sites as st
from corpusaudit.session import shared_folder
from corpusaudit.sources import readers

DOMAIN = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(
    f"""WITH r AS (SELECT {DOMAIN} AS domain, len(regexp_extract_all(url, '[\\p{{L}}\\p{{N}}_]+')) AS n FROM pages)
    SELECT domain, sum(n)::BIGINT AS tokens, count(*) AS pages FROM r GROUP BY domain"""
)
def merged_domain_counts(spark, sf_dir):
    """Counts of three parts of a corpus, added up."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    parts = [pages.filter(F.col("page_id") % 3 == i) for i in range(3)]
    return domains.merge_counts(*[domains.domain_tokens(p, F.col("url"), urls.netloc(F.col("url"))) for p in parts])


@query(
    """SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE url END AS url, 'main' AS kind FROM pages
    UNION SELECT DISTINCT 'http://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/robots.txt', 'robots' FROM pages"""
)
def annotated_urls(spark, sf_dir):
    """Addresses to fetch for annotated sites: main pages and robots files."""
    pages = table(spark, sf_dir, "pages")
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    main = st.annotated_urls(pages.select(bare.alias("URL")), "main")
    robots = st.annotated_urls(pages.select(urls.netloc(F.col("url")).alias("URL")), "robots")
    return main.withColumn("kind", F.lit("main")).union(robots.withColumn("kind", F.lit("robots")))


_LABELS = sorted(dims.DOMAIN_CATEGORY)
_PAIRS = ", ".join(f"({i}, '{dims.DOMAIN_CATEGORY[v]}')" for i, v in enumerate(_LABELS))


@query(
    f"""WITH m(i, category) AS (VALUES {_PAIRS}), v AS (SELECT doc_id, unnest([doc_id % {len(_LABELS)}, (doc_id + 3) % {len(_LABELS)}]) AS i FROM documents)
    SELECT DISTINCT doc_id, category FROM v JOIN m USING (i)"""
)
def compressed_domains(spark, sf_dir):
    """Lists of domain labels reduced to their categories."""
    names = F.array(*[F.lit(v) for v in _LABELS])
    pick = lambda k: F.get(names, ((F.col("doc_id") + k) % len(_LABELS)).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", st.compress_domains(F.array(pick(0), pick(3))).alias("c"))
    return rows.select("doc_id", F.explode("c").alias("category"))


@query(
    f"""WITH {CATALOG}, v AS (SELECT uid, unnest(text_sources) AS s FROM cat)
    SELECT DISTINCT uid, CASE WHEN s LIKE 'web%' THEN 'Web' WHEN s IN ('src1', 'src2') THEN 'Source' ELSE 'Other' END AS category FROM v"""
)
def category_rows(spark, sf_dir):
    """List values mapped by a dictionary table."""
    pairs = [("web0", "Web"), ("web1", "Web"), ("src1", "Source"), ("src2", "Source")]
    known = dims.literal_table(spark, pairs, "member string, group string")
    return st.category_rows(catalog(spark, sf_dir), "uid", "text_sources", known)


@query("SELECT doc_id, string_split(text, chr(10))[1] || CASE WHEN contains(text, chr(10)) THEN chr(10) || string_split(text, chr(10))[2] ELSE '' END AS head FROM documents")
def first_two_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_lines(F.col("text"), 2).alias("head"))


@query(f"""WITH {MESSAGES} SELECT dataset, dialog, idx::INT AS idx, "from", text, coalesce(parent_idx, -1)::INT AS parent_idx FROM messages""")
def unfolded_messages(spark, sf_dir):
    """Dialogs folded into one row each and unfolded again."""
    folded = dg.fold_rows(messages(spark, sf_dir), F.concat(F.lit("set"), F.col("dialog") % 5))
    rows = dg.unfold(folded, keep=("dataset", "dialog"))
    return rows.select("dataset", "dialog", "idx", "from", "text", F.coalesce("parent_idx", F.lit(-1)).alias("parent_idx"))


@query(
    f"""WITH {MESSAGES} SELECT 'role' AS rule, dialog, count(*)::VARCHAR AS detail FROM messages GROUP BY dialog HAVING bool_or("from" NOT IN ('user', 'assistant'))
    UNION ALL SELECT 'empty text', dialog, count(*)::VARCHAR FROM messages GROUP BY dialog HAVING bool_or(text = '')
    UNION ALL SELECT 'no reply to first message', dialog, count(*)::VARCHAR FROM messages GROUP BY dialog HAVING NOT bool_or(coalesce(parent_idx = 0, false))"""
)
def nested_dialog_quality(spark, sf_dir):
    """Message rules on dialogs stored as arrays."""
    folded = dg.fold_rows(messages(spark, sf_dir), F.lit("set"))
    return quality.nested_message_violations(folded, "dialog")


@query(
    f"""WITH {CATALOG} SELECT 'not a number' AS rule, uid, 'repo_date=' || repo_date AS detail FROM cat WHERE repo_date IS NOT NULL
    UNION ALL SELECT 'not a number', uid, 'collection=' || collection FROM cat"""
)
def numeric_fields(spark, sf_dir):
    """Texts that should be numbers; NULL and numbers pass."""
    rows = catalog(spark, sf_dir).withColumn("n", F.col("num_dialogs").cast("string"))
    return quality.numeric_fields(rows, "uid", ["n", "repo_date", "collection"])


@query("SELECT DISTINCT 'uid' || (c_custkey % 50) AS uid, 'f' || c_custkey AS filter_id FROM customer WHERE c_custkey % 50 NOT IN (SELECT conv_id % 7 FROM conversations)")
def unused_filter_ids(spark, sf_dir):
    """Filter ids of datasets without a dialog."""
    ids = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("uid"), F.col("c_custkey") % 50).alias("uid"), F.concat(F.lit("f"), "c_custkey").alias("filter_id")
    )
    dialogs = table(spark, sf_dir, "conversations").select(F.concat(F.lit("uid"), F.col("conv_id") % 7).alias("dataset"))
    return quality.unused_filter_ids(ids, dialogs)


@query(
    """SELECT n_nationkey, n_name FROM nation
    ORDER BY CASE n_name WHEN 'JAPAN' THEN 1 WHEN 'BRAZIL' THEN 2 WHEN 'KENYA' THEN 3 ELSE 4 END, n_name LIMIT 6"""
)
def label_order(spark, sf_dir):
    """The first rows of a table in a fixed order of labels; unknown labels come last, by name."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return rp.in_order(rows, "n_name", ["JAPAN", "BRAZIL", "KENYA"]).limit(6)


@query(
    f"""WITH {consent.COUNTS} SELECT period::VARCHAR AS period, agent,
      round(coalesce(sum(tokens) FILTER (status IN ('some', 'all')), 0)::DOUBLE / nullif(sum(tokens), 0), 6) AS share FROM counts GROUP BY ALL"""
)
def restricted_between(spark, sf_dir):
    """Restricted part of tokens under a condition."""
    share = forecast.share_between(consent.counts(spark, sf_dir), F.col("status").isin("some", "all"))
    return consent.text_period(share.withColumn("share", F.round("share", 6)))


@query("SELECT 'set' AS dataset, lang AS language_code, (count(*) / 2.0)::DOUBLE AS hours FROM documents GROUP BY lang")
def language_hours(spark, sf_dir):
    """Hours per language from a side table in another unit and spelling."""
    folder = shared_folder(spark, "hours")
    table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("locale")).agg((F.count("*") * 30).alias("minutes")).write.option("header", True).csv(folder)
    return readers.read_hours(spark, folder, "set", "locale", F.col("minutes").cast("double") / 60)


BOUNDS = f"""{measures.RATES},
    bounds AS (SELECT variable, quantile_cont(rate, 0.025) AS lower, quantile_cont(rate, 0.975) AS upper FROM rates GROUP BY variable)"""


@query(
    f"""WITH {BOUNDS}, points(variable, point) AS (VALUES ('good', 0.5), ('toxic', 0.1), ('english', 0.99))
    SELECT variable, point::DOUBLE AS point, point < lower OR point > upper AS rejected FROM bounds JOIN points USING (variable)"""
)
def rejected_estimates(spark, sf_dir):
    """Point estimates outside the bootstrap interval of their variable."""
    points = dims.literal_table(spark, [("good", 0.5), ("toxic", 0.1), ("english", 0.99)], "variable string, point double")
    return pop.rejected(measures.rates(spark, sf_dir), points).select("variable", "point", "rejected")


@query(
    """WITH r AS (SELECT doc_id % 40 AS uid, doc_id % 3 AS a, lang AS b FROM documents), g AS (SELECT uid, min(a) <> max(a) AS x, min(b) <> max(b) AS y FROM r GROUP BY uid)
    SELECT uid, 'use_a' AS field FROM g WHERE x UNION ALL SELECT uid, 'use_b' FROM g WHERE y"""
)
def merge_conflicts(spark, sf_dir):
    """Datasets merged from rows whose license columns disagree, one row per column."""
    rows = criteria(spark, sf_dir).select(
        (F.col("uid") % 40).alias("uid"),
        "dataset_name", "num_dialogs", "model_generated", "paper_date", "hub_date", "repo_date",
        (F.col("uid") % 3).alias("use_a"),
        F.get("languages", F.lit(0)).alias("use_b"),
    )
    return ct.merge_duplicates(rows)[1].select("uid", F.explode("fields").alias("field"))
