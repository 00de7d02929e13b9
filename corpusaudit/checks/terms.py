"""Queries on terms of service and annotated sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.checks import consent
from corpusaudit.checks.registry import query, table
from corpusaudit.functions import text as tx
from corpusaudit.functions import urls
from corpusaudit.operators import sites as st
from corpusaudit.operators import tos

# Three policies per snapshot; codes by remainder, some of them missing. Some sites have no terms pages.
WITH_TERMS = "user_id % 9 <> 4"


def _verdicts_sql(chosen: str) -> str:
    return f"""
verdicts AS (
  SELECT 'site' || user_id AS url, ts::DATE AS date, 'page' || (event_id % 3) AS subpage, policy,
    CASE policy WHEN 'ai_scraping' THEN 1 + (event_id % 5)
         WHEN 'license' THEN CASE WHEN event_id % 7 = 0 THEN NULL ELSE 1 + (event_id // 5) % 3 END
         ELSE CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 + (event_id // 7) % 4 END END AS verdict
  FROM events CROSS JOIN (VALUES ('ai_scraping'), ('license'), ('compete')) p(policy)
  WHERE {chosen} AND NOT (policy = 'license' AND event_id % 13 = 0)
),
dates AS (
  SELECT url, date,
    min(verdict) FILTER (policy = 'ai_scraping') AS a,
    min(coalesce(nullif(verdict, 0), 3)) FILTER (policy = 'license') AS l,
    min(coalesce(nullif(verdict, 0), 4)) FILTER (policy = 'compete') AS c
  FROM verdicts GROUP BY ALL
),
labels AS (
  SELECT url, date,
    CASE a WHEN 1 THEN 'No Scraping & AI' WHEN 2 THEN 'No Scraping' WHEN 3 THEN 'No AI' WHEN 4 THEN 'Conditional Use'
           ELSE 'Unrestricted Use' END AS a,
    CASE l WHEN 1 THEN 'NC Only' WHEN 2 THEN 'Conditional Use' ELSE 'Unrestricted Use' END AS l,
    CASE c WHEN 1 THEN 'Non-Compete' WHEN 2 THEN 'No Re-Distribution' WHEN 3 THEN 'Non-Compete' ELSE 'Unrestricted Use' END AS c
  FROM dates WHERE a IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL
),
merged AS (
  SELECT url, date, CASE WHEN a LIKE 'No%' THEN a WHEN a = l AND a = c THEN a WHEN l = 'NC Only' THEN l
     WHEN c IN ('Non-Compete', 'No Re-Distribution') THEN c ELSE a END AS verdict
  FROM labels
)"""


ALL_VERDICTS, VERDICTS = _verdicts_sql("true"), _verdicts_sql(WITH_TERMS)


def verdicts(spark, sf_dir, chosen="true"):
    e = F.col("event_id")
    entries = F.array(
        F.struct(F.lit("ai_scraping").alias("policy"), (1 + e % 5).alias("verdict")),
        F.struct(
            F.lit("license").alias("policy"),
            F.when(e % 7 != 0, 1 + F.floor(e / 5) % 3).alias("verdict"),
        ),
        F.struct(
            F.lit("compete").alias("policy"),
            F.when(e % 11 == 0, 0).otherwise(1 + F.floor(e / 7) % 4).alias("verdict"),
        ),
    )
    return (
        table(spark, sf_dir, "events")
        .filter(chosen)
        .select(
            F.concat(F.lit("site"), "user_id").alias("url"),
            F.to_date("ts").alias("date"),
            F.concat(F.lit("page"), e % 3).alias("subpage"),
            "event_id",
            F.inline(entries),
        )
        .filter("NOT (policy = 'license' AND event_id % 13 = 0)")
    )


@query(f"WITH {ALL_VERDICTS} SELECT url, date::VARCHAR AS date, verdict FROM merged")
def tos_verdict_merge(spark, sf_dir):
    return consent.text_period(tos.time_verdicts(verdicts(spark, sf_dir)), "date")


NO_TERMS = f"""{VERDICTS}, {consent.SNAPSHOTS},
everyone AS (
  SELECT url, date, verdict FROM merged
  UNION ALL SELECT url, start_date::DATE, 'No Terms Pages' FROM sites
    WHERE url NOT IN (SELECT url FROM merged))"""


def all_verdicts(spark, sf_dir):
    sites = consent.sites(spark, sf_dir)
    return tos.add_sites_without_terms(tos.time_verdicts(verdicts(spark, sf_dir, WITH_TERMS)), sites, sites)


@query(f"WITH {NO_TERMS} SELECT url, date::VARCHAR AS date, verdict FROM everyone")
def tos_no_terms_pages(spark, sf_dir):
    return consent.text_period(all_verdicts(spark, sf_dir), "date")


@query(
    f"""WITH {NO_TERMS}, days AS (SELECT unnest(generate_series(DATE '{consent.START}', DATE '{consent.END}', INTERVAL 1 DAY))::DATE AS period),
    ticks AS (SELECT DISTINCT e.url, d.period FROM everyone e JOIN sites s USING (url) JOIN days d ON d.period >= s.start_date),
    f AS (SELECT t.url, t.period, coalesce(e.verdict, 'No Terms Pages') AS status
          FROM ticks t ASOF LEFT JOIN everyone e ON t.url = e.url AND t.period >= e.date)
    SELECT period::VARCHAR AS period, status, count(*) AS count, sum(coalesce(tokens, 0))::BIGINT AS tokens
    FROM f LEFT JOIN tokens USING (url) WHERE url IN (SELECT url FROM sites WHERE user_id % 3 = 0) GROUP BY ALL"""
)
def tos_period_counts(spark, sf_dir):
    sites = consent.sites(spark, sf_dir)
    members = sites.filter("user_id % 3 = 0")
    counts = tos.period_counts_from_changes(
        all_verdicts(spark, sf_dir), members, sites, consent.tokens(spark, sf_dir), consent.START, consent.END, "day"
    )
    return consent.text_period(counts)


@query(
    f"""WITH {NO_TERMS}, t AS (SELECT url, arg_max(verdict, date) AS terms FROM merged GROUP BY url),
    r AS (SELECT url, arg_max(status, (ts, event_id)) AS robots FROM snaps GROUP BY url),
    j AS (SELECT coalesce(robots, 'none') AS robots, coalesce(terms, 'Unrestricted Use') AS terms, coalesce(tokens, 0) AS w
          FROM sites LEFT JOIN t USING (url) LEFT JOIN r USING (url) LEFT JOIN tokens USING (url)),
    c AS (SELECT robots, terms, count(*) AS count, sum(w)::BIGINT AS tokens FROM j GROUP BY ALL)
    SELECT robots, terms, count, tokens, round(100 * count / sum(count) OVER (), 2) AS pct,
       round(100 * tokens / sum(tokens) OVER (), 2) AS pct_tokens FROM c"""
)
def contingency_pct(spark, sf_dir):
    from corpusaudit.operators import reports, temporal

    snaps = consent.snapshots(spark, sf_dir)
    latest = temporal.latest_statuses(snaps, ["url"], "ts", "status", "event_id")
    joined = tos.robots_and_terms(
        consent.sites(spark, sf_dir), latest, tos.latest_verdicts(tos.time_verdicts(verdicts(spark, sf_dir, WITH_TERMS)))
    ).join(consent.tokens(spark, sf_dir), "url", "left")
    return reports.contingency(joined, "robots", "terms", "tokens")


# Answers about pages: a domain is a document source, a link is a document.
ANSWERS = """
answers AS (
  SELECT source AS domain, 'https://' || source || '/' || (doc_id % 9) AS link,
    DATE '2024-01-01' + (doc_id % 30)::INT AS date,
    CASE WHEN doc_id % 17 = 0 THEN 'True' ELSE 'False' END AS flag, 1 + doc_id % 6 AS code,
    lang || doc_id AS evidence FROM documents)"""


def answers(spark, sf_dir):
    d = F.col("doc_id")
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.col("source").alias("domain"),
            F.concat(F.lit("https://"), "source", F.lit("/"), d % 9).alias("link"),
            F.date_add(F.lit("2024-01-01").cast("date"), (d % 30).cast("int")).alias("date"),
            F.when(d % 17 == 0, "True").otherwise("False").alias("flag"),
            (1 + d % 6).alias("code"),
            F.concat("lang", d).alias("evidence"),
        )
    )


LINKS = "links AS (SELECT DISTINCT domain, link FROM answers)"


@query(
    f"""WITH {ANSWERS}, {LINKS}, v AS (SELECT domain, bool_or(flag = 'True') AS verdict FROM answers GROUP BY domain)
    SELECT * FROM v JOIN links USING (domain)"""
)
def tos_rollup(spark, sf_dir):
    return tos.roll_up_flags(answers(spark, sf_dir).withColumnRenamed("flag", "verdict"))


@query(
    f"""WITH {ANSWERS}, {LINKS}, v AS (SELECT domain,
      coalesce(string_agg(code::VARCHAR, ' | ' ORDER BY code) FILTER (code <= 4), '5') AS verdict FROM answers GROUP BY domain)
    SELECT * FROM v JOIN links USING (domain)"""
)
def tos_code_rollup(spark, sf_dir):
    return tos.roll_up_codes(answers(spark, sf_dir).withColumnRenamed("code", "verdict"))


@query(
    f"""WITH {ANSWERS} SELECT domain, link, string_agg(evidence, ' | ' ORDER BY date, evidence) AS text
    FROM answers WHERE flag = 'True' GROUP BY ALL"""
)
def tos_evidence(spark, sf_dir):
    return tos.evidence_text(answers(spark, sf_dir), F.col("flag") == "True")


@query(
    f"""WITH {ANSWERS} SELECT domain, link, date::VARCHAR AS date, max(flag) AS verdict, max(evidence) AS evidence FROM answers
    WHERE flag IS NOT NULL AND evidence NOT LIKE 'fr%' GROUP BY domain, link, date"""
)
def tos_nested_answers(spark, sf_dir):
    rows = (
        answers(spark, sf_dir)
        .withColumn("evidence", F.when(~F.col("evidence").startswith("fr"), F.col("evidence")))
        .withColumnRenamed("flag", "verdict")
    )
    unique = tos.complete_answers(rows).groupBy("domain", "link", "date").agg(
        F.max("verdict").alias("verdict"), F.max("evidence").alias("evidence")
    )
    return tos.nested_answers(unique).select("domain", "link", F.explode("answers").alias("date", "_a")).select(
        "domain", "link", "date", "_a.verdict", "_a.evidence"
    )


@query(
    """SELECT page_id, url FROM (SELECT page_id, url, contains(lower(url), '/de/') AS p,
        regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages)
    QUALIFY NOT p OR bool_and(p) OVER (PARTITION BY domain)"""
)
def privacy_prefilter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", urls.netloc(F.col("url")).alias("domain")
    )
    return tos.without_privacy_pages(pages, "domain", F.contains(F.lower("url"), F.lit("/de/"))).select(
        "page_id", "url"
    )


def _keywords(topic: str) -> str:
    words = "|".join(w.replace(".", r"\.").replace("'", "''") for w in dims.TOPIC_KEYWORDS[topic])
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})([^\p{{L}}\p{{N}}_]|$)"


@query(
    f"""SELECT doc_id, {', '.join(f"regexp_matches(text, '{_keywords(t)}') AS {t.replace('-', '_').lower()}" for t in dims.TOPIC_KEYWORDS)}
    FROM documents"""
)
def keyword_relevance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id",
        *[
            tos.mentions_topic(F.col("text"), t).alias(t.replace("-", "_").lower())
            for t in dims.TOPIC_KEYWORDS
        ],
    )


# --- annotated sites -----------------------------------------------------------------------------

SITES = """
raw AS (
  SELECT c_custkey, 'shop' || (c_custkey % 400) || CASE WHEN c_custkey % 3 = 0 THEN '.news.example.org' ELSE '.example.org' END AS domain,
    CASE WHEN c_custkey % 37 = 0 THEN 'offline' ELSE '' END AS website_issue,
    CASE WHEN c_custkey % 23 = 0 THEN '' ELSE c_mktsegment END AS description,
    CASE WHEN c_custkey % 5 = 0 THEN 'All' WHEN c_custkey % 29 = 0 THEN '' ELSE 'No' END AS paywall
  FROM customer),
merged AS (
  SELECT CASE WHEN domain LIKE 'www.%' THEN domain ELSE 'www.' || domain END AS url,
    bool_or(website_issue <> '') AS issue, arg_max(description, c_custkey) AS description,
    arg_max(paywall, c_custkey) AS paywall
  FROM raw GROUP BY 1)"""


def merged_sites(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(
            F.lit("shop"), k % 400, F.when(k % 3 == 0, ".news.example.org").otherwise(".example.org")
        ).alias("domain"),
        F.when(k % 37 == 0, "offline").otherwise("").alias("website_issue"),
        F.when(k % 23 == 0, "").otherwise(F.col("c_mktsegment")).alias("description"),
        F.when(k % 5 == 0, "All").when(k % 29 == 0, "").otherwise("No").alias("paywall"),
    )
    return st.merge_annotations(rows, "c_custkey", ["description", "paywall"])


@query(
    f"""WITH {SITES} SELECT url, paywall, description <> '' AND paywall <> '' AS usable FROM merged WHERE NOT issue"""
)
def site_annotations(spark, sf_dir):
    usable, rest = st.split_annotations(merged_sites(spark, sf_dir))
    tag = lambda df, flag: df.select("url", "paywall", F.lit(flag).alias("usable"))
    return tag(usable, True).unionByName(tag(rest, False))


@query(
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages),
    n AS (SELECT page_id, string_split(host, '.')[-2] AS name FROM h)
    SELECT page_id, CASE WHEN regexp_matches(name, 'news|times|post|journal|press|daily|tribune') THEN 'News/Media'
      WHEN regexp_matches(name, 'edu|school|college|university|academy|institute') THEN 'Education'
      WHEN regexp_matches(name, 'tech|gadget|science|digital|innovation') THEN 'Technology/Science'
      WHEN regexp_matches(name, 'health|medical|clinic|hospital|wellness') THEN 'Health'
      WHEN regexp_matches(name, 'entertainment|movie|music|video|film|show|theater') THEN 'Entertainment'
      ELSE 'Other' END AS category FROM n"""
)
def domain_category(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", st.name_category(urls.netloc(F.col("url"))).alias("category")
    )


SERVICES = """
s AS (
  SELECT p_partkey AS id, p_size AS size, p_retailprice AS price,
    p_size % 3 = 0 AS paywall, p_size % 2 = 0 AS ads,
    [p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'Blogs' ELSE 'E-Commerce' END] AS services,
    CASE WHEN p_partkey % 5 = 0 THEN ['Academic', 'Books'] ELSE ['Blogs', 'General'] END AS domains,
    floor(p_retailprice)::BIGINT AS tokens
  FROM part)"""


def service_sites(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.col("p_size").alias("size"),
        (F.col("p_size") % 3 == 0).alias("paywall"),
        (F.col("p_size") % 2 == 0).alias("ads"),
        F.array(F.col("p_brand"), F.when(k % 2 == 0, "Blogs").otherwise("E-Commerce")).alias("services"),
        F.when(k % 5 == 0, F.array(F.lit("Academic"), F.lit("Books")))
        .otherwise(F.array(F.lit("Blogs"), F.lit("General")))
        .alias("domains"),
        F.floor("p_retailprice").alias("tokens"),
    )


@query(
    f"""WITH {SERVICES}, x AS (SELECT unnest(services) AS service, tokens,
      CASE WHEN paywall AND ads THEN 'Both Paywall & Ads' WHEN paywall THEN 'Paywall' WHEN ads THEN 'Ads' ELSE 'No Ads or Paywall' END AS label FROM s),
    c AS (SELECT service, label, count(*) AS instances, sum(tokens)::BIGINT AS tokens FROM x GROUP BY ALL)
    SELECT *, round(instances / sum(instances) OVER (PARTITION BY service), 6) AS share,
       round(tokens / sum(tokens) OVER (), 6) AS token_share FROM c"""
)
def paywall_ads_by_service(spark, sf_dir):
    rows = service_sites(spark, sf_dir).withColumn(
        "label", st.paywall_ads_class(F.col("paywall"), F.col("ads"))
    )
    out = st.class_by_service(rows, "services", "label", "tokens")
    return out.withColumn("share", F.round("share", 6)).withColumn("token_share", F.round("token_share", 6))


@query(
    f"""WITH {SERVICES}, m AS (SELECT id,
      list_sort(list_distinct(domains || list_filter(services, lambda x: x IN ('News/Periodicals', 'E-Commerce', 'Blogs', 'Academic', 'Social Media/Forums')))) AS d,
      list_sort(list_distinct(services || list_filter(domains, lambda x: x IN ('News/Periodicals', 'E-Commerce', 'Blogs', 'Academic', 'Social Media/Forums')))) AS v
      FROM s)
    SELECT id, array_to_string(d, ',') AS domains, array_to_string(v, ',') AS services FROM m"""
)
def shared_labels(spark, sf_dir):
    domains, services = F.col("domains"), F.col("services")
    return service_sites(spark, sf_dir).select(
        "id",
        F.array_join(F.array_sort(st.share_labels(domains, services)), ",").alias("domains"),
        F.array_join(F.array_sort(st.share_labels(services, domains)), ",").alias("services"),
    )


@query(
    f"""WITH {SERVICES}, x AS (SELECT unnest(domains) AS category FROM s),
    c AS (SELECT category, count(*) AS count FROM x GROUP BY category)
    SELECT category, count, round(100 * count / sum(count) OVER (), 6) AS pct,
      CASE category WHEN 'Academic' THEN 'Science, Academia, & Technology' WHEN 'Books' THEN 'Books'
        WHEN 'Blogs' THEN 'Blogs' ELSE 'General Information & Education' END AS class FROM c"""
)
def category_counts(spark, sf_dir):
    classes = dims.mapping_table(spark, dims.DOMAIN_CATEGORY)
    out = st.category_counts(service_sites(spark, sf_dir), "domains", classes)
    return out.withColumn("pct", F.round("pct", 6))


@query(
    f"""WITH {SERVICES} SELECT id, array_to_string(list_filter(
      [CASE WHEN size % 4 = 0 THEN 'Text' END, CASE WHEN size % 3 = 0 THEN 'Images' END, CASE WHEN size % 5 = 0 THEN 'Video' END],
      lambda x: x IS NOT NULL), ', ') AS modalities FROM s"""
)
def modalities_label(spark, sf_dir):
    level = lambda k: F.when(F.col("size") % k == 0, F.lit("High")).otherwise("None")
    return service_sites(spark, sf_dir).select(
        "id", st.modalities_label({"Text": level(4), "Images": level(3), "Video": level(5)}).alias("modalities")
    )


@query(
    f"""WITH {SERVICES}, x AS (SELECT services[1] AS brand, size % 5 = 0 AS video FROM s)
    SELECT brand, round(avg(video::INT), 6) AS share FROM x GROUP BY brand"""
)
def video_share(spark, sf_dir):
    rows = service_sites(spark, sf_dir).select(
        F.get("services", F.lit(0)).alias("brand"),
        F.when(F.col("size") % 5 == 0, F.array(F.lit("Text"), F.lit("Video")))
        .otherwise(F.array(F.lit("Text")))
        .alias("modalities"),
    )
    return st.share_with(rows, "brand", "modalities", "Video").withColumn("share", F.round("share", 6))


@query(
    f"""WITH {SERVICES}, v AS (SELECT id, lower(trim(unnest(services || domains))) AS value FROM s)
    SELECT value, count(*) AS count FROM v WHERE value NOT IN ('blogs', 'general', 'academic') GROUP BY value"""
)
def unmatched_annotations(spark, sf_dir):
    known = dims.mapping_table(spark, {"blogs": "Blogs", "general": "General", "academic": "Academic"})
    rows = service_sites(spark, sf_dir).withColumn("values", F.concat("services", "domains"))
    return st.unmatched_values(rows, "values", known)


@query(
    f"""WITH {SERVICES} SELECT DISTINCT services[1] AS domain, 'link' || (unnest([size % 4, size % 6 + 10])) AS link FROM s"""
)
def consolidated_links(spark, sf_dir):
    rows = service_sites(spark, sf_dir).select(
        F.get("services", F.lit(0)).alias("site"),
        F.concat(F.lit("link"), F.col("size") % 4).alias("l1"),
        F.concat(F.lit("link"), F.col("size") % 6 + 10).alias("l2"),
    )
    return st.domain_links(rows, "site", ["l1", "l2"])


@query(
    """SELECT page_id, trim(regexp_replace(regexp_replace(text_part, '[\\[\\]]', '', 'g'), '\\s+', ' ', 'g')) AS label
    FROM (SELECT page_id, '[ ' || split_part(url, '/', 3) || ' ]' AS text_part FROM pages)"""
)
def label_cleanup(spark, sf_dir):
    items = tx.list_literal(F.concat(F.lit("[ "), urls.netloc(F.col("url")), F.lit(" ]")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(items, ",").alias("label"))
