"""Queries on forecasts, page text, streams, sinks read back, and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.checks import catalogs, consent, crawlers, terms, web
from corpusaudit.checks.registry import query, table
from corpusaudit.functions import text as tx
from corpusaudit.functions import urls
from corpusaudit.operators import domains, forecast, html
from corpusaudit.plans import consent as consent_plan
from corpusaudit.plans import domain_tokens as token_plan
from corpusaudit.session import shared_folder
from corpusaudit.sources import readers, writers
from corpusaudit.streaming import jobs

# --- forecasts -----------------------------------------------------------------------------------

SERIES = f"""{consent.COUNTS},
pts AS (SELECT DISTINCT agent, period FROM counts),
series AS (
  SELECT g.agent, g.status, g.period, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.agent, g.period), 6) AS share
  FROM (SELECT * FROM pts CROSS JOIN (VALUES ('no_robots'), ('none'), ('some'), ('all')) s(status)) g
  LEFT JOIN counts c ON g.agent = c.agent AND g.period = c.period AND g.status = c.status)"""


def series(spark, sf_dir):
    return forecast.share_series(consent.counts(spark, sf_dir), "count", dims.STRICTNESS).withColumn(
        "share", F.round("share", 6)
    )


@query(
    f"""WITH {SERIES}, l AS (SELECT agent, status, period, share, lag(share, 1) OVER w AS lag_1, lag(share, 3) OVER w AS lag_3,
      lag(share, 6) OVER w AS lag_6 FROM series WINDOW w AS (PARTITION BY agent, status ORDER BY period))
    SELECT agent, status, period::VARCHAR AS period, share, lag_1, lag_3, lag_6 FROM l WHERE lag_6 IS NOT NULL"""
)
def lag_features(spark, sf_dir):
    out = forecast.lag_features(series(spark, sf_dir), ["agent", "status"], "period", "share", (1, 3, 6))
    return consent.text_period(out)


@query()
def ar_forecast(spark, sf_dir):
    out = forecast.forecast(series(spark, sf_dir), ["agent", "status"], "share", 6, (1, 3), "day")
    return consent.text_period(forecast.renormalise(out, ["agent", "period"]))


@query(
    f"""WITH {SERIES}, l AS (SELECT agent, status, period, share AS y, lag(share) OVER (PARTITION BY agent, status ORDER BY period) AS x FROM series),
    fit AS (SELECT agent, status, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, arg_max(y, period) AS f0, max(period) AS last FROM l GROUP BY ALL),
    f AS (SELECT *, a + b * f0 AS f1, a + b * (a + b * f0) AS f2 FROM fit)
    SELECT agent, status, (last + INTERVAL 1 DAY)::DATE::VARCHAR AS period, round(f1, 5) AS forecast FROM f
    UNION ALL SELECT agent, status, (last + INTERVAL 2 DAY)::DATE::VARCHAR, round(f2, 5) FROM f"""
)
def ar1_forecast(spark, sf_dir):
    """One lag and two steps, where least squares is a regression line."""
    out = forecast.forecast(series(spark, sf_dir), ["agent", "status"], "share", 2, (1,), "day")
    return consent.text_period(out.withColumn("forecast", F.round("forecast", 5)))


@query(
    f"""WITH {SERIES}, f AS (SELECT agent, status, (period + INTERVAL 20 DAY)::DATE AS period, share * 2 - 30 AS forecast FROM series),
    c AS (SELECT agent, status, period, greatest(forecast, 0) AS x FROM f),
    r AS (SELECT agent, status, period, round(x / nullif(sum(x) OVER (PARTITION BY agent, period), 0), 6) AS forecast FROM c)
    SELECT coalesce(s.agent, r.agent) AS agent, coalesce(s.status, r.status) AS status, coalesce(s.period, r.period)::VARCHAR AS period,
      share, forecast FROM series s FULL JOIN r ON s.agent = r.agent AND s.status = r.status AND s.period = r.period"""
)
def forecast_alignment(spark, sf_dir):
    actual = series(spark, sf_dir)
    shifted = actual.select(
        "agent",
        "status",
        F.date_add("period", 20).alias("period"),
        (F.col("share") * 2 - 30).alias("forecast"),
    )
    scaled = forecast.renormalise(shifted, ["agent", "period"]).withColumn("forecast", F.round("forecast", 6))
    return consent.text_period(forecast.align(actual, scaled, ["agent", "status", "period"]))


# --- text of pages -------------------------------------------------------------------------------


@query()
def html_text(spark, sf_dir):
    return html.extract_text(table(spark, sf_dir, "pages"), "html", ["page_id", "url"])


@query(
    r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
        '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS html FROM pages),
    t AS (SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', '', 'g'),
        '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;?', '&', 'g') AS text FROM h)
    SELECT page_id, regexp_replace(text, '\s+', '', 'g') AS letters FROM t"""
)
def html_letters(spark, sf_dir):
    """All visible characters of the pages: nothing is lost or invented by the extraction."""
    texts = html.extract_text(table(spark, sf_dir, "pages"), "html", ["page_id"])
    bare = F.regexp_replace(F.regexp_replace("text", "(?m)^# | #$", ""), r"\s+", "")
    return texts.select("page_id", bare.alias("letters"))


# --- streams -------------------------------------------------------------------------------------


def stream_of(spark, sf_dir, name):
    """The table's own path as a stream, one file per batch, whether it is a folder or a single file."""
    source = table(spark, sf_dir, name)
    files = [f.rsplit("/", 1)[-1] for f in source.inputFiles()]
    folder = f"{sf_dir}/{name}.parquet"
    if files == [f"{name}.parquet"]:
        reader = spark.readStream.option("pathGlobFilter", files[0])
        folder = sf_dir
    else:
        reader = spark.readStream
    return reader.format("parquet").schema(source.schema).option("maxFilesPerTrigger", 1).load(folder)


@query(f"WITH {web.COUNTS} SELECT * FROM counts")
def stream_domain_tokens(spark, sf_dir):
    pages = stream_of(spark, sf_dir, "pages").select("url", "html")
    folder = shared_folder(spark, "domains")
    run = jobs.domain_token_stream(
        pages, F.col("html"), urls.netloc(F.col("url")), f"{folder}/counts", f"{folder}/progress"
    )
    run.awaitTermination()
    return jobs.domain_token_totals(spark, f"{folder}/counts")


def event_stream(spark, sf_dir):
    return stream_of(spark, sf_dir, "events").select(
        F.concat(F.lit("site"), "user_id").alias("url"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("int").alias("digest"),
    )


@query(
    """SELECT DISTINCT 'site' || user_id AS url, strftime(ts, '%Y%m%d') AS "interval", (props::JSON->>'k')::INT AS digest FROM events"""
)
def stream_dedup(spark, sf_dir):
    folder = shared_folder(spark, "dedup")
    kept = jobs.without_repeats(event_stream(spark, sf_dir), "ts", "digest", "daily", "40 days")
    run = (
        kept.select("url", "interval", "digest")
        .writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema("url string, interval string, digest int").parquet(f"{folder}/rows")


@query(
    """WITH d AS (SELECT 'site' || user_id AS url, ts::DATE AS day, (props::JSON->>'k')::INT AS digest FROM events)
    SELECT url, day::VARCHAR AS day, count(DISTINCT digest) AS changes FROM d GROUP BY ALL"""
)
def stream_daily_changes(spark, sf_dir):
    """Distinct contents per day over all batches, the last days included."""
    folder = shared_folder(spark, "changes")
    run = jobs.daily_change_stream(event_stream(spark, sf_dir), "ts", "digest", f"{folder}/rows", f"{folder}/progress")
    run.awaitTermination()
    return consent.text_period(jobs.daily_change_totals(spark, f"{folder}/rows", "digest int"), "day")


def arrivals(parts, folder, start):
    """Let the tables ``parts`` arrive in ``folder`` one after the other; the stream is started anew for each.

    State is dealt to no more stores than there are cores: a store costs files in every batch, however few keys it has.
    """
    spark, setting = parts[0].sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        for part in parts:
            part.write.mode("append").parquet(folder)
            start().awaitTermination()
    finally:
        spark.conf.set(setting, before)


#: Days per arrival, and the delayed rows: every twentieth event comes that many arrivals late.
ARRIVAL_DAYS, LATE = 10, 1


@query(
    f"""WITH e AS (SELECT 'site' || user_id AS url, ts, (props::JSON->>'k')::INT AS digest,
        (date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // {ARRIVAL_DAYS} + CASE WHEN event_id % 20 = 7 THEN {LATE} ELSE 0 END) AS arrival FROM events),
    mark AS (SELECT a.arrival, max(e.ts) - INTERVAL 1 DAY AS watermark
        FROM (SELECT DISTINCT arrival FROM e) a LEFT JOIN e ON e.arrival < a.arrival GROUP BY 1),
    intime AS (SELECT e.* FROM e JOIN mark USING (arrival) WHERE watermark IS NULL OR ts::DATE + INTERVAL 1 DAY > watermark)
    SELECT url, ts::DATE::VARCHAR AS day, count(DISTINCT digest) AS changes FROM intime GROUP BY ALL"""
)
def stream_closed_days(spark, sf_dir):
    """Distinct contents per closed day; a twentieth of the events comes an arrival late, mostly after their day has been closed.

    The last arrival is one row of a far future that closes all days.
    """
    folder = shared_folder(spark, "closed")
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("site"), "user_id").alias("url"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("int").alias("digest"),
        "event_id",
    )
    bounds = events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
    late = F.when(F.col("event_id") % 20 == 7, LATE).otherwise(0)
    number = (F.floor(F.date_diff(F.to_date("ts"), F.lit(bounds["a"])) / ARRIVAL_DAYS) + late).cast("int")
    events = events.withColumn("arrival", number).drop("event_id")
    end = events.limit(1).select(F.lit("end").alias("url"), F.timestamp_add("YEAR", F.lit(10), F.lit(bounds["b"]).cast("timestamp")).alias("ts"), "digest")
    numbers = range((bounds["b"] - bounds["a"]).days // ARRIVAL_DAYS + LATE + 1)
    parts = [events.filter(F.col("arrival") == n).drop("arrival") for n in numbers]

    def start():
        incoming = jobs.file_stream(spark, f"{folder}/in", parts[0].schema)
        return jobs.closed_day_stream(incoming, "ts", "digest", f"{folder}/days", f"{folder}/progress")

    arrivals([*parts, end], f"{folder}/in", start)
    return consent.text_period(spark.read.schema("url string, day date, changes bigint").parquet(f"{folder}/days"), "day")


@query(
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id % 3, page_id) AS k FROM pages)
    SELECT url, page_id, octet_length(encode(html)) AS size, sha256(html) AS digest FROM p
    WHERE k = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)"""
)
def stream_new_only(spark, sf_dir):
    """Pages of URLs that were fetched earlier are skipped; of the others the first page is read, whatever comes later."""
    folder = shared_folder(spark, "fetch")
    pages = table(spark, sf_dir, "pages").select("url", "page_id", "html")
    known = pages.filter("page_id % 4 = 0").select("url")

    def fetched(df):
        return df.select("url", "page_id", F.octet_length("html").cast("bigint").alias("size"), F.sha2("html", 256).alias("digest"))

    def start():
        incoming = jobs.file_stream(spark, f"{folder}/in", pages.schema)
        return jobs.new_only_stream(incoming, known, ["url"], ["page_id"], fetched, f"{folder}/out", f"{folder}/progress")

    arrivals([pages.filter(F.col("page_id") % 3 == n) for n in range(3)], f"{folder}/in", start)
    return jobs.known_table(spark, f"{folder}/out", "url string, page_id bigint, size bigint, digest string, batch int").drop("batch")


@query(
    f"""WITH {consent.SNAPSHOTS} SELECT url, agent, arg_max(status, ts) AS status FROM snaps GROUP BY ALL"""
)
def stream_latest_status(spark, sf_dir):
    """Current status from keyed state; snapshots arrive in three parts that are not in order of time."""
    folder = shared_folder(spark, "latest")
    agent = F.when(F.col("event_id") % 3 == 0, "GPTBot").when(F.col("event_id") % 3 == 1, "CCBot").otherwise("*")
    status = tx.lookup(F.col("event_type"), consent.STATUS)
    snaps = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("site"), "user_id").alias("url"), agent.alias("agent"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status")
    )
    parts = [snaps.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == n).drop("event_id") for n in range(3)]

    def start():
        return jobs.latest_status_stream(jobs.file_stream(spark, f"{folder}/in", parts[0].schema), f"{folder}/changes", f"{folder}/progress")

    arrivals(parts, f"{folder}/in", start)
    return jobs.latest_status_table(spark, f"{folder}/progress").select("url", "agent", "status")


@query(
    """SELECT page_id FROM (SELECT page_id, contains(lower(url), '/de/') AS p,
        regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages)
    QUALIFY NOT p OR bool_and(p) OVER (PARTITION BY domain)"""
)
def stream_privacy_filter(spark, sf_dir):
    """Pages of a domain may come in any batch."""
    folder = shared_folder(spark, "privacy")
    pages = stream_of(spark, sf_dir, "pages").select("page_id", urls.netloc(F.col("url")).alias("domain"), "url")
    privacy = F.contains(F.lower("url"), F.lit("/de/"))
    run = jobs.privacy_stream(pages, "domain", privacy, f"{folder}/rows", f"{folder}/progress")
    run.awaitTermination()
    return jobs.without_privacy_pages(spark, f"{folder}/rows", "page_id bigint, domain string, url string", "domain").select("page_id")


# --- sinks read back -----------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars, text FROM documents")
def json_lines_roundtrip(spark, sf_dir):
    folder = shared_folder(spark, "lines")
    docs = table(spark, sf_dir, "documents")
    writers.write_json_lines(docs, folder, partition_by=["lang"])
    schema = "doc_id bigint, lang string, source string, n_chars bigint, text string"
    return readers.read_json_lines(spark, folder, schema).select("doc_id", "lang", "source", "n_chars", "text")


@query(
    """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 <> 0 THEN text END AS text,
       '["' || lang || '","' || source || '"]' AS labels FROM documents"""
)
def csv_roundtrip(spark, sf_dir):
    """Texts with quotes and all kinds of line breaks, empty and NULL cells, and a list column written as JSON."""
    folder = shared_folder(spark, "csv")
    text = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 13 != 0, F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.array("lang", "source").alias("labels"))
    writers.write_csv(rows, folder)
    schema = "doc_id string, text string, labels string"
    return readers.read_table(spark, folder, schema, multi_line=True, null_cell=writers.NULL_CELL)


@query(
    """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority FROM orders"""
)
def tab_dates(spark, sf_dir):
    """Tab-separated files with dates of another spelling, split over tasks."""
    folder = shared_folder(spark, "tabs")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority")
    )
    rows.write.option("header", True).option("sep", "\t").csv(folder)
    out = readers.read_table(spark, folder, "o_orderkey bigint, day date, priority string", sep="\t", date_format="dd.MM.yyyy")
    return consent.text_period(out, "day")


@query(
    f"""WITH {catalogs.FEEDS}, k AS (SELECT uid, count(*) AS k FROM named WHERE source = 'annotated' GROUP BY uid),
    r AS (SELECT 'Collections' AS title, collection AS item, num_dialogs AS d FROM cat
      UNION ALL SELECT 'Languages', unnest(languages), num_dialogs // len(languages) FROM cat
      UNION ALL SELECT 'Task Categories', unnest(task_categories), num_dialogs // len(task_categories) FROM cat
      UNION ALL SELECT 'Licenses', license, num_dialogs // k FROM named JOIN k USING (uid) JOIN cat USING (uid) WHERE source = 'annotated'),
    t AS (SELECT title, item, count(*) AS datasets, sum(d)::BIGINT AS dialogs FROM r GROUP BY title, item),
    p AS (SELECT title, item, datasets, round(100 * datasets / sum(datasets) OVER (PARTITION BY title), 2) AS a, dialogs,
      round(100 * dialogs / sum(dialogs) OVER (PARTITION BY title), 2) AS b FROM t)
    SELECT title, printf('%s  %d (%.2f %%)  %d (%.2f %%)', item, datasets, a, dialogs, b) AS line FROM p"""
)
def composition_text(spark, sf_dir):
    return writers.composition_lines(catalogs.catalog(spark, sf_dir)).select("title", "line")


@query(
    """SELECT DISTINCT trim('@misc{' || source || lang || '}') AS entry FROM documents WHERE doc_id % 7 <> 0"""
)
def bibliography(spark, sf_dir):
    folder = shared_folder(spark, "bib")
    rows = table(spark, sf_dir, "documents").select(
        F.when(
            F.col("doc_id") % 7 != 0, F.concat(F.lit(" @misc{"), "source", "lang", F.lit("}"))
        ).otherwise("").alias("bibtex")
    )
    writers.write_bibliography(rows, folder)
    return readers.read_items(spark, folder, "entry")


@query(
    f"""WITH {consent.SNAPSHOTS} SELECT url, 'all' AS split, ts::DATE::VARCHAR AS date, agent, arg_max(status, (ts, event_id)) AS status
    FROM snaps GROUP BY url, ts::DATE, agent"""
)
def nested_statistics(spark, sf_dir):
    """Per-URL nested maps written as JSON lines and read back, entry by entry."""
    folder = shared_folder(spark, "stats")
    daily = (
        consent.snapshots(spark, sf_dir)
        .groupBy("url", F.to_date("ts").alias("date"), "agent")
        .agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
        .withColumn("split", F.lit("all"))
    )
    writers.write_json_lines(writers.statistics_per_url(daily), folder)
    back = readers.read_json_lines(
        spark, folder, "url string, split string, statuses map<string,map<string,string>>"
    )
    by_date = back.select("url", "split", F.explode("statuses").alias("date", "agents"))
    return by_date.select("url", "split", "date", F.explode("agents").alias("agent", "status"))


@query(
    f"""WITH {terms.VERDICTS}, {consent.SNAPSHOTS},
    daily AS (SELECT url, ts::DATE AS date, agent, arg_max(status, (ts, event_id)) AS status FROM snaps GROUP BY ALL),
    ranked AS (SELECT url, tokens, row_number() OVER (ORDER BY tokens DESC, url) AS rank FROM tokens)
    SELECT url, 'purposes' AS part, 'kind' || (user_id % 4) AS entry FROM sites
    UNION ALL SELECT url, 'modalities', 'Text' FROM sites
    UNION ALL SELECT url, 'ranks', 'c4|' || rank || '|' || tokens FROM ranked
    UNION ALL SELECT url, 'robots', date || '|' || agent || '|' || status FROM daily
    UNION ALL SELECT url, 'terms', date || '|' || verdict FROM merged"""
)
def url_profiles(spark, sf_dir):
    from corpusaudit.operators import tos

    sites = consent.sites(spark, sf_dir)
    daily = (
        consent.snapshots(spark, sf_dir)
        .groupBy("url", F.to_date("ts").alias("date"), "agent")
        .agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    )
    tokens = consent.tokens(spark, sf_dir).withColumn("corpus", F.lit("c4"))
    profiles = writers.url_profiles(
        sites,
        domains.rank_urls(tokens, ["corpus"]),
        sites.select("url", F.array(F.concat(F.lit("kind"), F.col("user_id") % 4)).alias("purposes")),
        sites.select("url", F.array(F.lit("Text")).alias("modalities")),
        daily,
        tos.time_verdicts(terms.verdicts(spark, sf_dir, terms.WITH_TERMS)),
    )
    entry = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("entry"))
    joined = lambda part, *cols: F.transform(part, lambda x: entry(part, F.concat_ws("|", *[x[c].cast("string") for c in cols])))
    lists = [
        F.transform("purposes", lambda x: entry("purposes", x)),
        F.transform("modalities", lambda x: entry("modalities", x)),
        joined("ranks", "corpus", "rank", "tokens"),
        joined("robots", "date", "agent", "status"),
        joined("terms", "date", "verdict"),
    ]
    none = F.slice(F.array(entry("", F.lit(""))), 1, 0)
    return profiles.select("url", F.inline(F.concat(*[F.coalesce(part, none) for part in lists])))


@query(
    """WITH p AS (SELECT url, strftime(DATE '2024-01-01' + (page_id % 3)::INT, '%Y-%m-%d') AS date, page_id FROM pages)
    SELECT url, date, coalesce('new ' || max(page_id) FILTER (page_id % 2 = 0), 'old ' || max(page_id)) AS text FROM p GROUP BY url, date"""
)
def dated_texts(spark, sf_dir):
    """Two sets of lines {url, date, text}; the second replaces entries of the first."""
    folder = shared_folder(spark, "dated")
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 3).cast("int")).cast("string")
    pages = table(spark, sf_dir, "pages").select("url", date.alias("date"), "page_id")
    for name, rows in (("old", pages), ("new", pages.filter("page_id % 2 = 0"))):
        last = rows.groupBy("url", "date").agg(F.concat(F.lit(f"{name} "), F.max("page_id")).alias("text"))
        writers.write_json_lines(last, f"{folder}/{name}")
    return readers.read_dated_texts(spark, f"{folder}/old", f"{folder}/new")


# --- whole jobs ----------------------------------------------------------------------------------


@query(
    f"""WITH {crawlers.ROBOTS}, t(company, agent) AS (VALUES ('OpenAI', 'gptbot'), ('OpenAI', 'chatgpt-user'), ('OpenAI', 'oai-searchbot'),
       ('Common Crawl', 'ccbot'), ('*', '*'))
    SELECT s.page_id, company AS agent, CASE max(CASE coalesce(j.status, s.star) WHEN 'all' THEN 3 WHEN 'some' THEN 2 ELSE 1 END)
       WHEN 3 THEN 'all' WHEN 2 THEN 'some' ELSE 'none' END AS status
    FROM stars s CROSS JOIN t LEFT JOIN judged j ON j.page_id = s.page_id AND j.agent = t.agent GROUP BY ALL
    UNION ALL SELECT t2.page_id, '*All Agents*', t2.status FROM together t2"""
)
def consent_facts(spark, sf_dir):
    """Status per snapshot and company straight from robots text, without a shuffle."""
    settings = consent_plan.ConsentSettings("2024-01-01", "2024-03-01", companies=("OpenAI", "Common Crawl"))
    snaps = crawlers.robots_files(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("url"),
        F.lit("2024-01-05").cast("date").alias("snap_date"),
        F.col("body").alias("robots_txt"),
    )
    facts = consent_plan.status_facts(snaps, settings)
    return facts.select(
        F.replace("url", F.lit("www."), F.lit("")).cast("bigint").alias("page_id"), "agent", "status"
    )


@query(
    f"""WITH {consent.COUNTS} SELECT period::VARCHAR AS period, agent, status, n AS count, tokens FROM counts"""
)
def consent_period_table(spark, sf_dir):
    settings = consent_plan.ConsentSettings(consent.START, consent.END, "day")
    facts = consent.snapshots(spark, sf_dir).withColumnRenamed("ts", "snap_date")
    out = consent_plan.period_table(
        facts, consent.sites(spark, sf_dir), settings, consent.tokens(spark, sf_dir)
    )
    return consent.text_period(out)


@query(
    f"""WITH {consent.FILLED}, split AS (SELECT url, CASE WHEN row_number() OVER (ORDER BY tokens DESC, url) <= 8 THEN 'head' ELSE 'rand' END AS split FROM tokens),
    member AS (SELECT url, split, tokens, unnest(['kind' || (user_id % 4), 'all']) AS service FROM split JOIN tokens USING (url) JOIN sites USING (url)),
    sums AS (SELECT service, coalesce(sum(tokens) FILTER (split = 'head'), 0)::DOUBLE AS h, coalesce(sum(tokens) FILTER (split = 'rand'), 0)::DOUBLE AS r FROM member GROUP BY service),
    whole AS (SELECT h AS head, {dims.CORPUS_TOKENS['c4']} - h AS rest FROM sums WHERE service = 'all'),
    fracs AS (SELECT service, CASE WHEN service = 'all' THEN head / {dims.CORPUS_TOKENS['c4']} ELSE h / head END AS hf,
      CASE WHEN service = 'all' THEN rest / {dims.CORPUS_TOKENS['c4']} ELSE r / rest END AS rf FROM sums, whole),
    rows AS (SELECT m.split, m.service, f.period, f.status, m.tokens FROM filled f JOIN member m USING (url) WHERE f.agent = 'GPTBot'),
    d AS (SELECT service, period,
      sum(CASE WHEN split = 'rand' AND status = 'all' THEN tokens ELSE 0 END) / nullif(sum(CASE WHEN split = 'rand' THEN tokens ELSE 0 END), 0) AS random,
      sum(CASE WHEN split = 'head' AND status = 'all' THEN tokens ELSE 0 END) / nullif(sum(CASE WHEN split = 'head' THEN tokens ELSE 0 END), 0) AS head
      FROM rows GROUP BY ALL),
    span AS (SELECT service, min(period) AS a, max(period) AS b FROM rows WHERE split = 'rand' GROUP BY service),
    grid AS (SELECT service, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS period FROM span)
    SELECT service, period::VARCHAR AS period, round(random, 6) AS random, round(d.head, 6) AS head,
      round(rf * random, 6) AS rand_portion, round(hf * d.head, 6) AS head_portion, round(rf * random + hf * d.head, 6) AS full_corpus
    FROM grid LEFT JOIN d USING (service, period) JOIN fracs USING (service)"""
)
def corpus_estimate_job(spark, sf_dir):
    """Head and random split by rank, services, forward fill and estimate in one job."""
    settings = consent_plan.ConsentSettings(consent.START, consent.END, "day", head_size=8)
    tokens = consent.tokens(spark, sf_dir)
    every = tokens.withColumn("corpus", F.lit("c4"))
    facts = consent.snapshots(spark, sf_dir).withColumnRenamed("ts", "snap_date")
    services = F.array(F.concat(F.lit("kind"), F.col("user_id") % 4))
    sites = consent.sites(spark, sf_dir).withColumn("services", services)
    out = consent_plan.corpus_estimate(facts, sites, every, "c4", "GPTBot", settings)
    parts = ("random", "head", "rand_portion", "head_portion", "full_corpus")
    return out.select("service", F.col("period").cast("string").alias("period"), *[F.round(c, 6).alias(c) for c in parts])


@query(
    r"""SELECT source AS domain, sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')))::BIGINT AS tokens, count(*) AS pages
    FROM documents GROUP BY 1"""
)
def domain_tokens_with_metadata(spark, sf_dir):
    """Records with a metadata struct that names no domain fall back to the source."""
    records = table(spark, sf_dir, "documents").select(
        "text", "source", F.struct(F.lit(None).cast("string").alias("url"), "doc_id").alias("metadata")
    )
    return token_plan.count_with_metadata(records)
