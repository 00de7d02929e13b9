"""Queries on consent over time. Events stand for snapshots: user = site, time = snapshot time."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.checks.registry import query, table
from corpusaudit.operators import temporal
from corpusaudit.session import written

START, END = "2024-01-03", "2024-01-28"
STATUS = {"view": "none", "click": "some", "purchase": "all", "signup": "some", "error": "no_robots"}

SNAPSHOTS = """
snaps AS (
  SELECT 'site' || user_id AS url, CASE event_id % 3 WHEN 0 THEN 'GPTBot' WHEN 1 THEN 'CCBot' ELSE '*' END AS agent,
    ts, event_id, CASE event_type WHEN 'view' THEN 'none' WHEN 'click' THEN 'some' WHEN 'purchase' THEN 'all'
      WHEN 'signup' THEN 'some' ELSE 'no_robots' END AS status,
    value, (props::JSON->>'k')::INT AS digest
  FROM events),
sites AS (SELECT DISTINCT user_id, 'site' || user_id AS url,
    TIMESTAMP '2023-12-30' + INTERVAL 1 DAY * (user_id % 20)::INT + INTERVAL 12 HOUR * (user_id % 2)::INT AS start_date
  FROM events),
tokens AS (SELECT 'site' || user_id AS url, sum(floor(value * 100))::BIGINT AS tokens FROM events
           GROUP BY 1)"""
FILLED = f"""{SNAPSHOTS},
days AS (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY))::DATE AS period),
pairs AS (SELECT DISTINCT url, agent FROM snaps),
ticks AS (SELECT p.url, p.agent, d.period FROM pairs p JOIN sites s USING (url) JOIN days d ON d.period >= s.start_date),
filled AS (
  SELECT t.url, t.agent, t.period, coalesce(s.status, 'no_robots') AS status
  FROM ticks t ASOF LEFT JOIN snaps s
    ON t.url = s.url AND t.agent = s.agent AND t.period + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND >= s.ts)"""
COUNTS = f"""{FILLED},
counts AS (
  SELECT period, agent, status, count(*) AS n, sum(coalesce(tokens, 0))::BIGINT AS tokens
  FROM filled LEFT JOIN tokens USING (url) GROUP BY ALL)"""
RANK = "CASE status WHEN 'all' THEN 4 WHEN 'some' THEN 3 WHEN 'none' THEN 2 ELSE 1 END"
UNRANK = "CASE {0} WHEN 4 THEN 'all' WHEN 3 THEN 'some' WHEN 2 THEN 'none' ELSE 'no_robots' END"


def snapshots(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    agent = F.when(F.col("event_id") % 3 == 0, "GPTBot").when(F.col("event_id") % 3 == 1, "CCBot").otherwise("*")
    status = F.when(F.col("event_type") == "view", "none")
    for kind, name in list(STATUS.items())[1:]:
        status = status.when(F.col("event_type") == kind, name)
    return events.select(
        F.concat(F.lit("site"), "user_id").alias("url"),
        agent.alias("agent"),
        "ts",
        "event_id",
        status.alias("status"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("digest"),
    )


def sites(spark, sf_dir):
    start = (
        F.lit("2023-12-30").cast("timestamp")
        + F.make_dt_interval(days=(F.col("user_id") % 20).cast("int"))
        + F.make_dt_interval(hours=(F.col("user_id") % 2 * 12).cast("int"))
    )
    return (
        table(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .select("user_id", F.concat(F.lit("site"), "user_id").alias("url"), start.alias("start_date"))
    )


def tokens(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("site"), "user_id").alias("url"))
        .agg(F.sum(F.floor(F.col("value") * 100)).alias("tokens"))
    )


def filled(spark, sf_dir):
    return temporal.fill_periods(
        snapshots(spark, sf_dir), sites(spark, sf_dir), START, END, "day", tie="event_id"
    )


def intervals(spark, sf_dir):
    return temporal.status_intervals(
        snapshots(spark, sf_dir), sites(spark, sf_dir), START, END, "day", tie="event_id"
    )


def counts(spark, sf_dir, weights=None):
    return temporal.period_counts_from_changes(
        snapshots(spark, sf_dir),
        sites(spark, sf_dir),
        START,
        END,
        "day",
        tie="event_id",
        tokens=tokens(spark, sf_dir) if weights is None else weights,
    )


def text_period(df, column="period"):
    return df.withColumn(column, F.col(column).cast("string"))


@query(f"WITH {FILLED} SELECT url, agent, period::VARCHAR AS period, status FROM filled")
def status_asof_fill(spark, sf_dir):
    return text_period(filled(spark, sf_dir))


@query(
    f"""WITH {SNAPSHOTS}, days AS (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY))::DATE AS period),
    pairs AS (SELECT DISTINCT url, agent FROM snaps)
    SELECT p.url, p.agent, d.period::VARCHAR AS period, s.status
    FROM (SELECT * FROM pairs CROSS JOIN days) p JOIN days d ON p.period = d.period
    ASOF JOIN snaps s ON p.url = s.url AND p.agent = s.agent AND p.period::TIMESTAMP <= s.ts"""
)
def asof_forward(spark, sf_dir):
    return text_period(
        temporal.first_from_period(snapshots(spark, sf_dir), START, END, "day", tie="event_id")
    )


@query(
    f"""WITH series AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, max(o_totalprice) AS hi, min(o_totalprice) AS lo
        FROM orders WHERE month(o_orderdate) % 3 <> 0 GROUP BY 1),
    days AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders),
    near AS (SELECT d, arg_min(period, (abs(date_diff('day', period, d)), period)) AS period FROM days CROSS JOIN series GROUP BY d)
    SELECT near.period::VARCHAR AS period, hi, lo, count(*) AS orders
    FROM orders JOIN near ON o_orderdate::DATE = d JOIN series ON near.period = series.period GROUP BY ALL"""
)
def asof_nearest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    series = (
        orders.filter(F.month("o_orderdate") % 3 != 0)
        .groupBy(F.trunc("o_orderdate", "month").alias("period"))
        .agg(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
    )
    near = temporal.nearest_period(orders, series, "o_orderdate", ["hi", "lo"])
    return text_period(near.groupBy("period", "hi", "lo").agg(F.count("*").alias("orders")))


@query(f"""WITH {COUNTS} SELECT period::VARCHAR AS period, agent, status, n AS count, tokens FROM counts""")
def period_status_counts(spark, sf_dir):
    return text_period(counts(spark, sf_dir))


@query(
    f"""WITH {FILLED}, known AS (SELECT * FROM tokens WHERE tokens % 2 = 0)
    SELECT period::VARCHAR AS period, agent, status, count(*) AS count, sum(coalesce(tokens, 0))::BIGINT AS tokens
    FROM filled LEFT JOIN known USING (url) GROUP BY ALL"""
)
def unknown_site_tokens(spark, sf_dir):
    """Sites without a token count are counted, with weight 0."""
    return text_period(counts(spark, sf_dir, tokens(spark, sf_dir).filter("tokens % 2 = 0")))


@query(
    f"""WITH {FILLED}, together AS (SELECT url, period, {UNRANK.format(f'max({RANK})')} AS status FROM filled GROUP BY ALL),
    everything AS (SELECT url, agent, period, status FROM filled
                   UNION ALL SELECT url, 'Combined Agent', period, status FROM together)
    SELECT period::VARCHAR AS period, agent, status, count(*) AS count, sum(coalesce(tokens, 0))::BIGINT AS tokens
    FROM everything LEFT JOIN tokens USING (url) GROUP BY ALL"""
)
def combined_agent(spark, sf_dir):
    return text_period(temporal.counts_with_combined_agent(intervals(spark, sf_dir), tokens(spark, sf_dir), END, "day"))


@query(
    f"""WITH {COUNTS}, pts AS (SELECT DISTINCT agent, period FROM counts),
    grid AS (SELECT * FROM pts CROSS JOIN (VALUES ('no_robots'), ('none'), ('some'), ('all')) s(status))
    SELECT g.agent, g.period::VARCHAR AS period, g.status,
       round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.agent, g.period), 6) AS share
    FROM grid g LEFT JOIN counts c ON g.agent = c.agent AND g.period = c.period AND g.status = c.status"""
)
def status_share(spark, sf_dir):
    shares = temporal.status_shares(counts(spark, sf_dir), "count", dims.STRICTNESS)
    return text_period(shares.withColumn("share", F.round("share", 6)))


@query(
    f"""WITH {COUNTS} SELECT period::VARCHAR AS period, agent,
      round(coalesce(sum(tokens) FILTER (status = 'all'), 0)::DOUBLE / nullif(sum(tokens), 0), 6) AS share
    FROM counts GROUP BY ALL"""
)
def restricted_token_share(spark, sf_dir):
    share = temporal.restricted_share(counts(spark, sf_dir))
    return text_period(share.withColumn("share", F.round("share", 6)))


@query(
    f"""WITH {FILLED}, l AS (SELECT *, lag(status) OVER w AS before, lag(period) OVER w AS prev FROM filled
          WINDOW w AS (PARTITION BY url, agent ORDER BY period))
    SELECT period::VARCHAR AS period, agent, before, status AS after, count(*) AS urls
    FROM l WHERE prev = period - INTERVAL 1 DAY GROUP BY ALL"""
)
def status_transitions(spark, sf_dir):
    return text_period(temporal.transitions_from_changes(intervals(spark, sf_dir), END, "day"))


@query(
    f"""WITH {SNAPSHOTS} SELECT url, agent, arg_max(status, (ts, event_id)) AS status FROM snaps GROUP BY ALL"""
)
def latest_status(spark, sf_dir):
    return temporal.latest_statuses(
        snapshots(spark, sf_dir), ["url", "agent"], "ts", "status", "event_id"
    )


@query(
    f"""WITH {SNAPSHOTS}, d AS (SELECT url, ts::DATE AS day, max({RANK}) AS r FROM snaps
         WHERE agent IN ('GPTBot', 'CCBot') GROUP BY ALL)
    SELECT url, {UNRANK.format('arg_max(r, day)')} AS status FROM d GROUP BY url"""
)
def latest_strictest(spark, sf_dir):
    daily = snapshots(spark, sf_dir).withColumn("snap_date", F.to_date("ts"))
    return temporal.latest_strictest(daily, ["GPTBot", "CCBot"])


MEMBERS = f"""{COUNTS},
member AS (SELECT 'site' || user_id AS url, CASE WHEN user_id % 3 = 0 THEN 'head' ELSE 'rand' END AS split,
    unnest(['kind' || (user_id % 4), 'all']) AS service FROM (SELECT DISTINCT user_id FROM events)),
split_counts AS (
  SELECT split, service, period, agent, status, count(*) AS n, sum(coalesce(tokens, 0))::BIGINT AS tokens
  FROM filled JOIN member USING (url) LEFT JOIN tokens USING (url) GROUP BY ALL),
sums AS (SELECT service, sum(tokens) FILTER (split = 'head') AS h, sum(tokens) FILTER (split = 'rand') AS r
         FROM member JOIN tokens USING (url) GROUP BY service),
tot AS (SELECT (h + 900000000)::DOUBLE AS total, h::DOUBLE AS head, 900000000::DOUBLE AS rest FROM sums WHERE service = 'all'),
fracs AS (SELECT service, CASE WHEN service = 'all' THEN head / total ELSE h / head END AS head_frac,
    CASE WHEN service = 'all' THEN rest / total ELSE r / rest END AS rand_frac FROM sums, tot),
sums_by_day AS (
  SELECT service, period,
    sum(CASE WHEN split = 'rand' AND status IN ('all', 'some') THEN tokens ELSE 0 END)
      / nullif(sum(CASE WHEN split = 'rand' THEN tokens ELSE 0 END), 0) AS random,
    sum(CASE WHEN split = 'head' AND status IN ('all', 'some') THEN tokens ELSE 0 END)
      / nullif(sum(CASE WHEN split = 'head' THEN tokens ELSE 0 END), 0) AS head
  FROM split_counts WHERE agent = 'GPTBot' GROUP BY ALL),
-- the periods of an estimate are those of the random sample
span AS (SELECT service, min(period) AS a, max(period) AS b FROM split_counts
         WHERE agent = 'GPTBot' AND split = 'rand' GROUP BY service),
grid AS (SELECT service, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS period FROM span),
parts AS (SELECT service, period, random, head FROM grid LEFT JOIN sums_by_day USING (service, period))"""


def split_urls(spark, sf_dir):
    """(url, user_id, start_date, split, services)"""
    return sites(spark, sf_dir).withColumns(
        {
            "split": F.when(F.col("user_id") % 3 == 0, "head").otherwise("rand"),
            "services": F.array(F.concat(F.lit("kind"), F.col("user_id") % 4)),
        }
    )


def members(spark, sf_dir):
    return temporal.services_with_all(split_urls(spark, sf_dir).select("url", "split", "services"))


@query(
    f"""WITH {MEMBERS} SELECT split, service, period::VARCHAR AS period, agent, status, n AS count, tokens FROM split_counts"""
)
def split_service_counts(spark, sf_dir):
    return text_period(
        temporal.split_counts(
            intervals(spark, sf_dir), members(spark, sf_dir), tokens(spark, sf_dir), END, "day"
        )
    )


def estimate(spark, sf_dir):
    urls = written(split_urls(spark, sf_dir).join(tokens(spark, sf_dir), "url", "left"), "split-urls")
    snaps = snapshots(spark, sf_dir).filter("agent = 'GPTBot'")
    spans = temporal.status_intervals(snaps, urls, START, END, "day", tie="event_id", carry=("split", "services", "tokens"))
    total = temporal.head_tokens(urls) + 900000000
    return temporal.restriction_estimate(spans, urls, total, ["all", "some"], END, "day")


@query(
    f"""WITH {MEMBERS} SELECT service, period::VARCHAR AS period, round(random, 5) AS random, round(head, 5) AS head,
      round(rand_frac * random, 5) AS rand_portion, round(head_frac * head, 5) AS head_portion,
      round(rand_frac * random + head_frac * head, 5) AS full_corpus
    FROM parts JOIN fracs USING (service)"""
)
def corpus_restriction_estimate(spark, sf_dir):
    out = estimate(spark, sf_dir)
    for c in ("random", "head", "rand_portion", "head_portion", "full_corpus"):
        out = out.withColumn(c, F.round(c, 5))
    return text_period(out)


@query(
    f"""WITH {MEMBERS} SELECT service, period::VARCHAR AS period, 'head' AS measure, round(head, 5) AS value
      FROM parts JOIN fracs USING (service)
    UNION ALL SELECT service, period::VARCHAR, 'full_corpus', round(rand_frac * random + head_frac * head, 5)
      FROM parts JOIN fracs USING (service)"""
)
def service_split_estimate(spark, sf_dir):
    long = temporal.estimates_long(estimate(spark, sf_dir), ["service"])
    return text_period(long.withColumn("value", F.round("value", 5)))


@query(
    f"""WITH {SNAPSHOTS}, l AS (SELECT *, lag(digest % 3) OVER (PARTITION BY url ORDER BY ts, event_id) AS before FROM snaps)
    SELECT url, event_id, digest % 3 AS content FROM l WHERE before IS NULL OR before <> digest % 3"""
)
def adjacent_dedup(spark, sf_dir):
    snaps = snapshots(spark, sf_dir).withColumn("content", F.col("digest") % 3)
    kept = temporal.drop_adjacent_duplicates(snaps, "ts", "content", "event_id")
    return kept.select("url", "event_id", "content")


@query(
    f"""WITH {SNAPSHOTS} SELECT url, ts::DATE::VARCHAR AS "interval", digest, arg_min(event_id, (ts, event_id)) AS event_id
    FROM snaps GROUP BY ALL"""
)
def first_per_interval(spark, sf_dir):
    kept = temporal.first_per_interval(snapshots(spark, sf_dir), "ts", "digest", "daily", "event_id")
    return kept.select(
        "url", F.to_date("interval").cast("string").alias("interval"), "digest", "event_id"
    )


@query(
    f"""WITH {SNAPSHOTS}, days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS d),
    c AS (SELECT url, ts::DATE AS d, count(DISTINCT digest) AS n FROM snaps GROUP BY ALL)
    SELECT s.url, s.d::VARCHAR AS "interval", coalesce(n, 0) AS changes
    FROM (SELECT DISTINCT url, days.d FROM snaps CROSS JOIN days) s LEFT JOIN c ON s.url = c.url AND s.d = c.d"""
)
def change_counts(spark, sf_dir):
    out = temporal.change_counts(
        snapshots(spark, sf_dir), "ts", "digest", "2024-01-01", "2024-02-02", "daily"
    )
    return text_period(out, "interval")


@query(
    f"""WITH {SNAPSHOTS}, q AS (SELECT DISTINCT url FROM snaps)
    SELECT url FROM q WHERE url NOT IN (SELECT url FROM snaps WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-02-02')"""
)
def unchanged_series(spark, sf_dir):
    out = temporal.change_counts(
        snapshots(spark, sf_dir), "ts", "digest", "2024-01-30", "2024-02-01", "daily"
    )
    return temporal.unchanged_series(out)


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, year(o_orderdate) AS y FROM orders)
    SELECT o_custkey, o_orderkey, y AS year FROM o
    QUALIFY d = min(d) OVER (PARTITION BY o_custkey, y) OR d = max(d) OVER (PARTITION BY o_custkey, y)"""
)
def farthest_per_year(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d")
    )
    return temporal.farthest_per_year(orders, ["o_custkey"], "d").select("o_custkey", "o_orderkey", F.col("year").cast("bigint").alias("year"))


@query(
    """WITH c AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS count FROM orders GROUP BY ALL)
    SELECT *, round(count / count(*) OVER (PARTITION BY year), 6) AS per_month FROM c"""
)
def monthly_heat(spark, sf_dir):
    out = temporal.monthly_normalised(table(spark, sf_dir, "orders"), "o_orderdate")
    return out.select(
        F.col("year").cast("bigint").alias("year"),
        F.col("month").cast("bigint").alias("month"),
        "count",
        F.round("per_month", 6).alias("per_month"),
    )


@query(
    f"""WITH {SNAPSHOTS} SELECT count(DISTINCT url) AS urls, min(ts)::VARCHAR AS earliest, max(ts)::VARCHAR AS latest FROM snaps"""
)
def snapshot_profile(spark, sf_dir):
    out = temporal.snapshot_profile(snapshots(spark, sf_dir), "ts")
    return text_period(text_period(out, "earliest"), "latest")


@query(
    f"""WITH {SNAPSHOTS}, starts AS (SELECT url, min(ts) AS s FROM snaps GROUP BY url)
    SELECT u.url, coalesce(s, TIMESTAMP '1970-01-01')::VARCHAR AS start_date
    FROM (SELECT DISTINCT url FROM snaps UNION ALL SELECT 'nowhere') u LEFT JOIN starts USING (url)"""
)
def site_start_dates(spark, sf_dir):
    snaps = snapshots(spark, sf_dir)
    urls = snaps.select("url").distinct().union(spark.createDataFrame([("nowhere",)], "url string"))
    starts = temporal.start_dates(snaps)
    return text_period(temporal.with_start_dates(urls, starts), "start_date")


@query(
    f"""WITH {SNAPSHOTS} SELECT url, arg_max(status, event_id) FILTER (digest % 2 = 0) AS policy,
      arg_max(value, event_id) FILTER (digest % 3 <> 0) AS value FROM snaps GROUP BY url"""
)
def merge_last_values(spark, sf_dir):
    rows = snapshots(spark, sf_dir).select(
        "url",
        "event_id",
        F.when(F.col("digest") % 2 == 0, F.col("status")).alias("policy"),
        F.when(F.col("digest") % 3 != 0, F.col("value")).alias("value"),
    )
    return temporal.merge_last_values(rows, "url", "event_id", ["policy", "value"])


@query(
    f"""WITH {SNAPSHOTS}, old AS (SELECT url, max(ts)::VARCHAR AS seen FROM snaps WHERE ts < TIMESTAMP '2024-01-29' GROUP BY url),
    new AS (SELECT url, max(ts)::VARCHAR AS seen FROM snaps WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY url)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE url NOT IN (SELECT url FROM new)"""
)
def upsert_latest(spark, sf_dir):
    snaps = snapshots(spark, sf_dir)
    old = snaps.filter("ts < '2024-01-29'").groupBy("url").agg(F.max("ts").cast("string").alias("seen"))
    new = snaps.filter("ts >= '2024-01-29'").groupBy("url").agg(F.max("ts").cast("string").alias("seen"))
    return temporal.upsert(old, new, ["url"])


@query(
    f"""WITH {SNAPSHOTS}, t AS (SELECT s.url, s.status, t.tokens, CASE WHEN t.tokens < 20000 THEN '0-20000'
         WHEN t.tokens < 100000 THEN '20000-100000' ELSE '100000-' END AS bucket
         FROM (SELECT url, arg_max(status, (ts, event_id)) AS status FROM snaps GROUP BY url) s JOIN tokens t USING (url))
    SELECT bucket, count(*) FILTER (status = 'all') AS "all", count(*) FILTER (status = 'some') AS "some",
       count(*) FILTER (status IN ('none', 'no_robots')) AS "none" FROM t GROUP BY bucket"""
)
def size_bucket_status(spark, sf_dir):
    from corpusaudit.operators import reports

    latest = temporal.latest_statuses(snapshots(spark, sf_dir), ["url"], "ts", "status", "event_id")
    sized = latest.join(tokens(spark, sf_dir), "url")
    labelled = sized.withColumn("bucket", reports.size_bucket(F.col("tokens"), [0, 20000, 100000, None]))
    status = F.when(F.col("status") == "no_robots", "none").otherwise(F.col("status"))
    return reports.counts_by_label(labelled.withColumn("status", status), "bucket", "status", ["all", "some", "none"])
