"""Queries on robots files. The given pages have none, so one is derived from each page's address."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit.checks.registry import query, table
from corpusaudit.functions import urls
from corpusaudit.operators import robots

PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"
# Eight kinds of file; the page's own path is one of the rules.
FILES = [
    "User-agent: *\\nDisallow:{path}\\nSitemap: https://{host}/map.xml",
    "User-Agent: GPTBot\\nUser-agent: CCBot\\nDisallow: /\\n\\nUser-agent: *\\nAllow: /",
    "# closed\\nUser-agent: *\\nDisallow: /\\n",
    "User-agent: gptbot\\nDisallow: /{path}\\nAllow: /open # note\\nUser-agent: Googlebot\\nUser-agent: Bingbot\\nDisallow: /admin",
    "User-agent: *\\nDisallow:\\nCrawl-delay: 10\\nUser-agent: ClaudeBot\\nDisallow: /",
    "Disallow: /lost\\nnonsense line\\nUser-agent: *\\nDisallow: /*?id={path}",
    "User-agent: CCBot\\nDisallow: {path}\\nAllow: {path}\\nUser-agent: ccbot\\nDisallow: /private",
    "",
]


def _sql_file(i: int) -> str:
    body = FILES[i].replace("\\n", "' || chr(10) || '")
    body = body.replace("{path}", f"' || {PATH} || '").replace("{host}", "' || host || '")
    return f"'{body}'"


ROBOTS = f"""
hosts AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
files AS (
  SELECT page_id, host, page_id % 8 AS kind,
    CASE page_id % 8 {' '.join(f'WHEN {i} THEN {_sql_file(i)}' for i in range(8))} END AS body
  FROM hosts
),
-- what each kind of file means, per agent, read off the files by hand
meaning(kind, agent, status) AS (VALUES
  (0, '*', 'some'),
  (1, 'gptbot', 'all'), (1, 'ccbot', 'all'), (1, '*', 'none'),
  (2, '*', 'all'),
  (3, 'gptbot', 'some'), (3, 'googlebot', 'none'), (3, 'bingbot', 'some'),
  (4, '*', 'none'), (4, 'claudebot', 'all'),
  (5, '*', 'none'),
  (6, 'ccbot', 'some')),
judged AS (SELECT page_id, host, kind, agent, status FROM files JOIN meaning USING (kind)),
stars AS (
  SELECT f.page_id, f.host, f.kind, f.body, coalesce(m.status, 'none') AS star
  FROM files f LEFT JOIN meaning m ON f.kind = m.kind AND m.agent = '*'),
together AS (
  SELECT s.page_id, s.star,
    CASE WHEN s.star = 'all' AND coalesce(bool_and(j.status = 'all'), true) THEN 'all'
         WHEN s.star <> 'none' OR coalesce(bool_or(j.status <> 'none'), false) THEN 'some' ELSE 'none' END AS status
  FROM stars s LEFT JOIN judged j USING (page_id) GROUP BY s.page_id, s.star)"""


def robots_files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    host = urls.netloc(F.col("url"))
    kind = F.col("page_id") % 8

    def text(i: int):
        parts = []
        for piece in FILES[i].replace("\\n", "\n").replace("{path}", "\0P\0").replace("{host}", "\0H\0").split("\0"):
            parts.append(path if piece == "P" else host if piece == "H" else F.lit(piece))
        return F.concat(*parts)

    body = F.when(kind == 0, text(0))
    for i in range(1, 8):
        body = body.when(kind == i, text(i))
    return pages.select("page_id", host.alias("host"), body.alias("body"))


def judged(spark, sf_dir):
    return robots.with_judgements(robots_files(spark, sf_dir), "body")


# Rules of the same files by lines, group numbers and joins: an independent reading of the format.
PARSED = rf"""{ROBOTS},
raw AS (SELECT page_id, unnest(range(len(ls))) AS n, unnest(ls) AS l
        FROM (SELECT page_id, string_split(body, chr(10)) AS ls FROM files)),
lines AS (SELECT page_id, n, trim(regexp_replace(l, '#.*', '')) AS l FROM raw
          WHERE trim(regexp_replace(l, '#.*', '')) <> ''),
kinds AS (SELECT page_id, n, l, lower(split_part(l, ':', 1)) AS k, trim(substr(l, instr(l, ':') + 1)) AS v FROM lines),
firsts AS (SELECT page_id, min(n) FILTER (k IN ('allow', 'disallow', 'crawl-delay', 'sitemap')) AS first_rule
           FROM kinds GROUP BY page_id),
placed AS (
  SELECT x.*, f.first_rule,
         max(CASE WHEN k = 'user-agent' THEN n END) OVER (PARTITION BY page_id ORDER BY n) AS last_agent
  FROM kinds x JOIN firsts f USING (page_id)),
grouped AS (SELECT *, CASE WHEN last_agent < first_rule THEN -1 ELSE last_agent END AS g FROM placed),
spelled AS (SELECT page_id, lower(v) AS key, arg_min(v, n) AS agent FROM kinds WHERE k = 'user-agent' GROUP BY ALL)
"""


@query(
    f"""{"WITH " + PARSED} SELECT r.page_id, s.agent,
      CASE r.k WHEN 'allow' THEN 'Allow' WHEN 'disallow' THEN 'Disallow' ELSE 'Crawl-Delay' END AS directive,
      r.v AS value
    FROM grouped r JOIN grouped a ON r.page_id = a.page_id AND r.g = a.g AND a.k = 'user-agent'
    JOIN spelled s ON s.page_id = a.page_id AND s.key = lower(a.v)
    WHERE r.k IN ('allow', 'disallow', 'crawl-delay')"""
)
def robots_parse(spark, sf_dir):
    return robots.parse(robots_files(spark, sf_dir), ["page_id"], "body").drop("ord")


@query(
    f"""{"WITH " + PARSED} SELECT page_id, 'sitemap' AS kind, v AS detail FROM kinds WHERE k = 'sitemap'
    UNION ALL SELECT page_id, 'error', 'Unmatched line: ' || l FROM kinds
      WHERE k NOT IN ('user-agent', 'allow', 'disallow', 'crawl-delay', 'sitemap')
    UNION ALL SELECT page_id, 'error', 'Directive ''' || l || ''' found with no preceding user-agent.' FROM placed
      WHERE k IN ('allow', 'disallow') AND last_agent IS NULL"""
)
def robots_extras(spark, sf_dir):
    files = robots_files(spark, sf_dir)
    maps = robots.sitemaps(files, ["page_id"], "body").select(
        "page_id", F.lit("sitemap").alias("kind"), F.col("sitemap").alias("detail")
    )
    errors = robots.parse_errors(files, ["page_id"], "body").select(
        "page_id", F.lit("error").alias("kind"), F.col("error").alias("detail")
    )
    return maps.unionByName(errors)


@query(
    f"""WITH {ROBOTS}, tracked(agent) AS (VALUES ('GPTBot'), ('CCBot'), ('ClaudeBot'), ('*'), ('*All Agents*'))
    SELECT s.page_id, t.agent,
      CASE WHEN t.agent = '*All Agents*' THEN a.status ELSE coalesce(j.status, s.star) END AS status
    FROM stars s CROSS JOIN tracked t JOIN together a USING (page_id)
    LEFT JOIN judged j ON j.page_id = s.page_id AND j.agent = lower(t.agent)"""
)
def robots_judge(spark, sf_dir):
    tracked = ["GPTBot", "CCBot", "ClaudeBot", "*", "*All Agents*"]
    return robots.agent_statuses(judged(spark, sf_dir), ["page_id"], tracked)


@query(
    f"""WITH {ROBOTS} SELECT page_id, agent, status FROM judged
    UNION ALL SELECT page_id, '*All Agents*', status FROM together"""
)
def robots_mentioned(spark, sf_dir):
    return robots.mentioned_statuses(judged(spark, sf_dir), ["page_id"])


STATS = f"""{ROBOTS}, agents AS (SELECT DISTINCT agent FROM judged UNION SELECT '*'),
each_one AS (
  SELECT a.agent, coalesce(j.status, s.star) AS status, j.status IS NOT NULL AS seen
  FROM agents a CROSS JOIN stars s LEFT JOIN judged j ON j.page_id = s.page_id AND j.agent = a.agent
  UNION ALL SELECT '*All Agents*', status, true FROM together),
stats AS (
  SELECT agent, count(*) FILTER (seen) AS observed, count(*) FILTER (status = 'all') AS "all",
         count(*) FILTER (status = 'some') AS "some", count(*) FILTER (status = 'none') AS "none"
  FROM each_one GROUP BY agent)"""


@query(f"WITH {STATS} SELECT * FROM stats")
def robots_agent_stats(spark, sf_dir):
    return robots.agent_statistics(judged(spark, sf_dir))


@query(
    f"""WITH {STATS}, picked AS (
      SELECT * FROM (SELECT * FROM stats ORDER BY observed DESC, agent LIMIT 3)
      UNION SELECT * FROM stats WHERE agent IN ('gptbot', 'claudebot'))
    SELECT agent, observed, round(100 * "all" / observed, 2) AS pct_all,
      round(100 * "some" / observed, 2) AS pct_some, round(100 * "none" / observed, 2) AS pct_none FROM picked"""
)
def robots_agent_table(spark, sf_dir):
    stats = robots.agent_statistics(judged(spark, sf_dir))
    return robots.statistics_percent(robots.top_agents(stats, 3, ["gptbot", "claudebot"]))


@query(
    rf"""WITH {ROBOTS}, tracked(agent) AS (VALUES ('GPTBot'), ('CCBot'), ('*')),
    basic AS (SELECT s.page_id, s.body, t.agent, coalesce(j.status, s.star) AS status
      FROM stars s CROSS JOIN tracked t LEFT JOIN judged j ON j.page_id = s.page_id AND j.agent = lower(t.agent))
    SELECT page_id, agent, CASE
      WHEN status = 'some' AND regexp_matches(body, 'Disallow:\s+/[^\n]*\?') THEN 'some_pattern_restrictions'
      WHEN status = 'some' AND regexp_matches(body, 'Disallow:\s*/(admin|private|confidential)') THEN 'some_disallow_important_dir'
      WHEN status = 'some' THEN 'some_other'
      WHEN status = 'none' AND contains(body, 'Crawl-delay:') THEN 'none_crawl_delay'
      WHEN status = 'none' AND regexp_matches(body, '[Ss]itemap') THEN 'none_sitemap'
      ELSE status END AS status
    FROM basic"""
)
def robots_detailed(spark, sf_dir):
    return robots.agent_statuses_detailed(
        judged(spark, sf_dir), ["page_id"], ["GPTBot", "CCBot", "*"], "body"
    )


@query(
    f"""WITH {PARSED}, c AS (SELECT key, agent, count(*) AS n FROM spelled GROUP BY ALL)
    SELECT key AS agent_key, arg_min(agent, (-n, agent)) AS agent FROM c GROUP BY key"""
)
def robots_spelling(spark, sf_dir):
    first = robots.first_spellings(robots_files(spark, sf_dir), ["page_id"], "body")
    return robots.common_spelling(first)


@query(
    f"""WITH {ROBOTS}, tracked(company, agent) AS (VALUES ('OpenAI', 'gptbot'), ('OpenAI', 'chatgpt-user'),
        ('Common Crawl', 'ccbot')),
    s AS (SELECT st.page_id, t.company, CASE coalesce(j.status, st.star) WHEN 'all' THEN 3 WHEN 'some' THEN 2 ELSE 1 END AS r
      FROM stars st CROSS JOIN tracked t LEFT JOIN judged j ON j.page_id = st.page_id AND j.agent = t.agent)
    SELECT page_id, company AS agent, CASE max(r) WHEN 3 THEN 'all' WHEN 2 THEN 'some' ELSE 'none' END AS status
    FROM s GROUP BY ALL"""
)
def strictest_status(spark, sf_dir):
    companies = {
        "OpenAI": ["GPTBot", "ChatGPT-User"],
        "Common Crawl": robots.agents_of("Common Crawl"),
    }
    tracked = sorted({a for agents in companies.values() for a in agents})
    statuses = robots.agent_statuses(judged(spark, sf_dir), ["page_id"], tracked)
    return robots.group_statuses(statuses, ["page_id"], companies)
