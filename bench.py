"""Headline queries, timed: one JSON line on stdout.

``BENCH_SF_DIR`` (default the sf0.1 tables), ``BENCH_CPUS`` (default 8). Beside them, a few operators over a million rows that are
derived from the documents, where start-up no longer counts (``large_rows_per_sec``; not part of the total).
"""

import contextlib
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusaudit import build_session  # noqa: E402
from corpusaudit.checks import load_queries  # noqa: E402

HEADLINE = [
    "domain_tokens",
    "topk_domains",
    "domain_tokens_mixed_layouts",
    "url_rank",
    "dialog_messages",
    "supervised_pairs",
    "dialog_text_metrics",
    "license_criteria",
    "license_use_filter",
    "composition_card",
    "robots_judge",
    "robots_agent_stats",
    "status_asof_fill",
    "period_status_counts",
    "combined_agent",
    "status_transitions",
    "corpus_restriction_estimate",
    "tos_period_counts",
    "contingency_pct",
    "keyword_relevance",
    "change_counts",
    "gini",
    "gini_by_group",
    "gini_by_year",
    "population_estimate",
    "license_terms_cube",
    "ip_range_join",
    "html_text",
    "stream_domain_tokens",
]


LARGE_ROWS = 1_000_000


def large(spark, sf_dir):
    """Rows per second of single operators over LARGE_ROWS short texts: paragraphs of the documents, repeated under new names."""
    from pyspark.sql import functions as F

    from corpusaudit.functions import urls
    from corpusaudit.operators import domains, tos

    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"))
    copies = -(-LARGE_ROWS // texts.count())
    rows = texts.repartition(32).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).limit(LARGE_ROWS)
    url = F.concat(F.lit("https://host"), (F.col("doc_id") * 7 + F.col("copy")) % 50_000, F.lit(".org/"), "copy")
    rows = rows.select(url.alias("url"), "text").repartition(64).cache()
    rows.count()
    made = {
        "domain_tokens": lambda: domains.domain_tokens(rows, F.col("text"), urls.netloc(F.col("url"))),
        "keyword_relevance": lambda: rows.select(*[tos.mentions_topic(F.col("text"), t).alias(t) for t in ("scraping", "AI-policy")]),
        "url_normalize": lambda: rows.select(urls.with_www(urls.netloc(F.col("url"))).alias("site")),
    }
    speed = {}
    for name, build in made.items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        speed[name] = round(LARGE_ROWS / (time.perf_counter() - start))
    rows.unpersist()
    return speed


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session(
            "bench",
            master=f"local[{cpus}]",
            shuffle_partitions=int(cpus),
            extra={"spark.ui.enabled": "false", "spark.driver.memory": "8g"},
        )
        spark.sparkContext.setLogLevel("ERROR")
        known = load_queries()
        spark.range(1000).selectExpr("sum(id)").collect()
        times = {}
        for name in HEADLINE:
            best = None
            for _ in range(2):
                start = time.perf_counter()
                known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
                taken = time.perf_counter() - start
                best = taken if best is None else min(best, taken)
            times[name] = round(best, 3)
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
        pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
        speed = large(spark, sf_dir)
        spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (best of two runs each)",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
                "large_rows_per_sec": speed,
                "rows_per_sec": {
                    "domain_tokens (pages)": round(pages / times["domain_tokens"]),
                    "domain_tokens_mixed_layouts (documents)": round(docs / times["domain_tokens_mixed_layouts"]),
                    "keyword_relevance (documents)": round(docs / times["keyword_relevance"]),
                },
            }
        )
    )


if __name__ == "__main__":
    main()
