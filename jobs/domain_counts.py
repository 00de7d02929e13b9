"""spark-submit jobs/domain_counts.py PAGES OUT [plain|metadata]: tokens and pages per domain."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusaudit import build_session  # noqa: E402
from corpusaudit.plans import domain_tokens  # noqa: E402
from corpusaudit.sources import writers  # noqa: E402


def main(pages, out, layout="plain"):
    spark = build_session("domain-counts")
    table = spark.read.json(pages) if pages.rstrip("/").endswith((".gz", ".jsonl", "json")) else spark.read.parquet(pages)
    counts = domain_tokens.count_with_metadata(table) if layout == "metadata" else domain_tokens.count_plain(table)
    writers.write_parquet(counts, out)


if __name__ == "__main__":
    main(*sys.argv[1:])
