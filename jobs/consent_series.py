"""spark-submit jobs/consent_series.py SNAPSHOTS SITES TOKENS OUT START END

SNAPSHOTS (url, snap_date, robots_txt), SITES (url, start_date, services), TOKENS (url, c4_tokens,
rf_tokens, dolma_tokens) are Parquet.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusaudit import build_session, dims  # noqa: E402
from corpusaudit.operators import domains  # noqa: E402
from corpusaudit.plans import consent  # noqa: E402
from corpusaudit.sources import writers  # noqa: E402


def main(snapshots, sites, tokens, out, start, end):
    spark = build_session("consent-series")
    settings = consent.ConsentSettings(start, end)
    facts_path = f"{out}/facts"
    writers.write_parquet(consent.status_facts(spark.read.parquet(snapshots), settings), facts_path)
    # written once, read by every report below
    facts, site_table = spark.read.parquet(facts_path), spark.read.parquet(sites)
    columns = {c: f"{c}_tokens" for c in dims.CORPUS_TOKENS}
    wide = domains.url_tokens(spark.read.parquet(tokens), "url", list(columns.values()))
    every = domains.long_tokens(wide, columns)
    for corpus in columns:
        weights = domains.corpus_url_tokens(every, corpus)
        writers.write_parquet(consent.period_table(facts, site_table, settings, weights), f"{out}/periods/{corpus}")
        estimate = consent.corpus_estimate(facts, site_table, every, corpus, dims.ALL_AGENTS, settings)
        writers.write_csv(estimate, f"{out}/estimates/{corpus}")


if __name__ == "__main__":
    main(*sys.argv[1:])
