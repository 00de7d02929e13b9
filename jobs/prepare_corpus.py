"""spark-submit jobs/prepare_corpus.py SUMMARIES RAW OUT [preset] [messages|supervised] [limit]

RAW holds one Parquet folder per collection name.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusaudit import build_session  # noqa: E402
from corpusaudit.operators.catalog import FILTER_PRESETS  # noqa: E402
from corpusaudit.operators.presets import PRESETS  # noqa: E402
from corpusaudit.plans import corpus_prep  # noqa: E402
from corpusaudit.sources import writers  # noqa: E402


def main(summaries, raw, out, preset="default", form="messages", limit="0"):
    spark = build_session("prepare-corpus")
    selected = corpus_prep.select_catalog(spark, summaries, FILTER_PRESETS[preset])
    writers.write_composition_card(selected, f"{out}/card")
    writers.write_bibliography(selected, f"{out}/bibliography")
    # the list of collection names is bounded by the presets
    names = [r.collection for r in selected.select("collection").distinct().collect()]
    if unprepared := sorted(set(names) - set(PRESETS)):
        raise ValueError(f"no preset for the selected collections {unprepared}")
    for name in sorted(names):
        rows = spark.read.parquet(f"{raw}/{name}")
        dialogs, unknown = corpus_prep.prepare_collection(name, rows, selected, int(limit) or None)
        corpus_prep.write_corpus(dialogs, f"{out}/corpus/{name}", form)
        writers.write_json_lines(unknown, f"{out}/unknown_ids/{name}")


if __name__ == "__main__":
    main(*sys.argv[1:])
