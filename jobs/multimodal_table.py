"""spark-submit jobs/multimodal_table.py TEXT SPEECH VIDEO TERMS OUT: one table over three catalogs."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusaudit import build_session, dims, schemas  # noqa: E402
from corpusaudit.plans import multimodal  # noqa: E402
from corpusaudit.sources import readers, writers  # noqa: E402


def main(text, speech, video, terms, out):
    spark = build_session("multimodal-table")
    unified = multimodal.unify(
        readers.read_summaries(spark, text),
        readers.read_summaries(spark, speech, schemas.SPEECH_SUMMARY),
        readers.read_summaries(spark, video, schemas.VIDEO_SUMMARY),
    )
    verdicts = readers.read_table(spark, terms, "collection string, terms string")
    writers.write_csv(multimodal.multimodal_table(unified, dims.license_table(spark), verdicts), out)


if __name__ == "__main__":
    main(*sys.argv[1:])
