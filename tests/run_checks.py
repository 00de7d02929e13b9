"""Run named queries against DuckDB: ``python tests/run_checks.py [sf_dir] [name ...]``."""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import connect, difference  # noqa: E402

from corpusaudit import build_session  # noqa: E402
from corpusaudit.checks import load_queries  # noqa: E402


def main(sf_dir, names):
    spark = build_session(
        "checks", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, q in load_queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            problem = difference(df, con, q.sql) if q.sql else f"rows-only {len(df.collect())}"
        except Exception as exc:
            problem = "ERROR " + "".join(traceback.format_exception_only(exc))[:1500]
        failed = problem is not None and not problem.startswith("rows-only")
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
