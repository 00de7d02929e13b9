"""Streams: restart without double counting, late rows, bookkeeping."""

import datetime as dt
import tracemalloc

import pyarrow as pa
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from corpusaudit.functions import urls
from corpusaudit.operators import html
from corpusaudit.streaming import jobs


def test_restart_counts_once(spark, tmp_path):
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "url string, text string"
    run = lambda: jobs.domain_token_stream(
        jobs.file_stream(spark, folder, schema, files_per_batch=1), F.col("text"), urls.netloc(F.col("url")), out, ck
    ).awaitTermination()
    spark.createDataFrame([("http://a.org/1", "one two"), ("http://b.org", "x")], schema).coalesce(1).write.parquet(folder)
    run()
    run()
    spark.createDataFrame([("http://a.org/2", "three")], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = {r.domain: (r.tokens, r.pages) for r in jobs.domain_token_totals(spark, out).collect()}
    assert got == {"a.org": (3, 2), "b.org": (1, 1)}


def test_known_urls_are_skipped(spark, tmp_path):
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "url string, n int"
    known = spark.createDataFrame([("k", 0), ("k", 1)], schema)
    run = lambda: jobs.new_only_stream(
        jobs.file_stream(spark, folder, schema), known, ["url"], ["n"], lambda df: df, out, ck
    ).awaitTermination()
    arrive = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    arrive([("a", 2), ("a", 1), ("b", None), ("b", 2), ("k", 5), (None, 3)])
    run()
    run()
    arrive([("b", 3), ("c", 4), ("k", 6), (None, 1)])
    run()
    rows = spark.read.parquet(out).select("url", "n").collect()
    assert sorted(map(tuple, rows), key=repr) == [("a", 1), ("b", None), ("c", 4), (None, 3)]
    # history is not read again: a batch does its work although all earlier results are unreadable
    for part in (tmp_path / "out").rglob("*.parquet"):
        part.write_text("broken")
    arrive([("a", 7), ("d", 8)])
    run()
    new = max((tmp_path / "out").iterdir(), key=lambda f: int(f.name.split("=")[1]))
    assert [tuple(r) for r in spark.read.parquet(str(new)).collect()] == [("d", 8)]


def test_current_status_survives_restarts(spark, tmp_path):
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "url string, agent string, ts timestamp, status string"
    at = lambda d: dt.datetime(2020, 1, d)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.latest_status_stream(jobs.file_stream(spark, folder, schema), out, ck).awaitTermination()
        return {(r.url, r.agent): (r.status, r.ts) for r in jobs.latest_status_table(spark, ck).collect()}

    assert arrive([("u", "a", at(5), "all"), ("u", "b", None, "some"), ("v", "a", at(1), None)]) == {
        ("u", "a"): ("all", at(5)), ("u", "b"): ("some", None), ("v", "a"): (None, at(1))}
    late = arrive([("u", "a", at(2), "none"), ("u", "b", at(1), "none"), ("w", "a", at(9), "all")])
    assert late[("u", "a")] == ("all", at(5)) and late[("u", "b")] == ("none", at(1)) and len(late) == 4
    assert arrive([("u", "a", at(6), "some")])[("u", "a")] == ("some", at(6))
    # only keys of the batch are written
    last = max((tmp_path / "out").iterdir(), key=lambda f: int(f.name.split("=")[1]))
    assert [r.url for r in spark.read.parquet(str(last)).collect()] == ["u"]


def test_late_rows_are_dropped(spark, tmp_path):
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "url string, ts timestamp, digest int"
    day = lambda d: dt.datetime(2020, 1, d, 12)
    run = lambda: jobs.closed_day_stream(jobs.file_stream(spark, folder, schema), "ts", "digest", out, ck).awaitTermination()
    spark.createDataFrame([("u", day(1), 1), ("u", day(1), 2), ("u", day(9), 3)], schema).coalesce(1).write.parquet(folder)
    run()
    spark.createDataFrame([("u", day(1), 7), ("u", day(20), 4)], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = {(r.day.day, r.changes) for r in spark.read.parquet(out).collect()}
    assert (1, 2) in got and (9, 1) in got and not [g for g in got if g[0] == 1 and g[1] != 2]


def test_page_text():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var x='<p>no</p>';</script></head>"
        "<body><h1> Big <b>one</b></h1>a<br>b<h2>Sub</h2><p>first<br>line</p><p>second &amp; last</p><!-- c --></body></html>"
    )
    assert html.html_to_text(page) == "T\n# Big one #\na\nb\n## Sub ##\nfirstline\nsecond & last"
    # an unclosed paragraph swallows the ones after it, up to the end of its parent
    assert html.html_to_text("<div><p>one <p>two</p></div>three") == "one two\nthree"
    assert html.html_to_text(None) == "" and html.html_to_text("") == ""


def test_pages_of_a_large_batch_are_not_held_as_texts_at_once(spark):
    pages = [f"<p>{n}</p>" + "words " * 1600 for n in range(3000)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array(range(len(pages))), "html": pages})
    seen = 0
    tracemalloc.start()
    try:
        for part in html.texts_of(iter([batch]), "text"):
            seen += part.num_rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen == len(pages) and peak < 8e6  # the batch has 29 MB, its texts as many
    rows = spark.createDataFrame([(None, "u", "<p>a"), (2**60 + 1, None, None), (3, "v", "")], "page_id bigint, url string, html string")
    found = html.extract_text(rows, "html", ["page_id", "url"])
    assert {tuple(r) for r in found.collect()} == {(None, "u", "a"), (2**60 + 1, None, ""), (3, "v", "")}


def test_streams_over_folders_of_several_files(spark, tmp_path):
    """Every stream query gives the same rows when each table is a folder of four files, one file per batch."""
    from corpusaudit.checks import load_queries

    known = load_queries()
    names = [n for n in known if n.startswith("stream_")]
    assert len(names) >= 6
    for name in ("pages", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    con = connect("/root/testdata/sf0.001")
    for name in names:
        assert difference(known[name].run(spark, str(tmp_path)), con, known[name].sql) is None, name


def test_state_tables_may_be_missing_but_not_broken(spark, tmp_path):
    assert jobs.known_table(spark, str(tmp_path / "none"), "a int").collect() == []
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        jobs.known_table(spark, str(tmp_path / "broken"), "a int").collect()
