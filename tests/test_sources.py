"""Readers and sinks on small folders."""

import json
from urllib.parse import unquote

import pytest

from pyspark.sql import functions as F

from corpusaudit.checks import intake
from corpusaudit.operators import catalog as ct
from corpusaudit.operators import quality
from corpusaudit.plans import corpus_prep, multimodal
from corpusaudit import dims, schemas
from corpusaudit.sources import readers, writers

RECORD = {
    "Unique Dataset Identifier": "u1",
    "Dataset Name": "One",
    "Collection": "Flan Collection (P3)",
    "Languages": ["English"],
    "Task Categories": ["QA"],
    "Text Sources": ["web"],
    "Model Generated": [],
    "Format": ["Zero-shot Prompts"],
    "Text Metrics": {"Num Dialogs": 10, "Mean Inputs Length": 5.0, "Mean Targets Length": 7.0, "Mean Dialog Turns": 2.0},
    "Creators": ["Lab"],
    "Licenses": [{"License": "MIT License", "License URL": ""}, {"License": "OpenAI", "License URL": ""}],
    "Dataset Filter IDs": ["f1", "f2"],
    "Bibtex": "@misc{a}",
    "Inferred Metadata": {"Github Date": "2020-05-01", "HF Date": "2021-01-01", "GitHub License": "Apache License 2.0"},
}


def summaries(folder):
    (folder / "One.json").write_text(json.dumps({"u1": RECORD, "u2": RECORD | {"Unique Dataset Identifier": "u2", "Licenses": [{"License": "CC BY-NC 4.0"}], "Dataset Filter IDs": ["f3"]}}))
    (folder / "_template.json").write_text("{}")
    (folder / "x_template.json").write_text(json.dumps({"t": RECORD}))
    return str(folder)


def test_catalog(spark, tmp_path):
    raw = readers.read_summaries(spark, summaries(tmp_path))
    rows = readers.catalog_columns(raw)
    assert {r.uid for r in rows.collect()} == {"u1", "u2"}
    assert rows.filter("uid = 'u1'").select(ct.creation_date().cast("string")).first()[0] == "2020-05-01"
    selected = corpus_prep.select_catalog(
        spark, str(tmp_path), ct.FILTER_PRESETS["commercial_licenses"])
    assert [r.uid for r in selected.collect()] == ["u1"]
    strict = corpus_prep.select_catalog(spark, str(tmp_path), ct.FILTER_PRESETS["commercial_licenses_and_terms"])
    assert strict.count() == 0


def test_prepare_collection(spark, tmp_path):
    selected = corpus_prep.select_catalog(spark, summaries(tmp_path), ct.FILTER_PRESETS["commercial_licenses"])
    raw = spark.createDataFrame(
        [("q1", "a1", "f1"), ("q2", "a2", "f3"), ("q3", "a3", "f2")], "inputs string, targets string, task_name string")
    dialogs, unknown = corpus_prep.prepare_collection("Flan Collection (P3)", raw, selected)
    assert dialogs.count() == 2 and {r.dataset for r in dialogs.collect()} == {"u1"} and unknown.count() == 0
    assert quality.nested_message_violations(dialogs, "dataset").count() == 0
    limited, _ = corpus_prep.prepare_collection("Flan Collection (P3)", raw, selected, limit=1)
    assert limited.count() == 1
    out = str(tmp_path / "out")
    corpus_prep.write_corpus(dialogs, out, "supervised")
    back = readers.read_json_lines(spark, out)
    assert {(r.inputs, r.targets) for r in back.collect()} == {("q1", "a1"), ("q3", "a3")}


def test_filter_arguments():
    for bad in (dict(license_use="free"), dict(start="2020-02-01", end="2020-01-01"), dict(license_sources=("x",))):
        try:
            ct.CatalogFilter(**bad).validated()
        except ValueError:
            continue
        raise AssertionError(bad)


def test_dictionaries_and_classes(spark, tmp_path):
    (tmp_path / "langs.json").write_text(json.dumps({"Romance": ["fr", "es"], "Code": []}))
    got = {tuple(r) for r in readers.read_dictionaries(spark, str(tmp_path)).collect()}
    assert got == {("langs", "Romance", "fr"), ("langs", "Romance", "es")}
    (tmp_path / "c.txt").write_text(json.dumps({"http://x": ["NC", "1", "?"]}))
    row = readers.read_license_classes(spark, str(tmp_path / "c.txt"), "license_url").first()
    assert tuple(row) == ("http://x", "NC", "1", "?")


def test_small_files(spark, tmp_path):
    (tmp_path / "items.txt").write_text(" a \n\n b\n")
    assert [r.item for r in readers.read_items(spark, str(tmp_path / "items.txt")).collect()] == ["a", "b"]
    (tmp_path / "urls.csv").write_text('url,n\n"x.org",1\n')
    assert readers.read_url_list(spark, str(tmp_path / "urls.csv")).first().url == "x.org"
    (tmp_path / "c4_news_est.csv").write_text("period,v\n2020-01,0.5\n")
    row = readers.read_named_tables(spark, str(tmp_path / "*_est.csv"), ["corpus", "service"]).first()
    assert (row.corpus, row.service) == ("c4", "news")
    (tmp_path / "doc.json").write_text('{\n "a": 1\n}')
    assert readers.read_json(spark, str(tmp_path / "doc.json")).first().a == 1
    (tmp_path / "map.json").write_text(json.dumps({"u": "text"}))
    assert tuple(readers.read_url_texts(spark, str(tmp_path / "map.json")).first()) == ("u", "text")
    for name, text in (("head", "old"), ("rand", "new")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"u": {"2020-01-01": text}}))
    dated = readers.read_dated_texts(spark, str(tmp_path / "head.json"), str(tmp_path / "rand.json"))
    assert [tuple(r) for r in dated.collect()] == [("u", "2020-01-01", "new")]
    (tmp_path / "h.csv").write_text("code\thours\nen\t2.5\n")
    assert readers.read_table(spark, str(tmp_path / "h.csv"), "code string, hours double", sep="\t").first().hours == 2.5


def test_binary_sources(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes("é".encode("latin-1"))
    assert readers.read_encoded(spark, str(tmp_path / "l.txt")).first().text == "é"
    assert readers.read_encoded(spark, str(tmp_path / "l.txt"), "ISO-8859-1").first().charset == "ISO-8859-1"
    site = tmp_path / "snap" / "x_org_"
    site.mkdir(parents=True)
    (site / "20200102030405.html").write_text("<p>hi</p>")
    row = readers.read_snapshots(spark, str(tmp_path / "snap")).first()
    assert row.url_key == "x_org_" and row.ts.isoformat() == "2020-01-02T03:04:05"


def test_character_sets(spark, tmp_path):
    said = {"UTF-8": "naïve 日本 €", "utf-8-sig": "naïve 日本", "ISO-8859-1": "caf\xe9 \xdf", "cp1252": "„caf\xe9“ – €", "UTF-16": "caf\xe9 日", "UTF-16LE": "plain caf\xe9", "UTF-16BE": "plain caf\xe9"}
    for charset, text in said.items():
        (tmp_path / f"{charset}.txt").write_bytes(text.encode(charset))
    (tmp_path / "none.txt").write_bytes(b"")
    files = readers.read_encoded(spark, str(tmp_path / "*.txt"))
    found = {r.path.rsplit("/", 1)[1][:-4]: r for r in files.collect()}
    assert {k: r.text for k, r in found.items()} == said
    assert found["cp1252"].charset == "windows-1252" and found["UTF-16LE"].charset == "UTF-16LE"
    assert readers.CP1252.encode("cp1252", "replace") == bytes(b if bytes([b]).decode("cp1252", "ignore") else 63 for b in range(0x80, 0xA0))


def test_trees_of_many_small_files(spark, tmp_path):
    rows = [("a b/c", "1", "x\ny"), ("a b/c", "2", None), ("a b/c", "2", "twice"), ("é=%", "1", ""), (None, "1", "z"), ("", "1", "日本"), ("q", None, "w")]
    df = spark.createDataFrame(rows, "key string, time string, html string").coalesce(1)
    writers.write_tree(df, ["key", "time"], "html", f"file:{tmp_path}/own")
    df.write.partitionBy("key", "time").text(f"file:{tmp_path}/sink")

    def tree(top):
        files = [f for f in (tmp_path / top).rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]
        return sorted((unquote(str(f.parent.relative_to(tmp_path / top))), sorted(f.read_bytes().split(b"\n"))) for f in files)

    assert tree("own") == tree("sink") and len(tree("own")) == 5
    assert not [f for f in (tmp_path / "own").rglob("*") if f.name.startswith((".", "_"))]  # nothing half written, no checksums


def test_snapshot_folders_are_listed_by_few_tasks(spark, tmp_path):
    for n in range(200):
        (tmp_path / f"site{n}").mkdir()
        (tmp_path / f"site{n}" / "20200102030405.html").write_text(f"<p>{n}</p>")
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        read = readers.read_snapshots(spark, str(tmp_path))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    track = spark.sparkContext.statusTracker()
    jobs = [track.getJobInfo(j) for j in track.getJobIdsForGroup("listing")]
    tasks = [track.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and max(tasks) <= readers.LISTERS * spark.sparkContext.defaultParallelism
    assert read.count() == 200 and spark.conf.get(setting) == before


def test_snapshot_trees_open_only_what_is_asked_for(spark, tmp_path):
    keys = ["a_org", "b_org_x y", *[f"site{i}" for i in range(18)]]
    for key in keys:
        (tmp_path / key).mkdir()
        for year in (2018, 2019, 2020):
            (tmp_path / key / f"{year}0102030405.html").write_text(f"<p>{key} {year}</p>")
    (tmp_path / "a_org" / "20200102030405.html.part").write_text("no")
    (tmp_path / "a_org" / "readme.html").write_text("no")
    everything = readers.read_snapshots(spark, str(tmp_path))
    assert everything.count() == 60 and everything.rdd.getNumPartitions() <= 12
    some = readers.read_snapshots(spark, str(tmp_path), "20190101000000", "20200101000000")
    assert {(r.url_key, r.html) for r in some.collect()} == {(k, f"<p>{k} 2019</p>") for k in keys}
    # files of other times are too long to be read at all
    for key in keys:
        (tmp_path / key / "20180102030405.html").write_text("x" * 1000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 500)
    try:
        assert len(readers.read_snapshots(spark, str(tmp_path), "20190101000000", "20200101000000").collect()) == 20
        with pytest.raises(Exception, match="(?i)length"):
            readers.read_snapshots(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
