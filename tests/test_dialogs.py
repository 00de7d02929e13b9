"""Normalisers: one synthetic row per layout family, and pairs from trees."""

import json

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import dialogs as dg
from corpusaudit.operators import presets, quality


def normal(df):
    row = df.collect()[0]
    return row.dataset, [(m["idx"], m["from"], m["text"], m["parent_idx"], m["score"]) for m in row.messages]


def one(spark, ddl, *values):
    return spark.createDataFrame([values], ddl)


def test_every_preset_builds(spark):
    assert len(presets.PRESETS) == 108
    for name, preset in presets.PRESETS.items():
        if not isinstance(preset.spec, dg.WholeTable):
            assert preset.spec.messages() is not None, name
            F.expr(preset.spec.dataset)


def test_pair_is_stripped(spark):
    raw = one(spark, "inputs string, targets string, task_name string", " 　hi \n", "yo\t", "t1")
    dataset, messages = normal(presets.normalise_collection("Flan Collection (P3)", raw))
    assert dataset == "t1"
    assert messages == [(0, "user", "hi", None, None), (1, "assistant", "yo", 0, None)]


def test_templated_pairs(spark):
    raw = one(
        spark, "context string, instruction string, response string, category string",
        "Known [1] facts", "Explain", "Because [a] so", "qa",
    )
    _, messages = normal(presets.normalise_collection("Dolly 15k", raw))
    assert [m[2] for m in messages] == ["Knownfacts\nExplain", "Becauseso"]
    raw = one(spark, "instruction string, input string, output string", "add ", "1 2", "3")
    assert normal(presets.normalise_collection("Code Alpaca", raw))[1][0][2] == "add\n1 2"
    raw = one(spark, "instruction string, input string, output string", "add", "", "3")
    assert normal(presets.normalise_collection("Code Alpaca", raw))[1][0][2] == "add"
    raw = one(spark, "joke string, explaination string", "Why?", "Puns")
    assert normal(presets.normalise_collection("Joke Explanation", raw))[1][0][2] == "Why?\n\nExplain this joke."


def test_options_are_listed(spark):
    raw = one(
        spark, "question string, choices struct<label:array<string>,text:array<string>>, answerKey string",
        "What? ", (["A", "B"], ["x", "y"]), "B",
    )
    assert normal(presets.normalise_collection("RiddleSense", raw))[1][0][2] == "What?\nA: x, B: y,"


def test_commit_language_key(spark):
    raw = one(spark, "old_contents string, subject string, new_contents string, lang string", "a", "fix", "b", "Common Lisp (x)")
    assert normal(presets.normalise_collection("CommitPackFT", raw))[0] == "common-lisp-x"


def test_turns_chain(spark):
    raw = one(
        spark, "conversations array<struct<from:string,value:string>>, source string",
        [("human", " a "), ("gpt", "b"), ("human", "c")], "s",
    )
    dataset, messages = normal(presets.normalise_collection("Deita 10K", raw))
    assert dataset == "s"
    assert [(m[1], m[2], m[3]) for m in messages] == [("user", "a", None), ("assistant", "b", 0), ("user", "c", 1)]
    raw = one(spark, "conversations array<string>, source string", ["q", "r", "s"], "x")
    assert [m[1] for m in normal(presets.normalise_collection("LIMA", raw))[1]] == ["user", "assistant", "user"]
    raw = one(
        spark, "conversation struct<message:array<string>,is_human:array<boolean>>", (["a", "b"], [False, True])
    )
    assert [m[1] for m in normal(presets.normalise_collection("PygmalionAI-PIPPA", raw))[1]] == ["assistant", "user"]


def test_exchanges(spark):
    raw = one(
        spark, "conversation array<struct<input:string,output:string>>, source string",
        [("a", "b"), ("c", "d")], "s",
    )
    messages = normal(presets.normalise_collection("Capybara", raw))[1]
    assert [(m[0], m[1], m[2], m[3]) for m in messages] == [
        (0, "user", "a", None), (1, "assistant", "b", 0), (2, "user", "c", 1), (3, "assistant", "d", 2)]
    raw = one(
        spark, "interaction array<struct<instruction:string,answer_1:string,answer_2:string,rating:int>>",
        [("i", "x", "y", 4), ("j", "z", None, 2)],
    )
    messages = normal(presets.normalise_collection("KIWI", raw))[1]
    assert [m[2] for m in messages] == ["i", "x", "y", "j", "z"]
    assert messages[2][4] == 4.0


def test_transcripts(spark):
    raw = one(spark, "text string, _source string", "<human>: hi\n<bot>: yo\n<human>: bye", "oig")
    messages = normal(presets.normalise_collection("OIG", raw))[1]
    assert [(m[1], m[2], m[3]) for m in messages] == [("user", "hi", None), ("assistant", "yo", 0), ("user", "bye", 1)]
    raw = one(spark, "text string, _source string", "Background: facts.\n<human>: hi\n<bot>: yo", "oig")
    messages = normal(presets.normalise_collection("OIG", raw))[1]
    assert [m[1] for m in messages] == ["user", "assistant"] and "facts." in messages[0][2] and "hi" in messages[0][2]
    raw = one(
        spark, "input string, _source string",
        "The conversation between human and AI assistant.\n[|Human|] a\n[|AI|] b\n[|Human|]", "baize",
    )
    assert [(m[1], m[2]) for m in normal(presets.normalise_collection("Baize Chat Data", raw))[1]] == [
        ("user", "a"), ("assistant", "b")]
    raw = one(spark, "conversation string", "Teacher: try|EOM|Bob: ok: now")
    assert [(m[1], m[2]) for m in normal(presets.normalise_collection("MathDial", raw))[1]] == [
        ("assistant", "try"), ("user", "ok: now")]
    raw = one(spark, "text string, _source string", "<|user|> q <|eos|> <|ai|> r <|eos|>", "s")
    assert [(m[1], m[2]) for m in normal(presets.normalise_collection("OpenGPT Healthcare", raw))[1]] == [
        ("user", "q"), ("assistant", "r")]


def test_multi_turn_prompt(spark):
    ddl = "prompt string, turns int, answers array<struct<answer:string>>"
    raw = one(spark, ddl, " Human: a Assistant: b Human: c Assistant:", 2, [("d",)])
    assert [m[2] for m in normal(presets.normalise_collection("Nectar", raw))[1]] == ["a", "b", "c", "d"]


def test_ranked_replies(spark):
    raw = one(
        spark, "question string, human_answers array<string>, chatgpt_answers array<string>, source string",
        "q", ["h"], ["", "x"], "s",
    )
    messages = normal(presets.normalise_collection("HC3 (English)", raw))[1]
    assert messages == [(0, "user", "q", None, None), (1, "assistant", "h", 0, 1.0)]
    raw = one(
        spark,
        "conversation_a array<struct<role:string,content:string>>, conversation_b array<struct<role:string,content:string>>,"
        " model_a string, model_b string, winner string",
        [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")], "m1", "m2", "m2",
    )
    messages = normal(presets.normalise_collection("ChatbotArena", raw))[1]
    assert [(m[0], m[3], m[4]) for m in messages] == [(0, None, None), (1, 0, 0.0), (2, None, None), (3, 2, 1.0)]


def test_branched_transcripts(spark):
    shared = "\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant: "
    raw = one(spark, "chosen string, rejected string", shared + "good", shared + "bad")
    messages = normal(presets.normalise_collection("Anthropic HH-RLHF", raw))[1]
    assert messages == [
        (0, "user", "a", None, None), (1, "assistant", "b", 0, 1.0), (2, "user", "c", 1, None),
        (3, "assistant", "good", 2, 1.0), (4, "assistant", "bad", 2, 0.0)]


def test_numbered_columns(spark):
    spec = dg.NumberedColumns(("message_1", "message_2", "message_3"), "'code'")
    ddl = ", ".join(f"message_{i} struct<content:string,role_type:string>" for i in (1, 2, 3))
    raw = one(spark, ddl, ("a", "USER"), ("", "USER"), ("b", "ASSISTANT"))
    assert [(m[1], m[2], m[3]) for m in normal(dg.normalise(raw, spec))[1]] == [("user", "a", None), ("assistant", "b", 0)]


def test_whole_tables(spark):
    rows = [("t", "m1", None, 0, "prompter", 'q"', "en"), ("t", "m2", "m1", 1, "assistant", "a", "en"),
            ("t", "m3", "gone", 2, "assistant", "lost", "en"), ("t", "m4", "m3", 3, "prompter", "b", "en"),
            ("u", "n1", None, 0, "prompter", "alone", "en")]
    raw = spark.createDataFrame(
        rows, "message_tree_id string, message_id string, parent_id string, ord int, role string, text string, lang string")
    out = presets.normalise_collection("Open Assistant", raw)
    assert out.count() == 1
    assert [(m[0], m[2], m[3]) for m in normal(out)[1]] == [(0, "q", None), (1, "a", 0), (2, "b", 1)]
    lines = ["Words: x", "Story: Once", "upon", "", "Words: y", "Story: End"]
    raw = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no int, text string")
    texts = {tuple(m["text"] for m in r.messages) for r in presets.normalise_collection("Tiny Stories", raw).collect()}
    assert texts == {("Words: x\nStory:", "Once\nupon"), ("Words: y\nStory:", "End")}


def test_rounds_instructions_questions(spark):
    good = '{"round_0": {"response": "{\\"Q\\": \\"a\\", \\"A\\": \\"b\\"}"}}'
    bad = '{"round_0": {"response": "{\\"Q\\": 5, \\"A\\": \\"b\\"}"}}'
    rows = spark.createDataFrame([(1, good), (2, bad), (3, "{}")], "id int, body string")
    kept = dg.json_rounds(rows, "body").collect()
    assert [(r.id, r.conversations[0].question) for r in kept] == [(1, "a")]
    rows = spark.createDataFrame([("###Instruction: Load it\ncode",), ("x 'Instruction': 'Do it', 'Output': 1",)], "c string")
    assert [r[0] for r in rows.select(dg.instruction_of(F.col("c"))).collect()] == ["Load it", "Do it"]
    rows = spark.createDataFrame(
        [("t", [(["q1", "q2"], ["a1", "a2"])])], "title string, entries array<struct<q:array<string>,a:array<string>>>")
    assert dg.question_rows(rows, "entries", "q", "a").count() == 2


def test_pairs_need_score_and_root(spark):
    messages = [(0, "user", "q", None, None), (1, "assistant", "a", 0, 1.0), (2, "assistant", "b", 0, 0.0),
                (3, "user", "c", 1, None), (4, "assistant", "d", 3, None), (5, "user", "loop", 5, None),
                (6, "assistant", "e", 5, None)]
    dialogs = spark.createDataFrame([("s", messages)], f"dataset string, messages {dg.MESSAGES_TYPE}")
    pairs = {(r.inputs, r.targets) for r in dg.supervised_pairs(dialogs).collect()}
    assert pairs == {("q", "a"), ("c", "d")}


def test_unknown_ids(spark):
    ids = spark.createDataFrame([("c", "uid", "f1")], "collection string, uid string, filter_id string")
    dialogs = spark.createDataFrame([("f1", 1), ("f2", 2)], "dataset string, n int")
    known, unknown = dg.root_to_uid(dialogs, ids)
    assert [r.dataset for r in known.collect()] == ["uid"]
    assert [r.filter_id for r in unknown.collect()] == ["f2"]
    with pytest.raises(Exception, match="unknown filter id"):
        dg.root_to_uid(dialogs, ids, strict=True)[0].collect()


def test_nested_quality(spark):
    good = [(0, "user", "q", None, None), (1, "assistant", "a", 0, None)]
    bad = [(0, "gpt", "", 0, None), (1, "user", "x", 7, None)]
    dialogs = spark.createDataFrame([("g", good), ("b", bad)], f"dataset string, messages {dg.MESSAGES_TYPE}")
    found = {(r.dataset, r.rule) for r in quality.nested_message_violations(dialogs, "dataset").collect()}
    assert {rule for key, rule in found if key == "b"} == {
        "role", "empty text", "parent out of range", "first message is not a root"}
    assert not [f for f in found if f[0] == "g"]


def test_sample_is_stable(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    take = lambda parts: sorted(
        r.id for r in dg.sample_dialogs(df.repartition(parts), ["g"], F.col("id"), 5, seed=3).collect())
    assert take(2) == take(7) and len(take(2)) == 15


def test_json_rounds_are_all_kept_in_order(spark):
    turn = lambda i: {"response": json.dumps({"Q": f"q{i}", "A": f"a{i}"})}
    body = json.dumps({f"round_{i}": turn(i) for i in (11, 2, 0, 10, 1, 3, 4, 5, 6, 7, 8, 9)} | {"other": {"response": "x"}})
    rows = spark.createDataFrame([(1, body), (2, json.dumps({"round_12": turn(12)})), (3, "{}")], "id int, body string")
    got = {r["id"]: [c["question"] for c in r["conversations"]] for r in dg.json_rounds(rows, "body").collect()}
    assert got == {1: [f"q{i}" for i in range(12)], 2: ["q12"]}


def test_layouts_pass_the_message_rules(spark):
    """Messages of all layouts on the shared tables: roles, parents and order as the rules want them."""
    from corpusaudit.checks import load_queries

    known = load_queries()
    names = [n for n in known if n.startswith("layout_") and n != "layout_templated_pair"]
    assert len(names) == 12
    for name in names:
        rows = known[name].run(spark, "/root/testdata/sf0.001").withColumns(
            {"parent_idx": F.expr("nullif(parent_idx, -1)").cast("int"), "score": F.expr("nullif(score, -1.0)").cast("double")}
        )
        message = F.struct(F.col("idx").cast("int").alias("idx"), "from", "text", "parent_idx", "score")
        folded = rows.groupBy("dataset").agg(F.array_sort(F.collect_list(message)).alias("messages"))
        found = quality.nested_message_violations(folded, "dataset").filter("rule NOT IN ('empty text', 'role')")
        assert found.count() == 0, (name, found.limit(3).collect())
