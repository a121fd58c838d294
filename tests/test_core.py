"""Decisions, funnel, profile, skew, annotation, extraction and streaming on small fixtures."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatloom.operators import annotate, extract, funnel, profile, skew
from chatloom.operators import decisions as dec
from chatloom.operators.messages import first_user_prompt, messages
from chatloom.streaming import ingest


def U(text, language="English"):
    return ("user", text, language)


def A(text, language="English"):
    return ("assistant", text, language)


def reasons(raw, **settings):
    policy = dec.Policy(**settings)
    return {r["source_row_position"]: r["removal_reason"] for r in dec.decide(dec.metadata(raw, policy), policy).collect()}


def test_reasons_in_order(raw_of):
    raw = raw_of(
        [[U("a")], [U("b", "Spanish")], [U("c")], [U("  ")], [U("d")], [U(" d\n")], [U("d", "fr")], None, [A("x")]],
        turn=[1, 1, 2, 1, 1, 1, 1, 1, 1],
    )
    got = reasons(raw)
    assert got == {0: "KEPT", 1: "NON_ENGLISH", 2: "MULTI_TURN", 3: "EMPTY_FIRST_PROMPT", 4: "DUPLICATE_FIRST_PROMPT", 5: "DUPLICATE_FIRST_PROMPT", 6: "NON_ENGLISH", 7: "NON_ENGLISH", 8: "NON_ENGLISH"}
    assert {k for k, v in reasons(raw, duplicate_mode="keep_first").items() if v == "KEPT"} == {0, 4}
    assert {k for k, v in reasons(raw, duplicate_mode="none").items() if v == "KEPT"} == {0, 4, 5}


def test_a_group_with_a_removed_member_is_unique(raw_of):
    assert reasons(raw_of([[U("d")], [U("d", "fr")]]))[0] == "KEPT"


def test_filters_that_are_off_keep_all(raw_of):
    raw = raw_of([[U("", "x")], [U(" ", "x")]], turn=[None, 3])
    off = {"filter_non_english": False, "filter_multiturn": False, "drop_empty_first_prompt": False}
    assert set(reasons(raw, **off, duplicate_mode="none").values()) == {"KEPT"}
    # blank prompts share one hash
    assert set(reasons(raw, **off).values()) == {"DUPLICATE_FIRST_PROMPT"}


def test_unknown_settings():
    with pytest.raises(ValueError):
        dec.Policy(single_turn_method="x")
    with pytest.raises(ValueError):
        dec.Policy(duplicate_mode="x")
    assert dec.english_labels(" English, en_GB,, ") == ("english", "en-gb")


def test_row_key_and_methods(raw_of):
    raw = raw_of([[U("a"), U("b")], [U("c")], [U("d")]], conversation_id=[None, " ", " x "], turn=[1, 1, None])
    rows = dec.metadata(raw).orderBy("source_row_position").collect()
    assert [r["row_key"] for r in rows] == ["a.parquet::0", "a.parquet::1", " x "]
    assert [r["single_turn"] for r in rows] == [True, True, False]
    both = dec.metadata(raw, dec.Policy(single_turn_method="both")).orderBy("source_row_position").collect()
    assert [r["single_turn"] for r in both] == [False, True, False]


def test_modes_nest_and_counts_add_up(odd_raw):
    raw = odd_raw.where("row_id IS NOT NULL AND source_file IS NOT NULL").dropDuplicates(["row_id"])
    kept = {}
    for mode in dec.MODES:
        d = dec.decide(dec.metadata(raw), dec.Policy(duplicate_mode=mode))
        s = dec.summary(d).first()
        assert s["total_records"] == s["kept_records"] + s["removed_records"] == raw.count()
        kept[mode] = {r["row_key"] for r in d.where("keep_final").collect()}
    assert kept["drop_all"] <= kept["keep_first"] <= kept["none"]


def test_filtered_keeps_columns(odd_raw):
    got = dec.filtered(odd_raw.where("source_file IS NOT NULL"))
    assert set(odd_raw.columns) < set(got.columns)


@pytest.mark.parametrize("block", [100_000, 3, 1])
def test_shards_are_contiguous(spark, monkeypatch, block):
    monkeypatch.setattr(dec, "BLOCK", block)
    rows = [(f"f{i // 7}", i % 7 * 2) for i in range(30)]
    got = dec.shards(spark.createDataFrame(rows, "source_file string, source_row_position long"), 4).collect()
    order = sorted(got, key=lambda r: (r["source_file"], r["source_row_position"]))
    assert [r["shard_no"] for r in order] == [i // 4 for i in range(30)]


def test_funnel(raw_of):
    good = [U("a", "en"), A("b", "en-US")]
    raw = raw_of(
        [good, good, [U("c", "en"), A("d", "en")], [U("e", "en"), A("f", "en")], [U("g", "en"), A(" ", "en")], [U("h", "en"), A("i", "fr")], [U(" ", "en"), A("x", "en")], [U(" ", "en"), A("x", "en")]],
        conversation_id=["1", "2", "1", "4", "5", "6", None, None],
        snippet_turns=[[1], [1], [1], [2], [1], [1], [1], [1]],
    )
    got = [r["removed_at"] for r in funnel.tagged(raw).orderBy("source_row_position").collect()]
    assert got == [None, "first_prompt_dedup", "conversation_id_dedup", "snippet_first_turn", "structural_validity", "english_labels", "structural_validity", "structural_validity"]
    rows = funnel.funnel(funnel.tagged(raw)).orderBy("step_no").collect()
    assert [r["n_removed"] for r in rows] == [1, 1, 0, 1, 3, 1, 0] and rows[-1]["n_after"] == 1
    assert funnel.funnel(funnel.tagged(raw.limit(0))).where("total_share IS NULL").count() == 7
    assert {r["metric"]: r["value"] for r in funnel.size_summary(funnel.tagged(raw)).collect()}["rows_after"] == 1.0


def test_null_content_reads_as_role_and_label(raw_of):
    flags = funnel.tagged(raw_of([[("user", None, "English"), A("x", "en")]]))
    assert flags.first()["removed_at"] is None


def test_language_cleaning(spark):
    df = spark.createDataFrame([("see `x` at https://a.b/c ```\ncode\n``` Ünder  score_d",), ("中文",)], "t string")
    assert [r[0] for r in df.select(funnel.cleaned_for_language(F.col("t"))).collect()] == ["see at Ünder score d", ""]
    short = df.select(funnel.detected(F.col("t"), lambda c: F.lit("en"))).collect()
    assert [r[0] for r in short] == ["not_enough_text"] * 2


def test_profile(spark, odd_raw):
    missing = {r["column_name"]: r["n_missing"] for r in profile.missing_values(odd_raw.select("model", "conversation", "turn")).collect()}
    assert missing == {"model": 3, "conversation": 2, "turn": 2}
    card = {r["column_name"]: (r["n_distinct"], r["n_null"], r["n_duplicate"]) for r in profile.cardinality(odd_raw, ["conversation_id", "model"], "conversation_id").collect()}
    assert card == {"conversation_id": (3, 2, 5), "model": (2, 2, None)}
    assert [(r["value"], r["n_rows"]) for r in profile.top_counts(odd_raw, F.col("model"), 1).collect()] == [("m", 5)]
    assert profile.duplicate_records(odd_raw, "conversation_id", ["row_id"]).count() == 5
    empty = odd_raw.limit(0)
    assert profile.missing_values(empty).where("missing_percent IS NULL").count() == len(empty.columns)
    assert profile.describe(empty, "turn").first()["n"] == 0
    paths = {r["key_path"]: r["n_values"] for r in profile.nested_keys(odd_raw, ["conversation"]).collect()}
    assert paths["conversation"] == 7 and paths["conversation[][].role"] == 11
    assert {r["metric"]: r["value"] for r in profile.size_summary(odd_raw).collect()}["n_expected_missing"] == 0
    assert profile.schema_summary(odd_raw).where("is_expected").count() == 5
    assert profile.histogram(odd_raw, "turn", 0, 2, 2).agg(F.sum("n_rows")).first()[0] == 6
    assert profile.duplicate_groups(odd_raw.select(profile.record_hash(odd_raw).alias("h")), F.col("h")).first()["n_rows"] == 2


def test_label_counts(odd_raw):
    rows = {(r["role"], r["label"]): r["n_messages"] for r in profile.label_counts(odd_raw).collect()}
    assert rows[("user", "en")] == 2 and rows[(None, "en")] == 5 and not any(k[1] == "" for k in rows)


def test_salted_sums_equal_plain_ones(spark):
    rows = [(i, "hot" if i % 3 else None if i % 9 == 0 else f"k{i % 50}", i if i % 5 else None, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, v long, key_value string")
    got = {r["key_value"]: (r["n"], r["s"]) for r in skew.salted_aggregate(df, "k", {"n": F.lit(1), "s": F.col("v")}, F.col("id"), share=0.05).collect()}
    n, s = Counter(), Counter()
    for _, k, v, _ in rows:
        n[k] += 1
        s[k] += v or 0
    assert got == {k: (n[k], s[k]) for k in n}
    assert {r["key_value"] for r in skew.heavy_keys(df, "k", 0.5).collect()} == {"hot"}
    assert skew.salted_aggregate(df.limit(0), "k", {"n": F.lit(1)}, F.col("id")).count() == 0
    assert skew.heavy_keys(df.limit(0), "k").count() == 0
    per = skew.salted_aggregate(df, "k", {"n": F.lit(1)}, F.col("id"))
    assert {r["key_value"] for r in skew.keys_of_share(per, "n", 20).collect()} == {"hot"}


def test_messages_keep_positions(odd_raw):
    rows = messages(odd_raw, "row_id").where("row_id = 3").orderBy("msg_pos").collect()
    assert [(r["msg_pos"], r["role"]) for r in rows] == [(0, None), (1, "user")]
    assert {r[0] for r in odd_raw.where("row_id in (1, 2, 3)").select(first_user_prompt(F.col("conversation"))).collect()} == {""}


def label_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(annotate.line_label(F.col("t"))).collect()]


def test_line_labels(spark):
    code = ["```", "$ ls", "#!/bin/sh", "x = 1", "é = 1", "² = 1", "open main.py", "see a/b.sql now", "}", "SELECT 1", "if (x", "var x"]
    prose = ["is a=b?", "plain words", "version two", "main.pyc", "return"]
    assert label_of(spark, code) == ["CODE"] * len(code)
    assert label_of(spark, prose) == ["NATURAL_LANGUAGE"] * len(prose)
    assert label_of(spark, ["", " \t", "　"]) == ["EMPTY"] * 3


def test_tasks_and_languages(spark):
    rows = [
        ("", "AMBIGUOUS", "UNKNOWN"), ("Hello", "OTHER", "EN"), ("the latest", "TEST_GENERATION", "EN"), ("refactor it", "REFACTORING", "EN"), ("a prefix", "BUG_FIXING", "EN"), ("convert it", "CODE_MODIFICATION", "EN"),
        ("specific", "CONFIGURATION", "EN"), ("a csv", "DATA_QUERY", "EN"), ("explain", "EXPLANATION", "EN"), ("an api", "CODE_GENERATION", "EN"), ("look at that", "OTHER", "EN"),
        ("你好", "OTHER", "ZH"), ("カナ", "OTHER", "JA"), ("errore", "BUG_FIXING", "IT"), ("the error", "BUG_FIXING", "ES"), ("code", "OTHER", "FR"), ("warum", "OTHER", "DE"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select("t", annotate.task_category(F.col("t"), F.lit(False)), annotate.language_guess(F.col("t"))).collect()
    assert [tuple(r) for r in got] == rows
    helped = spark.createDataFrame([("please look",)], "t string").select(annotate.task_category(F.col("t"), F.lit(True))).first()[0]
    assert helped == "BUG_FIXING"


def test_annotated_records(raw_of):
    long = "\n".join(["x = 1"] * 21)
    raw = raw_of([[U("Explain this:\n\nx = 1\n")], [U(" ")], [U("def f():\n} >>>\n ")], [U(long)], None])
    rows = {r["row_index"]: r for r in annotate.annotated(raw).collect()}
    assert (rows[0]["natural_language_text"], rows[0]["code_text"], rows[0]["task_category"]) == ("Explain this:", "x = 1", "EXPLANATION")
    assert rows[1]["overall_status"] == "empty_prompt" and rows[1]["task_category"] == "AMBIGUOUS"
    assert rows[2]["overall_status"] == "partial_error" and rows[2]["code_text"] == "" and rows[2]["natural_language_text"] == "def f():\n} >>>"
    assert rows[2]["overall_error"] == "code_nl: Missing classifications for lines: [1, 2, 3]"
    assert rows[4]["user_prompt_original"] == "" and len(rows[0]) == 19
    lines = annotate.lines(annotate.prompts(raw)).where("row_index = 3").collect()
    assert Counter(r["batch_no"] for r in lines) == {0: 20, 1: 1} and len(lines) == 21
    counts = annotate.separated(annotate.prompts(raw)).where("row_index = 0").first()
    assert (counts["natural_language_line_count"], counts["code_line_count"], counts["empty_line_count"], counts["line_count"]) == (1, 1, 1, 3)


def test_annotation_of_odd_rows(odd_raw):
    assert annotate.annotated(odd_raw).count() == odd_raw.count()
    assert annotate.annotated(odd_raw.limit(0)).count() == 0


def test_extraction_of_any_nesting(spark):
    m = {"role": "user", "content": "a", "language": None}
    deep = {"x": [[m], {"y": json.dumps([{"role": "assistant", "content": "b"}])}]}
    inputs = [json.dumps([[m]]), json.dumps(json.dumps([m])), json.dumps(deep), "no json", None, "[]", json.dumps({"role": "user", "content": {"k": 1}}), json.dumps({"role": "user"})]
    df = spark.createDataFrame([(x,) for x in inputs], "c string")
    got = [[x["content"] for x in r[0]] for r in df.select(extract.normalize("c")).collect()]
    assert got == [["a"], ["a"], ["a", "b"], [], [], [], ['{"k": 1}'], []]


def test_stable_hash_and_paths(spark):
    import hashlib

    values = ['{"b": 1, "a": "é"}', None, "x y", "3"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = ['{"a": "é", "b": 1}', "null", '"x y"', "3"]
    assert [r[0] for r in df.select(extract.stable_hash("v")).collect()] == [hashlib.sha256(w.encode()).hexdigest() for w in want]
    paths = {r["key_path"]: r["n_values"] for r in extract.json_paths(spark.createDataFrame([('{"a": [{"b": 1}, {"b": 2}]}',), (None,), ("{",)], "v string"), "v").collect()}
    assert paths == {"a": 1, "a[].b": 2}


def test_streaming_equals_batch(spark, raw_of, tmp_path):
    raw = raw_of([[U("a")], [U("x = 1")], None])
    raw.write.parquet(f"{tmp_path}/in")
    stream = ingest.stream_files(spark, f"{tmp_path}/in", raw.schema)
    for _ in range(2):  # the second run finds nothing new
        ingest.annotate_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 3 and got.exceptAll(annotate.annotated(raw)).count() == 0


def test_call_windows_stream(spark, tmp_path):
    calls = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:10:00', 'task', 200), (2, timestamp'2024-01-01 00:20:00', 'task', null), (3, timestamp'2024-01-09 00:00:00', 'lines', 500) AS t(call_id, called_at, call_kind, http_status)")
    calls.write.parquet(f"{tmp_path}/calls")
    batch = {(str(r[0]), r[1], r[2], r[3]) for r in ingest.call_windows(calls).collect()}
    assert ("2024-01-01 00:00:00", "task", 2, 1) in batch
    stream = ingest.call_windows(ingest.first_per_key(ingest.stream_files(spark, f"{tmp_path}/calls", calls.schema), "call_id", "called_at", "30 days"), late=None)
    q = stream.writeStream.format("memory").queryName("windows_of_calls").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
