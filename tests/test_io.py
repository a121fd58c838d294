"""Sources, sinks, answers of a service and the jobs end to end."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from chatloom.operators import answers, annotate
from chatloom.operators import decisions as dec
from chatloom.plans import jobs
from chatloom.sources import corpus, sinks


@pytest.fixture()
def folder(spark, raw_of, tmp_path):
    raw = raw_of([[("user", f"prompt {i}", "English"), ("assistant", "x", "en")] for i in range(12)]).select("conversation_id", "model", "conversation", "turn", "snippet_turns")
    for name, part in (("b", raw.limit(5)), ("a", raw.limit(12).offset(5))):
        part.coalesce(1).write.parquet(f"{tmp_path}/tmp_{name}")
        (tmp_path / "raw").mkdir(exist_ok=True)
        next((tmp_path / f"tmp_{name}").glob("*.parquet")).rename(tmp_path / f"raw/{name}.parquet")
    spark.createDataFrame([(1,)], "other int").write.parquet(f"{tmp_path}/raw/reports")
    return tmp_path


def test_scan(spark, folder):
    df = corpus.scan(spark, f"{folder}/raw")
    assert df.count() == 12
    first = corpus.scan(spark, f"{folder}/raw", max_files=1)
    assert {r[0] for r in first.select("source_file").collect()} == {"a.parquet"}
    assert corpus.scan(spark, f"{folder}/raw", 2).count() == 4
    assert corpus.scan(spark, f"{folder}/raw", file="b.parquet").count() == 5
    assert corpus.scan(spark, f"{folder}/raw", start="b.parquet").count() == 5
    for wrong in ({"file": "c.parquet"}, {"start": "x"}):
        with pytest.raises(FileNotFoundError):
            corpus.scan(spark, f"{folder}/raw", **wrong)
    with pytest.raises(FileNotFoundError):
        corpus.scan(spark, f"{folder}/nothing")


def test_canonical_columns(spark):
    m = {"role": "user", "content": "a", "language": "en"}
    df = spark.createDataFrame([("1", json.dumps([[m]]), 1), (" 2 ", json.dumps([m]), None), ("x", json.dumps(m), 3), (None, "text", 1)], "turn string, conversation string, snippet_turn int")
    rows = corpus.canonical(df).collect()
    assert [r["turn"] for r in rows] == [1, 2, None, None]
    assert [r["conversation"] is not None for r in rows] == [True, True, True, False]
    assert [r["snippet_turns"] for r in rows] == [[1], [], [3], [1]]
    assert rows[0]["model"] is None


def test_union_and_resume(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y",)], "s string")
    assert sorted(map(str, corpus.union([a, b]).collect())) == ["Row(i=1, s='x')", "Row(i=None, s='y')"]
    assert corpus.done_keys(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "log.jsonl").write_text('{"processing_key": "a"}\n\n{"processing_key": ""}\n{"processing_key": null}\n[1]\n{"processing_key": "b", "x"\n{"processing_key": "c"}\n')
    done = corpus.done_keys(spark, f"{tmp_path}/log.jsonl")
    assert sorted(r[0] for r in done.collect()) == ["a", "c"]
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "processing_key string")
    assert sorted(str(r[0]) for r in corpus.pending(rows, done).collect()) == ["None", "b", "b"]


def test_guard_and_shards(spark, folder):
    assert sinks.guard(spark, f"{folder}/new", False) == "append"
    with pytest.raises(FileExistsError):
        sinks.guard(spark, f"{folder}/raw", False)
    with pytest.raises(ValueError):
        sinks.guard(spark, f"{folder}/raw/", True, reads=f"{folder}/raw")
    df = corpus.scan(spark, f"{folder}/raw")
    assert sinks.write_shards(df, f"{folder}/shards", 5)
    written = corpus.files(spark, f"{folder}/shards")
    assert [p.rpartition("/")[2] for p in written] == ["part_000.parquet", "part_001.parquet", "part_002.parquet"]
    assert [spark.read.parquet(p).count() for p in written] == [5, 5, 2]
    again = corpus.scan(spark, f"{folder}/shards").orderBy("source_file", "source_row_position").select("conversation_id").collect()
    assert again == df.orderBy("source_file", "source_row_position").select("conversation_id").collect()
    assert sinks.write_shards(df.limit(3), f"{folder}/shards", 5) and [p.rpartition("/")[2] for p in corpus.files(spark, f"{folder}/shards")] == ["part_000.parquet"]
    assert not sinks.write_shards(df.limit(0), f"{folder}/none", 5)
    assert not (folder / "none").exists()


def test_csv_and_exports(spark, folder):
    df = corpus.scan(spark, f"{folder}/raw")
    sinks.write_csv(df, f"{folder}/csv")
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 12
    sinks.write_exports(df, f"{folder}/exports")
    assert spark.read.json(f"{folder}/exports/jsonl").count() == 12


def test_filter_job_and_resume(spark, folder):
    summary = jobs.run_filter(spark, f"{folder}/raw", f"{folder}/kept", f"{folder}/kept/reports", dec.Policy(), rows_per_file=4)
    assert summary["total_records"] == 12 and summary["kept_records"] == 12 and summary["removal_reason_counts"] == {"KEPT": 12}
    assert json.loads((folder / "kept/reports/filter_summary.json").read_text())["total_records"] == 12
    with pytest.raises(FileExistsError):
        jobs.run_filter(spark, f"{folder}/raw", f"{folder}/kept", f"{folder}/r", dec.Policy())
    assert jobs.run_annotate(spark, f"{folder}/kept", f"{folder}/log") == 12
    assert jobs.run_annotate(spark, f"{folder}/kept", f"{folder}/log") == 0
    line = next((folder / "log").rglob("*.json")).read_text().splitlines()[0]
    assert set(annotate.RECORD) <= set(json.loads(line))


def problem(spark, text, expected=(1, 2)):
    df = spark.createDataFrame([(text,)], "a string")
    return df.select(answers.line_answer_error(F.col("a"), F.array(*[F.lit(n) for n in expected]))).first()[0]


def test_line_answers(spark):
    good = {"lines": [{"line_number": 1, "label": "code"}, {"line_number": 2, "label": " EMPTY "}, {"line_number": 2, "label": "CODE"}]}
    assert problem(spark, json.dumps(good)) is None
    assert problem(spark, f"```json\n{json.dumps(good)}\n```") is None
    assert problem(spark, f"Sure: {json.dumps(good)} done") is None
    assert problem(spark, "none") == "No JSON object" == problem(spark, "[1]") == problem(spark, None)
    assert problem(spark, "{}") == "Missing field: lines"
    assert problem(spark, '{"lines": 3}') == "Field 'lines' must be a list."
    assert problem(spark, '{"lines": [{"line_number": 1}]}') == "Each line classification needs line_number and label."
    assert problem(spark, '{"lines": [{"line_number": 9, "label": "CODE"}]}') == "Unexpected line_number: 9"
    assert problem(spark, '{"lines": [{"line_number": 1, "label": "X"}]}') == "Invalid line label: X"
    assert problem(spark, '{"lines": [{"line_number": 2, "label": "CODE"}]}', (1, 2, 3)) == "Missing classifications for lines: [1, 3]"


TASK = {"task_category": "bug_fixing", "task_confidence": "high", "is_code_generation": "True", "code_generation_confidence": "LOW", "detected_language": "en", "language_confidence": "medium", "short_reason": " r "}


def test_task_answers(spark):
    def read(**change):
        answer = {k: v for k, v in (TASK | change).items() if v != "gone"}
        return spark.createDataFrame([(json.dumps(answer),)], "a string").select(answers.task_answer(F.col("a")).alias("t")).first()["t"]

    ok = read()
    assert (ok["error"], ok["task_category"], ok["is_code_generation"], ok["detected_language"], ok["short_reason"]) == (None, "BUG_FIXING", True, "EN", "r")
    assert read(is_code_generation=False)["is_code_generation"] is False
    assert read(detected_language="mixed")["detected_language"] == "MIXED"
    assert read(short_reason="gone", task_category="gone")["error"] == "Missing fields: ['short_reason', 'task_category']"
    assert read(task_category="x")["error"] == "Invalid task_category: X"
    assert read(task_confidence="x")["error"] == "Invalid task_confidence: X"
    assert read(detected_language="eng")["error"] == "Invalid detected_language: ENG"
    assert read(is_code_generation="maybe")["error"] == "Invalid is_code_generation value: maybe"


class Service(BaseHTTPRequestHandler):
    def do_POST(self):  # noqa: N802
        prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
        if "boom" in prompt:
            self.send_error(500)
            return
        payload = json.loads(prompt.partition("<<<")[2].rpartition(">>>")[0])
        if "lines" in payload:
            content = json.dumps({"lines": [{"line_number": x["line_number"], "label": "CODE" if "=" in x["text"] else "NATURAL_LANGUAGE"} for x in payload["lines"]]})
        else:
            content = "" if "silent" in prompt else "```json\n" + json.dumps(TASK) + "\n```"
        body = json.dumps({"choices": [{"message": {"content": content}, "finish_reason": "stop"}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_annotation_by_service(spark, raw_of):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = answers.http_chat(f"http://127.0.0.1:{server.server_port}/v1", "m", "key", timeout=10)
    raw = raw_of([[("user", "fix\nx = 1", "en")], [("user", " ", "en")], [("user", "boom", "en")], [("user", "silent", "en")]])
    rows = {r["row_index"]: r for r in jobs.annotate_by_service(raw, call, "label the lines", "name the task", retries=1, pause=0.0).collect()}
    server.shutdown()
    assert (rows[0]["overall_status"], rows[0]["code_text"], rows[0]["task_category"]) == ("ok", "x = 1", "BUG_FIXING")
    assert rows[1]["overall_status"] == "empty_prompt"
    assert rows[2]["overall_status"] == "partial_error" and rows[2]["natural_language_text"] == "boom" and rows[2]["task_category"] is None
    assert rows[3]["task_lang_status"] == "error" and "Empty content" in rows[3]["overall_error"]


def test_invalid_answers_are_asked_again(spark, raw_of, tmp_path):
    good = {"lines": [{"line_number": n, "label": x} for n, x in ((1, "NATURAL_LANGUAGE"), (2, "CODE"))]}
    bad = ['{"lines": [{"line_number": 1', json.dumps({"lines": good["lines"][:1]}), json.dumps({"lines": [{"line_number": 9, "label": "X"}]})]
    replies = {"lines": [*bad, json.dumps(good)], "task": ["{}", json.dumps(TASK | {"task_category": "X"}), json.dumps(TASK)]}

    def call(prompt):
        kind = "lines" if prompt.startswith("label") else "task"
        n = len(list(tmp_path.glob(f"{kind}*")))
        (tmp_path / f"{kind}{n}").touch()
        return replies[kind][min(n, len(replies[kind]) - 1)]

    raw = raw_of([[("user", "fix\nx = 1", "en")]])
    row = jobs.annotate_by_service(raw, call, "label the lines", "name the task", retries=3, pause=0.0).first()
    assert (row["overall_status"], row["code_text"], row["task_category"]) == ("ok", "x = 1", "BUG_FIXING")
    assert len(list(tmp_path.glob("lines*"))) == 4 and len(list(tmp_path.glob("task*"))) == 3


def test_paths_of_long_and_deep_payloads(spark):
    from chatloom.operators import extract

    payload = json.dumps({"turns": [{"text": "x"}] * 30, "a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1}}}}}}}})
    got = {r["key_path"]: r["n_values"] for r in extract.json_paths(spark.createDataFrame([(payload,)], "payload string"), "payload").collect()}
    assert got["turns[].text"] == 30 and got["a.b.c.d.e.f.g.h"] == 1


def test_retries(spark):
    calls = spark.createDataFrame([(1, "a")], "request_id int, prompt string")

    def failing(prompt):
        raise RuntimeError("no")

    row = answers.ask(calls, failing, retries=2, pause=0.0).first()
    assert (row["answer"], row["attempts"], row["error"]) == (None, 3, "no")


def test_stub_service_equals_the_rules(spark, folder):
    from chatloom.plans import stub_service

    server = stub_service.server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v1"
    call = answers.http_chat(base, "m", timeout=10)
    texts = ["fix it\nx = 1\n\nopen main.py", "def f():\n} >>>", "hello", "你好", "please help\n$ ls", " "]
    rows = [(f"c{i}", "a", i, [[("user", t, "en")]]) for i, t in enumerate(texts)]
    raw = spark.createDataFrame(rows, "conversation_id string, source_file string, source_row_position long, conversation array<array<struct<role:string,content:string,language:string>>>")
    columns = [c for c in annotate.RECORD if c != "overall_error"]
    by_service = jobs.annotate_by_service(raw, call, "label each line_number and text", "name the task", retries=0, pause=0.0).select(*columns)
    by_rules = annotate.annotated(raw).select(*columns)
    # a text that ends the payload too early also ends that of its task, which is then told from the whole prompt
    whole = "natural_language_text not like '%>>>%'"
    assert by_service.where(whole).exceptAll(by_rules).count() == by_rules.where(whole).exceptAll(by_service).count() == 0
    assert by_service.where(f"not ({whole})").first()["code_nl_status"] == "partial_error"
    (folder / "t.txt").write_text(" template \n")
    main = ["annotate", "--input-dir", f"{folder}/raw", "--output-dir", f"{folder}/served", "--api-base", base, "--code-nl-prompt-path", f"{folder}/t.txt"]
    for _ in range(2):
        jobs.main(main)
    assert spark.read.json(f"{folder}/served").count() == 12
    server.shutdown()


def test_stub_service_refuses(spark):
    import urllib.error
    import urllib.request

    from chatloom.plans import stub_service

    server = stub_service.server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert b"rules" in urllib.request.urlopen(f"{base}/v1/models").read()
    for url, data, status in ((f"{base}/x", None, 404), (f"{base}/x", b"{}", 404), (f"{base}/v1/chat/completions", b"{", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(url, data)
        assert e.value.code == status
    server.shutdown()


def test_all_labels_are_in_the_summary(spark, raw_of, tmp_path):
    raw = raw_of([[("user", f"prompt {i}", f"tongue{i}")] for i in range(10_001)])
    sinks.write_report(dec.decide(dec.metadata(raw)), f"{tmp_path}/r", {"input_dir": "x"})
    told = json.loads((tmp_path / "r/filter_summary.json").read_text())
    assert len(told["language_label_counts"]) == 10_001 and told["input_dir"] == "x" and told["total_records"] == 10_001


def test_a_cluster_needs_a_shared_checkpoint_folder(spark):
    from types import SimpleNamespace

    from chatloom.session import checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda d: None)
    unset = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        checkpoint_dir(unset)
    told = []
    named = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: told[-1] if told else None, master="spark://host:7077", setCheckpointDir=told.append), conf=SimpleNamespace(get=lambda k, d=None: "/shared"))
    assert checkpoint_dir(named) == "/shared" == told[0]
    assert checkpoint_dir(spark)


def test_items_are_checked_in_order(spark):
    items = [{"line_number": 9, "label": "CODE"}, {"line_number": 1, "label": "X"}]
    assert problem(spark, json.dumps({"lines": items})) == "Unexpected line_number: 9"
    assert problem(spark, json.dumps({"lines": items[::-1]})) == "Invalid line label: X"
    assert problem(spark, json.dumps({"lines": [3, *items]})) == "Each line classification must be an object."
    assert problem(spark, json.dumps({"lines": [{"line_number": "x", "label": "CODE"}]})) == "invalid literal for int() with base 10: 'x'"
    assert problem(spark, json.dumps({"lines": [{"line_number": None, "label": "CODE"}]})).startswith("int() argument must be")
    assert problem(spark, json.dumps({"other": {"lines": []}})) == "Missing field: lines"
    assert problem(spark, json.dumps({"lines": [{"line_number": "1", "label": "code"}, {"line_number": 2, "label": "EMPTY"}]})) is None


def test_payloads_are_those_of_the_json_module(spark):
    texts = ['say "hi"\t\\ {x} é 😀', "", "plain"]
    df = spark.createDataFrame([([(i + 1, t) for i, t in enumerate(texts)], texts[0], True, 2)], "l array<struct<line_number:int,text:string>>, t string, c boolean, n int")
    row = df.select(answers.lines_payload(F.col("l")).alias("a"), answers.task_payload(F.col("t"), F.col("c"), F.col("n")).alias("b"), answers.lines_payload(F.slice("l", 1, 0)).alias("e")).first()
    assert row["a"] == json.dumps({"lines": [{"line_number": i + 1, "text": t} for i, t in enumerate(texts)]}, ensure_ascii=False, indent=2)
    assert row["b"] == json.dumps({"natural_language_text": texts[0], "metadata": {"original_prompt_contained_code": True, "code_line_count": 2}}, ensure_ascii=False, indent=2)
    assert row["e"] == json.dumps({"lines": []}, indent=2)


def test_pipeline_with_a_service(spark, folder):
    from chatloom.plans import stub_service

    server = stub_service.server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v1"
    run = ["pipeline", "--input-dir", f"{folder}/raw", "--output-dir", f"{folder}/out", "--rows-per-output-file", "5", "--api-base", base, "--retries", "0", "--max-tokens-task-lang", "64"]
    jobs.main(run)
    kept = corpus.scan(spark, f"{folder}/out/filtered")
    columns = [c for c in annotate.RECORD if c not in ("overall_error", "row_index")]
    served = spark.read.json(f"{folder}/out/annotated").select(*columns)
    ruled = annotate.annotated(kept).select(*columns)
    assert served.count() == 12 and served.exceptAll(ruled).count() == ruled.exceptAll(served).count() == 0
    jobs.main([*run, "--skip-filtering"])
    assert spark.read.json(f"{folder}/out/annotated").count() == 12
    with pytest.raises(RuntimeError, match="Step failed: filter"):
        jobs.main(run)
    server.shutdown()


def test_calls_are_bounded(spark, raw_of, tmp_path):
    import os
    import time

    def call(prompt):
        mine = tmp_path / f"run-{os.getpid()}-{threading.get_ident()}-{time.monotonic_ns()}"
        mine.touch()
        (tmp_path / f"seen-{len(list(tmp_path.glob('run-*')))}").touch()
        time.sleep(0.02)
        mine.unlink()
        return json.dumps({"lines": [{"line_number": 1, "label": "CODE"}]} if prompt.startswith("label") else TASK)

    raw = raw_of([[("user", f"prompt {i}", "en")] for i in range(40)])
    assert jobs.annotate_by_service(raw, call, "label", "task", retries=0, workers=2).count() == 40
    assert max(int(p.name.removeprefix("seen-")) for p in tmp_path.glob("seen-*")) <= 2


def test_audit_tables(spark, folder):
    jobs.main(["audit", "--input-dir", f"{folder}/raw", "--output-dir", f"{folder}/audit"])
    names = {p.name for p in (folder / "audit").glob("*.csv")}
    assert len(names) == 16
    steps = {r["step"]: r["n_after"] for r in spark.read.option("header", True).csv(f"{folder}/audit/filtering_steps_summary.csv").collect()}
    assert steps["single_turn"] == "12"
    chart = (folder / "audit/figures/filtering_funnel.svg").read_text()
    assert chart.startswith("<svg") and "single_turn" in chart


def test_arrow_and_single_files(spark, folder):
    import pyarrow as pa

    df = corpus.scan(spark, f"{folder}/raw").select("conversation_id", "turn")
    sinks.write_arrow(df, f"{folder}/arrow")
    tables = [pa.ipc.open_file(p).read_all() for p in (folder / "arrow").glob("*.arrow")]
    assert sum(t.num_rows for t in tables) == 12
    sinks.write_one_parquet(df, f"{folder}/one.parquet")
    assert (folder / "one.parquet").is_file() and spark.read.parquet(f"{folder}/one.parquet").count() == 12


def test_detector(spark):
    from chatloom.functions.language import detect

    texts = ["The loop is not the reason for that", "Der Fehler ist nicht in der Schleife und wird", "El problema es que la función no está", "Le problème est dans la boucle et pas", "Il problema è che non sono nel", "O erro não está no laço mas também", "zzz qqq", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(detect(F.col("t"))).collect()] == ["en", "de", "es", "fr", "it", "pt", "detection_error", "detection_error"]


def test_lenient_messages(spark):
    from chatloom.operators import extract

    given = [{"from": "Human ", "text": " a "}, [{"role": None, "author": "x", "value": "b"}, {"role": "", "sender": "Bot", "message": 3, "extra": "c"}], "plain", 7, None, [[]]]
    rows = spark.createDataFrame([(json.dumps(given),), (json.dumps(json.dumps(given[:1])),), ("no json",), (None,)], "c string").select(extract.normalize_lenient("c").alias("m")).collect()
    assert [tuple(m) for m in rows[0]["m"]] == [("human", "a"), ("none", "b"), ("bot", "Botc"), ("", "plain"), ("", "7")]
    assert [tuple(m) for m in rows[1]["m"]] == [("human", "a")] and [tuple(m) for m in rows[2]["m"]] == [("", "no json")] and rows[3]["m"] == []
