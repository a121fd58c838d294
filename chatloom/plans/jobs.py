"""The jobs end to end: filter a corpus, annotate it by rules or by a service, and both in a row.

    python -m chatloom.plans.jobs filter --input-dir raw --output-dir kept --report-dir kept/reports --overwrite
    python -m chatloom.plans.jobs annotate --input-dir kept --output-dir annotated
    python -m chatloom.plans.jobs pipeline --input-dir raw --output-dir out
    python -m chatloom.plans.jobs audit --input-dir raw --output-dir tables
"""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import is_blank
from ..operators import annotate, answers, audit
from ..operators import decisions as dec
from ..session import checkpoint_dir
from ..sources import corpus, sinks


def run_filter(
    spark: SparkSession, input_dir: str, output_dir: str, report_dir: str, policy: dec.Policy, rows_per_file: int = 10_000, max_files: int | None = None, max_rows_per_file: int | None = None, overwrite: bool = False
) -> dict:
    """Decides on every record of a corpus, writes the kept ones in shards and the reports; gives the summary."""
    mode = sinks.guard(spark, output_dir, overwrite, reads=input_dir)
    raw = corpus.scan(spark, input_dir, max_rows_per_file, max_files=max_files)
    settings = {"input_dir": input_dir, "output_dir": output_dir} | {k: getattr(policy, k) for k in ("filter_non_english", "filter_multiturn", "single_turn_method", "duplicate_mode", "drop_empty_first_prompt")}
    # the decision table is made once, and read back for whatever needs it
    summary = sinks.write_report(dec.decide(dec.metadata(raw, policy), policy), report_dir, settings)
    decisions = spark.read.parquet(f"{report_dir}/filter_decisions.parquet")
    sinks.write_shards(dec.kept_records(raw, decisions), output_dir, rows_per_file, mode, decisions.where("keep_final"))
    return summary


def run_annotate(
    spark: SparkSession, input_dir: str, output_dir: str, log: str | None = None, nth: int = 0, batch: int = annotate.LINE_BATCH, max_rows: int | None = None, service: Callable[[DataFrame], DataFrame] | None = None, **which
) -> int:
    """Annotates the records of a corpus that the log doesn't hold and appends them; gives how many.

    By rules, or by ``service``, which makes annotated records of records. Only records not yet done are sent to it.
    """
    raw = corpus.scan(spark, input_dir, max_rows, **which)
    done = corpus.done_keys(spark, log or output_dir)
    raw = corpus.pending(raw.withColumn("_pk", dec.row_key(F.col("conversation_id"), F.col("source_file"), F.col("source_row_position"))), done, "_pk").drop("_pk")
    checkpoint_dir(spark)
    fresh = (service or (lambda r: annotate.annotated(r, nth=nth, batch=batch)))(raw)
    fresh = fresh.checkpoint()  # the log that was read is the log that is appended to
    sinks.append_jsonl(fresh, output_dir)
    return fresh.count()


def annotate_by_service(
    records: DataFrame, call: Callable[[str], str], line_template: str, task_template: str, batch: int = annotate.LINE_BATCH, retries: int = 2, pause: float = 1.0, position: str = "source_row_position", nth: int = 0,
    task_call: Callable[[str], str] | None = None, workers: int = 4,
) -> DataFrame:
    """The 19 columns of the annotated record with labels, task and language from a chat-completion service.

    One call per batch of lines, one per record for task and language. Answers that are missing or not valid are
    asked for again, up to ``retries`` times. Answers are checkpointed, so that no later action asks again. A batch without a valid answer falls back to EMPTY and NATURAL_LANGUAGE and is an error of
    its record; blank prompts have no line calls. At most ``workers`` calls run at a time; ``task_call`` is asked for
    task and language where it differs.
    """
    spark = records.sparkSession
    checkpoint_dir(spark)
    asked = annotate.prompts(records, position, nth)
    place = ["source_file", "row_index"]
    lines = annotate.lines(asked.where(~is_blank(F.col("user_prompt_original"))), batch).drop("label")
    batches = lines.groupBy(*place, "batch_no").agg(F.array_sort(F.collect_list(F.struct("line_number", F.col("line_text").alias("text")))).alias("lines"))
    batches = batches.select("*", F.to_json(F.struct(*place, "batch_no")).alias("request_id"), answers.prompt_with_payload(line_template, answers.lines_payload(F.col("lines"))).alias("prompt"))
    got = _answered(batches, call, lambda: answers.line_error(F.col("_v"), F.transform("lines", lambda x: x["line_number"])), retries, pause, workers).drop("prompt")
    got = got.withColumn("given", F.when(F.col("problem").isNull(), answers.line_answer_labels(F.col("answer"))))
    relabelled = F.transform(
        "lines",
        lambda x: F.struct(
            x["line_number"].alias("line_number"), x["text"].alias("line_text"),
            F.coalesce(F.element_at(F.transform(F.filter("given", lambda g: g["line_number"] == x["line_number"]), lambda g: g["label"]), -1), F.when(is_blank(x["text"]), "EMPTY").otherwise("NATURAL_LANGUAGE")).alias("label"),
        ),
    )
    per_batch = got.select(*place, "batch_no", relabelled.alias("l"), "problem")
    per_record = per_batch.groupBy(*place).agg(F.array_sort(F.flatten(F.collect_list("l"))).alias("_l"), F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("batch_no", "problem")))).alias("_e"))
    blank = is_blank(F.col("user_prompt_original"))
    rows = asked.join(per_record, place, "left").withColumn("_l", F.coalesce("_l", F.array().cast("array<struct<line_number:int,line_text:string,label:string>>")))
    code = annotate._joined("CODE")
    rows = rows.withColumns(
        {
            "natural_language_text": annotate._joined("NATURAL_LANGUAGE"), "code_text": code, "contains_code": code != "",
            "code_line_count": F.size(F.filter("_l", lambda x: x["label"] == "CODE")),
            "code_nl_status": F.when(blank, "empty_prompt").when(F.size("_e") > 0, "partial_error").otherwise("ok"),
            "code_nl_error": F.when(F.size("_e") > 0, F.array_join(F.transform("_e", lambda e: e["problem"]), " | ")),
        }
    ).drop("_l", "_e")
    payload = answers.task_payload(F.col("natural_language_text"), F.col("contains_code"), F.col("code_line_count"))
    tasks = rows.select(F.to_json(F.struct(*place)).alias("request_id"), answers.prompt_with_payload(task_template, payload).alias("prompt"))
    told = _answered(tasks, task_call or call, lambda: answers.task_fields(F.col("_v"))["error"], retries, pause, workers)
    told = told.select(F.col("request_id").alias("_r"), answers.task_answer(F.col("answer")).alias("t"), "problem")
    out = rows.join(told, F.to_json(F.struct(*place)) == F.col("_r"), "left")
    out = out.select(*rows.columns, "t.*", "problem").withColumns({"task_lang_status": F.when(F.col("problem").isNull(), "ok").otherwise("error")})
    errors = F.nullif(F.concat_ws(" | ", F.when(F.col("code_nl_status") == "partial_error", F.concat(F.lit("code_nl: "), "code_nl_error")), F.when(F.col("problem").isNotNull(), F.concat(F.lit("task_lang: "), "problem"))), F.lit(""))
    status = F.when(F.col("code_nl_status") == "empty_prompt", "empty_prompt").when(errors.isNotNull(), "partial_error").otherwise("ok")
    return out.withColumns({"overall_status": status, "overall_error": errors}).select(*annotate.RECORD)


def _answered(requests: DataFrame, call: Callable[[str], str], problem: Callable[[], Column], retries: int, pause: float, workers: int) -> DataFrame:
    """``requests`` with their answer, cut off from the calls, and what is wrong with it (problem).

    A request is asked in rounds until its answer is valid by ``problem``, of the parsed answer (_v), or ``retries`` + 1 calls were made; of the
    invalid answers the last one counts.
    """
    requests = requests.checkpoint()
    left, done = requests, []
    per_task = min(4, workers)
    for attempt in range(retries + 1):
        # as many tasks as keep the number of calls at a time in bounds, however many cores there are
        got = answers.ask(left.repartition(max(1, workers // per_task)), call, retries=0, calls_per_task=per_task).checkpoint().withColumnRenamed("request_id", "_id").drop("attempts")
        both = left.join(got, F.col("request_id") == F.col("_id")).drop("_id")
        both = both.withColumn("_v", answers.json_object(F.col("answer"))).withColumn("problem", F.coalesce("error", problem())).drop("_v").checkpoint()
        again = both.where(F.col("problem").isNotNull()).select(*requests.columns)
        if attempt == retries or again.isEmpty():
            return reduce(DataFrame.unionByName, [*done, both])
        done.append(both.where(F.col("problem").isNull()))
        left = again
        time.sleep(pause)
    raise ValueError("retries must not be negative")


def _step(name: str, run: Callable[[], object]) -> object:
    """Run a step of a job, telling its begin and end; a failure names the step."""
    print(f"[{name}] started")
    start = time.perf_counter()
    try:
        out = run()
    except Exception as e:
        raise RuntimeError(f"Step failed: {name}: {e}") from e
    print(f"[{name}] done in {time.perf_counter() - start:.1f} s")
    return out


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("filter", "annotate", "pipeline", "audit"):
        q, both = sub.add_parser(name), name == "pipeline"
        q.add_argument("--input-dir", required=True)
        q.add_argument("--output-dir", required=True)
        q.add_argument("--max-files", type=int)
        if name in ("filter", "pipeline"):
            q.add_argument("--report-dir")
            q.add_argument("--filter-non-english", action="store_true", default=both)
            q.add_argument("--english-labels", default="english,en,eng")
            q.add_argument("--filter-multiturn", action="store_true", default=both)
            q.add_argument("--single-turn-method", choices=dec.METHODS, default="turn_column")
            q.add_argument("--duplicate-mode", choices=dec.MODES, default="drop_all")
            q.add_argument("--drop-empty-first-prompt", action="store_true", default=both)
            q.add_argument("--rows-per-output-file", type=int, default=10_000)
            q.add_argument("--max-rows-per-file", type=int)
            q.add_argument("--overwrite", action="store_true")
        if name in ("annotate", "pipeline"):
            q.add_argument("--max-rows", type=int)
            q.add_argument("--user-message-index", type=int, default=0)
            q.add_argument("--line-batch-size", type=int, default=annotate.LINE_BATCH)
            q.add_argument("--api-base", help="a chat-completion service; rules are used without it")
            q.add_argument("--api-key", help="else the environment's OPENAI_API_KEY")
            q.add_argument("--model", default="rules")
            q.add_argument("--code-nl-prompt-path")
            q.add_argument("--task-lang-prompt-path")
            q.add_argument("--workers", type=int, default=4 if both else 1)
            q.add_argument("--retries", type=int, default=2)
            q.add_argument("--max-tokens-code-nl", type=int, default=4096 if both else 2048)
            q.add_argument("--max-tokens-task-lang", type=int, default=4096 if both else 2048)
            q.add_argument("--timeout", type=int, default=300 if both else 180)
        if name == "annotate":
            q.add_argument("--file")
            q.add_argument("--start-file")
            q.add_argument("--end-file")
        if both:
            q.add_argument("--skip-filtering", action="store_true", help="use the filtered folder as it is")
    return p


def _service(a: argparse.Namespace) -> Callable[[DataFrame], DataFrame] | None:
    if not a.api_base:
        return None
    key = a.api_key or os.environ.get("OPENAI_API_KEY")
    lines, tasks = (answers.http_chat(a.api_base, a.model, key, n, a.timeout) for n in (a.max_tokens_code_nl, a.max_tokens_task_lang))
    templates = [Path(t).read_text(encoding="utf-8").strip() if t else "" for t in (a.code_nl_prompt_path, a.task_lang_prompt_path)]
    return lambda rows: annotate_by_service(rows, lines, *templates, a.line_batch_size, a.retries, nth=a.user_message_index, task_call=tasks, workers=a.workers)


def main(argv: list[str] | None = None) -> None:
    a = _arguments().parse_args(argv)
    spark = SparkSession.builder.appName(f"chatloom {a.job}").getOrCreate()
    kept = f"{a.output_dir}/filtered" if a.job == "pipeline" else a.output_dir
    if a.job in ("filter", "pipeline") and not getattr(a, "skip_filtering", False):
        policy = dec.Policy(a.filter_non_english, dec.english_labels(a.english_labels), a.filter_multiturn, a.single_turn_method, a.drop_empty_first_prompt, a.duplicate_mode)
        _step("filter", lambda: run_filter(spark, a.input_dir, kept, a.report_dir or f"{kept}/reports", policy, a.rows_per_output_file, a.max_files, a.max_rows_per_file, a.overwrite))
    if a.job == "annotate":
        which = {"file": a.file, "start": a.start_file, "end": a.end_file, "max_files": a.max_files}
        _step("annotate", lambda: run_annotate(spark, a.input_dir, a.output_dir, None, a.user_message_index, a.line_batch_size, a.max_rows, _service(a), **which))
    elif a.job == "pipeline":
        _step("annotate", lambda: run_annotate(spark, kept, f"{a.output_dir}/annotated", None, a.user_message_index, a.line_batch_size, a.max_rows, _service(a)))
    elif a.job == "audit":
        _step("audit", lambda: audit.write_tables(corpus.scan(spark, a.input_dir, max_files=a.max_files), a.output_dir))


if __name__ == "__main__":
    main()
