"""Answers of a model: tolerant JSON, validation, and the calls that bring them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import py_strip
from .annotate import TASKS

LINE_LABELS = ("NATURAL_LANGUAGE", "CODE", "EMPTY")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
TASK_FIELDS = ("code_generation_confidence", "detected_language", "is_code_generation", "language_confidence", "short_reason", "task_category", "task_confidence")


def json_object(text: Column) -> Column:
    """The JSON object of an answer as a variant: without a Markdown fence, else from the first brace to the last.

    Null for null, for text without a readable object, and for JSON that is no object.
    """
    bare = py_strip(F.regexp_replace(F.regexp_replace(py_strip(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    block = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    whole, part = F.try_parse_json(bare), F.try_parse_json(F.when(block != "", block))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(is_object(part), part)


def field(v: Column, name: str) -> Column:
    """A field of an answer as text: null where it is missing or null."""
    return F.try_variant_get(v, f"$.{name}", "string")


def has_field(v: Column, name: str) -> Column:
    """Whether an answer is an object that has the field itself, be it null."""
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & F.try_variant_get(v, f"$.{name}", "variant").isNotNull()


def line_answer_error(answer: Column, expected: Column) -> Column:
    """``line_error`` of an answer as text; parse it into a column of its own first where there are many."""
    return line_error(json_object(answer), expected)


def line_error(v: Column, expected: Column) -> Column:
    """What is wrong with an object that labels lines, null for a valid one; ``expected``: array of line numbers.

    Items are checked one by one, and the first fault counts. Labels count in any case and padding; a line may be
    labelled twice, none may be left out or unknown. Fixed values: the texts of the faults.
    """
    items = F.try_variant_get(v, "$.lines", "array<variant>")

    def fault(x: Column) -> Column:
        told, number = F.try_variant_get(x, "$.line_number", "string"), F.try_variant_get(x, "$.line_number", "int")
        label = F.upper(py_strip(F.coalesce(F.try_variant_get(x, "$.label", "string"), F.lit("None"))))
        return (
            F.when(~F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)), "Each line classification must be an object.")
            .when(~has_field(x, "line_number") | ~has_field(x, "label"), "Each line classification needs line_number and label.")
            .when(told.isNull(), "int() argument must be a string, a bytes-like object or a real number, not 'NoneType'")
            .when(number.isNull(), F.concat(F.lit("invalid literal for int() with base 10: '"), told, F.lit("'")))
            .when(~F.array_contains(expected, number), F.concat(F.lit("Unexpected line_number: "), number.cast("string")))
            .when(~label.isin(*LINE_LABELS), F.concat(F.lit("Invalid line label: "), label))
        )

    first = F.get(F.filter(F.transform(items, fault), lambda x: x.isNotNull()), F.lit(0))
    missing = F.array_except(expected, F.transform(items, lambda x: F.try_variant_get(x, "$.line_number", "int")))
    return (
        F.when(v.isNull(), "No JSON object")
        .when(~has_field(v, "lines"), "Missing field: lines")
        .when(items.isNull(), "Field 'lines' must be a list.")
        .when(first.isNotNull(), first)
        .when(F.size(missing) > 0, F.concat(F.lit("Missing classifications for lines: ["), F.array_join(F.array_sort(missing).cast("array<string>"), ", "), F.lit("]")))
    )


def line_answer_labels(answer: Column) -> Column:
    """``line_labels`` of an answer as text."""
    return line_labels(json_object(answer))


def line_labels(v: Column) -> Column:
    """Array of (line_number, label) of a valid object; of a line labelled twice the last counts in labels_by_line."""
    return F.transform(
        F.try_variant_get(v, "$.lines", "array<variant>"),
        lambda x: F.struct(F.try_variant_get(x, "$.line_number", "int").alias("line_number"), F.upper(py_strip(F.try_variant_get(x, "$.label", "string"))).alias("label")),
    )


def task_answer(answer: Column) -> Column:
    """``task_fields`` of an answer as text."""
    return task_fields(json_object(answer))


def task_fields(v: Column) -> Column:
    """Struct of the seven fields of a task answer, upper-cased and stripped, and what is wrong with it (error). The texts of the faults."""
    up = {f: F.upper(py_strip(F.coalesce(field(v, f), F.lit("None")))) for f in TASK_FIELDS}
    flag = F.lower(F.coalesce(field(v, "is_code_generation"), F.lit("None")))
    lacking = F.filter(F.array(*[F.when(~has_field(v, f), F.lit(f)) for f in TASK_FIELDS]), lambda x: x.isNotNull())
    error = (
        F.when(v.isNull(), "No JSON object")
        .when(F.size(lacking) > 0, F.concat(F.lit("Missing fields: ['"), F.array_join(lacking, "', '"), F.lit("']")))
        .when(~up["task_category"].isin(*TASKS), F.concat(F.lit("Invalid task_category: "), up["task_category"]))
        .when(~up["task_confidence"].isin(*CONFIDENCES), F.concat(F.lit("Invalid task_confidence: "), up["task_confidence"]))
        .when(~up["code_generation_confidence"].isin(*CONFIDENCES), F.concat(F.lit("Invalid code_generation_confidence: "), up["code_generation_confidence"]))
        .when(~up["language_confidence"].isin(*CONFIDENCES), F.concat(F.lit("Invalid language_confidence: "), up["language_confidence"]))
        .when(~is_language_code(up["detected_language"]), F.concat(F.lit("Invalid detected_language: "), up["detected_language"]))
        .when(~flag.isin("true", "false"), F.concat(F.lit("Invalid is_code_generation value: "), F.coalesce(field(v, "is_code_generation"), F.lit("None"))))
    )
    good = error.isNull()
    return F.struct(
        *[F.when(good, up[f]).alias(f) for f in ("task_category", "task_confidence", "code_generation_confidence", "detected_language", "language_confidence")],
        F.when(good, flag == "true").alias("is_code_generation"),
        F.when(good, py_strip(F.coalesce(field(v, "short_reason"), F.lit("None")))).alias("short_reason"),
        error.alias("error"),
    )


def is_language_code(code: Column) -> Column:
    """UNKNOWN, MIXED or two capital letters, and nothing else."""
    return code.isin("UNKNOWN", "MIXED") | code.rlike(r"\A[A-Z]{2}\z")


def prompt_with_payload(template: str, payload: Column) -> Column:
    """A template followed by a payload between triple angle brackets."""
    return F.concat(F.lit(template + "\n<<<\n"), payload, F.lit("\n>>>"))


def _json_text(c: Column) -> Column:
    # the text as JSON writes it, quotes included; a null one is null
    one = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("t")))
    return one.substr(F.lit(6), F.length(one) - 6)


def lines_payload(lines: Column) -> Column:
    """Lines (line_number, text) as indented JSON, two blanks a level."""
    items = F.transform(lines, lambda x: F.concat(F.lit('    {\n      "line_number": '), x["line_number"].cast("string"), F.lit(',\n      "text": '), _json_text(x["text"]), F.lit("\n    }")))
    return F.when(F.size(lines) > 0, F.concat(F.lit('{\n  "lines": [\n'), F.array_join(items, ",\n"), F.lit("\n  ]\n}"))).otherwise('{\n  "lines": []\n}')


def task_payload(text: Column, contains_code: Column, code_lines: Column) -> Column:
    """The prose of a prompt and what is told of its code, as indented JSON."""
    return F.concat(
        F.lit('{\n  "natural_language_text": '), _json_text(text), F.lit(',\n  "metadata": {\n    "original_prompt_contained_code": '), F.coalesce(contains_code, F.lit(False)).cast("string"),
        F.lit(',\n    "code_line_count": '), F.coalesce(code_lines, F.lit(0)).cast("string"), F.lit("\n  }\n}"),
    )


def http_chat(api_base: str, model: str, api_key: str | None = None, max_tokens: int = 2048, timeout: int = 180) -> Callable[[str], str]:
    """A function that sends one prompt to a chat-completion service and gives the content of its answer.

    A status of 400 or more raises, and so does a blank content, with the reason the service gives for its end.
    """

    def call(prompt: str) -> str:
        import json
        import urllib.request

        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": 0.0, "max_tokens": max_tokens, "stream": False}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        request = urllib.request.Request(api_base.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            choice = json.loads(answer.read())["choices"][0]
        content = (choice.get("message") or {}).get("content") or ""
        if not content.strip():
            thought = str((choice.get("message") or {}).get("reasoning_content") or "")[:800]
            raise ValueError(f"Empty content (finish_reason={choice.get('finish_reason')}, reasoning={thought!r})")
        return content

    return call


def ask(rows: DataFrame, call: Callable[[str], str], key: str = "request_id", prompt: str = "prompt", retries: int = 2, pause: float = 1.0, calls_per_task: int = 4) -> DataFrame:
    """(request_id, answer, attempts, error): each prompt's answer, tried ``retries`` + 1 times.

    A few calls run at a time in each task; how many run in all is set by the number of partitions of ``rows``.
    A call that fails every time has a null answer and the last error; it never fails the task. Calls have side
    effects: write or checkpoint the result before it is used twice.
    """

    def one(text: str) -> tuple[str | None, int, str | None]:
        error = None
        for attempt in range(retries + 1):
            try:
                return call(text), attempt + 1, None
            except Exception as e:  # noqa: BLE001
                error = str(e)
                if attempt < retries:
                    time.sleep(pause)
        return None, retries + 1, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(calls_per_task) as pool:
            for b in batches:
                got = list(pool.map(one, b[prompt]))
                yield pd.DataFrame({key: b[key], "answer": [g[0] for g in got], "attempts": [g[1] for g in got], "error": [g[2] for g in got]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, attempts int, error string")
