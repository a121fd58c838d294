"""Queries that write and read again, check answers and payloads, and detect languages; with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import WORDS, detect
from ..functions.pytext import split_lines, word_count
from ..operators import annotate, answers, audit, extract, funnel, profile
from ..operators import decisions as dec
from ..operators.messages import first_user_prompt, flat, messages
from ..session import checkpoint_dir
from ..sources import corpus, sinks
from ..sources.tables import table
from . import catalog as c

PLACE, SHARD = c.PLACE, 10


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, for queries that write and read again."""
    return f"{checkpoint_dir(spark)}/written-{uuid4().hex}"


def _written(**which):
    """The kept records, written as shards and scanned again: their new places."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        folder = _folder(spark)
        sinks.write_shards(dec.filtered(table(spark, d, "raw_corpus")), folder, SHARD)
        return corpus.scan(spark, folder, **which).select(*PLACE, "conversation_id", "model", "prompt_hash", F.size(flat(F.col("conversation"))).alias("n_messages"))

    return run


def _report(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_report(c._decided(table(spark, d, "raw_corpus")), folder, {"input_dir": d})
    return spark.read.option("multiLine", True).json(f"{folder}/filter_summary.json").select("total_records", "kept_records", "removed_records", "removal_reason_counts.KEPT", "removal_reason_counts.NON_ENGLISH", "single_turn_counts.true")


def _label_report(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_report(c._decided(table(spark, d, "raw_corpus")), folder, {})
    told = spark.read.schema("language_label_counts map<string, bigint>").option("multiLine", True).json(f"{folder}/filter_summary.json")
    return told.select(F.explode("language_label_counts").alias("label", "n_rows"))


def _csv(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_csv(profile.top_counts(table(spark, d, "raw_corpus"), F.col("model"), 25), folder)
    return spark.read.option("header", True).schema("value string, n_rows bigint").csv(folder)


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Half of the records are annotated and logged; what is pending then is annotated and logged too; the log read again."""
    folder, raw = _folder(spark), table(spark, d, "raw_corpus")
    sinks.append_jsonl(annotate.annotated(raw.where("row_id % 2 = 0")), folder)
    keyed = raw.withColumn("_pk", dec.row_key(F.col("conversation_id"), *[F.col(x) for x in PLACE]))
    fresh = annotate.annotated(corpus.pending(keyed, corpus.done_keys(spark, folder), "_pk")).checkpoint()
    sinks.append_jsonl(fresh, folder)
    log = spark.read.schema("processing_key string, source_file string, row_index bigint, overall_status string, task_category string").json(folder)
    return log.select("processing_key", "source_file", "row_index", "overall_status", "task_category")


def _exports(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    rows = table(spark, d, "filtered_corpus").select("conversation_id", "turn", "prompt_hash")
    sinks.write_exports(rows, folder)
    sinks.write_one_parquet(rows, f"{folder}/one.parquet")
    kinds = {"parquet": spark.read.parquet(f"{folder}/parquet"), "jsonl": spark.read.json(f"{folder}/jsonl"), "one": spark.read.parquet(f"{folder}/one.parquet")}
    return corpus.union([r.select(F.lit(k).alias("kind"), "conversation_id", F.col("turn").cast("int").alias("turn"), "prompt_hash") for k, r in kinds.items()])


def _answer_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every answer of the log, checked against the lines of the batch that its call asked about."""
    key = dec.row_key(F.col("conversation_id"), *[F.col(x) for x in PLACE])
    asked = table(spark, d, "raw_corpus").select(key.alias("_k"), F.struct(*PLACE).alias("_at"), F.size(split_lines(first_user_prompt(F.col("conversation")))).alias("_n"))
    asked = asked.groupBy("_k").agg(F.min_by("_n", "_at").alias("_n"))
    probes = table(spark, d, "probe_prompts").select(F.col("processing_key").alias("_k"), F.size(split_lines(F.col("prompt"))).alias("_n"))
    # one row a key on that side: a hot key of the log is split by adaptive execution, answers are parsed once
    calls = table(spark, d, "call_log").select("processing_key", "call_kind", "batch_no", answers.json_object(F.col("answer")).alias("_v"))
    rows = calls.join(asked.unionByName(probes), F.col("processing_key") == F.col("_k"), "left")
    first, last = F.col("batch_no") * annotate.LINE_BATCH + 1, F.least((F.col("batch_no") + 1) * annotate.LINE_BATCH, F.coalesce("_n", F.lit(0)))
    expected = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    error = F.when(F.col("call_kind") == "lines", answers.line_error(F.col("_v"), expected)).otherwise(answers.task_fields(F.col("_v"))["error"])
    return rows.select("call_kind", F.coalesce(error, F.lit("valid")).alias("problem")).groupBy("call_kind", "problem").agg(F.count("*").alias("n_calls"))


def _payload_lenient(spark: SparkSession, d: str) -> DataFrame:
    held = F.try_variant_get(F.try_parse_json("payload"), "$.conversation", "variant")
    text = F.when(F.schema_of_variant(held) == "STRING", F.try_variant_get(held, "$", "string")).otherwise(F.to_json(held))
    p = table(spark, d, "raw_payloads").where(held.isNotNull()).select("payload_id", F.explode(extract.normalize_lenient(text)).alias("m"))
    return p.groupBy("payload_id", F.col("m.role").alias("role")).agg(F.count("*").alias("n_messages"), F.sum(F.length("m.text")).alias("n_chars"))


def _full_duplicates(raw: DataFrame) -> DataFrame:
    rows = c._columns(raw)
    return profile.duplicate_summary(rows, {"record": profile.record_hash(rows)})


def _line_requests(raw: DataFrame) -> DataFrame:
    lines = annotate.lines(annotate.prompts(raw)).groupBy("source_file", "row_index", "batch_no")
    held = lines.agg(F.array_sort(F.collect_list(F.struct("line_number", F.col("line_text").alias("text")))).alias("lines"))
    return held.select("source_file", "row_index", "batch_no", answers.prompt_with_payload("Label each line.", answers.lines_payload(F.col("lines"))).alias("prompt"))


def _task_requests(raw: DataFrame) -> DataFrame:
    s = annotate.separated(annotate.prompts(raw))
    return s.select("source_file", "row_index", answers.prompt_with_payload("Name the task.", answers.task_payload(F.col("natural_language_text"), F.col("contains_code"), F.col("code_line_count"))).alias("prompt"))


def _words(raw: DataFrame) -> DataFrame:
    return messages(raw, "row_id").select("row_id", "msg_pos", F.greatest(F.lit(1), word_count(F.coalesce("content", F.lit("")))).alias("n_tokens"))


def _snippets(raw: DataFrame) -> DataFrame:
    return corpus.canonical(raw.select("row_id", F.col("snippet_turns").cast("array<string>").alias("snippet_turns"))).select("row_id", F.array_join(F.col("snippet_turns").cast("array<string>"), ",").alias("snippets"))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enriched_records").select("log_line", F.coalesce(answers.is_language_code(F.col("detected_language")), F.lit(False)).alias("is_code"))


def _rounded_funnel(raw: DataFrame) -> DataFrame:
    return audit.rounded(funnel.funnel(funnel.tagged(raw, detect)), "step_share", "total_share")


QUERIES = {
    "file_range": _written(start="part_001.parquet", end="part_003.parquet"),
    "first_files": _written(max_files=2),
    "one_file": _written(file="part_001.parquet"),
    "head_of_shards": _written(max_rows_per_file=7),
    "written_shards": _written(),
    "written_report": _report,
    "written_labels": _label_report,
    "written_csv": _csv,
    "written_log": _log,
    "written_exports": _exports,
    "duplicate_full_records": c._raw(_full_duplicates),
    "detected_messages": c._raw(lambda raw: audit.message_labels(raw, "row_id").select("row_id", "message_position", "role", "detected", "n_letters")),
    "short_user_prompts": c._raw(lambda raw: audit.short_user_prompts(raw, "row_id")),
    "label_failures": c._raw(lambda raw: audit.label_failures(raw, "row_id")),
    "filter_funnel_detected": c._raw(_rounded_funnel),
    "memory_profile": c._raw(lambda raw: profile.memory_profile(raw.drop("conversation"))),
    "example_records": c._raw(lambda raw: audit.examples(raw).select(*PLACE)),
    "snippet_arrays": c._raw(_snippets),
    "word_counts": c._raw(_words),
    "line_requests": c._raw(_line_requests),
    "task_requests": c._raw(_task_requests),
    "language_codes_valid": _codes,
    "answer_errors": _answer_errors,
    "payload_lenient": _payload_lenient,
}

_q, _strip, _PLACES = c._q, c._strip, c._PLACES
_SHARDS = (
    c._decision_sql()
    + f""", placed AS (SELECT d.conversation_id, source_model AS model, first_user_prompt_hash AS prompt_hash, CAST(coalesce(len(b.m), 0) AS INTEGER) AS n_messages, row_number() OVER (ORDER BY {_PLACES}) - 1 AS rank FROM decisions d JOIN (SELECT {_PLACES}, m FROM base) b USING ({_PLACES}) WHERE keep_final),
sharded AS (SELECT * EXCLUDE (rank), rank // {SHARD} AS shard, 'part_' || lpad(CAST(rank // {SHARD} AS VARCHAR), 3, '0') || '.parquet' AS source_file, rank % {SHARD} AS source_row_position FROM placed)
SELECT * EXCLUDE (shard) FROM sharded """
)
_CASES = ", ".join("{'code': '%s', 'n': len(list_filter(string_split(lower(cleaned), ' '), lambda w: w IN (%s)))}" % (code, ", ".join(map(_q, words))) for code, words in WORDS.items())
_SAID = f"""
told_messages AS (SELECT row_id, msg_pos, CASE WHEN {c._LENIENT_ROLE} = '' THEN 'role_missing' ELSE {c._LENIENT_ROLE} END AS role, {_strip("x.language")} AS label, {c._ENGLISH} AS english, {c._LENIENT} AS text FROM {c._MSG} WHERE x IS NOT NULL),
cleaned_messages AS (SELECT *, {c._clean_sql("text")} AS cleaned FROM told_messages WHERE {_strip("text")} <> ''),
counted_messages AS (SELECT *, length(replace(cleaned, ' ', '')) AS n_letters, [{_CASES}] AS n FROM cleaned_messages),
topped AS (SELECT *, list_max(list_transform(n, lambda s: s.n)) AS most FROM counted_messages),
said AS (SELECT *, CASE WHEN n_letters < {funnel.LEAST_LETTERS} THEN 'not_enough_text' WHEN most = 0 THEN 'detection_error' ELSE list_filter(n, lambda s: s.n = most)[1].code END AS detected FROM topped)"""
_BARE = f"regexp_replace(regexp_replace({_strip('answer')}, {_q('^```(?:json)?' + chr(92) + 's*')}, '', 'i'), {_q(chr(92) + 's*```$')}, '')"
_OBJECTS = f"""bared AS (SELECT *, {_strip(_BARE)} AS bare FROM call_log),
blocked AS (SELECT *, TRY_CAST(bare AS JSON) AS whole, TRY_CAST(nullif(regexp_extract(bare, {_q(chr(92) + '{.*' + chr(92) + '}')}, 0, 's'), '') AS JSON) AS part FROM bared),
objects AS (SELECT *, CASE WHEN json_type(whole) = 'OBJECT' THEN whole WHEN json_type(part) = 'OBJECT' THEN part END AS o FROM blocked)"""


def _told(f: str) -> str:
    return f"coalesce(json_extract_string(o, '$.{f}'), 'None')"


def _up(f: str) -> str:
    return f"upper({_strip(_told(f))})"


def _one_of(f: str, values) -> str:
    return f"WHEN {_up(f)} NOT IN ({', '.join(map(_q, values))}) THEN 'Invalid {f}: ' || {_up(f)}"


_NUMBER, _LABEL = "json_extract_string(i, '$.line_number')", f"upper({_strip(chr(106) + 'son_extract_string(i, ' + _q('$.label') + ')')})"
_ITEM_FAULT = f"""CASE WHEN json_type(i) <> 'OBJECT' THEN 'Each line classification must be an object.'
  WHEN NOT json_exists(i, '$.line_number') OR NOT json_exists(i, '$.label') THEN 'Each line classification needs line_number and label.'
  WHEN TRY_CAST({_NUMBER} AS INTEGER) IS NULL THEN 'invalid literal for int() with base 10: ' || chr(39) || {_NUMBER} || chr(39)
  WHEN NOT list_contains(expected, TRY_CAST({_NUMBER} AS BIGINT)) THEN 'Unexpected line_number: ' || {_NUMBER}
  WHEN {_LABEL} NOT IN ('NATURAL_LANGUAGE', 'CODE', 'EMPTY') THEN 'Invalid line label: ' || {_LABEL} END"""
_LAST = f"least((batch_no + 1) * {annotate.LINE_BATCH}, coalesce(n, 0))"
_ERRORS = f"""WITH {_OBJECTS}, {c._LINES},
sizes AS (SELECT processing_key AS k, len(l) AS n, row_number() OVER (PARTITION BY processing_key ORDER BY source_file, row_index) AS first FROM trimmed),
known AS (SELECT k, n FROM sizes WHERE first = 1 UNION ALL SELECT processing_key, len(string_split(prompt, chr(10))) FROM probe_prompts),
wanted AS (SELECT o.*, CASE WHEN {_LAST} >= batch_no * {annotate.LINE_BATCH} + 1 THEN range(batch_no * {annotate.LINE_BATCH} + 1, {_LAST} + 1) ELSE [] END AS expected FROM objects o LEFT JOIN known ON processing_key = k),
listed_items AS (SELECT *, CASE WHEN json_type(json_extract(o, '$.lines')) = 'ARRAY' THEN CAST(json_extract(o, '$.lines') AS JSON[]) END AS a FROM wanted),
faults AS (SELECT *, list_filter(list_transform(a, lambda i: {_ITEM_FAULT}), lambda f: f IS NOT NULL)[1] AS fault,
  list_sort(list_filter(expected, lambda e: NOT list_contains(list_transform(a, lambda i: TRY_CAST({_NUMBER} AS BIGINT)), e))) AS missing,
  list_filter([{", ".join(map(_q, answers.TASK_FIELDS))}], lambda f: NOT list_contains(json_keys(o), f)) AS lacking FROM listed_items),
judged AS (SELECT call_kind, CASE WHEN o IS NULL THEN 'No JSON object'
  WHEN call_kind = 'lines' THEN CASE WHEN NOT json_exists(o, '$.lines') THEN 'Missing field: lines' WHEN a IS NULL THEN 'Field ' || chr(39) || 'lines' || chr(39) || ' must be a list.' WHEN fault IS NOT NULL THEN fault
    WHEN len(missing) > 0 THEN 'Missing classifications for lines: [' || array_to_string(missing, ', ') || ']' END
  WHEN len(lacking) > 0 THEN 'Missing fields: [' || chr(39) || array_to_string(lacking, chr(39) || ', ' || chr(39)) || chr(39) || ']'
  {_one_of("task_category", annotate.TASKS)} {_one_of("task_confidence", answers.CONFIDENCES)} {_one_of("code_generation_confidence", answers.CONFIDENCES)} {_one_of("language_confidence", answers.CONFIDENCES)}
  WHEN NOT ({_up("detected_language")} IN ('UNKNOWN', 'MIXED') OR regexp_full_match({_up("detected_language")}, '[A-Z]{{2}}')) THEN 'Invalid detected_language: ' || {_up("detected_language")}
  WHEN lower({_told("is_code_generation")}) NOT IN ('true', 'false') THEN 'Invalid is_code_generation value: ' || {_told("is_code_generation")} END AS problem FROM faults)
SELECT call_kind, coalesce(problem, 'valid') AS problem, count(*) AS n_calls FROM judged GROUP BY ALL"""
_WRITTEN_LOG = f"""WITH {c._SEPARATED}, y AS (SELECT *, {c._task_sql('lower(natural_language_text)', "code_text <> ''")} AS task_category FROM separated),
z AS (SELECT y.processing_key, y.source_file, y.row_index, CASE code_nl_status WHEN 'ok' THEN 'ok' WHEN 'empty_prompt' THEN 'empty_prompt' ELSE 'partial_error' END AS overall_status, task_category, r.row_id % 2 = 0 AS done
  FROM y JOIN raw_corpus r ON r.source_file = y.source_file AND r.source_row_position = y.row_index)
SELECT * EXCLUDE (done) FROM z WHERE done OR processing_key NOT IN (SELECT processing_key FROM z WHERE done)"""
_HELD = """parsed AS (SELECT payload_id, TRY_CAST(payload AS JSON) AS j FROM raw_payloads),
held AS (SELECT payload_id, CASE WHEN json_type(json_extract(j, '$.conversation')) = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.conversation') AS JSON) ELSE json_extract(j, '$.conversation') END AS c FROM parsed WHERE j IS NOT NULL)"""
_ROLE, _CONTENT, _LANGUAGE = (_strip(f"json_extract_string(t.value, '$.{f}')") for f in ("role", "content", "language"))
_NL = " || chr(10) || "

ORACLES = {
    "file_range": _SHARDS + "WHERE shard BETWEEN 1 AND 3",
    "first_files": _SHARDS + "WHERE shard < 2",
    "one_file": _SHARDS + "WHERE shard = 1",
    "head_of_shards": _SHARDS + "WHERE source_row_position < 7",
    "written_shards": _SHARDS,
    "written_report": c._decision_sql()
    + """SELECT count(*) AS total_records, count(*) FILTER (WHERE keep_final) AS kept_records, count(*) FILTER (WHERE NOT keep_final) AS removed_records,
count(*) FILTER (WHERE removal_reason = 'KEPT') AS "KEPT", count(*) FILTER (WHERE removal_reason = 'NON_ENGLISH') AS "NON_ENGLISH", count(*) FILTER (WHERE single_turn) AS "true" FROM decisions""",
    "written_labels": c._decision_sql() + "SELECT first_user_language_normalized AS label, count(*) AS n_rows FROM decisions GROUP BY 1",
    "written_csv": "SELECT model AS value, count(*) AS n_rows FROM raw_corpus WHERE model IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "written_log": _WRITTEN_LOG,
    "written_exports": "SELECT kind, conversation_id, turn, prompt_hash FROM filtered_corpus, (VALUES ('parquet'), ('jsonl'), ('one')) AS k(kind)",
    "duplicate_full_records": "SELECT 'record' AS check_name, count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM raw_corpus GROUP BY conversation_id, model, conversation, turn, snippet_turns HAVING count(*) > 1)",
    "memory_profile": " UNION ALL ".join(
        f"SELECT '{k}' AS column_name, '{t}' AS column_type, count({k}) AS n_filled, CAST(coalesce(sum({b}), 0) AS BIGINT) AS n_bytes FROM raw_corpus"
        for k, t, b in (
            *[(k, "string", f"strlen({k})") for k in ("source_file", "conversation_id", "model")], ("row_id", "bigint", "CASE WHEN row_id IS NOT NULL THEN 8 END"), ("source_row_position", "bigint", "CASE WHEN source_row_position IS NOT NULL THEN 8 END"),
            ("turn", "int", "CASE WHEN turn IS NOT NULL THEN 4 END"), ("snippet_turns", "array<int>", "strlen(CAST(to_json(snippet_turns) AS VARCHAR))"),
        )
    ),
    "example_records": f"SELECT {_PLACES} FROM raw_corpus ORDER BY ALL LIMIT 3",
    "snippet_arrays": "SELECT row_id, CASE WHEN snippet_turns IS NOT NULL THEN coalesce(array_to_string(list_filter(snippet_turns, lambda x: x IS NOT NULL), ','), '') END AS snippets FROM raw_corpus",
    "word_counts": f"SELECT row_id, CAST(msg_pos AS INTEGER) AS msg_pos, CAST(greatest(1, len(list_filter(regexp_split_to_array(coalesce(x.content, ''), {_q(c._S + '+')}), lambda w: w <> ''))) AS INTEGER) AS n_tokens FROM {c._MSG}",
    "line_requests": f"""WITH {c._LINES} SELECT source_file, row_index, batch_no, 'Label each line.'{_NL}'<<<'{_NL}'{{'{_NL}'  "lines": ['{_NL}string_agg('    {{'{_NL}'      "line_number": ' || line_number || ','{_NL}'      "text": ' || CAST(to_json(line_text) AS VARCHAR){_NL}'    }}', ',' || chr(10) ORDER BY line_number){_NL}'  ]'{_NL}'}}'{_NL}'>>>' AS prompt FROM lines GROUP BY ALL""",
    "task_requests": f"""WITH {c._SEPARATED} SELECT source_file, row_index, 'Name the task.'{_NL}'<<<'{_NL}'{{'{_NL}'  "natural_language_text": ' || CAST(to_json(natural_language_text) AS VARCHAR) || ','{_NL}'  "metadata": {{'{_NL}'    "original_prompt_contained_code": ' || CAST(code_text <> '' AS VARCHAR) || ','{_NL}'    "code_line_count": ' || n_code{_NL}'  }}'{_NL}'}}'{_NL}'>>>' AS prompt FROM separated""",
    "language_codes_valid": "SELECT log_line, coalesce(detected_language IN ('UNKNOWN', 'MIXED') OR regexp_full_match(detected_language, '[A-Z]{2}'), false) AS is_code FROM enriched_records",
    "detected_messages": f"WITH {_SAID} SELECT row_id, CAST(msg_pos AS INTEGER) AS message_position, role, detected, CAST(n_letters AS INTEGER) AS n_letters FROM said",
    "label_failures": f"WITH {_SAID} SELECT row_id, CAST(msg_pos AS INTEGER) AS message_position, role, label, substring(text, 1, 250) AS preview FROM said WHERE NOT english",
    "short_user_prompts": f"""WITH {_SAID} SELECT row_id, CAST(msg_pos AS INTEGER) AS message_position, role, label, CAST(n_letters AS INTEGER) AS n_letters, substring(text, 1, 250) AS preview, substring(cleaned, 1, 250) AS cleaned_preview FROM said
WHERE detected = 'not_enough_text' AND regexp_matches(role, 'user|human|developer') AND row_id NOT IN (SELECT row_id FROM said WHERE detected NOT IN ('en', 'not_enough_text'))""",
    "filter_funnel_detected": f"""WITH {c._NB}, {_SAID}, elsewhere AS (SELECT DISTINCT r.source_file, r.source_row_position FROM said JOIN raw_corpus r USING (row_id) WHERE detected NOT IN ('en', 'not_enough_text')),
tags2 AS (SELECT t.* EXCLUDE (removed_at), CASE WHEN removed_at IS NULL AND l.source_file IS NOT NULL THEN 'detected_language' ELSE removed_at END AS removed_at FROM tags t LEFT JOIN elsewhere l USING ({_PLACES})),
c AS (SELECT count(*) AS total, {c._FUNNEL_COUNTS} FROM tags2), steps AS ({c._FUNNEL_ROWS}) SELECT * REPLACE (round(step_share * 100, 2) AS step_share, round(total_share * 100, 2) AS total_share) FROM steps""",
    "schema_summary": """SELECT column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'INTEGER[]' THEN 'array<int>' ELSE 'array<array<struct<role:string,content:string,language:string>>>' END AS column_type,
column_name IN ('conversation_id', 'model', 'conversation', 'turn', 'snippet_turns') AS is_expected FROM information_schema.columns WHERE table_name = 'raw_corpus'""",
    "answer_objects": f"WITH {_OBJECTS} SELECT call_kind, answer IS NULL AS no_answer, o IS NOT NULL AS has_object, count(*) AS n_calls FROM objects GROUP BY ALL",
    "answer_errors": _ERRORS,
    "payload_messages": f"""WITH {_HELD}, m AS (SELECT payload_id, json_extract_string(t.value, '$.content') AS content FROM held, json_tree(held.c) t WHERE t.type = 'OBJECT' AND json_exists(t.value, '$.role') AND json_exists(t.value, '$.content'))
SELECT payload_id, count(*) AS n_messages, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM m GROUP BY 1""",
    "payload_lenient": f"""WITH {_HELD}, m AS (SELECT payload_id, CASE WHEN json_exists(t.value, '$.role') THEN coalesce(lower({_ROLE}), 'none') ELSE '' END AS role, coalesce({_CONTENT}, coalesce({_ROLE}, '') || coalesce({_LANGUAGE}, '')) AS text FROM held, json_tree(held.c) t WHERE t.type = 'OBJECT')
SELECT payload_id, role, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM m GROUP BY 1, 2""",
    "payload_paths": f"""WITH p AS (SELECT TRY_CAST(payload AS JSON) AS j FROM raw_payloads), t AS (SELECT x.fullkey FROM p, json_tree(p.j) x WHERE p.j IS NOT NULL AND NOT ends_with(x.fullkey, ']') AND x.fullkey <> '$')
SELECT regexp_replace(substring(fullkey, 3), {_q(chr(92) + '[[0-9]+' + chr(92) + ']')}, '[]', 'g') AS key_path, count(*) AS n_values FROM t GROUP BY 1""",
}
