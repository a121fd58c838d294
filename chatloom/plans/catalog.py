"""All queries of the core and their SQL, by name: each takes (spark, folder of tables) and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import WS, is_blank, is_english_notebook
from ..operators import annotate, answers, extract, funnel, profile
from ..operators import decisions as dec
from ..operators.messages import flat, lenient_text, messages, nth_user, structure_flags
from ..sources import corpus
from ..sources.tables import table
from ..streaming import ingest
from . import skew

PLACE = ("source_file", "source_row_position")
FLAGS = ("keep_after_language_filter", "keep_after_turn_filter", "keep_after_empty_prompt_filter", "keep_after_duplicate_filter", "keep_final", "removal_reason")
HEAD, SHARD = 100, 50


def _raw(run):
    return lambda spark, d: run(table(spark, d, "raw_corpus"))


def _decided(raw: DataFrame, **settings) -> DataFrame:
    policy = dec.Policy(**settings)
    return dec.decide(dec.metadata(raw, policy), policy)


def _mode(mode: str):
    return _raw(lambda raw: _decided(raw, duplicate_mode=mode).select(*PLACE, *FLAGS))


def _turn_methods(raw: DataFrame) -> DataFrame:
    turn, n = F.col("turn"), F.size(dec.users(flat(F.col("conversation"))))
    return raw.select(*PLACE, *[dec.single_turn(m, turn, n).alias(m) for m in dec.METHODS])


def _nth(n: int):
    return _raw(lambda raw: raw.select(*PLACE, F.coalesce(nth_user(flat(F.col("conversation")), n)["content"], F.lit("")).alias("prompt")))


def _shards(raw: DataFrame) -> DataFrame:
    return dec.shards(_decided(raw).where("keep_final"), SHARD)


def _semi(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "filter_decisions").where("keep_final").select(*PLACE)
    return table(spark, d, "raw_corpus").join(kept, list(PLACE), "left_semi").select("row_id", "model", "turn")


def _inner(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "filter_decisions").where("keep_final").select(*PLACE, "first_user_prompt_hash", "removal_reason").distinct()
    return table(spark, d, "raw_corpus").join(told, list(PLACE)).select("row_id", "first_user_prompt_hash", "removal_reason")


def _pending(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "enriched_records").where("coalesce(processing_key, '') <> ''").select("processing_key")
    return corpus.pending(table(spark, d, "filter_decisions").select("row_key", *PLACE), done, "row_key").select("row_key", *PLACE)


def _duplicate_summary(raw: DataFrame) -> DataFrame:
    prompt = F.sha2(F.coalesce(nth_user(flat(F.col("conversation")))["content"], F.lit("")), 256)
    return profile.duplicate_summary(raw, {"conversation_id": F.col("conversation_id"), "first_user_prompt": prompt, "conversation": F.sha2(F.coalesce(F.to_json("conversation"), F.lit("null")), 256)})


def _removed_duplicates(raw: DataFrame) -> DataFrame:
    return funnel.tagged(raw).where(F.col("removed_at").isin(*funnel.STEPS[:2])).select(*PLACE, "removed_at")


def _structure(raw: DataFrame) -> DataFrame:
    return raw.select(*PLACE, *[c.alias(k) for k, c in structure_flags(flat(F.col("conversation"))).items()])


def _labels_english(raw: DataFrame) -> DataFrame:
    checked = F.filter(flat(F.col("conversation")), lambda m: ~is_blank(lenient_text(m)))
    good = F.forall(checked, lambda m: is_english_notebook(m["language"])) & (F.size(checked) > 0)
    return raw.select(*PLACE, F.coalesce(F.size(checked), F.lit(0)).alias("n_checked"), F.coalesce(good, F.lit(False)).alias("all_english"))


def _cleaning(raw: DataFrame) -> DataFrame:
    m = messages(raw, "row_id").where(~is_blank(F.col("content")))
    n = funnel.letters(F.col("content"))
    return m.select("row_id", "msg_pos", funnel.cleaned_for_language(F.col("content")).alias("cleaned"), n.alias("n_letters"), (n < funnel.LEAST_LETTERS).alias("too_little"))


def _annotated(raw: DataFrame) -> DataFrame:
    return annotate.annotated(raw)


def _line_counts(raw: DataFrame) -> DataFrame:
    cols = ("natural_language_line_count", "code_line_count", "empty_line_count", "line_count")
    return annotate.separated(annotate.prompts(raw)).select("source_file", "row_index", *cols, "code_nl_status")


def _batches(raw: DataFrame) -> DataFrame:
    return annotate.lines(annotate.prompts(raw)).groupBy("source_file", "row_index", "batch_no").agg(F.count("*").alias("n_lines"), F.min("line_number").alias("first_line"))


def _tasks(raw: DataFrame) -> DataFrame:
    m = messages(raw, "row_id").select("row_id", "msg_pos", F.coalesce("content", F.lit("")).alias("t"))
    task = annotate.task_category(F.col("t"), F.lit(False))
    return m.select("row_id", "msg_pos", task.alias("task_category"), task.isin(*annotate.GENERATING).alias("is_code_generation"), annotate.language_guess(F.col("t")).alias("detected_language"))


def _answer_objects(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "call_log")
    return calls.select("call_kind", F.col("answer").isNull().alias("no_answer"), answers.json_object(F.col("answer")).isNotNull().alias("has_object")).groupBy("call_kind", "no_answer", "has_object").agg(F.count("*").alias("n_calls"))


def _payload_messages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_payloads").select("payload_id", F.explode(extract.normalize("payload")).alias("m"))
    return p.groupBy("payload_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("m.content")).alias("n_chars"))


def _union(spark: SparkSession, d: str) -> DataFrame:
    raw, kept = table(spark, d, "raw_corpus"), table(spark, d, "filtered_corpus")
    both = corpus.union([raw.select("conversation_id", "model", "turn", F.lit("raw").alias("split")), kept.select("model", "conversation_id", "turn", F.lit("kept").alias("split"))])
    return both.groupBy("split", "model").agg(F.count("*").alias("n_rows"))


def _bins(raw: DataFrame) -> DataFrame:
    return profile.histogram(raw, "turn", 0, 10, 5)


def _columns(raw: DataFrame) -> DataFrame:
    return raw.select("conversation_id", "model", "conversation", "turn", "snippet_turns")


def _canonical(raw: DataFrame) -> DataFrame:
    return corpus.canonical(raw.select("row_id", "conversation_id", F.col("turn").cast("string").alias("turn"), F.to_json("conversation").alias("conversation"))).select(
        "row_id", F.coalesce(F.size(flat(F.col("conversation"))), F.lit(0)).alias("n_messages"), "turn", F.col("model").isNull().alias("no_model")
    )


QUERIES = {
    **skew.QUERIES,
    "filter_decisions": _raw(_decided),
    "decisions_keep_first": _mode("keep_first"),
    "decisions_none": _mode("none"),
    "decisions_user_count": _raw(lambda raw: _decided(raw, single_turn_method="user_message_count").select(*PLACE, *FLAGS)),
    "removal_reason_counts": _raw(lambda raw: dec.counts(_decided(raw), "removal_reason")),
    "language_label_counts": _raw(lambda raw: dec.counts(_decided(raw), "first_user_language_normalized")),
    "single_turn_counts": _raw(lambda raw: dec.counts(_decided(raw), "single_turn")),
    "filter_summary": _raw(lambda raw: dec.summary(_decided(raw))),
    "single_turn_methods": _raw(_turn_methods),
    "filtered_records": _raw(lambda raw: dec.filtered(raw).select("conversation_id", "model", "turn", "_filter_source_file", "_filter_source_row_position", "prompt_hash", "_first_user_language_label", "_filter_removal_reason")),
    "first_user_prompt": _nth(0),
    "second_user_prompt": _nth(1),
    "head_per_file": _raw(lambda raw: raw.where(F.col("source_row_position") < HEAD).select(*PLACE)),
    "shard_assignment": _raw(_shards),
    "keep_rows_semi_join": _semi,
    "metadata_inner_join": _inner,
    "resume_anti_join": _pending,
    "schema_summary": _raw(lambda raw: profile.schema_summary(raw)),
    "dataset_size_summary": _raw(lambda raw: profile.size_summary(raw)),
    "missing_summary": _raw(lambda raw: profile.missing_values(_columns(raw))),
    "cardinality_summary": _raw(lambda raw: profile.cardinality(raw, ["conversation_id", "model", "turn"], "conversation_id")),
    "duplicate_groups": _raw(lambda raw: profile.duplicate_groups(raw, F.col("conversation_id"))),
    "duplicate_records": _raw(lambda raw: profile.duplicate_records(raw, "conversation_id", list(PLACE))),
    "duplicate_summary": _raw(_duplicate_summary),
    "removed_duplicates": _raw(_removed_duplicates),
    "top_models": _raw(lambda raw: profile.top_counts(raw, F.col("model"), 25)),
    "turn_describe": _raw(lambda raw: profile.describe(raw, "turn")),
    "turn_histogram_p99": _raw(lambda raw: profile.clipped_counts(raw, "turn")),
    "turn_histogram_bins": _raw(_bins),
    "turn_distribution": _raw(lambda raw: profile.value_counts(raw, "turn")),
    "message_count_distribution": _raw(profile.shape_counts),
    "role_language_distribution": _raw(profile.label_counts),
    "nested_key_census": _raw(lambda raw: profile.nested_keys(raw, ["conversation_id", "conversation", "snippet_turns"])),
    "structural_validity": _raw(_structure),
    "snippet_first_turn": _raw(lambda raw: raw.select(*PLACE, F.coalesce(F.array_contains("snippet_turns", 1), F.lit(False)).alias("first_turn"))),
    "all_labels_english": _raw(_labels_english),
    "filter_funnel": _raw(lambda raw: funnel.funnel(funnel.tagged(raw))),
    "funnel_steps": _raw(lambda raw: funnel.tagged(raw).select(*PLACE, "removed_at")),
    "funnel_size_summary": _raw(lambda raw: funnel.size_summary(funnel.tagged(raw))),
    "language_cleaning": _raw(_cleaning),
    "prompt_lines": _raw(lambda raw: annotate.lines(annotate.prompts(raw))),
    "line_batches": _raw(_batches),
    "line_label_counts": _raw(_line_counts),
    "message_tasks": _raw(_tasks),
    "annotated_records": _raw(_annotated),
    "answer_objects": _answer_objects,
    "payload_messages": _payload_messages,
    "payload_paths": lambda spark, d: extract.json_paths(table(spark, d, "raw_payloads"), "payload"),
    "record_hashes": lambda spark, d: table(spark, d, "raw_payloads").select("payload_id", extract.stable_hash("payload").alias("hash")),
    "canonical_columns": _raw(_canonical),
    "union_splits": _union,
    "call_windows": lambda spark, d: ingest.call_windows(table(spark, d, "call_log")),
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"trim({x}, {_q(WS)})"


_PROMPT = "coalesce(u[1].content, '')"
_NORMAL = f"replace(replace(lower({_strip('label')}), '_', '-'), ' ', '-')"
_META = f"""
base AS (SELECT *, flatten(list_filter(conversation, lambda t: t IS NOT NULL)) AS m FROM raw_corpus),
used AS (SELECT *, list_filter(m, lambda x: lower({_strip("x.role")}) = 'user') AS u FROM base),
told AS (SELECT *, {_PROMPT} AS p, coalesce(u[1].language, '') AS label FROM used),
meta AS (
  SELECT CASE WHEN {_strip("coalesce(conversation_id, '')")} <> '' THEN conversation_id ELSE source_file || '::' || source_row_position END AS row_key,
    conversation_id, source_file, source_row_position, model AS source_model, turn, sha256({_strip("p")}) AS first_user_prompt_hash,
    CAST(length(p) AS INTEGER) AS first_user_prompt_length, {_strip("p")} = '' AS first_user_prompt_empty, substring(p, 1, 300) AS first_user_prompt_preview,
    label AS first_user_language_label, {_NORMAL} AS first_user_language_normalized, {_NORMAL} IN ('english', 'en', 'eng') AS language_is_english,
    coalesce(turn = 1, false) AS by_turn, coalesce(len(u) = 1, false) AS by_users
  FROM told
)"""


def _decision_sql(method: str = "by_turn", mode: str = "drop_all") -> str:
    kept = {
        "drop_all": "pre AND count(*) FILTER (WHERE pre) OVER (PARTITION BY first_user_prompt_hash) = 1",
        "keep_first": "pre AND row_number() OVER (PARTITION BY first_user_prompt_hash, pre ORDER BY source_file, source_row_position) = 1",
        "none": "true",
    }[mode]
    return f"""WITH {_META},
flagged AS (SELECT * EXCLUDE (by_turn, by_users), {method} AS single_turn, language_is_english AS keep_after_language_filter, {method} AS keep_after_turn_filter,
  NOT first_user_prompt_empty AS keep_after_empty_prompt_filter, language_is_english AND {method} AND NOT first_user_prompt_empty AS pre FROM meta),
kept AS (SELECT *, {kept} AS keep_after_duplicate_filter FROM flagged),
decisions AS (SELECT * EXCLUDE (pre), pre AND keep_after_duplicate_filter AS keep_final,
  CASE WHEN NOT keep_after_language_filter THEN 'NON_ENGLISH' WHEN NOT keep_after_turn_filter THEN 'MULTI_TURN' WHEN NOT keep_after_empty_prompt_filter THEN 'EMPTY_FIRST_PROMPT'
       WHEN NOT keep_after_duplicate_filter THEN 'DUPLICATE_FIRST_PROMPT' ELSE 'KEPT' END AS removal_reason FROM kept)
"""


_PLACES = "source_file, source_row_position"
_FLAG_LIST = ", ".join(FLAGS)
_LENIENT = f"coalesce({_strip('x.content')}, coalesce({_strip('x.role')}, '') || coalesce({_strip('x.language')}, ''))"
_LENIENT_ROLE = f"coalesce(lower({_strip('x.role')}), 'none')"
_ENGLISH = f"coalesce(replace(lower({_strip('x.language')}), '_', '-') IN ('en', 'eng', 'english') OR starts_with(replace(lower({_strip('x.language')}), '_', '-'), 'en-'), false)"
_NB = f"""
base AS (SELECT *, flatten(list_filter(conversation, lambda t: t IS NOT NULL)) AS m FROM raw_corpus),
parts AS (SELECT *,
  list_filter(m, lambda x: regexp_matches({_LENIENT_ROLE}, 'user|human|developer')) AS nu,
  list_filter(m, lambda x: regexp_matches({_LENIENT_ROLE}, 'assistant|gpt|chatgpt|llm|model')) AS na,
  list_filter(m, lambda x: {_strip(_LENIENT)} <> '') AS checked FROM base),
flags AS (SELECT *,
  coalesce(len(m) > 0, false) AS has_messages, coalesce(len(nu) > 0, false) AS has_user, coalesce(len(na) > 0, false) AS has_assistant,
  coalesce(len(list_filter(nu, lambda x: {_strip(_LENIENT)} <> '')) > 0, false) AS has_user_text,
  coalesce(len(list_filter(na, lambda x: {_strip(_LENIENT)} <> '')) > 0, false) AS has_assistant_text,
  coalesce(len(checked), 0) AS n_checked,
  coalesce(len(checked) > 0 AND len(list_filter(checked, lambda x: NOT {_ENGLISH})) = 0, false) AS all_english,
  coalesce(list_transform(nu, lambda x: {_LENIENT})[1], list_transform(m, lambda x: {_LENIENT})[1], '') AS prompt FROM parts),
ided AS (SELECT *, {_strip("coalesce(conversation_id, '')")} <> '' AS has_id FROM flags),
first_ids AS (SELECT *, NOT has_id OR row_number() OVER (PARTITION BY conversation_id ORDER BY {_PLACES}) = 1 AS stays FROM ided),
hashed AS (SELECT *, CASE WHEN {_strip("prompt")} <> '' THEN {_strip("prompt")} END AS ph FROM first_ids),
tags AS (SELECT source_file, source_row_position, model,
  CASE WHEN NOT stays THEN 'conversation_id_dedup'
       WHEN ph IS NOT NULL AND row_number() OVER (PARTITION BY stays, ph ORDER BY {_PLACES}) > 1 THEN 'first_prompt_dedup'
       WHEN NOT coalesce(turn = 1, false) THEN 'single_turn' WHEN NOT coalesce(list_contains(snippet_turns, 1), false) THEN 'snippet_first_turn'
       WHEN NOT (has_messages AND has_user_text AND has_assistant_text) THEN 'structural_validity' WHEN NOT all_english THEN 'english_labels' END AS removed_at FROM hashed)
"""

_W = r"[\p{L}\p{N}_]"
_S = r"[\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_P = r"[ \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES_RE = r"[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


_CODE_SQL = (
    "(" + " OR ".join(f"starts_with(s, {_q(w)})" for w in annotate.CODE_STARTS) + f" OR {_any('lower(s)', annotate.CODE_MARKERS)}"
    + f" OR (regexp_matches(s, {_q(_W + _S + '*=' + _S + '*' + '[^' + chr(92) + 'n]')}) AND NOT ends_with(s, '?'))"
    + f" OR regexp_matches(lower(s), {_q('(^|[^' + _W[1:-1] + '])' + _W + '[' + _W[1:-1] + r'\-./]*\.(' + '|'.join(annotate.CODE_FILES) + ')($|[^' + _W[1:-1] + '])')}))"
)
_LINES = f"""
base AS (SELECT *, flatten(list_filter(conversation, lambda t: t IS NOT NULL)) AS m FROM raw_corpus),
asked AS (SELECT source_file, source_row_position AS row_index, conversation_id,
  CASE WHEN {_strip("coalesce(conversation_id, '')")} <> '' THEN conversation_id ELSE source_file || '::' || source_row_position END AS processing_key,
  coalesce(list_filter(m, lambda x: lower({_strip("x.role")}) = 'user')[1].content, '') AS p FROM base),
broken AS (SELECT *, regexp_split_to_array(replace(p, chr(13) || chr(10), chr(10)), {_q(_LINES_RE)}) AS a FROM asked),
trimmed AS (SELECT *, CASE WHEN p = '' THEN [] WHEN a[-1] = '' THEN a[:len(a) - 1] ELSE a END AS l FROM broken),
listed AS (SELECT * EXCLUDE (a, l), unnest(l) AS line_text, generate_subscripts(l, 1) AS line_number FROM trimmed),
labelled AS (SELECT *, CAST(floor((line_number - 1) / {annotate.LINE_BATCH}) AS INTEGER) AS batch_no, {_strip("line_text")} AS s,
  regexp_matches(line_text, {_q(r'\}' + _P + '*>>>')}) AS breaks FROM listed),
said AS (SELECT *, bool_or(breaks) OVER (PARTITION BY source_file, row_index, batch_no) AS bad, CASE WHEN s = '' THEN 'EMPTY' WHEN {_CODE_SQL} THEN 'CODE' ELSE 'NATURAL_LANGUAGE' END AS own FROM labelled),
lines AS (SELECT * EXCLUDE (own, breaks, s), CASE WHEN bad AND own = 'CODE' THEN 'NATURAL_LANGUAGE' ELSE own END AS label FROM said)
"""


def _task_sql(t: str, code: str) -> str:
    # t: a stripped text in lower case
    cases = [f"WHEN {t} = '' THEN 'AMBIGUOUS'", f"WHEN {t} IN ({', '.join(_q(g) for g in annotate.GREETINGS)}) THEN 'OTHER'"]
    cases += [f"WHEN {_any(t, words)} THEN '{task}'" for task, words in annotate.TASK_WORDS]
    return "CASE " + " ".join(cases) + f" WHEN {code} AND {_any(t, annotate.TASK_HELP)} THEN 'BUG_FIXING' ELSE 'OTHER' END"


def _language_sql(s: str) -> str:
    cases = [f"WHEN {s} = '' THEN 'UNKNOWN'", rf"WHEN regexp_matches({s}, '[\x{{4e00}}-\x{{9fff}}]') THEN 'ZH'", rf"WHEN regexp_matches({s}, '[\x{{3040}}-\x{{30ff}}]') THEN 'JA'"]
    cases += [f"WHEN {_any(f'lower({s})', words)} THEN '{lang}'" for lang, words in annotate.LANGUAGE_WORDS]
    return "CASE " + " ".join(cases) + " ELSE 'EN' END"


_GENERATING = ", ".join(_q(x) for x in annotate.GENERATING)
_SEPARATED = f"""{_LINES},
grouped AS (SELECT source_file, row_index,
    count(*) FILTER (WHERE label = 'NATURAL_LANGUAGE') AS n_nl, count(*) FILTER (WHERE label = 'CODE') AS n_code, count(*) FILTER (WHERE label = 'EMPTY') AS n_empty, count(*) AS n,
    string_agg(line_text, chr(10) ORDER BY line_number) FILTER (WHERE label = 'NATURAL_LANGUAGE') AS nl, string_agg(line_text, chr(10) ORDER BY line_number) FILTER (WHERE label = 'CODE') AS code, bool_or(bad) AS bad
  FROM lines GROUP BY ALL),
errors AS (SELECT source_file, row_index, string_agg(e, ' | ' ORDER BY batch_no) AS code_nl_error FROM
    (SELECT source_file, row_index, batch_no, 'Missing classifications for lines: [' || string_agg(line_number, ', ' ORDER BY line_number) || ']' AS e FROM lines WHERE bad GROUP BY ALL) GROUP BY ALL),
separated AS (SELECT asked.*, {_strip("p")} = '' AS blank,
    CASE WHEN {_strip("p")} = '' THEN 0 ELSE coalesce(n_nl, 0) END AS n_nl, CASE WHEN {_strip("p")} = '' THEN 0 ELSE coalesce(n_code, 0) END AS n_code,
    CASE WHEN {_strip("p")} = '' THEN 0 ELSE coalesce(n_empty, 0) END AS n_empty, CASE WHEN {_strip("p")} = '' THEN 0 ELSE coalesce(n, 0) END AS n,
    CASE WHEN {_strip("p")} = '' THEN '' ELSE coalesce({_strip("nl")}, '') END AS natural_language_text, CASE WHEN {_strip("p")} = '' THEN '' ELSE coalesce({_strip("code")}, '') END AS code_text,
    CASE WHEN {_strip("p")} = '' THEN 'empty_prompt' WHEN coalesce(bad, false) THEN 'partial_error' ELSE 'ok' END AS code_nl_status, code_nl_error
  FROM asked LEFT JOIN grouped USING (source_file, row_index) LEFT JOIN errors USING (source_file, row_index))
"""

_MSG = "(SELECT row_id, unnest(flatten(list_filter(conversation, lambda t: t IS NOT NULL))) AS x, generate_subscripts(flatten(list_filter(conversation, lambda t: t IS NOT NULL)), 1) - 1 AS msg_pos FROM raw_corpus)"


def _clean_sql(x: str) -> str:
    x = f"regexp_replace({x}, '```.*?```', ' ', 'gs')"
    x = f"regexp_replace({x}, '`[^`]*`', ' ', 'g')"
    x = rf"regexp_replace({x}, 'https?://[^\t\n\x{{0b}}\x{{0c}}\r ]+|www\.[^\t\n\x{{0b}}\x{{0c}}\r ]+', ' ', 'g')"
    x = f"regexp_replace({x}, {_q('[^A-Za-zÀ-ÖØ-öø-ÿ' + _S[1:-1] + ']')}, ' ', 'g')"
    return _strip(f"regexp_replace({x}, {_q(_S + '+')}, ' ', 'g')")


_FUNNEL_COUNTS = ", ".join(f"count(*) FILTER (WHERE removed_at = '{s}') AS n{i}" for i, s in enumerate(funnel.STEPS))
_FUNNEL_ROWS = " UNION ALL ".join(
    f"SELECT {i + 1} AS step_no, '{s}' AS step, total{''.join(f' - n{j}' for j in range(i))} AS n_before, total{''.join(f' - n{j}' for j in range(i + 1))} AS n_after, n{i} AS n_removed, "
    f"CAST(total{''.join(f' - n{j}' for j in range(i + 1))} AS DOUBLE) / nullif(total{''.join(f' - n{j}' for j in range(i))}, 0) AS step_share, CAST(total{''.join(f' - n{j}' for j in range(i + 1))} AS DOUBLE) / nullif(total, 0) AS total_share FROM c"
    for i, s in enumerate(funnel.STEPS)
)

_MISSING = {"conversation_id": f"coalesce({_strip('conversation_id')}, '') = ''", "model": f"coalesce({_strip('model')}, '') = ''", "conversation": "conversation IS NULL OR len(conversation) = 0", "turn": "turn IS NULL", "snippet_turns": "snippet_turns IS NULL OR len(snippet_turns) = 0"}

ORACLES = {
    **skew.ORACLES,
    "filter_decisions": _decision_sql() + "SELECT * FROM decisions",
    "decisions_keep_first": _decision_sql(mode="keep_first") + f"SELECT {_PLACES}, {_FLAG_LIST} FROM decisions",
    "decisions_none": _decision_sql(mode="none") + f"SELECT {_PLACES}, {_FLAG_LIST} FROM decisions",
    "decisions_user_count": _decision_sql("by_users") + f"SELECT {_PLACES}, {_FLAG_LIST} FROM decisions",
    "removal_reason_counts": _decision_sql() + "SELECT removal_reason, count(*) AS n_rows FROM decisions GROUP BY 1",
    "language_label_counts": _decision_sql() + "SELECT first_user_language_normalized, count(*) AS n_rows FROM decisions GROUP BY 1",
    "single_turn_counts": _decision_sql() + "SELECT CAST(single_turn AS VARCHAR) AS single_turn, count(*) AS n_rows FROM decisions GROUP BY 1",
    "filter_summary": _decision_sql()
    + """SELECT count(*) AS total_records, count(*) FILTER (WHERE keep_final) AS kept_records, count(*) FILTER (WHERE NOT keep_final) AS removed_records,
count(DISTINCT first_user_prompt_hash) AS unique_prompt_hashes_before_filtering, count(DISTINCT CASE WHEN keep_final THEN first_user_prompt_hash END) AS unique_prompt_hashes_after_filtering FROM decisions""",
    "single_turn_methods": f"WITH {_META} SELECT {_PLACES}, by_turn AS turn_column, by_users AS user_message_count, by_turn AND by_users AS both FROM meta",
    "filtered_records": _decision_sql()
    + "SELECT conversation_id, source_model AS model, turn, source_file AS _filter_source_file, source_row_position AS _filter_source_row_position, first_user_prompt_hash AS prompt_hash, first_user_language_label AS _first_user_language_label, removal_reason AS _filter_removal_reason FROM decisions WHERE keep_final",
    "first_user_prompt": f"WITH {_META} SELECT {_PLACES}, coalesce(u[1].content, '') AS prompt FROM used",
    "second_user_prompt": f"WITH {_META} SELECT {_PLACES}, coalesce(u[2].content, '') AS prompt FROM used",
    "head_per_file": f"SELECT {_PLACES} FROM raw_corpus WHERE source_row_position < {HEAD}",
    "shard_assignment": _decision_sql() + f"SELECT {_PLACES}, CAST(floor((row_number() OVER (ORDER BY {_PLACES}) - 1) / {SHARD}) AS BIGINT) AS shard_no FROM decisions WHERE keep_final",
    "keep_rows_semi_join": "SELECT row_id, model, turn FROM raw_corpus r WHERE EXISTS (SELECT 1 FROM filter_decisions f WHERE f.keep_final AND f.source_file = r.source_file AND f.source_row_position = r.source_row_position)",
    "metadata_inner_join": f"SELECT row_id, first_user_prompt_hash, removal_reason FROM raw_corpus JOIN (SELECT DISTINCT {_PLACES}, first_user_prompt_hash, removal_reason FROM filter_decisions WHERE keep_final) USING ({_PLACES})",
    "resume_anti_join": f"SELECT row_key, {_PLACES} FROM filter_decisions f WHERE NOT EXISTS (SELECT 1 FROM enriched_records e WHERE e.processing_key = f.row_key AND e.processing_key <> '')",
    "dataset_size_summary": """SELECT 'n_rows' AS metric, count(*) AS value FROM raw_corpus UNION ALL SELECT 'n_columns', 8 UNION ALL SELECT 'n_expected_present', 5 UNION ALL SELECT 'n_unexpected', 3 UNION ALL SELECT 'n_expected_missing', 0""",
    "missing_summary": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {p}) AS n_missing, count(*) FILTER (WHERE {p}) * 100.0::DOUBLE / count(*) AS missing_percent FROM raw_corpus" for c, p in _MISSING.items()),
    "cardinality_summary": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_null, {'count(*) - count(DISTINCT conversation_id)' if c == 'conversation_id' else 'CAST(NULL AS BIGINT)'} AS n_duplicate FROM raw_corpus" for c in ("conversation_id", "model", "turn")
    ),
    "duplicate_groups": "SELECT conversation_id AS key_value, count(*) AS n_rows FROM raw_corpus WHERE conversation_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "duplicate_records": f"SELECT * FROM (SELECT conversation_id AS key_value, {_PLACES}, count(*) OVER (PARTITION BY conversation_id) AS n_rows FROM raw_corpus WHERE conversation_id IS NOT NULL AND length(conversation_id) > 0) WHERE n_rows > 1",
    "duplicate_summary": f"WITH {_META}, keys AS (SELECT 'conversation_id' AS check_name, conversation_id AS k FROM base UNION ALL SELECT 'first_user_prompt', p FROM told UNION ALL SELECT 'conversation', coalesce(CAST(conversation AS VARCHAR), 'null') FROM base),"
    " g AS (SELECT check_name, k, count(*) AS n FROM keys GROUP BY ALL HAVING count(*) > 1) SELECT c.check_name, count(n) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM (SELECT DISTINCT check_name FROM keys) c LEFT JOIN g USING (check_name) GROUP BY 1",
    "removed_duplicates": f"WITH {_NB} SELECT {_PLACES}, removed_at FROM tags WHERE removed_at IN ('conversation_id_dedup', 'first_prompt_dedup')",
    "top_models": "SELECT model AS value, count(*) AS n_rows FROM raw_corpus WHERE model IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "turn_describe": "SELECT count(turn) AS n, avg(turn) AS mean, stddev_samp(turn) AS std, CAST(min(turn) AS DOUBLE) AS min, " + ", ".join(f"CAST(quantile_cont(turn, {p}) AS DOUBLE) AS p{int(p * 100):02d}" for p in profile.PERCENTILES) + ", CAST(max(turn) AS DOUBLE) AS max FROM raw_corpus",
    "turn_histogram_p99": "SELECT turn AS value, count(*) AS n_rows FROM raw_corpus WHERE turn <= (SELECT greatest(1, ceil(quantile_cont(turn, 0.99))) FROM raw_corpus) GROUP BY 1",
    "turn_histogram_bins": "SELECT CAST(CASE WHEN turn < 0 THEN 0 WHEN turn >= 10 THEN 6 ELSE floor(turn / 2.0) + 1 END AS BIGINT) AS bin_no, count(*) AS n_rows FROM raw_corpus WHERE turn IS NOT NULL GROUP BY 1",
    "turn_distribution": "SELECT turn AS value, count(*) AS n_rows FROM raw_corpus WHERE turn IS NOT NULL GROUP BY 1",
    "message_count_distribution": f"WITH {_META} SELECT CAST(coalesce(len(m), 0) AS INTEGER) AS n_messages, count(*) AS n_rows FROM base GROUP BY 1",
    "role_language_distribution": f"WITH x AS (SELECT CASE WHEN lower({_strip('coalesce(x.role, ' + chr(39) + 'none' + chr(39) + ')')}) = '' THEN 'role_missing' ELSE lower({_strip('coalesce(x.role, ' + chr(39) + 'none' + chr(39) + ')')}) END AS role, {_strip('x.language')} AS label FROM {_MSG} WHERE coalesce({_strip('x.language')}, '') <> '') SELECT role, label, count(*) AS n_messages FROM x GROUP BY 1, 2 UNION ALL SELECT NULL, label, count(*) FROM x GROUP BY label",
    "nested_key_census": """WITH t AS (SELECT unnest(list_filter(conversation, lambda t: t IS NOT NULL)) AS t FROM raw_corpus), x AS (SELECT unnest(t) AS x FROM t)
SELECT 'conversation_id' AS key_path, count(conversation_id) AS n_values FROM raw_corpus UNION ALL SELECT 'conversation', count(conversation) FROM raw_corpus UNION ALL SELECT 'snippet_turns', count(snippet_turns) FROM raw_corpus
UNION ALL SELECT 'conversation[][].role', count(x.role) FROM x UNION ALL SELECT 'conversation[][].content', count(x.content) FROM x UNION ALL SELECT 'conversation[][].language', count(x.language) FROM x""",
    "structural_validity": f"WITH {_NB} SELECT {_PLACES}, has_messages, has_user, has_assistant, has_user_text, has_assistant_text, has_messages AND has_user_text AND has_assistant_text AS structurally_valid FROM flags",
    "snippet_first_turn": f"SELECT {_PLACES}, coalesce(list_contains(snippet_turns, 1), false) AS first_turn FROM raw_corpus",
    "all_labels_english": f"WITH {_NB} SELECT {_PLACES}, CAST(n_checked AS INTEGER) AS n_checked, all_english FROM flags",
    "filter_funnel": f"WITH {_NB}, c AS (SELECT count(*) AS total, {_FUNNEL_COUNTS} FROM tags) {_FUNNEL_ROWS}",
    "funnel_steps": f"WITH {_NB} SELECT {_PLACES}, removed_at FROM tags",
    "funnel_size_summary": f"""WITH {_NB}, c AS (SELECT count(*) AS a, count(*) FILTER (WHERE removed_at IS NULL) AS b, count(DISTINCT model) AS e, count(DISTINCT CASE WHEN removed_at IS NULL THEN model END) AS f FROM tags)
SELECT 'rows_before' AS metric, CAST(a AS DOUBLE) AS value FROM c UNION ALL SELECT 'rows_after', b FROM c UNION ALL SELECT 'rows_removed', a - b FROM c UNION ALL SELECT 'models_before', e FROM c UNION ALL SELECT 'models_after', f FROM c UNION ALL SELECT 'kept_percent', b * 100.0::DOUBLE / a FROM c""",
    "language_cleaning": f"SELECT row_id, CAST(msg_pos AS INTEGER) AS msg_pos, {_clean_sql('x.content')} AS cleaned, CAST(length(replace({_clean_sql('x.content')}, ' ', '')) AS INTEGER) AS n_letters, length(replace({_clean_sql('x.content')}, ' ', '')) < {funnel.LEAST_LETTERS} AS too_little FROM {_MSG} WHERE coalesce({_strip('x.content')}, '') <> ''",
    "prompt_lines": f"WITH {_LINES} SELECT source_file, row_index, CAST(line_number AS INTEGER) AS line_number, line_text, batch_no, label FROM lines",
    "line_batches": f"WITH {_LINES} SELECT source_file, row_index, batch_no, count(*) AS n_lines, CAST(min(line_number) AS INTEGER) AS first_line FROM lines GROUP BY ALL",
    "line_label_counts": f"WITH {_SEPARATED} SELECT source_file, row_index, CAST(n_nl AS INTEGER) AS natural_language_line_count, CAST(n_code AS INTEGER) AS code_line_count, CAST(n_empty AS INTEGER) AS empty_line_count, CAST(n AS INTEGER) AS line_count, code_nl_status FROM separated",
    "message_tasks": f"WITH x AS (SELECT row_id, CAST(msg_pos AS INTEGER) AS msg_pos, {_strip('coalesce(x.content, ' + chr(39) * 2 + ')')} AS s FROM {_MSG}), y AS (SELECT *, {_task_sql('lower(s)', 'false')} AS task_category FROM x) SELECT row_id, msg_pos, task_category, task_category IN ({_GENERATING}) AS is_code_generation, {_language_sql('s')} AS detected_language FROM y",
    "annotated_records": f"""WITH {_SEPARATED}, y AS (SELECT *, {_task_sql('lower(natural_language_text)', "code_text <> ''")} AS task_category, {_language_sql('natural_language_text')} AS detected_language FROM separated)
SELECT processing_key, conversation_id, source_file, row_index, p AS user_prompt_original, natural_language_text, code_text, code_text <> '' AS contains_code,
  task_category, CASE task_category WHEN 'AMBIGUOUS' THEN 'LOW' ELSE 'HIGH' END AS task_confidence, task_category IN ({_GENERATING}) AS is_code_generation, CASE task_category WHEN 'AMBIGUOUS' THEN 'LOW' ELSE 'HIGH' END AS code_generation_confidence,
  detected_language, CASE detected_language WHEN 'UNKNOWN' THEN 'LOW' ELSE 'HIGH' END AS language_confidence, {_q(annotate.REASON[0])} || task_category || {_q(annotate.REASON[1])} || detected_language || {_q(annotate.REASON[2])} AS short_reason,
  code_nl_status, 'ok' AS task_lang_status, CASE code_nl_status WHEN 'ok' THEN 'ok' WHEN 'empty_prompt' THEN 'empty_prompt' ELSE 'partial_error' END AS overall_status, CASE WHEN code_nl_status = 'partial_error' THEN 'code_nl: ' || code_nl_error END AS overall_error FROM y""",
    "canonical_columns": f"WITH {_META} SELECT row_id, CAST(coalesce(len(m), 0) AS INTEGER) AS n_messages, turn, true AS no_model FROM base",
    "union_splits": "SELECT 'raw' AS split, model, count(*) AS n_rows FROM raw_corpus GROUP BY 2 UNION ALL SELECT 'kept', model, count(*) FROM filtered_corpus GROUP BY 2",
    "call_windows": "SELECT date_trunc('hour', called_at) AS window_start, call_kind, count(*) AS n_calls, count(*) FILTER (WHERE coalesce(http_status >= 400, true)) AS n_failed FROM call_log WHERE called_at IS NOT NULL GROUP BY 1, 2",
}
