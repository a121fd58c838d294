"""The exploratory policy: keep-first deduplication, then five filters, as one tagged plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import is_blank, is_english_notebook, prompt_hash, py_strip
from ..session import checkpoint_dir
from .decisions import survivors
from .messages import USER_ROLES, flat, lenient_role, lenient_text, structure_flags

STEPS = (
    "conversation_id_dedup",
    "first_prompt_dedup",
    "single_turn",
    "snippet_first_turn",
    "structural_validity",
    "english_labels",
    "detected_language",
)

#: Code, links and other signs taken out, in this order, before a language is detected.
_CLEANING = (
    (r"(?s)```.*?```", " "),
    (r"`[^`]*`", " "),
    (r"https?://\S+|www\.\S+", " "),
    ("[^A-Za-zÀ-ÖØ-öø-ÿ\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]", " "),
    ("[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+", " "),
)
LEAST_LETTERS = 40


def cleaned_for_language(c: Column) -> Column:
    """Latin letters and single spaces of a text, without code and links, stripped."""
    for pattern, by in _CLEANING:
        c = F.regexp_replace(c, pattern, by)
    return py_strip(c)


def letters(c: Column) -> Column:
    """How many letters a text has after cleaning."""
    return F.length(F.replace(cleaned_for_language(c), F.lit(" "), F.lit("")))


def detected(c: Column, detector=None) -> Column:
    """Language of a text by a detector column function, or why there is none: too little text, or no detector."""
    if detector is None:
        return F.lit("langdetect_not_installed")
    return F.when(letters(c) < LEAST_LETTERS, "not_enough_text").otherwise(detector(cleaned_for_language(c)))


def first_prompt(msgs: Column) -> Column:
    """Text of the first user message in the lenient sense, else of the first message, else ''."""
    user = F.get(F.filter(msgs, lambda m: lenient_role(m).rlike(USER_ROLES)), F.lit(0))
    return F.coalesce(F.when(user.isNotNull(), lenient_text(user)), F.when(F.get(msgs, F.lit(0)).isNotNull(), lenient_text(F.get(msgs, F.lit(0)))), F.lit(""))


def tagged(raw: DataFrame, detector=None) -> DataFrame:
    """(source_file, source_row_position, model, conversation_id, removed_at): the step that removes each record, null if none.

    Records with a blank id, and those with a blank prompt, are never duplicates. A record is first by its place.
    """
    msgs = flat(F.col("conversation"))
    checked = F.filter("_m", lambda m: ~is_blank(lenient_text(m)))
    rows = raw.select("source_file", "source_row_position", "model", "conversation_id", "turn", "snippet_turns", msgs.alias("_m"))
    prompt = first_prompt(F.col("_m"))
    none = F.coalesce(F.size(checked), F.lit(0)) == 0
    compatible = F.forall(checked, lambda m: detected(lenient_text(m), detector).isin("en", "not_enough_text", "langdetect_not_installed"))
    light = rows.select(
        "source_file", "source_row_position", "model", "conversation_id",
        F.when(~is_blank(prompt), prompt_hash(prompt)).alias("_hash"),
        F.coalesce(F.col("turn") == 1, F.lit(False)).alias("_single"),
        F.coalesce(F.array_contains("snippet_turns", 1), F.lit(False)).alias("_snippet"),
        structure_flags(F.col("_m"))["structurally_valid"].alias("_valid"),
        F.coalesce(~none & F.forall(checked, lambda m: is_english_notebook(m["language"])), F.lit(False)).alias("_english"),
        F.coalesce(~none & compatible, F.lit(False)).alias("_detected"),
    )
    checkpoint_dir(raw.sparkSession)
    light = light.checkpoint()  # flags and hashes only: conversations are read once for all steps
    has_id = ~is_blank(F.col("conversation_id"))
    by_id = _mark(light, light.where(has_id), "conversation_id", "_first_id")
    stays = ~has_id | F.col("_first_id")
    by_prompt = _mark(by_id, by_id.where(stays & F.col("_hash").isNotNull()), "_hash", "_first_prompt")
    removed = (
        F.when(~stays, STEPS[0])
        .when(F.col("_hash").isNotNull() & ~F.col("_first_prompt"), STEPS[1])
        .when(~F.col("_single"), STEPS[2])
        .when(~F.col("_snippet"), STEPS[3])
        .when(~F.col("_valid"), STEPS[4])
        .when(~F.col("_english"), STEPS[5])
        .when(~F.col("_detected"), STEPS[6])
    )
    return by_prompt.select("source_file", "source_row_position", "model", "conversation_id", removed.alias("removed_at"))


def _mark(rows: DataFrame, among: DataFrame, key: str, flag: str) -> DataFrame:
    first = survivors(among, key, "keep_first").select(F.col("source_file").alias("_f"), F.col("source_row_position").alias("_p"))
    same = (F.col("source_file") == F.col("_f")) & (F.col("source_row_position") == F.col("_p"))
    return rows.join(first, same, "left").withColumn(flag, F.col("_f").isNotNull()).drop("_f", "_p")


def funnel(tags: DataFrame) -> DataFrame:
    """(step_no, step, n_before, n_after, n_removed, step_share, total_share): all steps from one aggregate pass."""
    n = tags.agg(F.count("*").alias("_total"), *[F.count_if(F.col("removed_at") == s).alias(s) for s in STEPS])
    gone = [F.lit(0).cast("long")]
    for s in STEPS:
        gone.append(gone[-1] + F.col(s))
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_no"), F.lit(s).alias("step"), (F.col("_total") - gone[i]).alias("n_before"), (F.col("_total") - gone[i + 1]).alias("n_after"), F.col(s).alias("n_removed"),
                F.try_divide((F.col("_total") - gone[i + 1]).cast("double"), F.col("_total") - gone[i]).alias("step_share"),
                F.try_divide((F.col("_total") - gone[i + 1]).cast("double"), F.col("_total")).alias("total_share"),
            )
            for i, s in enumerate(STEPS)
        ]
    )
    return n.select(F.explode(rows).alias("r")).select("r.*")


def size_summary(tags: DataFrame) -> DataFrame:
    """(metric, value): rows before and after, removed, kept share in percent, models before and after."""
    kept = F.col("removed_at").isNull()
    n = tags.agg(
        F.count("*").alias("a"), F.count_if(kept).alias("b"), F.count_if(~kept).alias("c"),
        F.count_distinct("model").alias("e"), F.count_distinct(F.when(kept, F.col("model"))).alias("f"),
    )
    pairs = {"rows_before": "a", "rows_after": "b", "rows_removed": "c", "models_before": "e", "models_after": "f"}
    cells = [F.struct(F.lit(k).alias("metric"), F.col(v).cast("double").alias("value")) for k, v in pairs.items()]
    cells.append(F.struct(F.lit("kept_percent").alias("metric"), F.try_divide(F.col("b") * F.lit(100.0), F.col("a")).alias("value")))
    return n.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
