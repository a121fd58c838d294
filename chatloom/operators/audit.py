"""The tables that tell how a corpus was filtered step by step: what went, why, and what duplicates are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import detect
from ..functions.pytext import is_blank, is_english_notebook, prompt_hash, py_strip
from ..session import checkpoint_dir
from ..sources import sinks
from . import funnel, profile
from .messages import USER_ROLES, flat, lenient_role, lenient_text, structure_flags

PLACE = ("source_file", "source_row_position")


def message_labels(raw: DataFrame, *keep: str) -> DataFrame:
    """Every message with text: (*keep, message_position, role, label, label_is_english, text, cleaned, n_letters, detected)."""
    m = F.col("m")
    role = F.when(lenient_role(m) == "", "role_missing").otherwise(lenient_role(m))
    rows = raw.select(*keep, F.posexplode(flat(F.col("conversation"))).alias("message_position", "m"))
    rows = rows.select(*keep, "message_position", role.alias("role"), py_strip(m["language"]).alias("label"), is_english_notebook(m["language"]).alias("label_is_english"), lenient_text(m).alias("text")).where(~is_blank(F.col("text")))
    return rows.select("*", funnel.cleaned_for_language(F.col("text")).alias("cleaned"), funnel.letters(F.col("text")).alias("n_letters"), funnel.detected(F.col("text"), detect).alias("detected"))


def label_failures(raw: DataFrame, *keep: str) -> DataFrame:
    """(*keep, message_position, role, label, preview): messages whose label is not English."""
    return message_labels(raw, *keep).where(~F.col("label_is_english")).select(*keep, "message_position", "role", "label", F.substring("text", 1, 250).alias("preview"))


def detection_failures(raw: DataFrame, *keep: str) -> DataFrame:
    """(*keep, message_position, role, label, detected, n_letters, preview, cleaned_preview): messages detected as another language, or as none."""
    rows = message_labels(raw, *keep).where(~F.col("detected").isin("en", "not_enough_text"))
    return rows.select(*keep, "message_position", "role", "label", "detected", "n_letters", F.substring("text", 1, 250).alias("preview"), F.substring("cleaned", 1, 250).alias("cleaned_preview"))


def short_user_prompts(raw: DataFrame, *keep: str) -> DataFrame:
    """(*keep, message_position, role, label, n_letters, preview, cleaned_preview): user messages too short for a detector, in records all of whose other messages pass it."""
    bad = F.exists(F.filter(flat(F.col("conversation")), lambda m: ~is_blank(lenient_text(m))), lambda m: ~funnel.detected(lenient_text(m), detect).isin("en", "not_enough_text"))
    rows = message_labels(raw.where(~F.coalesce(bad, F.lit(False))), *keep).where((F.col("detected") == "not_enough_text") & F.col("role").rlike(USER_ROLES))
    return rows.select(*keep, "message_position", "role", "label", "n_letters", F.substring("text", 1, 250).alias("preview"), F.substring("cleaned", 1, 250).alias("cleaned_preview"))


def rounded(table: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    """``table`` with shares as percent, rounded half up."""
    return table.withColumns({c: F.round(F.col(c) * 100, digits) for c in columns})


def examples(raw: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` records in corpus order: a look at the structure."""
    return raw.orderBy(*PLACE).limit(n)


def tables(raw: DataFrame) -> dict[str, DataFrame]:
    """All audit tables by name; ``raw`` is a canonical corpus with places. Tags are made once and checkpointed, without texts."""
    checkpoint_dir(raw.sparkSession)
    tags = funnel.tagged(raw, detect).checkpoint()
    mark = tags.select(F.col("source_file").alias("_f"), F.col("source_row_position").alias("_p"), "removed_at")
    told = raw.join(mark, (raw["source_file"] == F.col("_f")) & (raw["source_row_position"] == F.col("_p")), "left").drop("_f", "_p")
    prompt = funnel.first_prompt(flat(F.col("conversation")))
    light = told.select(*PLACE, "conversation_id", "model", "turn", "snippet_turns", F.substring(prompt, 1, 300).alias("first_user_prompt_preview"), F.when(~is_blank(prompt), prompt_hash(prompt)).alias("prompt_key"), "removed_at").checkpoint()

    def at(step: str) -> Column:
        return F.coalesce(F.col("removed_at") == step, F.lit(False))

    details = [*PLACE, "conversation_id", "model", "turn", "snippet_turns", "first_user_prompt_preview"]

    def duplicates(rows: DataFrame, key: str, name: str) -> dict[str, DataFrame]:
        valid = rows.where(F.col(key).isNotNull() & (F.length(key) > 0))
        return {f"{name}_groups": profile.duplicate_groups(valid, F.col(key)), f"{name}_records": profile.duplicate_records(valid, key, [c for c in details if c != key])}

    ids, prompts, kept = F.lit(True), ~at(funnel.STEPS[0]), F.col("removed_at").isNull()
    out = {
        "filtering_steps_summary": rounded(funnel.funnel(tags), "step_share", "total_share"),
        "filtered_dataset_size_summary": funnel.size_summary(tags).withColumn("value", F.round("value", 2)),
        "removed_duplicate_records_by_id": light.where(at(funnel.STEPS[0])).select(*details),
        "removed_duplicate_records_by_first_user_prompt": light.where(at(funnel.STEPS[1])).select(*details),
        "removed_structural_problem_records": told.where(at(funnel.STEPS[4])).select(*PLACE, "conversation_id", *[c.alias(k) for k, c in structure_flags(flat(F.col("conversation"))).items()]),
        "removed_non_english_by_language_label_records": label_failures(told.where(at(funnel.STEPS[5])), *PLACE, "conversation_id"),
        "removed_non_english_by_detection_records": detection_failures(told.where(at(funnel.STEPS[6])), *PLACE, "conversation_id"),
        "detection_short_user_prompts_passed": short_user_prompts(told.where(kept), *PLACE, "conversation_id"),
    }
    for when, by_id, by_prompt in (("pre_filter", light.where(ids), light.where(prompts)), ("post_filter", light.where(kept), light.where(kept))):
        out |= duplicates(by_id, "conversation_id", f"{when}_duplicates_by_id") | duplicates(by_prompt, "prompt_key", f"{when}_duplicates_by_first_user_prompt")
    return out


def write_tables(raw: DataFrame, folder: str) -> list[str]:
    """Writes all audit tables as CSV with a header, and bar charts of the small ones; gives their names."""
    made = tables(raw)
    for name, table in made.items():
        sinks.write_csv(table, f"{folder}/{name}.csv")
    charts = {
        "filtering_funnel": funnel.funnel(funnel.tagged(raw, detect)).select(F.col("step").alias("value"), F.col("n_after").alias("n_rows"), "step_no").orderBy("step_no").drop("step_no"),
        "declared_languages": profile.label_counts(raw).where("role IS NULL").select(F.col("label").alias("value"), F.col("n_messages").alias("n_rows")).orderBy(F.desc("n_rows"), "value").limit(25),
        "models": profile.top_counts(raw, F.col("model")),
        "turns": profile.clipped_counts(raw, "turn").orderBy("value").limit(100),
    }
    for name, table in charts.items():
        sinks.write_bar_chart(table, f"{folder}/figures/{name}.svg", name.replace("_", " "))
    return list(made)
