"""The batch filter: metadata, decision and removal reason of every record."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import is_blank, label_script, prompt_hash, py_strip, try_int
from .messages import flat, users

METHODS = ("turn_column", "user_message_count", "both")
MODES = ("none", "keep_first", "drop_all")
#: So many positions of a file are ranked together.
BLOCK = 100_000
REASONS = ("KEPT", "NON_ENGLISH", "MULTI_TURN", "EMPTY_FIRST_PROMPT", "DUPLICATE_FIRST_PROMPT")


@dataclass(frozen=True)
class Policy:
    """Settings of the filter; as in the pipeline all filters are on and duplicates are dropped altogether."""

    filter_non_english: bool = True
    english_labels: tuple[str, ...] = field(default=("english", "en", "eng"))
    filter_multiturn: bool = True
    single_turn_method: str = "turn_column"
    drop_empty_first_prompt: bool = True
    duplicate_mode: str = "drop_all"

    def __post_init__(self):
        if self.single_turn_method not in METHODS:
            raise ValueError(f"Unknown single-turn method: {self.single_turn_method}")
        if self.duplicate_mode not in MODES:
            raise ValueError(f"Unknown duplicate mode: {self.duplicate_mode}")


def english_labels(text: str) -> tuple[str, ...]:
    """The labels of a comma-separated list in normal form, blanks left out."""
    return tuple(w.strip().lower().replace("_", "-").replace(" ", "-") for w in text.split(",") if w.strip())


def row_key(conversation_id: Column, source_file: Column, position: Column) -> Column:
    """The id itself where it isn't blank, not stripped; else file::position."""
    return F.when(~is_blank(conversation_id), conversation_id).otherwise(F.concat_ws("::", source_file, position.cast("string")))


def single_turn(method: str, turn: Column, n_users: Column) -> Column:
    by_turn = F.coalesce(try_int(turn) == 1, F.lit(False))
    by_users = F.coalesce(n_users == 1, F.lit(False))
    return {"turn_column": by_turn, "user_message_count": by_users, "both": by_turn & by_users}[method]


def metadata(raw: DataFrame, policy: Policy = Policy(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The 14 metadata columns of each record, and ``keep`` columns of ``raw`` besides.

    ``raw`` has conversation_id, model, turn, conversation, source_file and source_row_position. A record without
    a user message has the prompt and the label ''. Null conversations and null contents count the same.
    """
    rows = raw.select(*keep, "conversation_id", "model", "turn", "source_file", "source_row_position", users(flat(F.col("conversation"))).alias("_u"))
    rows = rows.withColumns(
        {
            "_prompt": F.coalesce(F.get("_u", F.lit(0))["content"], F.lit("")),
            "_label": F.coalesce(F.get("_u", F.lit(0))["language"], F.lit("")),
        }
    )
    normal = label_script(F.col("_label"))
    return rows.select(
        *keep,
        row_key(F.col("conversation_id"), F.col("source_file"), F.col("source_row_position")).alias("row_key"),
        "conversation_id",
        "source_file",
        "source_row_position",
        F.col("model").alias("source_model"),
        "turn",
        prompt_hash(F.col("_prompt")).alias("first_user_prompt_hash"),
        F.length("_prompt").alias("first_user_prompt_length"),
        (py_strip(F.col("_prompt")) == "").alias("first_user_prompt_empty"),
        F.substring("_prompt", 1, 300).alias("first_user_prompt_preview"),
        F.col("_label").alias("first_user_language_label"),
        normal.alias("first_user_language_normalized"),
        normal.isin(*policy.english_labels).alias("language_is_english"),
        single_turn(policy.single_turn_method, F.col("turn"), F.size("_u")).alias("single_turn"),
    )


def survivors(rows: DataFrame, key: str, mode: str, order: tuple[str, ...] = ("source_file", "source_row_position")) -> DataFrame:
    """The places (``order``) of the rows that stay when rows of equal ``key`` are reduced: the first, or lone ones only.

    One aggregate, combined before its shuffle: however many rows share a key, each task sends one for it.
    """
    first = F.min(F.struct(*order)).alias("_first")
    groups = rows.groupBy(key).agg(first, F.count("*").alias("_n"))
    if mode == "drop_all":
        groups = groups.where("_n = 1")
    return groups.select(*[F.col(f"_first.{c}").alias(c) for c in order])


def decide(meta: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Metadata with the four keep flags, keep_final and removal_reason.

    Each flag is computed on all rows; that of a filter that is off is true. Duplicates are sought among the rows
    that pass the other filters only, and the flag is false for all others, unless the mode is ``none``. The
    reason is the first filter that fails. Places (source_file, source_row_position) are unique in a corpus; the
    decision comes back by place, not by hash, so that a prompt that a third of all rows share is no hot key.
    """
    on = {
        "keep_after_language_filter": F.col("language_is_english") if policy.filter_non_english else F.lit(True),
        "keep_after_turn_filter": F.col("single_turn") if policy.filter_multiturn else F.lit(True),
        "keep_after_empty_prompt_filter": ~F.col("first_user_prompt_empty") if policy.drop_empty_first_prompt else F.lit(True),
    }
    rows = meta.withColumns(on)
    before = F.col("keep_after_language_filter") & F.col("keep_after_turn_filter") & F.col("keep_after_empty_prompt_filter")
    if policy.duplicate_mode == "none":
        rows = rows.withColumn("keep_after_duplicate_filter", F.lit(True))
    else:
        kept = survivors(rows.where(before), "first_user_prompt_hash", policy.duplicate_mode)
        kept = kept.select(F.col("source_file").alias("_f"), F.col("source_row_position").alias("_p"))
        same = (F.col("source_file") == F.col("_f")) & (F.col("source_row_position") == F.col("_p"))
        rows = rows.join(kept, same, "left").withColumn("keep_after_duplicate_filter", before & F.col("_f").isNotNull()).drop("_f", "_p")
    reason = (
        F.when(~F.col("keep_after_language_filter"), "NON_ENGLISH")
        .when(~F.col("keep_after_turn_filter"), "MULTI_TURN")
        .when(~F.col("keep_after_empty_prompt_filter"), "EMPTY_FIRST_PROMPT")
        .when(~F.col("keep_after_duplicate_filter"), "DUPLICATE_FIRST_PROMPT")
        .otherwise("KEPT")
    )
    return rows.withColumn("keep_final", before & F.col("keep_after_duplicate_filter")).withColumn("removal_reason", reason)


def filtered(raw: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The kept records: all columns of ``raw`` and the five provenance columns.

    The decision is made on light columns; whole records meet it in a semi-join by place.
    """
    return kept_records(raw, decide(metadata(raw, policy), policy))


def kept_records(raw: DataFrame, decisions: DataFrame) -> DataFrame:
    """``filtered`` for decisions that were made, or read back, before."""
    kept = decisions.where("keep_final").select(
        F.col("source_file").alias("_f"), F.col("source_row_position").alias("_p"),
        F.col("first_user_prompt_hash").alias("prompt_hash"), F.col("first_user_language_label").alias("_first_user_language_label"), F.col("removal_reason").alias("_filter_removal_reason"),
    )
    same = (raw["source_file"] == F.col("_f")) & (raw["source_row_position"] == F.col("_p"))
    return raw.join(kept, same).select(
        *[raw[c] for c in raw.columns],
        F.col("_f").alias("_filter_source_file"),
        F.col("_p").alias("_filter_source_row_position"),
        "prompt_hash",
        "_first_user_language_label",
        "_filter_removal_reason",
    )


def shards(kept: DataFrame, rows_per_file: int) -> DataFrame:
    """(shard_no and the place of each kept record): contiguous runs of ``rows_per_file`` records in corpus order.

    Ranks come from counts per block of BLOCK positions of a file and from windows within a block, so that a file that
    holds a third of all rows is split; what one task sums up is a row per block.
    """
    from pyspark.sql import Window

    rows = kept.select("source_file", "source_row_position", F.floor(F.col("source_row_position") / BLOCK).alias("_block"))
    ranked = rows.select("*", (F.row_number().over(Window.partitionBy("source_file", "_block").orderBy("source_row_position")) - 1).cast("long").alias("_rank"))
    sizes = rows.groupBy("source_file", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("source_file", "_block")) - F.col("_n")
    starts = sizes.select(F.col("source_file").alias("_f"), F.col("_block").alias("_b"), before.alias("_start"))
    place = ranked.join(starts, (F.col("source_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return place.select("source_file", "source_row_position", F.floor((F.col("_start") + F.col("_rank")) / rows_per_file).cast("long").alias("shard_no"))


def counts(decisions: DataFrame, column: str, name: str = "n_rows") -> DataFrame:
    """Rows per value of ``column``, null included: (value as text, count)."""
    return decisions.groupBy(F.col(column).cast("string").alias(column)).agg(F.count("*").alias(name))


def summary(decisions: DataFrame) -> DataFrame:
    """One row: totals and distinct prompts before and after."""
    return decisions.agg(
        F.count("*").alias("total_records"),
        F.count_if("keep_final").alias("kept_records"),
        F.count_if(~F.col("keep_final")).alias("removed_records"),
        F.count_distinct("first_user_prompt_hash").alias("unique_prompt_hashes_before_filtering"),
        F.count_distinct(F.when(F.col("keep_final"), F.col("first_user_prompt_hash"))).alias("unique_prompt_hashes_after_filtering"),
    )
