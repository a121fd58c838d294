"""Problem 1: records that differ only in white space, letter case, punctuation or field order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.messages import flat, nth_user
from ..session import checkpoint_dir

#: A canonical key is hot from this share of all rows on; so at most 1 / HOT_SHARE hot keys are broadcast.
HOT_SHARE = 0.001
SALTS = 64
_MESSAGE = "struct<role:variant,content:variant,language:variant>"


def letters_and_digits(c: Column) -> Column:
    """The letters and digits of a text in order, case ignored: sharp s equals ss, a final sigma any sigma."""
    return F.regexp_replace(F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ"), r"[^\p{L}\p{N}]", "")


def prompt_key(conversation: Column) -> Column:
    """Canonical key of the first user prompt: null for no prompt, a null one, and one without letter or digit."""
    text = letters_and_digits(nth_user(flat(conversation))["content"])
    return F.when(text != "", F.unhex(F.sha2(text, 256)))


def payload_key(payload: Column) -> Column:
    """Canonical key of a whole JSON record, the same for every field order and encoding of its messages.

    Read are conversation_id, model, turn and the messages, held as a nested list, a flat list or JSON text of
    either. A missing or null value equals a blank one. Unreadable JSON and records without a list of messages
    give null.
    """
    record = F.try_parse_json(payload)

    def text(v: Column, path: str) -> Column:
        return letters_and_digits(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))

    held = F.try_variant_get(record, "$.conversation", "variant")
    is_text = F.schema_of_variant(held) == "STRING"
    messages = F.when(is_text, F.try_parse_json(F.try_variant_get(record, "$.conversation", "string"))).otherwise(held)
    turns = F.try_variant_get(messages, "$", "array<variant>")
    # a turn that is no list is a message of a flat list
    nested = F.flatten(F.transform(turns, lambda t: F.coalesce(F.try_variant_get(t, "$", "array<variant>"), F.array(t))))
    parts = F.transform(nested, lambda m: F.concat_ws("\u001f", text(m, "$.role"), text(m, "$.content"), text(m, "$.language")))
    head = F.concat_ws("\u001f", text(record, "$.conversation_id"), text(record, "$.model"), text(record, "$.turn"))
    return F.when(parts.isNotNull(), F.unhex(F.sha2(F.concat_ws("\u001e", head, F.array_join(parts, "\u001e")), 256)))


def hot_keys(rows: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """Exact hot keys by partial counts: the keys that hold at least ``share`` of the rows, never more than 1/share."""
    counts = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.where((F.col("_n") > 1) & (F.col("_n") >= F.lit(share) * total.scalar())).select("_key")


def keyed(df: DataFrame, id_column: str, key: Column) -> DataFrame:
    """(_id, _key) of the rows that have both, written to the checkpoint folder: texts are read and keyed once."""
    checkpoint_dir(df.sparkSession)
    return df.select(F.col(id_column).cast("long").alias("_id"), key.alias("_key")).where("_key IS NOT NULL AND _id IS NOT NULL").checkpoint()


def collapse(df: DataFrame, id_column: str, key: Column, share: float = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """One row per group of equal canonical keys: (key, first_id, n_copies), first_id the smallest id.

    Hot keys, found exactly with partial counts, are aggregated in two levels by a salt from a hash of the id;
    all others by one shuffle. Rows with a null key are left out; repeated ids count as copies each; an empty
    table gives no groups. Other columns of ``df`` are not read, whatever their names.
    """
    rows = keyed(df, id_column, key)
    return _groups(rows, F.broadcast(hot_keys(rows, share).checkpoint()), salts).withColumnRenamed("_key", "key")


def _groups(rows: DataFrame, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    heavy = rows.join(hot, "_key", "left_semi").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    two = (
        heavy.groupBy("_key", "_salt").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .groupBy("_key").agg(F.min("_first").alias("first_id"), F.sum("_n").alias("n_copies"))
    )
    one = rows.join(hot, "_key", "left_anti").groupBy("_key").agg(F.min("_id").alias("first_id"), F.count("*").alias("n_copies"))
    return two.unionByName(one)


def copies(df: DataFrame, id_column: str, key: Column, share: float = HOT_SHARE) -> DataFrame:
    """Each record that is not its group's representative: (first_id, copy_id), distinct.

    Rows of hot groups meet their representative in a broadcast join of at most 1/share rows, so that no group
    is gathered in one task; those of other groups in a join on the key.
    """
    rows = keyed(df, id_column, key)
    hot = F.broadcast(hot_keys(rows, share).checkpoint())  # counted once, at most 1/share rows
    groups = _groups(rows, hot).where("n_copies > 1").select("_key", "first_id").checkpoint()  # aggregated once for both joins
    of_hot = rows.join(hot, "_key", "left_semi").join(F.broadcast(groups.join(hot, "_key", "left_semi")), "_key")
    of_rest = rows.join(hot, "_key", "left_anti").join(groups.join(hot, "_key", "left_anti"), "_key")
    both = of_hot.unionByName(of_rest).where("_id <> first_id")
    return both.select("first_id", F.col("_id").alias("copy_id")).distinct()


def found(raw: DataFrame, payloads: DataFrame) -> DataFrame:
    """(table_name, first_id, copy_id) for the prompts of raw_corpus and the records of raw_payloads."""
    a = copies(raw, "row_id", prompt_key(F.col("conversation"))).select(F.lit("raw_corpus").alias("table_name"), "*")
    b = copies(payloads, "payload_id", payload_key(F.col("payload"))).select(F.lit("raw_payloads").alias("table_name"), "*")
    return a.unionByName(b)


def groups(raw: DataFrame, payloads: DataFrame) -> DataFrame:
    """One record per group with its number of copies: (table_name, first_id, n_copies)."""
    a = collapse(raw, "row_id", prompt_key(F.col("conversation"))).select(F.lit("raw_corpus").alias("table_name"), "first_id", "n_copies")
    b = collapse(payloads, "payload_id", payload_key(F.col("payload"))).select(F.lit("raw_payloads").alias("table_name"), "first_id", "n_copies")
    return a.unionByName(b)
