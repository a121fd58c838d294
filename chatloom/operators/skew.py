"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows on; so there are at most 1 / HEAVY_SHARE heavy keys, whatever the size.
HEAVY_SHARE = 0.01
SALTS = 64


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """The non-null values of ``key`` that hold at least ``share`` of all rows, as (key_value, n_rows).

    Exact: one count per key, combined before the shuffle, so a heavy key sends one row per task.
    At most 1/share rows come out, which bounds a broadcast of them. Empty input gives no rows.
    """
    counts = df.groupBy(F.col(key).alias("key_value")).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("n_total"))
    return counts.where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * total.scalar()))


def salted_aggregate(
    df: DataFrame,
    key: str,
    sums: dict[str, Column],
    spread_by: Column,
    share: float = HEAVY_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Sums per value of ``key`` by two-stage salted aggregation, as (key_value, *sums).

    Rows of heavy keys get a salt of ``salts`` values from a hash of ``spread_by``; partial sums are made per
    (key, salt) and merged per key. The salt is a hash, not a random number, so a task that is run again after
    an executor was lost sends each row where it went before. Null is a key of its own, salted like a heavy one.
    Nulls in a summed column count as 0; keys come out once each; empty input gives no rows.
    """
    heavy = heavy_keys(df, key, share).select("key_value", F.lit(True).alias("_heavy"))
    rows = df.select(F.col(key).alias("key_value"), spread_by.alias("_by"), *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in sums.items()])
    rows = rows.join(F.broadcast(heavy), "key_value", "left")
    salt = F.when(F.col("_heavy") | F.col("key_value").isNull(), F.pmod(F.xxhash64("_by"), F.lit(salts))).otherwise(F.lit(0))
    partial = rows.withColumn("_salt", salt).groupBy("key_value", "_salt").agg(*[F.sum(n).alias(n) for n in sums])
    return partial.groupBy("key_value").agg(*[F.sum(n).alias(n) for n in sums])


def keys_of_share(per_key: DataFrame, n_rows: str, one_in: int) -> DataFrame:
    """Of per-key results, the non-null keys with at least one row in ``one_in`` of all."""
    total = per_key.agg(F.sum(n_rows).alias("n_total"))
    return per_key.where(F.col("key_value").isNotNull() & (F.col(n_rows) * one_in >= total.scalar()))
