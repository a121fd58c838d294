"""Profiles of a table: missing values, cardinalities, duplicates, distributions, nested keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pytext import is_blank, is_missing, py_strip
from .messages import flat, messages
from .skew import heavy_keys

EXPECTED = ("conversation_id", "model", "conversation", "turn", "snippet_turns")
PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def schema_summary(df: DataFrame, expected: tuple[str, ...] = EXPECTED) -> DataFrame:
    """(column_name, column_type, is_expected) of a table's columns."""
    rows = [(f.name, f.dataType.simpleString(), f.name in expected) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, is_expected boolean")


def size_summary(df: DataFrame, expected: tuple[str, ...] = EXPECTED) -> DataFrame:
    """(metric, value): rows, columns, and expected columns present, missing and unexpected ones."""
    have = set(df.columns)
    fixed = {"n_columns": len(have), "n_expected_present": len(have & set(expected)), "n_unexpected": len(have - set(expected)), "n_expected_missing": len(set(expected) - have)}
    cells = [F.struct(F.lit("n_rows").alias("metric"), F.col("n").alias("value")), *[F.struct(F.lit(k).alias("metric"), F.lit(v).cast("long").alias("value")) for k, v in fixed.items()]]
    return df.agg(F.count("*").alias("n")).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def missing_values(df: DataFrame) -> DataFrame:
    """(column_name, n_missing, missing_percent) of all columns in one pass; an empty table has null percents."""
    n = df.agg(F.count("*").alias("_n"), *[F.count_if(is_missing(F.col(f"`{c}`"), t)).alias(f"_{i}") for i, (c, t) in enumerate(df.dtypes)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_missing"), F.try_divide(F.col(f"_{i}") * F.lit(100.0), F.col("_n")).alias("missing_percent")) for i, c in enumerate(df.columns)]
    return n.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def _named(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(name, v): the named values of every row, so that one scan and one grouping serve all of them."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("v")) for k, v in values.items()])).alias("x")).select("x.*")


def _for_all(df: DataFrame, names: list[str], told: DataFrame) -> DataFrame:
    # a name without rows, as in an empty table, has zeros
    known = df.sparkSession.createDataFrame([(n,) for n in names], "_name string")
    return known.join(told, F.col("_name") == F.col("name"), "left")


def cardinality(df: DataFrame, columns: list[str], duplicates_of: str | None = None) -> DataFrame:
    """(column_name, n_distinct, n_null, n_duplicate): the last for one column only, rows less distinct values.

    The table is read once; values are counted by one grouping that is combined before its shuffle.
    """
    values = _named(df, {c: F.col(c) for c in columns}).groupBy("name", "v").agg(F.count("*").alias("n"))
    told = values.groupBy("name").agg(F.count("v").alias("d"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("e"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    duplicate = F.when(F.col("_name") == duplicates_of, F.coalesce("n", zero) - F.coalesce("d", zero)) if duplicates_of else F.lit(None).cast("long")
    return _for_all(df, columns, told).select(F.col("_name").alias("column_name"), F.coalesce("d", zero).alias("n_distinct"), F.coalesce("e", zero).alias("n_null"), duplicate.alias("n_duplicate"))


def memory_profile(df: DataFrame) -> DataFrame:
    """(column_name, column_type, n_filled, n_bytes): non-null values of each column and the bytes they hold: UTF-8 of texts, JSON of nested values, the width of numbers."""
    widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}

    def size(c: str, t: str) -> Column:
        col = F.col(f"`{c}`")
        held = F.octet_length(col) if t in ("string", "binary") else F.octet_length(F.to_json(col)) if t.startswith(("array", "map", "struct")) else F.lit(widths.get(t, 8))
        return F.coalesce(F.sum(F.when(col.isNotNull(), held)), F.lit(0)).cast("long")

    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)], *[size(c, t).alias(f"_b{i}") for i, (c, t) in enumerate(df.dtypes)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type"), F.col(f"_n{i}").alias("n_filled"), F.col(f"_b{i}").alias("n_bytes")) for i, (c, t) in enumerate(df.dtypes)]
    return n.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def duplicate_groups(df: DataFrame, key: Column, null_counts: bool = False) -> DataFrame:
    """(key_value, n_rows) of keys that occur more than once; null is a key only where asked."""
    rows = df.select(key.alias("key_value"))
    if not null_counts:
        rows = rows.where("key_value IS NOT NULL")
    return rows.groupBy("key_value").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def duplicate_summary(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, n_groups, n_rows) for each named key; null keys count, as hashes of null do. The table is read once for all of them."""
    groups = _named(df, checks).groupBy("name", "v").agg(F.count("*").alias("n")).where("n > 1")
    told = groups.groupBy("name").agg(F.count("*").alias("g"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    return _for_all(df, list(checks), told).select(F.col("_name").alias("check_name"), F.coalesce("g", zero).alias("n_groups"), F.coalesce("n", zero).alias("n_rows"))


def duplicate_records(df: DataFrame, key: str, place: list[str]) -> DataFrame:
    """All members of groups of more than one: (key_value, *place, n_rows).

    Groups of one are dropped after counts that were combined before their shuffle. Rows of heavy keys, of which a
    share bounds the number, meet their group's size in a broadcast join where they lie; all others in a join on the key.
    """
    groups = duplicate_groups(df, F.col(key))
    heavy = F.broadcast(groups.join(F.broadcast(heavy_keys(df, key).select("key_value")), "key_value", "left_semi").select(F.col("key_value").alias("_k"), "n_rows"))
    rows = df.where(F.col(key).isNotNull() & (F.length(key) > 0)).select(F.col(key).alias("key_value"), *place)
    same = F.col("key_value") == F.col("_k")
    of_heavy = rows.join(heavy, same)
    of_rest = rows.join(heavy, same, "left_anti").join(groups.select(F.col("key_value").alias("_k"), "n_rows"), same)
    return of_heavy.unionByName(of_rest).select("key_value", *place, "n_rows")


def record_hash(df: DataFrame) -> Column:
    """Grouping hash of a whole record: all columns as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def top_counts(df: DataFrame, value: Column, k: int = 20) -> DataFrame:
    """(value, n_rows) of the k most frequent non-null values as text; ties by the value."""
    rows = df.select(value.cast("string").alias("value")).where("value IS NOT NULL")
    return rows.groupBy("value").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "value").limit(k)


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, std, min, nine percentiles, max of a numeric column."""
    quantiles = F.percentile(column, F.array(*[F.lit(p) for p in PERCENTILES]))
    agg = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"), quantiles.alias("q"))
    return agg.select("n", "mean", "std", "min", *[F.col("q")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(PERCENTILES)], "max")


def clipped_counts(df: DataFrame, column: str, share: float = 0.99) -> DataFrame:
    """(value, n_rows) up to the percentile ``share``, at least 1, rounded up: bins of one for a histogram."""
    rows = df.where(F.col(column).isNotNull())
    top = rows.agg(F.greatest(F.lit(1), F.ceil(F.percentile(column, F.lit(share)))).alias("t"))
    return rows.where(F.col(column) <= top.scalar()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int = 50) -> DataFrame:
    """(bin_no, n_rows) of equal bins between lo and hi; values outside fall into 0 and bins + 1."""
    rows = df.where(F.col(column).isNotNull())
    return rows.groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).alias("bin_no")).agg(F.count("*").alias("n_rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n_rows) of the non-null values of a column."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))


def label_counts(raw: DataFrame) -> DataFrame:
    """(role, label, n_messages): messages by label, over all roles (role null) and by role, in one pass.

    Blank labels are left out; a blank role reads role_missing, a null one none.
    """
    role = F.lower(py_strip(F.coalesce("role", F.lit("none"))))
    m = messages(raw).select(F.when(role == "", "role_missing").otherwise(role).alias("r"), py_strip(F.col("language")).alias("label"))
    m = m.where(~is_blank(F.col("label")))
    each = m.groupBy("r", "label").agg(F.count("*").alias("n_messages"))
    every = each.groupBy("label").agg(F.sum("n_messages").alias("n_messages"))
    return each.select(F.col("r").alias("role"), "label", "n_messages").unionByName(every.select(F.lit(None).cast("string").alias("role"), "label", "n_messages"))


def _field(name: str):
    return lambda v: v[name]


def nested_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """(key_path, n_values): how often each path of nested columns has a value; list elements share a path.

    Paths come from the schema; the counts from one pass that sums per row before anything is shuffled.
    """
    paths: dict[str, Column] = {}

    def walk(path: str, kind: T.DataType, values: Column) -> None:
        # values: an array of all values at this path in a row
        if isinstance(kind, T.ArrayType):
            inner = F.flatten(F.filter(values, lambda v: v.isNotNull()))
            walk(f"{path}[]", kind.elementType, inner)
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                sub = F.transform(F.filter(values, lambda v: v.isNotNull()), _field(f.name))
                paths[f"{path}.{f.name}"] = F.size(F.filter(sub, lambda v: v.isNotNull()))
                walk(f"{path}.{f.name}", f.dataType, sub)

    for c in columns:
        paths[c] = F.when(F.col(c).isNotNull(), 1).otherwise(0)
        walk(c, df.schema[c].dataType, F.array(F.col(c)))
    keys = list(paths)
    n = df.select(*[p.alias(f"_{i}") for i, p in enumerate(paths.values())]).agg(*[F.coalesce(F.sum(F.greatest(F.col(f"_{i}"), F.lit(0))), F.lit(0)).alias(f"_{i}") for i in range(len(keys))])
    cells = [F.struct(F.lit(k).alias("key_path"), F.col(f"_{i}").cast("long").alias("n_values")) for i, k in enumerate(keys)]
    return n.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def shape_counts(raw: DataFrame) -> DataFrame:
    """(n_messages, n_rows): records by number of messages; no conversation counts as 0 messages."""
    n = F.coalesce(F.size(flat(F.col("conversation"))), F.lit(0))
    return raw.groupBy(F.greatest(n, F.lit(0)).alias("n_messages")).agg(F.count("*").alias("n_rows"))
