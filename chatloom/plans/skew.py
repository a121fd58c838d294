"""Problem 4: per-value results of skewed columns, and the values that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.messages import flat
from ..operators.skew import keys_of_share, salted_aggregate
from ..sources.tables import table

#: A value is heavy in the result from one row in so many on.
ONE_IN = 20


def model_results(spark: SparkSession, folder: str, light: bool = False) -> DataFrame:
    """Rows, messages and characters per model of raw_corpus; ``light``: rows only."""
    raw = table(spark, folder, "raw_corpus")
    sums = {"n_rows": F.lit(1)}
    if not light:
        msgs = flat(F.col("conversation"))
        sums["n_messages"] = F.size(msgs)
        sums["n_chars"] = F.aggregate(msgs, F.lit(0).cast("long"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))
    return salted_aggregate(raw, "model", sums, F.col("row_id"))


def category_results(spark: SparkSession, folder: str, light: bool = False) -> DataFrame:
    """Rows and characters per task_category of enriched_records; every record is one message."""
    sums = {"n_rows": F.lit(1)}
    if not light:
        sums |= {"n_messages": F.lit(1), "n_chars": F.length("user_prompt_original")}
    return salted_aggregate(table(spark, folder, "enriched_records"), "task_category", sums, F.col("log_line"))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(column_name, key_value, n_rows, n_messages, n_chars) of all values; the null value included."""
    a = model_results(spark, folder).select(F.lit("raw_corpus.model").alias("column_name"), "*")
    b = category_results(spark, folder).select(F.lit("enriched_records.task_category").alias("column_name"), "*")
    return a.unionByName(b)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """(column_name, key_value): the non-null values with at least one twentieth of all rows of their table."""
    a = keys_of_share(model_results(spark, folder, light=True), "n_rows", ONE_IN).select(F.lit("raw_corpus.model").alias("column_name"), "key_value")
    b = keys_of_share(category_results(spark, folder, light=True), "n_rows", ONE_IN).select(F.lit("enriched_records.task_category").alias("column_name"), "key_value")
    return a.unionByName(b)


QUERIES = {"p4_found": found, "p4_results": results}

ORACLES = {
    "p4_found": """
SELECT 'raw_corpus.model' AS column_name, model AS key_value FROM raw_corpus WHERE model IS NOT NULL
GROUP BY model HAVING count(*) * 20 >= (SELECT count(*) FROM raw_corpus)
UNION ALL
SELECT 'enriched_records.task_category', task_category FROM enriched_records WHERE task_category IS NOT NULL
GROUP BY task_category HAVING count(*) * 20 >= (SELECT count(*) FROM enriched_records)
""",
    "p4_results": """
SELECT 'raw_corpus.model' AS column_name, model AS key_value, count(*) AS n_rows,
       CAST(sum(coalesce(len(m), 0)) AS BIGINT) AS n_messages,
       CAST(sum(coalesce(list_sum(list_transform(m, lambda x: coalesce(length(x.content), 0))), 0)) AS BIGINT) AS n_chars
FROM (SELECT model, flatten(list_filter(conversation, lambda t: t IS NOT NULL)) AS m FROM raw_corpus) GROUP BY model
UNION ALL
SELECT 'enriched_records.task_category', task_category, count(*), count(*), CAST(sum(coalesce(length(user_prompt_original), 0)) AS BIGINT)
FROM enriched_records GROUP BY task_category
""",
}
