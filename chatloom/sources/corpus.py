"""Scans of a corpus: a folder of parquet files in the order of their names, with the place of every record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,content:string,language:string>"
CORPUS = {
    "conversation_id": "string",
    "model": "string",
    "conversation": f"array<array<{MESSAGE}>>",
    "turn": "int",
    "snippet_turns": "array<int>",
}


def files(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """Paths of the files of a folder with ``suffix``, by name; deeper folders, such as reports, are not entered."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.isFile()]
    return [p.toString() for p in sorted(found, key=lambda p: p.getName()) if p.getName().endswith(suffix)]


def choose(paths: list[str], file: str | None = None, start: str | None = None, end: str | None = None, max_files: int | None = None) -> list[str]:
    """Of paths in order: one named file, or an inclusive range of names, and of those the first ``max_files``.

    Paths that aren't chosen are never read. Nothing left raises FileNotFoundError.
    """

    def name(p: str) -> str:
        return p.rstrip("/").rpartition("/")[2]

    out = [p for p in paths if file is None or name(p) == file]
    out = [p for p in out if (start is None or name(p) >= start) and (end is None or name(p) <= end)]
    out = out[:max_files] if max_files is not None else out
    if not out:
        raise FileNotFoundError("No parquet files found in the input")
    return out


def scan(spark: SparkSession, folder: str, max_rows_per_file: int | None = None, **which) -> DataFrame:
    """The corpus with its canonical columns and places (source_file, source_row_position).

    Places come from the files, whatever columns of these names they hold. Columns that files lack are null,
    columns beyond the canonical ones are kept; a scalar or differently named snippet column becomes an array. ``max_rows_per_file`` is a filter on the position within a file.
    """
    df = spark.read.parquet(*choose(files(spark, folder), **which))
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("source_file", "source_row_position")]
    df = df.select(*own, F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row_position"))
    if max_rows_per_file is not None:
        df = df.where(F.col("source_row_position") < max_rows_per_file)
    return canonical(df)


def canonical(df: DataFrame) -> DataFrame:
    """``df`` with all columns of CORPUS in their types; unknown columns stay as they are."""
    kinds = dict(df.dtypes)
    if "snippet_turns" not in kinds and "snippet_turn" in kinds:
        df, kinds = df.withColumnRenamed("snippet_turn", "snippet_turns"), {**kinds, "snippet_turns": kinds["snippet_turn"]}
    for name, kind in CORPUS.items():
        if name not in kinds:
            df = df.withColumn(name, F.lit(None).cast(kind))
        elif name == "snippet_turns" and not kinds[name].startswith("array"):
            one = F.col(name).try_cast("int")
            df = df.withColumn(name, F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<int>")))
        elif name == "snippet_turns" and kinds[name] != kind:
            df = df.withColumn(name, F.filter(F.transform(name, lambda x: x.try_cast("int")), lambda x: x.isNotNull()))
        elif name == "conversation" and kinds[name] == "string":
            df = df.withColumn(name, conversation_of_json(F.col(name)))
        elif name == "conversation" and kinds[name].startswith("array<struct"):
            df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.array(name)))
        elif name == "turn" and kinds[name] not in ("int", "bigint"):
            df = df.withColumn(name, F.col(name).try_cast("int"))
    return df


def conversation_of_json(text) -> F.Column:
    """A conversation held as JSON text: nested list, flat list or one message; null for anything else.

    Deeper nesting and lists wrapped in objects are for operators.extract.normalize.
    """
    nested = F.from_json(text, F.lit(f"array<array<{MESSAGE}>>"))
    flat = F.from_json(text, F.lit(f"array<{MESSAGE}>"))
    one = F.from_json(text, F.lit(MESSAGE))
    has = lambda m: m["role"].isNotNull() | m["content"].isNotNull()
    return F.when(F.exists(F.flatten(nested), has), nested).when(F.exists(flat, has), F.array(flat)).when(has(one), F.array(F.array(one)))


def union(splits: list[DataFrame]) -> DataFrame:
    """All splits as one table, columns by name; one that a split lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), splits)


def done_keys(spark: SparkSession, path: str) -> DataFrame:
    """(processing_key) of a JSONL log: blank, malformed and non-object lines and empty keys are passed over.

    A log that isn't there gives no keys; a key that was logged twice comes out twice.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "processing_key string")
    log = spark.read.schema("processing_key string").option("mode", "DROPMALFORMED").json(path)
    return log.where("coalesce(processing_key, '') <> ''")


def pending(records: DataFrame, done: DataFrame, key: str = "processing_key") -> DataFrame:
    """The records whose key isn't among ``done``; repeated keys among the records all stay."""
    return records.join(done.select(F.col("processing_key").alias(key)), key, "left_anti")
