"""Sinks: sharded parquet, decision tables, summaries, JSON lines and CSV reports."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..session import checkpoint_dir
from .corpus import files


def guard(spark: SparkSession, folder: str, overwrite: bool, reads: str | None = None) -> str:
    """The write mode for ``folder``: raises FileExistsError where it holds parquet and mustn't be overwritten.

    Nothing is deleted here: the writer replaces the folder when it commits, after the input was read. A folder
    that is read can't be the one that is written.
    """
    if reads is not None and reads.rstrip("/") == folder.rstrip("/"):
        raise ValueError("The output folder is the input folder")
    if files(spark, folder) and not overwrite:
        raise FileExistsError(f"{folder} holds parquet files; pass overwrite to replace them")
    return "overwrite" if overwrite else "append"


def write_shards(kept: DataFrame, folder: str, rows_per_file: int = 10_000, mode: str = "overwrite", places: DataFrame | None = None) -> bool:
    """Kept records in corpus order as part_000.parquet, part_001.parquet and so on, exactly ``rows_per_file`` rows each but the last; False, and no file, for none.

    Numbers of shards come from light columns (``places``: source_file and source_row_position of what is kept, else
    taken from ``kept``); each shard is then written by one task and named when all are there.
    """
    spark = kept.sparkSession
    place = ("source_file", "source_row_position")
    checkpoint_dir(spark)
    numbers = dec.shards((places if places is not None else kept).select(*place), rows_per_file).checkpoint()
    if numbers.isEmpty():
        return False
    numbers = numbers.select(F.col("source_file").alias("_f"), F.col("source_row_position").alias("_p"), "shard_no")
    rows = kept.join(numbers, (kept["source_file"] == F.col("_f")) & (kept["source_row_position"] == F.col("_p"))).drop("_f", "_p")
    ordered = rows.repartition("shard_no").sortWithinPartitions("shard_no", *place)
    ordered.write.mode("overwrite").partitionBy("shard_no").parquet(f"{folder}/_shards")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    top = path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode == "overwrite":
        for old in files(spark, folder):
            fs.delete(path(old), False)
    for part in fs.listStatus(path(f"{folder}/_shards")):
        name = part.getPath().getName()
        if part.isDirectory() and name.startswith("shard_no="):
            (one,) = files(spark, part.getPath().toString())
            fs.rename(path(one), path(f"{folder}/part_{int(name.removeprefix('shard_no=')):03d}.parquet"))
    fs.delete(path(f"{folder}/_shards"), True)
    return True


def write_report(decisions: DataFrame, folder: str, settings: dict) -> dict:
    """The decision table as parquet and the summary as JSON beside it; gives the summary without the counts per label.

    All labels are written, however many there are: their counts pass through the driver one by one.
    """
    spark = decisions.sparkSession
    decisions.write.mode("overwrite").parquet(f"{folder}/filter_decisions.parquet")
    saved = spark.read.parquet(f"{folder}/filter_decisions.parquet")
    summary = settings | dec.summary(saved).first().asDict()
    for key, column in (("removal_reason_counts", "removal_reason"), ("single_turn_counts", "single_turn")):
        summary[key] = {json.dumps(r[0]) if r[0] is None else str(r[0]): r[1] for r in dec.counts(saved, column).orderBy(F.desc("n_rows"), column).collect()}

    def text() -> Iterator[str]:
        yield json.dumps(summary, ensure_ascii=False, indent=2)[:-2] + ',\n  "language_label_counts": {'
        labels = dec.counts(saved, "first_user_language_normalized").orderBy(F.desc("n_rows"), "first_user_language_normalized")
        for i, r in enumerate(labels.toLocalIterator()):
            yield f"{',' if i else ''}\n    {json.dumps('null' if r[0] is None else r[0], ensure_ascii=False)}: {r[1]}"
        yield "\n  }\n}"

    write_text(spark, f"{folder}/filter_summary.json", text())
    return summary


def write_text(spark: SparkSession, path: str, parts: str | Iterable[str]) -> None:
    """A UTF-8 file in any file system that the session knows, part by part."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        held, size = [], 0
        for x in [parts] if isinstance(parts, str) else parts:
            held.append(x)
            size += len(x)
            if size > 1_000_000:
                out.write(bytearray("".join(held).encode("utf-8")))
                held, size = [], 0
        out.write(bytearray("".join(held).encode("utf-8")))
    finally:
        out.close()


def append_jsonl(records: DataFrame, folder: str, by_file: bool = True) -> None:
    """Appends records as JSON lines with all keys, null ones too; a folder per source file where asked."""
    out = records
    writer = out.write.mode("append").option("ignoreNullFields", "false")
    if by_file:
        writer = out.withColumn("_of", F.col("source_file")).write.mode("append").option("ignoreNullFields", "false").partitionBy("_of")
    writer.json(folder)


def write_csv(table: DataFrame, folder: str) -> None:
    """A report as CSV with a header; nested columns as JSON text."""
    flat = [F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in table.dtypes]
    table.select(*flat).write.mode("overwrite").option("header", True).csv(folder)


def write_one_parquet(table: DataFrame, path: str) -> None:
    """A table as one parquet file at ``path``: written by one task, for exports and reports of bounded size."""
    spark = table.sparkSession
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}.parts")
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (one,) = files(spark, f"{path}.parts")
    fs.delete(hadoop(path), True)
    fs.rename(hadoop(one), hadoop(path))
    fs.delete(hadoop(f"{path}.parts"), True)


def write_arrow(table: DataFrame, folder: str) -> None:
    """A table as a folder (an absolute path or URI) of Arrow IPC files, one a task, written where the rows lie, batch by batch."""
    schema, spark = table.schema, table.sparkSession
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm.org.apache.hadoop.fs.Path(folder))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        first, n = next(batches, None), 0
        if first is not None:
            place, root = fs.FileSystem.from_uri(folder)
            with place.open_output_stream(f"{root}/data-{TaskContext.get().partitionId():05d}.arrow") as out, pa.ipc.new_file(out, first.schema) as w:
                for b in chain([first], batches):
                    w.write_batch(b)
                    n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    table.select(*[F.col(f"`{f.name}`") for f in schema]).mapInArrow(run, "n long").agg(F.sum("n")).collect()


#: A bar chart shows at most so many bars.
MOST_BARS = 100


def write_bar_chart(table: DataFrame, path: str, title: str) -> None:
    """The first MOST_BARS rows of (value, n_rows) as horizontal bars, in an SVG file; the table holds all."""
    rows = [(str(r[0]), int(r[1])) for r in table.limit(MOST_BARS).collect()]
    top, height = max((n for _, n in rows), default=1) or 1, 22
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="820" height="{40 + height * len(rows)}" font-family="sans-serif" font-size="12">', f'<text x="10" y="20" font-size="15">{escape(title)}</text>']
    for i, (value, n) in enumerate(rows):
        y, width = 32 + height * i, round(480 * n / top, 1)
        parts.append(f'<text x="230" y="{y + 14}" text-anchor="end">{escape(value[:34])}</text><rect x="240" y="{y}" width="{width}" height="17" fill="#4c78a8"/><text x="{246 + width}" y="{y + 14}">{n:,}</text>')
    write_text(table.sparkSession, path, "\n".join([*parts, "</svg>"]))


def write_exports(table: DataFrame, folder: str) -> None:
    """A filtered corpus as parquet, JSON lines and Arrow files."""
    write_arrow(table, f"{folder}/arrow")
    table.write.mode("overwrite").parquet(f"{folder}/parquet")
    table.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/jsonl")
