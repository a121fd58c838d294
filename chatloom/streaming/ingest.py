"""Streaming ingestion: new files of a corpus annotated once each, and windowed counts of calls with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.annotate import annotated


def stream_files(spark: SparkSession, folder: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def annotate_stream(stream: DataFrame, out: str, checkpoint: str, position: str = "source_row_position") -> StreamingQuery:
    """Annotates every record of a stream once and appends it to ``out`` as parquet; the checkpoint replaces the log of keys.

    Only what is decided record by record can run on a stream: duplicates dropped altogether, and first by place,
    change with later rows and stay in the batch job.
    """
    return annotated(stream, position).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def first_per_key(stream: DataFrame, key: str, event_time: str, late: str) -> DataFrame:
    """The first row of each key that arrives, forgotten after ``late``: state doesn't grow without end."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def call_windows(calls: DataFrame, event_time: str = "called_at", width: str = "1 hour", late: str | None = "7 days") -> DataFrame:
    """(window_start, call_kind, n_calls, n_failed) of calls; rows later than ``late`` are left out on a stream.

    None keeps the watermark that the stream has already.
    """
    rows = calls.withWatermark(event_time, late) if calls.isStreaming and late else calls
    failed = F.count_if(F.coalesce(F.col("http_status") >= 400, F.lit(True)))
    return rows.groupBy(F.window(event_time, width).alias("w"), "call_kind").agg(F.count("*").alias("n_calls"), failed.alias("n_failed")).select(
        F.col("w.start").alias("window_start"), "call_kind", "n_calls", "n_failed"
    )
