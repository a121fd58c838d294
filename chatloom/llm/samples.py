"""Bounded samples of messages, for the models that are trained on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.messages import messages

#: Bound of a sample in characters, shared out over the scan's partitions.
SAMPLE_CHARS = 32_000_000
#: A corpus of more files is sampled from so many of them, chosen by a hash of their names, so that only they are read again.
SAMPLE_FILES = 512


def _some_files(raw: DataFrame) -> DataFrame:
    """``raw`` cut to SAMPLE_FILES of its files; as it is where it has fewer, or its rows don't know their files."""
    files = raw.inputFiles()
    if len(files) <= SAMPLE_FILES:
        return raw
    try:
        path = F.col("_metadata.file_path")
        return raw.where(F.pmod(F.xxhash64(path), F.lit(len(files))) < SAMPLE_FILES)
    except AnalysisException:
        return raw


def sampled(raw: DataFrame, bound: int, *columns: str, chars: int = SAMPLE_CHARS) -> list[tuple]:
    """About ``bound`` messages of records chosen by a hash of row_id, all where there are fewer: ``columns`` of those with content.

    ``columns`` starts with content. Never more than twice ``bound`` rows, nor texts of more than ``chars`` characters in
    all: each partition takes the texts that fit into its part. An empty table gives none.
    """
    some = _some_files(raw)
    n = some.count()
    if not n:
        return []
    part = int(min(1.0, bound / (3.0 * n)) * (1 << 30)) + 1
    rows = messages(some.where(F.pmod(F.xxhash64("row_id"), F.lit(1 << 30)) < part), "row_id").where("content IS NOT NULL").select(*columns)
    room = max(1, chars // max(1, rows.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = room
        for b in batches:
            keep = []
            for i, text in enumerate(b.column(0).to_pylist()):
                if len(text) <= left:
                    left -= len(text)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return [tuple(r) for r in rows.mapInArrow(run, rows.schema).limit(2 * bound).collect()]
