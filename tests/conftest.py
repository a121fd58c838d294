import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

RAW = "row_id long, source_file string, source_row_position long, conversation_id string, model string, conversation array<array<struct<role:string,content:string,language:string>>>, turn int, snippet_turns array<int>"


@pytest.fixture(scope="session")
def spark():
    from chatloom.session import local_session

    s = local_session(cores=4, partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def raw_of(spark):
    """Builds a raw corpus from conversations, each a list of messages (role, content, language) in one turn."""

    def build(conversations, **columns):
        rows = []
        for i, c in enumerate(conversations):
            conversation = None if c is None else [[tuple(m) for m in c]]
            own = {"source_file": "a.parquet", "conversation_id": f"c{i}", "model": "m", "turn": 1, "snippet_turns": [1]}
            own |= {k: v[i] for k, v in columns.items()}
            rows.append((i, own["source_file"], own.get("source_row_position", i), own["conversation_id"], own["model"], conversation, own["turn"], own["snippet_turns"]))
        return spark.createDataFrame(rows, RAW)

    return build


@pytest.fixture(scope="session")
def odd_raw(spark):
    """Null, empty, very long and repeated rows, null turns and messages, and extra columns whose names clash."""
    from pyspark.sql import functions as F

    long = "The reason is that the loop stops before the last element. " * 4000
    rows = [
        (1, None, None, None, None, None, None, None),
        (2, "", 0, "", "", [], 0, []),
        (3, "f", 1, "x", "m", [None, [None, ("user", None, None)]], 1, [None, 1]),
        (4, "f", 2, "x", "m", [[(None, "", ""), ("user", "", ""), ("assistant", " \n", " ")]], 1, [1]),
        (5, "f", 3, "y", "m", [[("user", long, "English"), ("assistant", long, "en")]], 2, [2]),
        (6, "f", 4, "y", "m", [[("USER ", "Hi 😀", "en"), ("assistant", "a" * 60_000, "en")]], 1, [1]),
        (6, "f", 4, "y", "m", [[("USER ", "Hi 😀", "en"), ("assistant", "a" * 60_000, "en")]], 1, [1]),
        (None, None, None, None, None, [[("user", "hello there", None), ("assistant", None, None)]], None, None),
    ]
    df = spark.createDataFrame(rows, RAW)
    clash = ("role", "content", "language", "msg_pos", "m", "text", "key", "_key", "_id", "_salt", "_heavy", "label", "prompt", "answer", "col", "pos")
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])
