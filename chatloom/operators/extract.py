"""Messages in conversations of any nesting, exact hashes of values, and paths of nested JSON: Arrow-batched Python."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("role", "content", "language")]))


def _walk(value) -> Iterator[dict]:
    """Messages in depth-first order: an object with role and content is one and isn't entered; text that is JSON is read."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            try:
                inner = json.loads(x)
            except ValueError:
                continue
            if isinstance(inner, (str, list, dict)):
                stack.append(inner)
        elif isinstance(x, dict):
            if "role" in x and "content" in x:
                yield x
            else:
                stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))


#: Fields that may hold the text of a message, and its role, in the order in which they are tried.
TEXT_FIELDS = ("content", "text", "value", "message", "prompt")
ROLE_FIELDS = ("role", "from", "author", "speaker", "sender")
LENIENT = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("role", "text")]))


def _lenient(x) -> Iterator[tuple[str, str]]:
    """(role, text) of whatever a conversation holds: objects and scalars are messages, lists are entered, null is none."""
    stack = [x]
    while stack:
        m = stack.pop()
        if isinstance(m, list):
            stack.extend(reversed(m))
        elif isinstance(m, dict):
            # a null role reads as a word; only a field that is missing or blank leaves it to the next
            role = next((r for f in ROLE_FIELDS if (r := str(m.get(f, "")).lower().strip())), "")
            text = next((m[f].strip() for f in TEXT_FIELDS if isinstance(m.get(f), str)), None)
            yield role, "".join(v.strip() for v in m.values() if isinstance(v, str)) if text is None else text
        elif m is not None:
            yield "", str(m).strip()


@F.pandas_udf(LENIENT)
def normalize_lenient(conversations: pd.Series) -> pd.Series:
    """Messages of a conversation held as JSON text, in the exploratory sense; JSON text of a conversation within JSON is read, text that is no JSON is one message."""
    out = []
    for c in conversations:
        for _ in range(2):
            try:
                c = json.loads(c) if isinstance(c, str) else c
            except ValueError:
                break
        out.append([{"role": r, "text": t} for r, t in _lenient(c)])
    return pd.Series(out, dtype=object)


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x)


@F.pandas_udf(MESSAGES)
def normalize(conversations: pd.Series) -> pd.Series:
    """Messages of a conversation held as JSON text of any nesting; null and text that is no JSON have none."""
    return pd.Series([[{"role": _text(m.get("role")), "content": _text(m.get("content")), "language": _text(m.get("language"))} for m in _walk(c)] for c in conversations], dtype=object)


@F.pandas_udf(T.StringType())
def stable_hash(values: pd.Series) -> pd.Series:
    """SHA-256 of a JSON value with sorted keys and the separators of Python's json module; text that is no JSON is itself the value."""
    out = []
    for v in values:
        try:
            x = json.loads(v) if v is not None else None
        except ValueError:
            x = v
        out.append(hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, default=str).encode("utf-8", "surrogatepass")).hexdigest())
    return pd.Series(out, dtype=object)


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """(key_path, n_values): dotted paths of the objects in a column of JSON text and how often each occurs.

    All elements of lists and all levels are entered; paths are counted per batch before anything is shuffled. Unreadable text and null have no paths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, int] = {}
            for text in b.column(0).to_pylist():
                try:
                    stack = [(json.loads(text), "")] if text is not None else []
                except ValueError:
                    stack = []
                while stack:
                    x, path = stack.pop()
                    if isinstance(x, dict):
                        for k, v in x.items():
                            p = f"{path}.{k}" if path else str(k)
                            n[p] = n.get(p, 0) + 1
                            stack.append((v, p))
                    elif isinstance(x, list):
                        stack += [(v, f"{path}[]") for v in x]
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["key_path", "n"])

    paths = df.select(F.col(column).cast("string").alias("_json")).mapInArrow(run, "key_path string, n long")
    return paths.groupBy("key_path").agg(F.sum("n").alias("n_values"))


def snippet_array(value: Column) -> Column:
    """Snippet turns of any spelling as an array of whole numbers: bad items are left out, plain text gives none."""
    return F.coalesce(F.filter(F.transform(value, lambda x: x.try_cast("int")), lambda x: x.isNotNull()), F.array().cast("array<int>"))
