"""Problem 2, the method named: each page against its nearest by URL, lines that both hold in one order deleted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.messages import messages

#: Alignments of more cells than this are split in two, so that their bits take no more memory.
CELLS = 1 << 27


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit rows of the alignment of ``a`` with ``b``: bit j of row i is 0 where the common length grows at b[j]; all rows, or the last only."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            out.append(v)
    return out if keep else [v]


def _lengths(v: int, n: int) -> list[int]:
    """For each j up to n, the common length with the first j items, from the last bit row."""
    out, total = [0], 0
    for bit in reversed(bin(v | 1 << n)[3:] if n else ""):
        total += bit == "0"
        out.append(total)
    return out


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in order.

    Equal starts and ends are matched at once, items of one list only left out; the rest is aligned by rows of
    bits, split in two where these would take more than CELLS bits. Exact, whatever the lengths.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    both = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    at = [i for i in range(start, len(a) - end) if a[i] in both]
    x, y = [a[i] for i in at], [v for v in b[start : len(b) - end] if v in both]
    return [*range(start), *(at[i] for i in _aligned(x, y)), *range(len(a) - end, len(a))]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        left, right = _lengths(_rows(a[:half], b, False)[0], len(b)), _lengths(_rows(a[half:][::-1], b[::-1], False)[0], len(b))
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return [*_aligned(a[:half], b[:cut]), *(half + i for i in _aligned(a[half:], b[cut:]))]
    rows, out, j = _rows(a, b, True), [], len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        # the place where the common length grew last; it is row i's own where the row before had none there
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if i == 0 or rows[i - 1] >> j & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def difference(text: str | None, other: str | None) -> tuple[str | None, int]:
    """The text without the lines it shares with ``other`` in order, and how many these are; blank lines are shared with none."""
    if not text or not other:
        return text, 0
    numbers: dict[str, int] = {}

    def coded(t: str, blank: int) -> tuple[list[str], list[int]]:
        lines = t.split("\n")
        return lines, [numbers.setdefault(x.strip(), len(numbers)) if x.strip() else blank for x in lines]

    lines, a = coded(text, -1)
    gone = set(common(a, coded(other, -2)[1]))
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)


def without_shared_lines(docs: DataFrame, url: str, text: str, *keep: str) -> DataFrame:
    """(*keep, n_shared, rest): each page without the lines it shares with the page of the nearest path of its host.

    Pages are range-sorted by host and path, so that a host of many pages spreads over partitions; each is compared with
    the page before it, the first of a host in a partition with the one after it. Null and empty texts share nothing
    and stay; a host's only page stays whole; repeated rows are pages each; an empty table gives no rows.
    """
    rows = docs.select(host(F.col(url)).alias("_host"), path(F.col(url)).alias("_path"), F.col(text).cast("string").alias("_text"), *keep)
    order = ["_host", "_path", *keep]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = before = None  # a page that waits for the next; the page before the one at hand

        def out(batch: pa.RecordBatch, rest: list[str | None], shared: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3, batch.num_columns)], pa.array(shared, pa.int32()), pa.array(rest, pa.string())], names=[*keep, "n_shared", "rest"])

        for b in batches:
            rest, shared = [], []
            first = 0
            for i, (name, page) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if held is not None:
                    a, n = difference(held[1], page) if held[0] == name else (held[1], 0)
                    if i == 0 and held[2] is not None:
                        yield out(held[2], [a], [n])
                    else:
                        rest.append(a)
                        shared.append(n)
                    held = None
                if before is not None and before[0] == name:
                    a, n = difference(page, before[1])
                    rest.append(a)
                    shared.append(n)
                elif i == b.num_rows - 1:
                    held = (name, page, b.slice(i, 1))
                else:
                    held = (name, page, None)
                before = (name, page)
            n = len(rest)
            if n:
                yield out(b.slice(first, n), rest, shared)
        if held is not None:
            yield out(held[2], [held[1]], [0])

    kinds = ", ".join(f"`{k}` {t}" for k, t in docs.select(*keep).dtypes)
    return rows.mapInArrow(run, f"{kinds}, n_shared int, rest string")


def message_differences(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, n_shared, rest) of every message of a corpus, its file as the host and its place as the path."""
    m = messages(raw, "row_id", "source_file", "source_row_position")
    url = F.concat(F.lit("corpus://"), F.coalesce("source_file", F.lit("")), F.lit("/"), F.lpad(F.coalesce(F.col("source_row_position").cast("string"), F.lit("")), 12, "0"), F.lit("/"), F.lpad(F.col("msg_pos").cast("string"), 6, "0"))
    return without_shared_lines(m.select(F.col("row_id").cast("long").alias("row_id"), F.col("msg_pos").cast("int").alias("msg_pos"), url.alias("url"), "content"), "url", "content", "row_id", "msg_pos")
