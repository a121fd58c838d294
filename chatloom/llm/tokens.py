"""Problem 8: the corpus as ids of a public byte-level BPE tokenizer, merged by recursive queries."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts are taken in runs of about so many characters, words merged in runs of about so many bytes, and at most so many words are kept per task; all only bound memory.
RUN_CHARS = 4_000_000
RUN_BYTES = 1_000_000
KEPT_WORDS = 400_000
#: The split pattern of this vocabulary, with the Unicode White_Space property spelt out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same in the classes of the standard library, for texts without the few numerals that are no digits.
_SPLIT_PLAIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?(?:[^\W\d_]+|\d+|(?:[^{_SPACE}\w]|_)+)|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

# One step of the recursion contracts, in each piece that still has a known pair, every occurrence of its pair of
# minimum rank from left to right. In a vocabulary whose merges are listed in the order of training, that equals
# contracting the leftmost one again and again: a pair with the new token ranks after the pair that made it.
# Occurrences of one pair overlap only where both its tokens are the same; of such a run every other one is taken.
# USING KEY keeps the last state of a position only, so that memory doesn't grow with the number of steps; a
# position that was swallowed keeps the token -1. A piece without a known pair leaves the recursion.
_MERGE = """
WITH RECURSIVE state(w, pos, tok) USING KEY (w, pos) AS (
    SELECT w, pos, tok FROM words
  UNION ALL
    (WITH paired AS (
        SELECT w, pos, tok, lead(tok) OVER word AS nxt, row_number() OVER word AS n
        FROM state WHERE tok >= 0 WINDOW word AS (PARTITION BY w ORDER BY pos)
    ), known AS (
        SELECT p.w, p.n, p.tok = p.nxt AS twin, m.rank, m.made FROM paired p JOIN merges m ON m.a = p.tok AND m.b = p.nxt
    ), least AS (
        SELECT w, min(rank) AS rank FROM known GROUP BY w
    ), hits AS (
        SELECT k.w, k.n, k.made, k.twin FROM known k JOIN least l ON l.w = k.w AND l.rank = k.rank
    ), twins AS (
        SELECT w, n, made, n - row_number() OVER (PARTITION BY w ORDER BY n) AS run FROM hits WHERE twin
    ), taken AS (
        SELECT w, n, made FROM hits WHERE NOT twin
      UNION ALL
        SELECT w, n, made FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY n) AS k FROM twins) WHERE k % 2 = 1
    ), written AS (
        SELECT w, n, made AS tok FROM taken UNION ALL SELECT w, n + 1, -1 FROM taken
    )
    SELECT p.w, p.pos, coalesce(x.tok, p.tok) AS tok
    FROM paired p JOIN least l ON l.w = p.w LEFT JOIN written x ON x.w = p.w AND x.n = p.n)
)
SELECT w, tok FROM state WHERE tok >= 0 ORDER BY w, pos
"""


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else from 256 on."""
    own = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    rest = (b for b in range(256) if b not in own)
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> tuple[list[int], pa.Table, list[bytes]]:
    """Of a vocabulary file: the id of each byte, the merge table (a, b, rank, made), the bytes of each id."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    ids, letters = model["vocab"], byte_letters()
    of_byte = [0] * 256
    for letter, b in letters.items():
        of_byte[b] = ids[letter]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = pa.table(
        {
            "a": pa.array([ids[x] for x, _ in pairs], pa.int32()),
            "b": pa.array([ids[y] for _, y in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()),
            "made": pa.array([ids[x + y] for x, y in pairs], pa.int32()),
        }
    )
    texts = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        texts[i] = bytes(letters[ch] for ch in token) if all(ch in letters for ch in token) else token.encode()
    return of_byte, merges, texts


class Reach(NamedTuple):
    """What tells where no token reaches across two bytes: the tokens of two bytes, and the triples of bytes inside of longer ones."""

    pairs: np.ndarray
    triples: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Reach:
        pairs, triples = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for t in texts:
            if len(t) == 2:
                pairs[t[0] << 8 | t[1]] = True
            for i in range(len(t) - 2):
                triples[t[i] << 16 | t[i + 1] << 8 | t[i + 2]] = True
        return cls(pairs, np.packbits(triples))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each place between two bytes of ``data``, whether no token holds both; merging never passes it."""
        d = data.astype(np.int64)
        two = d[:-1] << 8 | d[1:]
        three = two[:-1] << 8 | d[2:]
        inside = (self.triples[three >> 3] >> (7 - (three & 7)).astype(np.uint8) & 1).astype(bool)
        held = self.pairs[two]
        held[:-1] |= inside
        held[1:] |= inside
        return ~held


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


@lru_cache(maxsize=1)
def _numerals() -> frozenset[str]:
    """Numerals that are no digits, for which the two split patterns differ."""
    return frozenset(ch for ch in map(chr, range(0x80, 0x20000)) if ch.isnumeric() and unicodedata.category(ch) in ("No", "Nl"))


class Merger:
    """Merges words of one task: a DuckDB connection with the merge table, and the words met so far."""

    def __init__(self, of_byte: list[int], merges: pa.Table, reach: Reach):
        import duckdb
        import regex

        self.of_byte, self.reach = np.array(of_byte, np.int32), reach
        self.numerals, self.odd = _numerals(), regex.compile(SPLIT).findall
        # whatever is in memory is bounded by RUN_BYTES: nothing is spilled to a folder of the machine
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("merge_rows", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self._forget()

    def _forget(self) -> None:
        self.known, self.learnt = _Numbers(), 0
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _SPLIT_PLAIN.findall(text) if text.isascii() or self.numerals.isdisjoint(text) else self.odd(text)

    def learn(self, new: list[str]) -> None:
        """Merge new words: cut into pieces where no token reaches across, equal pieces once, in runs of about RUN_BYTES."""
        sizes, ids, run, size = [self.sizes], [self.ids], [], 0
        for i, word in enumerate(new):
            run.append(word.encode("utf-8", "surrogatepass"))
            size += len(run[-1])
            if size >= RUN_BYTES or i == len(new) - 1:
                n, made = self._merged(run)
                sizes.append(n)
                ids.append(made)
                run, size = [], 0
        self.sizes, self.ids = np.concatenate(sizes), np.concatenate(ids)
        self.learnt += len(new)

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, the ids of all)."""
        every = b"".join(words)
        ends = np.cumsum([len(w) for w in words])
        cut = self.reach.cuts(np.frombuffer(every, np.uint8)) if len(every) > 2 else np.zeros(max(0, len(every) - 1), bool)
        at = np.union1d(np.flatnonzero(cut) + 1, ends)
        starts = np.concatenate([[0], at[:-1]])
        numbers = _Numbers()
        piece = np.fromiter((numbers[every[a:b]] for a, b in zip(starts.tolist(), at.tolist(), strict=True)), np.int64, len(at))
        distinct = b"".join(numbers)
        length = np.array([len(x) for x in numbers], np.int64)
        w = np.repeat(np.arange(len(length)), length)
        pos = np.arange(len(distinct)) - np.repeat(np.cumsum(length) - length, length)
        rows = pa.table({"w": pa.array(w, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(self.of_byte[np.frombuffer(distinct, np.uint8)], pa.int32())})
        self.db.register("words", rows)
        out = self.db.sql(_MERGE).to_arrow_table()
        self.db.unregister("words")
        made = np.bincount(out["w"].to_numpy(), minlength=len(length))
        per_piece, ids = gathered(out["tok"].to_numpy().astype(np.int32), made, piece)
        per_word = np.add.reduceat(per_piece, np.searchsorted(at, np.concatenate([[0], ends[:-1]]), side="right"))
        return per_word, ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, the ids of all)."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        parts = [self.split(t) for t in texts]
        words = np.array([len(p) for p in parts], np.int64)
        of = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(words.sum()))
        if len(self.known) > self.learnt:
            self.learn(list(islice(self.known, self.learnt, None)))
        per_word, ids = gathered(self.ids, self.sizes, of)
        total = np.concatenate([[0], np.cumsum(per_word)])
        upto = np.cumsum(words)
        return total[upto] - total[upto - words], ids


def gathered(values: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists held end to end in ``values``, those numbered in ``of``: (their sizes, their values end to end)."""
    n = sizes[of]
    starts = (np.cumsum(sizes) - sizes)[of]
    return n, values[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def lists(sizes: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))


def runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of a batch of about RUN_CHARS characters each: (start, end)."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < RUN_CHARS):
            chars += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the ids of each text by the byte-level BPE vocabulary at ``path``, without special tokens.

    Each partition splits its texts into words, cuts long ones where no token reaches across, and merges its distinct
    pieces by recursive DuckDB queries over (piece, position, token) rows joined with the merge table, many at once;
    their order by piece and position gives each word's ids.
    Nothing is shuffled. Null and empty texts give an empty list, the strings of special tokens are ordinary
    text, repeated rows come out as often as they went in, texts are never cut. Only the file's merge table, of
    fixed size, is sent to the executors; other columns are not read.
    """
    spark = docs.sparkSession
    of_byte, merges, held = vocabulary(path)
    sent = spark.sparkContext.broadcast((of_byte, merges, Reach.of(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = None
        for batch in batches:
            merger = merger or Merger(*sent.value)
            texts = batch.column(1).to_pylist()
            for at, end in runs(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), lists(*merger.encode(texts[at:end]))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of a list of ids."""
    texts = vocabulary(path)[2]
    return b"".join(texts[i] for i in ids).decode("utf-8", "replace")
