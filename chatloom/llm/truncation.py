"""Problem 10: texts cut by a field limit or during transfer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, spread
from . import prose

#: Texts are counted in runs of about so many characters, which bounds the memory of a run.
FIT_CHARS = 2_000_000
#: Context lengths in characters, longest first; a shorter one is asked where the longer ones are not known.
ORDERS = (24, 14, 9, 6)
#: A context is known where it was met at least so often.
KNOWN = 4
#: Bits of the table that tells, before anything is shuffled, which contexts no text asks for.
SLOT_BITS = 24
#: The rate of all sources counts as so many endings of each source.
BASELINE_ENDINGS = 20
#: A source whose prose lacks a terminator at most this often has none that ends in the middle of words never met.
STRICT_SHARE = 0.3
#: A length is a field limit of its source where at least so many texts, and so large a share of the source, have it.
LIMIT_TEXTS, LIMIT_SHARE, LIMIT_LEAST = 5, 0.01, 200
TERMINATORS = frozenset(".!?。！？:：;；")
CLOSERS = "\"'`)]}>»”’）」』】*_~|"
_MARKER = re.compile(r"(?:…|\.\.\.|\[(?:…|\.\.\.)\]|[(<\[]truncated[)>\]])$", re.I)
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})(.*)$")
_URL = re.compile(r"(?:https?://|www\.)\S+$")
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_BROKEN = re.compile("�$|\\\\u[0-9a-fA-F]{0,3}$|\\\\x[0-9a-fA-F]?$|&(?:#\\d{0,6}|[a-zA-Z]{1,8})$|%[0-9A-F]?$")
_CODE = re.compile(r"[;{}=<>$\\|]|\(\)|^\s{4,}|^\t|\w\(|^#!|^[\w.-]+:\s|^\./|^[a-f0-9]{16,}$|^\$ |\[\d")
_CLOSED = re.compile(r"(?:\[\[?[^\[\]\n]+\]\]?|\]\([^()\n]*\)|\}\}|\|\}|</\w+>|\\end\{\w+\*?\})$")
_PAIR = {")": "(", "]": "[", "}": "{"}
_TAGS = re.compile(r"<(/?)(ul|ol|table|thead|tbody|tr|pre|div|section|article|blockquote|code|h[1-6]|em|strong|a|span|details|summary)\b[^<>]*>", re.I)
_ENVIRONMENTS = re.compile(r"\\(begin|end)\{([a-zA-Z]+\*?)\}")
_BLOCKS = re.compile(r"\{(code|noformat|quote|panel)(?::[^}\n]*)?\}|(\{\||\|\})")
_SMILEY = re.compile(r"(?<!\w)[:;=8]-?[()\[\]{}]|^\s*\w{1,3}[.)]", re.M)
_QUOTES = {"”": "“", "»": "«", "」": "「", "』": "『", "）": "（", "】": "【", "》": "《", **_PAIR}


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Signs of words, and decimal digits."""
    every, tables = "".join(map(chr, range(0x110000))), []
    for pattern in (r"\w+", r"\d+"):
        tables.append(np.zeros(len(every), bool))
        for m in re.finditer(pattern, every):
            tables[-1][m.start() : m.end()] = True
    return tables[0], tables[1]


def _plain(codes: np.ndarray) -> np.ndarray:
    """Codes of a text with identifiers as one sign, digits as 0 and no space before a mark, so that contexts are shared between documents.

    An identifier is a run of words joined by single points that has a point, an inner underscore or a capital after a small letter or digit.
    """
    if not len(codes):
        return codes
    words, decimals = _tables()
    word, digit = words[codes], decimals[codes]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    point = (codes == 46) & before & after
    member = word | point
    small = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    capital = (codes >= 65) & (codes <= 90)
    capital[1:] &= small[:-1]
    capital[0] = False
    sign = point | capital | ((codes == 95) & before & after)
    start = member.copy()
    start[1:] &= ~member[:-1]
    run = np.cumsum(start)
    named = np.zeros(int(run[-1]) + 1, bool)
    named[run[sign]] = True
    identifier = member & named[run]
    digit &= ~identifier
    keep = ~identifier | start
    keep[1:] &= ~(digit[1:] & digit[:-1])
    out = np.where(identifier, 167, np.where(digit, 48, codes))[keep].astype(codes.dtype)
    space = (out == 32) | (out == 0xA0) | (out == 0x202F)
    mark = (out == 33) | (out == 58) | (out == 59) | (out == 63)
    # only runs of spaces are followed up, from their ends
    ends = np.flatnonzero(space[:-1] & mark[1:])
    if len(ends):
        first = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]]))
        begin = first[np.searchsorted(first, ends, side="right") - 1]
        gone = np.zeros(len(out) + 1, np.int64)
        np.add.at(gone, begin, 1)
        np.add.at(gone, ends + 1, -1)
        out = out[np.cumsum(gone[:-1]) == 0]
    return out


def _tail(text: str) -> str:
    """The end of a text as ``_plain`` has it, at least as long as the longest context where the text is."""
    for window in (400, len(text)):
        part = text[-window:]
        if window < len(text):
            cut = re.search(r"\s(?=\S)", part)
            part = part[cut.end() :] if cut else ""
        out = _text(_plain(_codes(part)))
        if len(out) >= ORDERS[0] or window >= len(text):
            return ("\0" + out) if len(part) == len(text) else out
    return "\0"


def unfinished(text: str) -> bool:
    """Whether the stack automaton of markup, or that of brackets and quotes in the last paragraph, is not empty at the end."""
    stack: list[str] = []
    for pattern in (_TAGS if "<" in text else None, _ENVIRONMENTS if "\\" in text else None):
        for m in pattern.finditer(text) if pattern else ():
            name = m[2].lower()
            if m[1] in ("", "begin"):
                stack.append(name)
            elif name in stack:
                while stack.pop() != name:
                    pass
    for m in _BLOCKS.finditer(text) if "{" in text else ():
        name = m[1] or "{|"
        if (m[1] and stack[-1:] == [name]) or m[2] == "|}":
            if stack[-1:] == [name]:
                stack.pop()
        else:
            stack.append(name)
    if stack:
        return True
    last = _SMILEY.sub(" ", text[text.rfind("\n\n") + 1 :])
    if not any(ch in last for ch in "([{“«「『（【《"):
        return False
    for ch in last:
        if ch in "([{“«「『（【《":
            stack.append(ch)
        elif ch in _QUOTES and _QUOTES[ch] in stack:
            while stack.pop() != _QUOTES[ch]:
                pass
    return bool(stack)


def open_at_end(lines: list[str]) -> tuple[bool, bool]:
    """Run the stack automaton over lines: (a fence is open at the end, a bracket or quote of the last code block is)."""
    fence, start = "", 0
    for i, line in enumerate(lines):
        m = _FENCE.match(line)
        if m and not fence:
            fence, start = m[1], i + 1
        elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            fence, start = "", i + 1
    if fence:
        return True, False
    first = len(lines)
    while first > start and _CODE.search(lines[first - 1]):
        first -= 1
    stack: list[str] = []
    for line in lines[first:]:
        quote, before = "", ""
        for ch in line:
            if quote:
                if ch == quote and before != "\\":
                    quote = ""
            elif ch in "\"`" or (ch == "'" and not before.isalnum()):
                quote = ch
            elif ch in "([{":
                stack.append(ch)
            elif ch in ")]}" and stack and stack[-1] == _PAIR[ch]:
                stack.pop()
            before = ch
        if quote and line is lines[-1]:
            return False, True
    return False, bool(stack)


_MORE, _TERMINATOR, _LINE, _END = range(4)
_KINDS = np.zeros(0x110000, np.uint8)
_KINDS[[ord(ch) for ch in TERMINATORS]] = _TERMINATOR
_KINDS[[10, 13]] = _LINE
_KINDS[0] = _END


def _hashes(codes: np.ndarray, slots: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, ends, hashes) of the contexts of ``codes``, shortest order first; the hash of a longer one goes on from that of its end.

    With ``slots`` only contexts whose slot is set; a longer context is asked for only together with its ends.
    """
    codes = codes.astype(np.uint64)
    ends, h, done = np.arange(len(codes)), np.zeros(0, np.uint64), 0
    for order in reversed(ORDERS):
        with np.errstate(over="ignore"):
            if not done:  # all places at once, by slices
                ends, h = ends[order - 1 :], np.zeros(max(0, len(codes) - order + 1), np.uint64)
                for k in range(order):
                    h *= np.uint64(0x9E3779B97F4A7C15)
                    h += codes[order - 1 - k : max(0, len(codes) - k)]
                    h += np.uint64(1)
                    h ^= h >> np.uint64(29)
            else:
                keep = ends >= order - 1
                ends, h = (ends, h) if keep.all() else (ends[keep], h[keep])
                for k in range(done, order):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + codes[ends - k] + np.uint64(1)
                    h ^= h >> np.uint64(29)
        done = order
        if slots is not None:
            keep = slots[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            ends, h = ends[keep], h[keep]
        yield order, ends, h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def _runs(texts: list[str]) -> Iterator[np.ndarray]:
    """The texts as codes, apart by 0, in runs of about FIT_CHARS."""
    parts: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        parts.append(t.rstrip())
        size += len(parts[-1])
        if size >= FIT_CHARS or i == len(texts) - 1:
            yield _plain(_codes("\0" + "\0".join(parts) + "\0"))
            parts, size = [], 0


def _tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes whose last two bits are what followed, as (hash without them, how often each of the four followed)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    n = np.diff(first, append=len(keys))
    h, where = np.unique(keys[first] >> np.uint64(2), return_inverse=True)
    total = np.zeros((len(h), 4), np.int64)
    total[where, (keys[first] & np.uint64(3)).astype(np.int64)] = n
    return h << np.uint64(2), total


def _followed(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    return (h & ~np.uint64(3)) | nxt.astype(np.uint64)


def fit(texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each order, the contexts met at least KNOWN times and how often each was followed by
    (more text, a terminator, the end of a line, the end of a document). Nothing is dropped before all is counted."""
    got: dict[int, list[np.ndarray]] = {order: [] for order in ORDERS}
    for codes in _runs(texts):
        nxt = _KINDS[codes[1:]]
        for order, ends, h in _hashes(codes[:-1]):
            got[order].append(_followed(h, nxt[ends]))
    model = {}
    for order in ORDERS:
        h, n = _tallied(np.concatenate([np.zeros(0, np.uint64), *got.pop(order)]))
        keep = n.sum(1) >= KNOWN
        model[order] = h[keep], n[keep]
    return model


def tail_hashes(tail: str) -> dict[int, int]:
    """The hash of the context of each order that ends ``tail``, as far as it is long enough."""
    return {order: int(h[-1]) & ~3 for order, _, h in _hashes(_codes(tail[-ORDERS[0] :])) if len(h)}


def seen(model: dict, tail: str) -> np.ndarray | None:
    """Counts of what followed the longest known context that ends ``tail``."""
    asked = tail_hashes(tail)
    for order in ORDERS:
        keys, n = model[order]
        i = int(np.searchsorted(keys, np.uint64(asked[order]))) if order in asked else len(keys)
        if i < len(keys) and int(keys[i]) == asked[order] and n[i].sum() >= KNOWN:
            return n[i]
    return None


def _tail_key(tail: str) -> int:
    """One key for what a tail asks: its last characters, as many as the longest context has."""
    last = tail[-ORDERS[0] :]
    return int.from_bytes(blake2b(last.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Ending(NamedTuple):
    """How a text ends: ``kind`` of cut where it is plain; ``ask`` where it takes more to tell: a mark of omission
    ("ellipsis"), code ("code"), prose without a terminator ("open"); what an open or marked text ends with
    (``tail``); whether an unknown end is no sentence (``loose``); whether prose ends with a terminator (``ended``);
    whether markup, a bracket or a quote is left open (``gap``)."""

    kind: str | None = None
    ask: str | None = None
    tail: str | None = None
    loose: bool = False
    ended: bool = False
    gap: bool = False


def ending(text: str | None) -> Ending:
    """The end of a text, as far as the text alone tells it. Null and blank texts are whole."""
    if not text or not text.strip():
        return Ending()
    body = text.rstrip("\r\n")
    if _BROKEN.search(body):
        return Ending("broken")
    lines = body.splitlines()
    fence, bracket = open_at_end(lines)
    if fence:
        return Ending("fence")
    last = lines[-1]
    if _FENCE.match(last):
        return Ending()
    if bracket:
        return Ending("bracket")
    end = last.rstrip()
    if marker := _MARKER.search(end):
        return Ending(ask="ellipsis", tail=_tail(body.rstrip()[: -len(marker[0])].rstrip()))
    core = end.rstrip(CLOSERS)
    if core and core[-1] in TERMINATORS:
        return Ending(ended=not _CODE.search(last))
    if _CLOSED.search(end):
        return Ending()
    if _URL.search(end) or _CODE.search(last) or prose.looks_like_code(last):
        return Ending() if _URL.search(end) or end.endswith(tuple("}])>;`")) else Ending(ask="code", gap=unfinished(body))
    return Ending(ask="open", tail=_tail(body.rstrip()), loose=bool(_LIST.match(last)) or len(end.split()) < 3, gap=unfinished(body))


def verdict(end: Ending, at_limit: bool, n, baseline: float = 1.0, free_source: bool = False, strict_source: bool = False) -> str | None:
    """Why a text counts as cut, or None for a whole one. ``n``: what follows its last characters in all texts, None
    where they are not known. ``baseline``: the odds of its source's prose to lack a terminator, over those of all sources;
    ``free_source``: most of its source's prose lacks one; ``strict_source``: at most STRICT_SHARE of it does.
    """
    if not end.ask:
        return end.kind
    at_limit = at_limit or end.gap
    if end.ask == "code":
        return "sentence" if at_limit else None
    if end.ask == "ellipsis":
        return "ellipsis" if at_limit or (n is not None and n[0] > sum(n[1:])) else None
    if n is None:
        return "sentence" if at_limit or (strict_source and not end.loose) else None
    goes_on, ended, line, done = (int(x) for x in n)
    if goes_on > ended + line + done and not (end.loose and free_source):
        return "sentence"
    free = (line + done) / max(1, ended + line + done)
    free = free * baseline / max(1e-12, free * baseline + 1 - free)
    return "sentence" if free < 0.03 or (at_limit and free < 0.5) else None


def cut(text: str | None, at_limit: bool, model: dict) -> str | None:
    """Why a text counts as cut, or None for a whole one. ``at_limit``: it has the length of a limit of its source.

    broken: it ends in a broken multibyte sequence or escape. fence, bracket: a code block, bracket or quote is
    open. ellipsis: it ends with a mark of omission, at a limit or in the middle of a sentence. sentence: it ends without
    a terminator where text like it goes on or has one. Null and blank texts are whole.
    """
    end = ending(text)
    return verdict(end, at_limit, seen(model, end.tail) if end.tail else None)


def limits(sizes: DataFrame) -> DataFrame:
    """Field limits by pile-ups of lengths: (source, unit, size), counted over all documents, given as (source, chars, bytes).

    Lengths are counted in characters and in bytes of UTF-8. A length is a limit of its source where it holds
    at least LIMIT_TEXTS texts and LIMIT_SHARE of the source; so a source has at most 2 / LIMIT_SHARE of them.
    """
    both = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes")])
    n = sizes.where("chars > 0").select("source", F.explode(both).alias("x")).groupBy("source", "x.unit", "x.size").agg(F.count("*").alias("n")).where("size IS NOT NULL")
    total = n.groupBy(F.col("source").alias("of"), F.col("unit").alias("in")).agg(F.sum("n").alias("total"))
    hit = (F.col("size") >= LIMIT_LEAST) & (F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_SHARE * F.col("total"))
    return n.join(total, F.col("source").eqNullSafe(F.col("of")) & (F.col("unit") == F.col("in"))).where(hit).select("source", "unit", "size")


_STATE = "doc_id long, source string, chars long, bytes long, kind string, ask string, loose boolean, ended boolean, gap boolean, tail long, " + ", ".join(f"h{o} long" for o in ORDERS)


def _signed(h: int | None) -> int | None:
    return None if h is None else (h ^ 1 << 63) - (1 << 63)


def _endings(rows: DataFrame) -> DataFrame:
    """How each row of (doc_id, source, text) ends, its sizes, and the hashes of its last characters; no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                e, t = ending(text), text or ""
                asked = tail_hashes(e.tail) if e.tail else {}
                tail = _tail_key(e.tail) if e.tail else None
                out.append((len(t), len(t.rstrip("�").encode("utf-8", "replace")), e.kind, e.ask, e.loose, e.ended, e.gap, tail, *[_signed(asked.get(o)) for o in ORDERS]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), *[pa.int64()] * (1 + len(ORDERS))]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[c.split()[0] for c in _STATE.split(", ")])

    return rows.mapInArrow(run, _STATE)


def _contexts(rows: DataFrame, tails: DataFrame) -> DataFrame:
    """(tail, n): what followed the longest known context of each tail, counted over the texts of all rows.

    A table of 2 ** SLOT_BITS bits tells which contexts no tail has; what passes it is summed per run of text, then by
    Spark, and met by the contexts asked for, so its size has no influence on the counts.
    """
    asked = tails.select("tail", F.explode(F.array(*[F.struct(F.lit(o).alias("order"), F.col(f"h{o}").alias("h")) for o in ORDERS])).alias("x")).select("tail", "x.*").where("h IS NOT NULL")
    slots = np.zeros(1 << SLOT_BITS, bool)
    slots[np.asarray(asked.select(F.shiftrightunsigned("h", 64 - SLOT_BITS).cast("int").alias("slot")).distinct().toArrow()["slot"])] = True
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            for codes in _runs([t for t in batch.column(0).to_pylist() if t]):
                nxt = _KINDS[codes[1:]]
                for order, ends, h in _hashes(codes[:-1], wanted):
                    keys, n = _tallied(_followed(h, nxt[ends]))
                    columns = [pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)), *[pa.array(n[:, k]) for k in range(4)]]
                    yield pa.RecordBatch.from_arrays(columns, names=["o", "k", "n0", "n1", "n2", "n3"])

    counts = rows.select("text").mapInArrow(run, "o int, k long, n0 long, n1 long, n2 long, n3 long").groupBy("o", "k").agg(F.array(*[F.sum(f"n{i}") for i in range(4)]).alias("n"))
    known = asked.join(counts.where(F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y) >= KNOWN), (F.col("order") == F.col("o")) & (F.col("h") == F.col("k")))
    return known.groupBy("tail").agg(F.max_by("n", "order").alias("n"))


def by_limits(light: DataFrame, known: DataFrame) -> DataFrame:
    """``light`` (source, chars, bytes) with ``full``: the text has a length of ``known`` of its source.

    The limits of a source, at most 2 / LIMIT_SHARE, meet its rows as one array; a sequence broken by the cut may have
    taken up to three bytes with it.
    """
    sizes = {u: F.collect_set(F.when(F.col("unit") == u, F.col("size").cast("long"))) for u in ("chars", "bytes")}
    by = known.groupBy(F.col("source").alias("_of")).agg(*[n.alias(f"_{u}") for u, n in sizes.items()])
    hit = F.array_contains("_chars", F.col("chars")) | F.arrays_overlap("_bytes", F.array(*[F.col("bytes") + d for d in range(4)]))
    return light.join(by, F.col("source").eqNullSafe(F.col("_of")), "left").withColumn("full", F.coalesce(hit, F.lit(False))).drop("_of", "_chars", "_bytes")


def baselines(told: DataFrame) -> DataFrame:
    """(source, baseline, free_source, strict_source): how prose of each source lacks a terminator, counted over all documents.

    Endings at a field limit and those where text goes on are no choice of the source and don't count. A source's
    rate is drawn to that of all by BASELINE_ENDINGS; the baseline is its odds over those of all sources.
    """
    goes_on = F.col("n")[0] > F.col("n")[1] + F.col("n")[2] + F.col("n")[3]
    lacks = (F.col("ask") == "open") & ~F.col("full") & ~F.coalesce(goes_on, F.lit(False))
    by = told.groupBy("source").agg(F.count(F.when(lacks, 1)).alias("lacking"), F.count(F.when(F.col("ended") & ~F.col("full"), 1)).alias("ending"))
    every = by.agg(F.coalesce(F.sum("lacking"), F.lit(0)).alias("lacking"), F.coalesce(F.sum("ending"), F.lit(0)).alias("ending")).first()
    rate = (every["lacking"] + 0.5) / (every["lacking"] + every["ending"] + 1)
    own = (F.col("lacking") + BASELINE_ENDINGS * rate) / (F.col("lacking") + F.col("ending") + BASELINE_ENDINGS)
    return by.select("source", (own / (1 - own) / (rate / (1 - rate))).alias("baseline"), (own > 0.5).alias("free_source"), (own <= STRICT_SHARE).alias("strict_source"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cut_kind) for each row of ``docs`` (doc_id, source, text): cut_kind null for whole texts.

    A first pass over the texts tells how each ends, a second counts what follows the last characters of the open
    ones in all documents; limits and baselines of each source are counted over all documents as well. Only
    endings, never texts, are checkpointed, shuffled and joined. Null sources have limits and a baseline of
    their own; repeated rows are judged alike; empty tables give no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    checkpoint_dir(docs.sparkSession)
    light = _endings(spread(rows)).checkpoint()
    tails = light.where("tail IS NOT NULL").groupBy("tail").agg(*[F.first(f"h{o}").alias(f"h{o}") for o in ORDERS])
    known = _contexts(spread(rows), tails)
    told = by_limits(light, limits(light)).join(known, "tail", "left").select("doc_id", "source", "kind", "ask", "loose", "gap", "ended", "full", "n").checkpoint()
    by = baselines(told).withColumnRenamed("source", "_of")
    told = told.join(by, F.col("source").eqNullSafe(F.col("_of")), "left").select("doc_id", "source", "kind", "ask", "loose", "gap", "full", "n", "baseline", "free_source", "strict_source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, source, *rest = batch.columns
            kinds = [verdict(Ending(kind, ask, None, loose, False, gap), full, n, baseline, free, strict) for kind, ask, loose, gap, full, n, baseline, free, strict in zip(*[c.to_pylist() for c in rest], strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, source, pa.array(kinds, pa.string())], names=["doc_id", "source", "cut_kind"])

    return told.mapInArrow(run, "doc_id long, source string, cut_kind string")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id) of the cut documents."""
    return judge(docs).where("cut_kind IS NOT NULL").select("doc_id").distinct()


def by_source(docs: DataFrame) -> DataFrame:
    """How often each source truncates: (source, n_docs, n_cut, cut_share)."""
    n_cut = F.count(F.when(F.col("cut_kind").isNotNull(), 1))
    return judge(docs).groupBy("source").agg(F.count("*").alias("n_docs"), n_cut.alias("n_cut"), (n_cut / F.count("*")).alias("cut_share"))
