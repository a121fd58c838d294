"""Problem 5: languages of texts and of the segments of mixed texts, by prediction by partial matching."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.messages import messages
from ..session import spread
from . import prose
from .samples import sampled

#: Bound of the sample of labelled messages that the context trees are built from.
SAMPLE_MESSAGES = 16_000
#: Longest context in bytes; a change of language inside a text costs so many bits.
ORDER, SWITCH_BITS = 4, 24.0
#: Units scored before are looked up while at most so many are kept per task; this bounds memory, not results.
KEPT_UNITS = 200_000

#: Other spellings of languages than their two-letter code (three-letter codes, English and own names).
_SPELLINGS = {
    "de": "deu ger german deutsch", "en": "eng english", "es": "spa spanish español espanol castellano", "fr": "fra fre french français francais",
    "it": "ita italian italiano", "ja": "jpn japanese 日本語", "pt": "por portuguese português portugues", "ru": "rus russian русский",
    "zh": "zho chi cmn chinese mandarin 中文 汉语 普通话 简体中文 繁體中文",
}
_CODES = {w: c for c, words in _SPELLINGS.items() for w in [c, *words.split()]}
_UNKNOWN = frozenset("unknown und undetermined n/a na none null nan ? - -- xx zxx mis unk undefined unspecified tbd other".split())


def label_code(label: str | None) -> str | None:
    """The language that a label names: its code, '' for a label that is missing or says unknown, None for any other."""
    s = (label or "").strip().lower()
    if not s or s in _UNKNOWN:
        return ""
    return _CODES.get(s) or _CODES.get(re.split(r"[-_ (/]", s)[0])


#: Stretches that are no prose, looked for in lines that have one of the signs they start with, and lines that name people.
_SIGN = re.compile(r"[`<&$\\\[{|]|://|www\.|@")
_SPAN = re.compile(
    r"<code[^>]*>.*|`[^`\n]*`|<!--.*?-->|</?[a-zA-Z][^<>\n]*>|&[a-zA-Z#0-9]{2,8};|https?://\S+|www\.\S+|(?<![^\s@])[^\s@]++@\S+|\$[^$\n]+\$|\\\(.*?\\\)|\\\[.*?\\\]"
    r"|\\(?:begin|end|label|cite|ref|usepackage)\*?\{[^{}\n]*\}(?:\[[^\]]*\])?|\\[a-zA-Z]+\*?|\]\([^)\n]*\)|\[\[[^\[\]|\n]*+\||\[\[[^\[\]|\n]*+\]\]|\{\{[^{|}\n]*+\||\{(?:code|noformat|quote|panel|color)(?:[:=][^}\n]*)?\}"
)
_NAMES = re.compile(r"^(?:Author|Committer|Signed-off-by|Co-authored-by|Reviewed-by|Merge|Date|Cc):[^<\n]*(?:<[^>\n]*>\.?)?|^\d+(?:;[^;\n]*)+$|^h[1-6]\.\s")
_CAMEL = re.compile(r"[a-z0-9][A-Z][a-z]")
_EDGE = ".,!?;:\"'()[]{}*~«»“”„‘’¿¡…|<>=+#-–—/"
_STOP = frozenset(".!?;:|")
_CLOSE = "\"')]*~»”’}"
_LETTERS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_CJK_NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.()/-]*")
_CJK_STOP = re.compile(r"[。！？；：]")


def units(text: str) -> list[str]:
    """Runs of prose between sentence marks and line ends: code, identifiers, markup and numbers are left out."""
    out: list[str] = []
    for row in prose.lines(text):
        if row.kind != "text":
            continue
        line = row.text
        if line[:1].isdigit() or line[:1] in "ACDMRSh":
            line = _NAMES.sub(" ", line)
        if _SIGN.search(line):
            line = _SPAN.sub(" ", line.replace("|", " | "))
        run: list[str] = []
        for token in line.split():
            if token.isalpha() and token.isascii() and (token.islower() or token.istitle()):
                run.append(token)
                continue
            core = token.strip(_EDGE)
            if not core:
                pass
            elif _CJK.search(core):
                parts = _CJK_STOP.split(_CJK_NAME.sub(" ", core))
                for i, part in enumerate(parts):
                    if i and run:
                        out.append(" ".join(run).lower())
                        run = []
                    run += _LETTERS.findall(part)
            elif core.isalpha():
                if not _CAMEL.search(core):
                    run.append(core)
            elif not any(ch.isdigit() or ch in "_/\\@()=.$" for ch in core):
                run += _LETTERS.findall(core)
            if run and (token.rstrip(_CLOSE)[-1:] in _STOP or token[-1] in "。！？；："):
                out.append(" ".join(run).lower())
                run = []
        if run:
            out.append(" ".join(run).lower())
    return out


def is_weak(unit: str) -> bool:
    """A unit too short to tell a language by itself, such as a heading or a table cell."""
    return unit.count(" ") < 2 and len(unit) < 25 and len(_CJK.findall(unit)) < 4


class Trees(NamedTuple):
    """Context trees of all languages in one table per order: code lengths of known strings, escapes of known contexts."""

    langs: list[str]
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def _grams(data: bytes, k: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    key = np.zeros(len(b) - k + 1, np.uint64)
    for i in range(k):
        key = (key << np.uint64(8)) | b[i : len(b) - k + 1 + i]
    return key


def grow(texts: dict[str, list[str]], langs: list[str]) -> Trees:
    """Frozen statistics: counts of each language's byte strings up to ORDER + 1, as code lengths in bits.

    A symbol seen n times in a context of t symbols, d of them distinct, costs log2((t + d) / n) bits; an escape to
    the next shorter context log2((t + d) / d); below order 0 all bytes are alike.
    """
    keys, bits, contexts, escapes = [], [], [], []
    pad = b"\n" * (ORDER + 1)
    data = {x: pad + (b"\n" * ORDER).join(t.encode() for t in texts.get(x, [])) + pad for x in langs}
    for k in range(1, ORDER + 2):
        counted = [np.unique(_grams(data[x], k), return_counts=True) for x in langs]
        key = np.unique(np.concatenate([u for u, _ in counted]))
        n = np.zeros((len(key), len(langs)), np.float32)
        for j, (u, c) in enumerate(counted):
            n[np.searchsorted(key, u), j] = c
        context, where = np.unique(key >> np.uint64(8), return_inverse=True)
        t = np.zeros((len(context), len(langs)), np.float32)
        d = np.zeros_like(t)
        np.add.at(t, where, n)
        np.add.at(d, where, (n > 0).astype(np.float32))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(t > 0, np.log2((t + d) / d), 0).astype(np.float32)
            own = np.log2((t + d)[where] / n)
        if k == 1:
            shorter = np.full((1, len(langs)), 8, np.float32)
            at = np.zeros(len(key), int)
        else:
            shorter = bits[-1]
            at = np.minimum(np.searchsorted(keys[-1], key & np.uint64((1 << (8 * (k - 1))) - 1)), len(keys[-1]) - 1)
        keys.append(key)
        contexts.append(context)
        escapes.append(escape)
        bits.append(np.where(n > 0, own, escape[where] + shorter[at]).astype(np.float32))
    return Trees(langs, keys, bits, contexts, escapes)


def code_lengths(texts: list[str], trees: Trees) -> np.ndarray:
    """Bits that each text takes in each language (rows: texts)."""
    if not texts:
        return np.zeros((0, len(trees.langs)), np.float32)
    gap = b"\n" * ORDER  # every text starts in the same context, whatever stands before it
    coded = [t.encode() for t in texts]
    data = gap + gap.join(coded)
    total = np.zeros((len(data) - ORDER, len(trees.langs)), np.float32)
    todo = np.arange(len(total))
    key = _grams(data, ORDER + 1)
    for k in range(ORDER + 1, 0, -1):
        low = key[todo] & np.uint64((1 << (8 * k)) - 1)
        i = np.minimum(np.searchsorted(trees.keys[k - 1], low), len(trees.keys[k - 1]) - 1)
        hit = trees.keys[k - 1][i] == low
        total[todo[hit]] += trees.bits[k - 1][i[hit]]
        todo, context = todo[~hit], low[~hit] >> np.uint64(8)
        if not len(todo):
            break
        j = np.minimum(np.searchsorted(trees.contexts[k - 1], context), len(trees.contexts[k - 1]) - 1)
        known = trees.contexts[k - 1][j] == context
        total[todo[known]] += trees.escapes[k - 1][j[known]]
    total[todo] += 8
    sums = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(total, axis=0, dtype=np.float64)])
    ends = np.cumsum([len(c) + ORDER for c in coded]) - ORDER
    starts = ends - [len(c) for c in coded]
    return (sums[ends] - sums[starts]).astype(np.float32)


def train(labelled: list[tuple[str, str]]) -> Trees:
    """Trees from (text, language) pairs whose labels may be wrong.

    Each distinct unit takes the label it has most often. A unit met three times or more with a clear majority is
    trusted; any other stays only if the trees of the other half of the units read it as its label says, so that
    no unit is judged by trees that hold its own wrong label.
    """
    langs = sorted(_SPELLINGS)
    votes: dict[str, np.ndarray] = {}
    for text, code in labelled:
        if code in langs:
            for u in units(text):
                if not is_weak(u):
                    votes.setdefault(u, np.zeros(len(langs)))[langs.index(code)] += 1
    known = sorted(votes)
    at = np.array([votes[u].argmax() for u in known], int)
    sure = np.array([votes[u].sum() >= 3 and votes[u].max() >= 0.6 * votes[u].sum() for u in known], bool)
    half = np.array([zlib.crc32(u.encode()) % 2 for u in known], int)

    def build(keep: np.ndarray) -> Trees:
        return grow({x: [u for u, j, k in zip(known, at, keep, strict=True) if k and j == i] for i, x in enumerate(langs)}, langs)

    keep = sure.copy()
    for h in (0, 1):
        rest = np.flatnonzero(~sure & (half == h))
        trees = build(half != h if sure.sum() < len(known) / 20 else sure | (half != h)) if len(rest) else None
        for start in range(0, len(rest), 10_000):
            part = rest[start : start + 10_000]
            keep[part] = code_lengths([known[i] for i in part], trees).argmin(1) == at[part]
    return build(keep)


class Reader:
    """Segments texts with given trees, keeping what units it scored."""

    def __init__(self, trees: Trees):
        self.trees, self.known = trees, {}

    def segments(self, texts: list[str | None]) -> list[list[tuple[str, float, str]]]:
        """For each text its segments in order: (language, confidence, prose of the segment)."""
        parts = [units(t) if t else [] for t in texts]
        new = list({u for p in parts for u in p} - self.known.keys())
        if len(self.known) + len(new) > KEPT_UNITS:
            self.known.clear()
            new = list({u for p in parts for u in p})
        for start in range(0, len(new), 5_000):
            some = new[start : start + 5_000]
            for u, row in zip(some, code_lengths(some, self.trees), strict=True):
                order = np.argsort(row)
                self.known[u] = (int(order[0]), float(row[order[1]] - row[order[0]]), row, is_weak(u), float(row[order[0]]) / max(1, len(u.encode())))
        return [self._path(p) for p in parts]

    def _path(self, parts: list[str]) -> list[tuple[str, float, str]]:
        if not parts:
            return []
        got = [self.known[u] for u in parts]
        strong = [(u, g) for u, g in zip(parts, got, strict=True) if not g[3]]
        if not strong:
            # a few words only: prose if they read like words of a language
            strong = [(u, g) for u, g in zip(parts, got, strict=True) if g[4] < 3.0]
            if not strong or sum(len(u) for u, _ in strong) < 4:
                return []
        first = strong[0][1][0]
        if all(g[0] == first for _, g in strong):
            path = [first] * len(strong)
        else:
            cost = strong[0][1][2].copy()
            back = []
            for _, g in strong[1:]:
                best = int(cost.argmin())
                stay = cost <= cost[best] + SWITCH_BITS
                back.append(np.where(stay, np.arange(len(cost)), best))
                cost = np.where(stay, cost, cost[best] + SWITCH_BITS) + g[2]
            path = [int(cost.argmin())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path.reverse()
        out, at = [], 0
        while at < len(path):
            end = at
            while end < len(path) and path[end] == path[at]:
                end += 1
            if end - at == 1:
                # of one unit, its language is the first and its lead over the second is kept with it
                rival = strong[at][1][1] if strong[at][1][0] == path[at] else 0.0
            else:
                total = sum(g[2] for _, g in strong[at:end])
                rival = float(np.partition(total, 1)[1] - total[path[at]])
            confidence = 1 / (1 + 2 ** -min(60.0, max(0.0, rival / 4)))
            out.append((self.trees.langs[path[at]], round(confidence, 4), " ".join(u for u, _ in strong[at:end])))
            at = end
        return out


def texts_of(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    """(table_name, record_id, msg_pos, label, text) of all messages and annotated texts."""
    a = messages(raw, "row_id").select(
        F.lit("raw_corpus").alias("table_name"), F.col("row_id").cast("long").alias("record_id"), F.col("msg_pos").cast("int").alias("msg_pos"), F.col("language").alias("label"), F.col("content").alias("text")
    )
    b = enriched.select(
        F.lit("enriched_records").alias("table_name"), F.col("log_line").cast("long").alias("record_id"), F.lit(0).alias("msg_pos"), F.col("detected_language").alias("label"), F.col("natural_language_text").alias("text")
    )
    return a.unionByName(b)


def labelled_sample(raw: DataFrame, bound: int = SAMPLE_MESSAGES) -> list[tuple[str, str]]:
    """About ``bound`` (text, language of the label) pairs of records chosen by a hash of row_id."""
    return [(text, c) for text, label in sampled(raw, bound, "content", "language") if (c := label_code(label))]


def segment(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    """(table_name, record_id, msg_pos, label, segment_no, lang, confidence, n_segments): all segments of all texts.

    Trees come from a bounded sample of labelled messages and are sent to the executors; each text is then read
    once, whole, where it lies. Null texts and texts without prose have no segments; repeated rows are alike.
    """
    trees = raw.sparkSession.sparkContext.broadcast(train(labelled_sample(raw)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for b in batches:
            reader = reader or Reader(trees.value)
            found = reader.segments(b.column("text").to_pylist())
            at = np.repeat(np.arange(len(found)), [len(s) for s in found])
            kept = b.drop_columns(["text"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *kept.columns,
                    pa.array([i for s in found for i in range(len(s))], pa.int32()),
                    pa.array([x[0] for s in found for x in s], pa.string()),
                    pa.array([x[1] for s in found for x in s], pa.float64()),
                    pa.array([len(s) for s in found for _ in s], pa.int32()),
                ],
                names=["table_name", "record_id", "msg_pos", "label", "segment_no", "lang", "confidence", "n_segments"],
            )

    return spread(texts_of(raw, enriched)).mapInArrow(run, "table_name string, record_id long, msg_pos int, label string, segment_no int, lang string, confidence double, n_segments int")


def label_language() -> Column:
    """Column expression of the language that ``label`` names: null for missing, unknown and unheard-of labels."""
    s = F.lower(F.btrim("label"))
    pairs = [F.lit(x) for kv in _CODES.items() for x in kv]
    names = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(names, s), F.try_element_at(names, F.split(s, r"[-_ (/]")[0]))


def found_rows(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    """(table_name, record_id, msg_pos, segment_no, lang) of texts with a missing or wrong label or several languages."""
    rows = segment(raw, enriched)
    right = F.coalesce(label_language() == F.col("lang"), F.lit(False))
    return rows.where((F.col("n_segments") > 1) | ~right).select("table_name", "record_id", "msg_pos", "segment_no", "lang").distinct()


def language_rows(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    """(table_name, record_id, msg_pos, segment_no, lang, confidence) of every segment."""
    return segment(raw, enriched).select("table_name", "record_id", "msg_pos", "segment_no", "lang", "confidence")
