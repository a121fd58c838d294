"""Problem 3: credentials in code and configuration, found by a trained classifier and redacted in place."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.messages import messages
from ..session import checkpoint_dir, spread

#: More trigrams, and more labels, weigh as much as so many against the smoothing and the weights before training, so that a larger table is judged alike.
MOST_TRIGRAMS, MOST_LABELS = 3_000_000, 7_500
THRESHOLD = 0.5

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\s\\]*)", re.S)
_NAME = r"(?<![\w$.-])(?P<name>[A-Za-z_$][\w$.-]*+)"
_FORMS = {
    "userinfo": re.compile(r"(?<![\w+.-])[a-z][a-z0-9+.-]*+://(?P<name>[^\s/:@\"'<>]*+):(?P<value>[^\s@\"'/<>]{3,}+)@(?=[\w.\[-])"),
    "parameter": re.compile(r"[?&](?P<name>[A-Za-z][\w.-]*)=(?P<value>[^&\s\"'#<>)]{6,})"),
    "header": re.compile(r"\b(?P<name>(?:Proxy-)?Authorization)[\"']?\s*[:=,]\s*[\"']?(?:Basic|Bearer|Token|ApiKey|Digest|Bot)\s+(?P<value>[^\s\"'<>,;]{4,})", re.I),
    "user_flag": re.compile(r"(?<!\w)(?:-u|--user)[ =][\"']?(?P<name>[\w.@-]+):(?P<value>[^\s\"']{3,})"),
    "flag": re.compile(r"(?<!\w)--?(?P<name>[a-z][a-z-]*)[ =][\"']?(?P<value>[^\s\"'-][^\s\"']{5,})"),
    "assign": re.compile(
        rf"{_NAME}[\"'`]?\]?[^\S\n]*(?::=|=>|<-|==?|:)[^\S\n]*"
        r"(?:[rbfu@]?\"(?P<dq>[^\"\n]{4,})\"|[rbfu@]?'(?P<sq>[^'\n]{4,})'|(?P<bare>[^\s\"'`,;<>(){}\[\]]{4,}+)(?![\w(\[{]|[^\S\n]+[\"']))"
    ),
    "connection": re.compile(r"(?:^|[;\"'\s])(?P<name>[A-Za-z][A-Za-z ]{0,30}?)=(?P<value>[^;\"'\s]{4,})(?=;|[\"'])"),
    "element": re.compile(r"<(?P<name>[A-Za-z][\w.:-]*)>(?P<value>[^<>\s]{4,})</"),
    "spoken": re.compile(
        r"\b(?P<name>ENV\s+[A-Z_]+|identified\s+by|SecureString|password|passwd|passphrase|passwort|pwd|token|secret|api[ _-]?key|access[ _-]?key|auth[ _-]?token)"
        r"(?:[^\S\n]+(?:is|was|ist|es|est|lautet)|[^\S\n]+for[^\S\n]+\S+[^\S\n]+is|:)?[^\S\n]+[\"'`]?(?P<value>[^\s\"'`<>]{5,})",
        re.I,
    ),
    # the last part of a web hook's address is its secret: whoever has it may post
    "webhook": re.compile(r"https?://hooks?\.[\w.-]+/(?P<name>services?|hooks?|webhooks?|workflows?)(?:/[A-Z0-9]{4,})*/(?P<value>[A-Za-z0-9_-]{12,})"),
    "prefixed": re.compile(r"(?<![\w/+.-])(?P<name>)(?P<value>(?:[a-z]{2,5}_(?:live|test|pat|prod)_|gh[pousr]_|xox[abpr]-|sk-|glpat-|nbl_|AKIA)[A-Za-z0-9_-]{14,})"),
}
#: A form is looked for only where its signs, parts of what the pattern needs, are in the text in lower case: one of each group.
_SIGNS = {
    "userinfo": (("://",), ("@",)), "parameter": (("?", "&"), ("=",)), "header": (("authorization",),), "user_flag": (("-u",),), "flag": (("-",),), "assign": (("=", ":", "<-"),),
    "connection": (("=",), (";", '"', "'")), "element": (("</",),), "webhook": (("://hook",),),
    "spoken": (("env", "identified", "securestring", "pass", "pwd", "token", "secret", "key"),),
    "prefixed": (("_live_", "_test_", "_pat_", "_prod_", "gho_", "ghp_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "glpat-", "nbl_", "akia"),),
}

_GOOD = re.compile(r"pass(?:word|wd|phrase|wort)?|pwd|\bpw\b|secret|token|api_?key|apikey|access_?key|auth|cred|private_?key|signing|sig(?:nature)?\b|identified|secure_?string|_key\b|\bkey\b|\bcode\b", re.I)
_STRONG = re.compile(r"pass(?:word|wd|phrase|wort|\b)|_pass\b|pwd|\bpw\b|secret|token|api_?key|authorization|identified|secure_?string|secret_?access_?key|access_?key|private_?key|cred", re.I)
#: Last words of a name that make it something other than a credential, and words that do so anywhere.
_BAD_LAST = frozenset(
    "id ids hash checksum digest commit sha sha1 sha256 sha512 md5 integrity fingerprint trace request version image url uri host user username limit field "
    "length count name resolved port expires expiry type scope path file server database timeout format tree parent endpoint label prefix policy column header "
    "size index row code status pattern regex min max input".split()
)
_BAD_ANY = frozenset("public hash checksum integrity fingerprint digest".split())


def _parts(name: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()) if w]


def _bad(name: str) -> bool:
    words = _parts(name)
    return bool(words) and (words[-1] in _BAD_LAST or not _BAD_ANY.isdisjoint(words)) and words[-3:] != ["access", "key", "id"]


def odd(value: str) -> bool:
    """Not a plain word or number: letters with digits, a capital within, a sign, or a run of capitals."""
    return bool(re.search(r"[A-Za-z].*\d|\d.*[A-Za-z]|[a-z][A-Z].*[a-zA-Z]|[^\w\s.,:-]|^[A-Z]{12,}$", value))


_PLACEHOLDER = re.compile(
    r"""^(?:x{4,}|\*{3,}|\.{3,}|-{4,}|0{6,}|1{6,}|<[^>]*>?|\[[^\]]*\]|\$\{?\w+\}?.*|%\w+%|\{\{?.*|!\w+.*|@\w+@|__\w+__|
    (?:your|my|the|some|insert|enter|put|replace|change|add)[-_ ]?.*|(?:change|replace)[-_]?me.*|.*(?:example|placeholder|dummy|redacted|changeme|your[-_]).*|
    (?:none|null|nil|true|false|undefined|string|str|password|passwd|secret|token|todo|tbd|test|bytes|number|int|bool|required|optional|empty)|
    (?:os|process|env|config|settings|secrets|vault|getpass|self|this|args|options|params|request|ctx|data|var|ssm|arn|file|https?)[.:/].*|vault_.*|.*[a-z]\.[a-z]+\(.*)$""",
    re.I | re.X,
)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_NOT_VALUE = re.compile(r"^(?:sha\d+[-:]|md5[-:]|ssh-|AAAA[A-Z]|data:|https?:|\.?/[a-z_.-]+(?:/|$)|\d+(?:\.\d+)*$|[a-z]+://)", re.I)


_HEX, _BRACKETS, _DIGIT, _LETTER = re.compile(r"[0-9a-fA-F-]{16,}"), re.compile(r"[(){}\[\]<>]|^\$"), re.compile(r"\d"), re.compile(r"[A-Za-z]")
_CLASSES = tuple(map(re.compile, (r"[a-z]", r"[A-Z]", r"\d", r"[^\w]")))
_PLAIN = re.compile(r"[a-z]+(?:[-_][a-z]+)*[-_]?\d{0,3}")
_ODD_SAID = re.compile(r"\d|[a-z][A-Z]|[A-Za-z][!@#$%^&*]")
_BEFORE = re.compile(r"(?:public|commit|checksum|integrity|sha\d|md5|digest|trace|request|ssh-)", re.I)
_JOIN, _JOINED = re.compile(r"[\"']\s*(?:[+.&\\]|\n)"), re.compile(r"[\"'](?:\s*[+.&\\]?\s*\n?\s*[\"']([^\"'\n]+)(?=[\"']))+")


@lru_cache(maxsize=4096)
def _name(name: str) -> tuple[bool, bool, bool]:
    """What the name beside a value tells: strong, good, bad."""
    joined = "_".join(_parts(name))
    return bool(_STRONG.search(joined)), bool(_GOOD.search(joined)), _bad(name)


@lru_cache(maxsize=1024)
def _shape(v: str) -> tuple[bool, bool, bool]:
    """Whether a value has the shape of a placeholder, of what is no value, of a UUID."""
    return bool(_PLACEHOLDER.match(v)), bool(_NOT_VALUE.match(v)), bool(_UUID.match(v))


class Candidate(NamedTuple):
    """A value that may be a credential: its place, the form it was found in, the name beside it."""

    start: int
    end: int
    form: str
    name: str
    value: str


def candidates(text: str) -> list[Candidate]:
    """Values in the places where credentials are written, each place once; private keys as whole blocks."""
    out: dict[int, Candidate] = {}
    blocks = [m.span() for m in _PEM.finditer(text)]
    for a, b in blocks:
        out[a] = Candidate(a, b, "pem", "private key", text[a:b])
    low = text.lower()
    for form, pattern in _FORMS.items():
        for m in pattern.finditer(text) if all(any(map(low.__contains__, group)) for group in _SIGNS[form]) else ():
            group = next(g for g in ("value", "dq", "sq", "bare") if g in pattern.groupindex and m[g] is not None)
            a, b = m.span(group)
            value = text[a:b].rstrip(".,;:!?。，)") if form in ("spoken", "flag") else text[a:b]
            if any(x <= a < y for x, y in blocks) or not value:
                continue
            known = out.get(a)
            if known is None or known.form in ("spoken", "prefixed") or form == "webhook":
                c = Candidate(a, a + len(value), form, m["name"] or "", value)
                end = joined(text, c)
                pieces = re.findall(r"[A-Za-z0-9+/=_.-]{4,}", text[c.end : end]) if end > c.end else ()
                out[a] = Candidate(a, end, form, c.name, value + "".join(pieces))
    found = sorted(out.values())
    # a value after its user name takes the place of both together; one told by its prefix alone gives way to what it is part of
    inner, kept, upto = [c.start for c in found if c.form in ("userinfo", "user_flag", "header", "parameter", "connection", "webhook")], [], -1
    for c in found:
        i = bisect_left(inner, c.start + 1)
        if (c.form == "prefixed" and c.start < upto) or (i < len(inner) and inner[i] < c.end and c.form != "pem"):
            continue
        kept.append(c)
        upto = max(upto, c.end)
    return kept


def joined(text: str, c: Candidate) -> int:
    """Where the last piece of a value written in pieces ends."""
    m = _JOINED.match(text, c.end) if _JOIN.match(text, c.end) else None
    return m.end() if m else c.end


class Markov:
    """Order-2 character model of ordinary words and names; classes of characters keep it small."""

    def __init__(self, counts: dict[str, float] | None = None):
        self.n: dict[str, float] = counts or {}
        self.of: dict[str, float] = {}
        for k, v in self.n.items():
            self.of[k[:2]] = self.of.get(k[:2], 0) + v
        self.known: dict[str, float] = {}

    def score(self, s: str) -> float:
        """Mean log likelihood of a character; low for random strings."""
        t = "^^" + _DIGIT.sub("0", s)
        if len(self.known) > 500_000:
            self.known.clear()
        total, known = 0.0, self.known
        for i in range(2, len(t)):
            k = t[i - 2 : i + 1]
            cost = known.get(k)
            if cost is None:
                cost = known[k] = log((self.n.get(k, 0) + 0.05) / (self.of.get(k[:2], 0) + 4.0))
            total += cost
        return total / max(1, len(s))


#: Words and names; those right after the sign of an assignment, a quote or an address may be values and are no ordinary words.
_WORD = re.compile(r"(?<![\w=:\"'@/])(?<![=:] )[A-Za-z][A-Za-z_.-]{2,23}(?!\w)")


def trigrams(texts: list[str]) -> dict[str, int]:
    """Trigram counts of the words and names of ``texts``, without those that stand where values do."""
    met: Counter[str] = Counter()
    for text in texts:
        met.update(_WORD.findall(text))
    counts: dict[str, int] = {}
    for w, n in met.items():
        t = "^^" + w
        for i in range(2, len(t)):
            k = t[i - 2 : i + 1]
            counts[k] = counts.get(k, 0) + n
    return counts


def markov(counts: dict[str, int]) -> Markov:
    """The model of trigram counts, brought down to MOST_TRIGRAMS in all."""
    share = min(1.0, MOST_TRIGRAMS / max(1, sum(counts.values())))
    return Markov({k: n * share for k, n in counts.items()} if share < 1 else counts)


_PATH = re.compile(
    r"(?P<config>\.(?:env|ya?ml|toml|ini|cfg|conf|properties|json|tfvars|netrc|npmrc|pypirc|htpasswd)\b|\bDockerfile\b|^```(?:ya?ml|toml|ini|dotenv|env|properties|json|dockerfile)\b)"
    r"|(?P<lock>(?:package-lock\.json|\w+\.lock|go\.sum|checksums?\.txt|SHA256SUMS)\b)|(?P<code>\.(?:py|js|tsx?|java|go|rb|rs|php|cs|sh|sql|tf|c|cpp|kt)\b|^```(?:python|py|javascript|js|typescript|ts|java|go|ruby|rust|php|csharp|c|cpp|bash|sh|sql)\b)"
    r"|(?P<test>\b(?:tests?|fixtures?|examples?|samples?)/\S|\btest_\w+\.\w+)",
    re.M | re.I,
)
_PATHS = ("config", "lock", "code", "test")
#: Parts of what the pattern needs, in lower case; the long s is an s where case is ignored.
_PATH_SIGNS = (".c", ".e", ".g", ".h", ".i", ".j", ".k", ".l", ".n", ".p", ".r", ".s", ".t", ".y", "```", "dockerfile", "checksum", "sha256sum", "s/", "t/", "e/", "test_", "\u017f")


def paths(text: str) -> list[tuple[int, str]]:
    """Where file names, paths and the tongues of fences stand in a text, and what kind of file each tells of."""
    return [(m.start(), m.lastgroup or "") for m in _PATH.finditer(text)] if any(map(text.lower().__contains__, _PATH_SIGNS)) else []


def features(c: Candidate, text: str, words: Markov, told: list[tuple[int, str]]) -> list[float]:
    """Features of a candidate: likelihood and shape of the value, names around it, where it stands, and the path told last before it."""
    before_it = bisect_left(told, (c.start, ""))
    path = told[before_it - 1][1] if before_it else ""
    v = c.value
    line = text.rfind("\n", 0, c.start) + 1
    strong, good, bad = _name(c.name)
    placeholder, no_value, uuid = _shape(v)
    return [
        1.0,
        max(-8.0, words.score(v)),
        min(len(v), 64) / 16,
        float(sum(p.search(v) is not None for p in _CLASSES)),
        float(_HEX.fullmatch(v) is not None),
        float(uuid),
        float(strong),
        float(good),
        float(bad),
        float(placeholder),
        float(no_value),
        float(_BRACKETS.search(v) is not None),
        float(_DIGIT.search(v) is not None),
        float(odd(v)),
        float(c.form in ("userinfo", "user_flag", "header", "webhook", "prefixed")),
        float(c.form == "spoken"),
        float(c.form == "parameter"),
        float(_BEFORE.search(text, line, c.start) is not None),
        *[float(path == k) for k in _PATHS],
        float(" " in v),
        float(len(v) < 5 or _PLAIN.fullmatch(v) is not None),
        # words said, not assigned: "the password expires"
        float(c.form in ("spoken", "flag") and not _ODD_SAID.search(v)),
    ]


def weak_label(c: Candidate) -> int | None:
    """1 or 0 where a pattern is sure of a candidate, else None."""
    v = c.value
    strong, good, bad = _name(c.name)
    if c.form != "webhook" and any(_shape(v)):
        return 0
    mixed = bool(_DIGIT.search(v)) and bool(_LETTER.search(v))
    if c.form in ("userinfo", "user_flag", "header") or (c.form in ("prefixed", "webhook") and mixed):
        return 1 if len(v) >= 5 and not re.search(r"[{}<>]|^\$", v) else 0
    if bad or not (c.form == "prefixed" or good):
        return 0
    if re.search(r"[(){}<>\s]|^\$", v) or not odd(v):
        return 0
    if strong and (mixed or len(v) >= 8):
        return 1
    return 1 if mixed and len(v) >= 16 else None


#: What the weights of the features are drawn to where the labels say nothing, and the rule without labels.
_PRIOR = (-5.0, -0.6, 0.1, 0.4, 0.0, -3.0, 3.0, 1.0, -3.0, -6.0, -4.0, -3.0, 0.5, 2.0, 3.0, 0.0, 0.0, -3.0, 0.5, -1.0, 0.0, -0.5, -4.0, -2.0, -3.0)


#: What the weights of the calibration are drawn to.
_PLATT = (1.0, 0.0)


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, each: tuple[float, float]) -> np.ndarray:
    """Loss, gradient and curvature of the logistic regression at ``w`` over labelled rows, one after the other; ``each``: what a label of 0 and one of 1 weighs."""
    z, n = x @ w, np.where(y == 1, each[1], each[0])
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.concatenate([[n @ (np.logaddexp(0, z) - y * z)], x.T @ (n * (p - y)), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], prior: tuple[float, ...], ridge: float) -> np.ndarray:
    """The weights, drawn to ``prior``, with the least loss: Newton steps, each halved until the loss falls, else they may run away."""
    start = np.array(prior)
    k = len(start)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s, d = sums(w), w - start
        return s[0] + ridge / 2 * (d @ d), s[1 : k + 1] + ridge * d, s[k + 1 :].reshape(k, k) + ridge * np.eye(k)

    w, here = start, at(start)
    for _ in range(25):
        step = np.linalg.solve(here[2], here[1])
        if np.abs(step).max() < 1e-6:
            break
        there = at(w - step)
        while there[0] > here[0] and np.abs(step).max() > 1e-6:
            step = step / 2
            there = at(w - step)
        if there[0] >= here[0]:
            break
        w, here = w - step, there
    return w


def _each(no: int, yes: int) -> tuple[float, float]:
    """What each label weighs: both classes the same, which keeps the scores comparable, and MOST_LABELS at most in all."""
    n = min(no + yes, MOST_LABELS)
    return n * 0.5 / max(1, no), n * 0.5 / max(1, yes)


class Model(NamedTuple):
    words: Markov
    weights: list[float]
    scale: tuple[float, float]


#: Sums over the labels (held back for the calibration or not): given weights, what labels weigh, and the weights through which rows are first made scores, if any.
Sums = Callable[[bool, np.ndarray, tuple[float, float], np.ndarray | None], np.ndarray]


def fitted(words: Markov, counts: dict[tuple[bool, int], int], sums: Sums) -> Model:
    """The model of weak labels, of which ``counts`` are (held back, label) and ``sums`` the sums.

    Scores are calibrated by Platt scaling on the tenth of the labels that the regression doesn't see. Without
    labels of both kinds a fixed rule on names and shape stands in.
    """
    n = {k: counts.get(k, 0) for k in ((False, 0), (False, 1), (True, 0), (True, 1))}
    if not (n[False, 0] + n[True, 0] and n[False, 1] + n[True, 1]):
        return Model(words, list(_PRIOR), _PLATT)
    w = _newton(lambda w: sums(False, w, _each(n[False, 0], n[False, 1]), None), _PRIOR, 0.05)
    scale = _PLATT
    if n[True, 0] and n[True, 1]:
        k, m = _newton(lambda v: sums(True, v, _each(n[True, 0], n[True, 1]), w), _PLATT, 1.0)
        scale = (max(0.1, float(k)), float(m))
    return Model(words, w.tolist(), scale)


def _scored(x: np.ndarray, through: np.ndarray | None) -> np.ndarray:
    return x if through is None else np.stack([x @ through, np.ones(len(x))], 1)


def train(texts: list[str]) -> Model:
    """Markov model and classifier from weakly labelled pattern matches in ``texts``; every tenth label is held back."""
    found = [candidates(t) for t in texts]
    words = markov(trigrams(texts))
    x, y = [], []
    for t, values in zip(texts, found, strict=True):
        told = paths(t) if values else []
        for c in values:
            label = weak_label(c)
            if c.form != "pem" and label is not None:
                x.append(features(c, t, words, told))
                y.append(label)
    a, b = np.array(x).reshape(-1, len(_PRIOR)), np.array(y, float)
    held = np.arange(len(b)) % 10 == 0
    counts = Counter(zip(held.tolist(), y, strict=True))
    return fitted(words, counts, lambda back, w, each, through: _sums(_scored(a[held == back], through), b[held == back], w, each))


def probability(x: list[float], model: Model) -> float:
    """Calibrated probability that a candidate with features ``x`` is a credential."""
    z = sum(w * f for w, f in zip(model.weights, x, strict=True))
    z = model.scale[0] * z + model.scale[1]
    return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def score(c: Candidate, text: str, model: Model, told: list[tuple[int, str]]) -> float:
    """Calibrated probability that a candidate is a credential; the block of a private key is one by its form."""
    return 1.0 if c.form == "pem" else probability(features(c, text, model.words, told), model)


def _placeholder(c: Candidate) -> bool:
    """The exact check beside the score: placeholders, references to a value held elsewhere, and ids in the form of UUIDs."""
    return c.form not in ("pem", "webhook") and bool(any(_shape(c.value)) or re.search(r"[{}<>]|\$\(|\(\)", c.value))


def found(text: str | None, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, score) of the credentials of a text, in order; none for null and blank texts."""
    if not text or not text.strip():
        return []
    out, upto, told = [], -1, None
    for c in candidates(text):
        if c.start < upto or _placeholder(c):
            continue
        told = paths(text) if told is None else told
        s = score(c, text, model, told)
        if s >= THRESHOLD:
            upto = c.end
            out.append((c.start, upto, s))
    return out


def redact(text: str | None, model: Model) -> str | None:
    """The text with each credential replaced by [CREDENTIAL]; names, quotes and everything else stay as they are."""
    return _replaced(text, found(text, model))


def _replaced(text: str | None, hits: list[tuple[int, int, float]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, _ in hits:
        out += [text[at:a], "[CREDENTIAL]"]
        # of a value in pieces the joining signs go as well, so that the code stays whole
        at = b
    return "".join(out) + text[at:]


def all_words(rows: DataFrame) -> Markov:
    """The Markov model of all messages: trigrams are counted per batch before anything is shuffled; there are few, being of letters and three marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = trigrams([t for t in b.column(0).to_pylist() if t])
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["k", "n"])

    counts = rows.select("content").mapInArrow(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return markov({r["k"]: r["n"] for r in counts.collect()})


_VALUE = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("label", pa.int8()), ("block", pa.bool_()), ("placeholder", pa.bool_()), ("x", pa.binary())])


def _values(rows: DataFrame, words) -> DataFrame:
    """(row_id, msg_pos, found array<struct<start_pos,end_pos,label,block,placeholder,x>>) of the messages with candidates, checkpointed: places, weak labels and features, no texts."""

    def told_of(text: str) -> list[tuple]:
        told = paths(text) if (got := candidates(text)) else []
        return [(c.start, c.end, weak_label(c), c.form == "pem", _placeholder(c), np.array(features(c, text, words.value, told)).tobytes()) for c in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [told_of(t) if t and t.strip() else [] for t in b.column(2).to_pylist()]
            at = pa.array([i for i, x in enumerate(got) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([x for x in got if x], pa.list_(_VALUE))], names=["row_id", "msg_pos", "found"])

    return rows.mapInArrow(run, "row_id long, msg_pos int, found array<struct<start_pos:int,end_pos:int,label:tinyint,block:boolean,placeholder:boolean,x:binary>>").checkpoint()


def _fitted(values: DataFrame, words: Markov) -> Model:
    """The model of the weak labels of all messages: each Newton step sums over all of them where they lie; a hash of the place holds back a tenth."""
    held = F.pmod(F.xxhash64("row_id", "msg_pos", "s.start_pos"), F.lit(10)) == 0
    labelled = values.select("row_id", "msg_pos", F.explode("found").alias("s")).where("s.label IS NOT NULL AND NOT s.block").select(held.alias("held"), F.col("s.label").alias("y"), F.col("s.x").alias("x"))

    def sums(back: bool, w: np.ndarray, each: tuple[float, float], through: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + len(w) + len(w) ** 2)
            for b in batches:
                x = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, -1)
                if len(x):
                    total += _sums(_scored(x, through), b.column(0).to_numpy(zero_copy_only=False), w, each)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        got = labelled.where(F.col("held") == back).select("y", "x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(got)])

    return fitted(words, {(r["held"], r["y"]): r["count"] for r in labelled.groupBy("held", "y").count().collect()}, sums)


def learnt(raw: DataFrame) -> tuple[DataFrame, DataFrame, Model]:
    """The messages (row_id, msg_pos, content), their candidates, and the model trained on all of them."""
    checkpoint_dir(raw.sparkSession)
    rows = spread(messages(raw, "row_id").select(F.col("row_id").cast("long").alias("row_id"), "msg_pos", "content"))
    words = all_words(rows)
    values = _values(rows, raw.sparkSession.sparkContext.broadcast(words))
    return rows, values, _fitted(values, words)


def scan(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, content, spans array<struct<start_pos,end_pos,score>>, redacted) of every message.

    A first pass counts the words of all messages, a second labels all candidates weakly and trains the classifier on
    them; then a last one goes over each whole message where it lies, without a shuffle.
    Null contents have no spans and stay null; repeated rows are treated alike; an empty table gives no rows.
    """
    rows, _, fit = learnt(raw)
    model = raw.sparkSession.sparkContext.broadcast(fit)
    span = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            hits = [found(t, model.value) for t in texts]
            clean = [_replaced(t, h) for t, h in zip(texts, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.list_(span)), pa.array(clean, pa.string())], names=["row_id", "msg_pos", "spans", "redacted"])

    return rows.mapInArrow(run, "row_id long, msg_pos int, spans array<struct<start_pos:int,end_pos:int,score:double>>, redacted string")


def found_rows(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, start_pos): one row per credential; repeated rows come out once. Candidates are scored as they were labelled, without their texts."""
    _, values, model = learnt(raw)
    light = raw.sparkSession.sparkContext.broadcast(model._replace(words=Markov()))

    def starts(values: list[dict]) -> list[int]:
        out, upto = [], -1
        for c in values:
            if c["start_pos"] >= upto and not c["placeholder"] and (c["block"] or probability(np.frombuffer(c["x"]).tolist(), light.value) >= THRESHOLD):
                upto = c["end_pos"]
                out.append(c["start_pos"])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [starts(x) for x in b.column(2).to_pylist()]
            at = pa.array([i for i, x in enumerate(got) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([a for x in got for a in x], pa.int32())], names=["row_id", "msg_pos", "start_pos"])

    return values.mapInArrow(run, "row_id long, msg_pos int, start_pos int").distinct()


def redacted_rows(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, redacted) of every message."""
    return scan(raw).select("row_id", "msg_pos", "redacted")
