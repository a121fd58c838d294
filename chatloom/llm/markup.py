"""Problem 2: Markdown, HTML, wiki and LaTeX in message texts, found and turned into clean text.

One grammar of constructs does both: found() tells which markups a text uses, clean() rewrites the same
constructs. Code lines, fenced or not, are set aside before, so nothing in them counts as markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.messages import messages
from ..session import spread
from . import prose

MARKUPS = ("html", "latex", "markdown", "wiki")
#: Element names of HTML, and of its character references that texts commonly hold.
_TAGS = (
    "a|abbr|article|aside|b|blockquote|body|br|button|caption|center|cite|code|dd|del|details|div|dl|dt|em|figcaption|figure|font|footer|"
    "form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|meta|nav|ol|option|p|pre|q|s|samp|script|section|"
    "select|small|span|strike|strong|style|sub|summary|sup|table|tbody|td|tfoot|th|thead|title|tr|tt|u|ul|var"
)
_HTML_TAG = re.compile(rf"</?(?:{_TAGS})(?:\s+[a-zA-Z-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))?)*\s*/?>|<!--.*?-->|<!doctype[^>]*>", re.I | re.S)
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}\d?|#\d{1,6}|#[xX][0-9a-fA-F]{1,6});")
_PRE = re.compile(r"<pre[^>]*>\s*(?:<code[^>]*>)?(.*?)(?:</code>\s*)?</pre>", re.I | re.S)

_TEX_MATH = re.compile(r"\\\(.+?\\\)|\\\[.+?\\\]|\$\$.+?\$\$|(?<![\w$\\])\$(?=[^\s$])(?=[^$\n]*[\\^_=+<>(])[^$\n]*?[^\s$\\]\$(?![\w$])", re.S)
_TEX_ENV = re.compile(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?")
_TEX_COMMAND = re.compile(
    r"\\(?:(?:sub)*section|(?:sub)?paragraph|chapter|part|title|author|caption|text(?:bf|it|tt|sc|rm|sf|normal)|emph|underline|cite[tp]?|ref|eqref|label|footnote|"
    r"url|href|input|include|usepackage|documentclass|includegraphics|mbox|verb|frac|sqrt)\*?(?:\[[^\]\n]*\])?[{|]"
    r"|\\(?:item|maketitle|tableofcontents|newline|noindent|LaTeX|TeX|ldots|dots|hline|centering|par|alpha|beta|gamma|delta|sum|prod|int|leq|geq|infty|cdot|times)\b"
)
_TEX_BREAK = re.compile(r"(?<=[.!?。！？}])\s*\\\\(?:\s*$|\s*\n)|(?<=\w)~\\(?:cite|ref)", re.M)

_MD_LINE = {
    "heading": re.compile(r"^ {0,3}#{1,6}[ \t]+\S.*$"),
    "task": re.compile(r"^\s*[-*+]\s+\[[ xX]\]\s"),
    "quote": re.compile(r"^ {0,3}>+\s*\S"),
    "table": re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$"),
    "reference": re.compile(r"^\s{0,3}\[\^?[^\]\n]+\]:\s*\S"),
}
_MD_BULLET = re.compile(r"^\s*[-+*]\s+\S")
_MD_NUMBER = re.compile(r"^\s*\d{1,3}[.)]\s+\S")
_MD_RULE = re.compile(r"^ {0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_MD_SETEXT = re.compile(r"^ {0,3}(?:={3,}|-{3,})\s*$")
_MD_INLINE = re.compile(
    r"!?\[[^\]\n]*\]\((?:[^()\n]|\([^()\n]*\))*\)"
    r"|\[[^\]\n]+\]\[[^\]\n]*\]|\[\^[\w-]+\]"
    r"|\*\*(?=\S)[^*\n]+?(?<=\S)\*\*"
    r"|(?<![\w_])__(?=[^\s_])[^_\n]*?[^\s_]__(?![\w_])"
    r"|~~(?=\S)[^~\n]+?(?<=\S)~~"
    r"|(?<!`)`[^`\n]+`(?!`)|``[^\n]+?``"
    r"|(?<![\w*\\])\*(?=[^\s*])[^*\n]*?[^\s*]\*(?![\w*])"
    r"|(?<![\w_\\/.])_(?=[^\s_])[^_\n]*[^\s_]_(?![\w_])"
    r"|<https?://[^>\s]+>"
    r"|\\[*_#`\[\]>~](?!\w*\{)"
)
_MD_OPEN = re.compile(r"`{3,}|(?:^|(?<=\s))\*\*(?=\w)|(?<=[\w.。])\*\*(?=\s|$)|\]\(https?://")

_WIKI_LINE = {
    "heading": re.compile(r"^\s*(={2,6})\s*[^=\s].*?\s*\1\s*$"),
    "table": re.compile(r"^\s*(?:\{\||\|\}|\|-+\s*$|!\s.*!!|\|\s.*\|\|)|^\s*\|\|.*\|\|\s*$"),
    "definition": re.compile(r"^[;:]\s*\S"),
    "double": re.compile(r"^\s*(?:\*{2,}|#{2,}|\*#|#\*|-{2})\s+\S.*[.。!?）)]\s*$"),
    "rule": re.compile(r"^-{4,}\s*$"),
    "jira": re.compile(r"^\s*h[1-6]\.\s+\S|^\s*bq\.\s+\S|^\s*\{(?:code|noformat|quote|panel|info|tip|note|warning|color|toc)(?:[:=][^}\n]*)?\}"),
    "trac": re.compile(r"^\s*\{\{\{|^\s*\}\}\}"),
}
_WIKI_NUMBER = re.compile(r"^#\s+\S.*[.。!?]\s*$")
_WIKI_INLINE = re.compile(
    r"'{2,5}(?=\S)[^'\n].*?'{2,5}"
    r"|\[\[[^\[\]\n\"'=]+\]\]"
    r"|(?<![\w\]])\[(?:https?|ftp)://[^\s\]]+(?:\s[^\]\n]*)?\](?!\()"
    r"|\[[^\[\]|\n]+\|(?:https?://)[^\]\s]+\]"
    r"|\{\{(?!\s)[^{}\n]+(?<!\s)\}\}"
    r"|<ref[^>]*>|</ref>|<nowiki>|</nowiki>|<br ?/?>(?=\{\{)"
    r"|~{3,5}(?=\s|$)"
    r"|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__"
    r"|(?<!begin)(?<!end)\{(?:code|noformat|quote|panel|color)(?:[:=][^}\n]*)?\}"
    r"|(?<![:\w/])//(?=[^\s/])[^/\n]+?(?<=[^\s:])//(?![\w/])"
    r"|'''|(?<=\s)''(?=\w)"
)
_WIKI_CODE = re.compile(r"\{(code|noformat)(?:[:=][^}\n]*)?\}(.*?)(?:\{\1\}|\Z)|\{\{\{(.*?)(?:\}\}\}|\Z)", re.S)
_LST = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?:\{\w+\})?(.*?)(?:\\end\{\1\}|\Z)", re.S)


#: Without one of these signs a text holds no construct of any markup; marked lines start with one of _MARKS.
_SIGN = re.compile(r"[`*~#<>&\\$|{}\[\]=]|(?<!\w)_|''|//|__|^\s*(?:[-+]|\d{1,3}[.)])\s|^[;:]|^\s*h[1-6]\.|^\s*bq\.|-{3}", re.M)
#: The same for the engine, where texts without a sign are passed over; it may let more texts through, never fewer.
_ENGINE_SIGN = r"(?m)[`*~#<>&\\$|{}\[\]=]|(?<!\w)_|''|//|__|^[\s\p{Z}]*(?:[-+]|\p{Nd}{1,3}[.)])[\s\p{Z}]|^[;:]|^[\s\p{Z}]*(?:h[1-6]|bq)\.|-{3}"
_MARKS = frozenset("#>-*+|:;[={}!_~0123456789h'b\t")


def _code_out(text: str) -> tuple[str, set[str]]:
    """The text without the code of wiki, LaTeX and HTML code blocks, and the markups these blocks are written in."""
    seen: set[str] = set()
    if "```" in text or "~~~" in text:
        rows = prose.lines(text)
        if any(x.kind == "fence" for x in rows):
            seen.add("markdown")
            text = "\n".join(x.text for x in rows if x.kind not in ("fence", "fenced"))
    for name, block, sign in (("wiki", _WIKI_CODE, "{"), ("latex", _LST, "\\begin"), ("html", _PRE, "<")):
        if sign in text:
            text, n = block.subn("\n", text)
            if n:
                seen.add(name)
    return text, seen


def _is_prose_markup(lines: list[str]) -> bool:
    """Whether a run of lines with tags holds prose, and so is a text written in HTML and not code."""
    rest = _ENTITY.sub(" ", _HTML_TAG.sub("\n", "\n".join(lines)))
    return any(len(re.findall(r"[^\W\d_]{2,}", x)) >= 3 or re.search(r"[぀-ヿ一-鿿]{5,}", x) for x in rest.split("\n"))


def found(text: str | None) -> list[str]:
    """The markups that a text is written in, sorted; none for null and blank texts."""
    if not text or not text.strip():
        return []
    if not _SIGN.search(text):
        return []
    rest, seen = _code_out(prose.LONG_SPACE.sub(" " * 40, text))
    if not _SIGN.search(rest):
        return sorted(seen)
    rows = prose.lines(rest)
    if "<" in rest:
        # runs of lines with tags, whatever the line rules call them
        run: list[str] = []
        for row in [*rows, prose.Line(0, "blank", "")]:
            if "<" in row.text and _HTML_TAG.search(row.text):
                run.append(row.text)
            elif run:
                if _is_prose_markup(run) or (len(run) == 1 and not _is_code_tag(run[0])):
                    seen.add("html")
                run = []
    kept = [r for r in rows if r.kind in ("text", "blank")]
    body = "\n".join(r.text for r in kept)
    if "&" in body and any(_entity_counts(r.text) for r in kept):
        seen.add("html")
    if "\\" in rest or "$" in body:
        math = any(_TEX_MATH.search(r.text) for r in kept) or re.search(r"(?<!\\)\\\[.+?\\\]", rest)
        if math or _TEX_ENV.search(rest) or _TEX_COMMAND.search(body) or _TEX_BREAK.search(body):
            seen.add("latex")
    plain = _HTML_TAG.sub(" ", _TEX_MATH.sub(" ", body)) if "<" in body or "$" in body or "\\" in body else body
    lines = plain.split("\n")
    marked = [x for x in lines if x.lstrip(" ")[:1] in _MARKS and x]
    if any(p.search(x) for x in marked for k, p in _WIKI_LINE.items() if k not in ("rule", "definition")) or _WIKI_INLINE.search(plain):
        seen.add("wiki")
    elif any(_WIKI_LINE["jira"].search(r.text) or (r.kind != "blank" and _WIKI_LINE["table"].search(r.text) and not r.text.strip().startswith("!")) for r in rows if r.kind != "text" and r.text.lstrip(" ")[:1] in _MARKS):
        seen.add("wiki")
    elif any(_WIKI_NUMBER.match(x) or (_WIKI_LINE["definition"].match(x) and prose._SENTENCE.search(x)) for x in marked):
        seen.add("wiki")
    in_wiki = "wiki" in seen
    if "markdown" not in seen:
        inline = _WIKI_INLINE.sub(" ", plain) if in_wiki else plain
        if (
            any(p.search(x) for x in marked for k, p in _MD_LINE.items() if not (k == "heading" and (in_wiki or _WIKI_NUMBER.match(x))))
            or _MD_INLINE.search(inline)
            or _MD_OPEN.search(inline)
            or any(_MD_NUMBER.match(x) for x in marked)
            or (not in_wiki and any(_MD_BULLET.match(x) for x in marked))
            or (not in_wiki and any(x[:1] in " -*_=" and (_MD_RULE.match(x) or (_MD_SETEXT.match(x) and i and lines[i - 1].strip())) for i, x in enumerate(lines)))
        ):
            seen.add("markdown")
    return sorted(seen)


def _is_code_tag(line: str) -> bool:
    """A single line with tags and no prose that is code by itself: indented, or a whole element with a short value."""
    return line.startswith((" ", "\t")) or bool(re.match(r"^\s*<(\w+)[^>]*>[^<>\s]*</\1>\s*$", line)) or "{" in line


def _entity_counts(line: str) -> bool:
    return any(html.unescape(m[0]) != m[0] for m in _ENTITY.finditer(line))


_HEAD_TAG = re.compile(r"<h([1-6])[^>]*>(.*?)</h\1>", re.I | re.S)
_SECTION = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


_PRIVATE = (*range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE))
_TEX_OPEN = re.compile(r"\\(text\w\w|emph|underline|mbox|url|title|author|caption|footnote)\{|(?<!\\)[{}]")


def _unwrapped(t: str) -> str:
    """LaTeX commands around text give way to that text, however deep, a footnote to its text in brackets; one pass with a stack."""
    if "\\" not in t:
        return t
    out: list[str] = []
    opened: list[tuple[int, str, str]] = []
    at = 0
    for m in _TEX_OPEN.finditer(t):
        out.append(t[at : m.start()])
        at = m.end()
        if m[0] == "}":
            out.append(opened.pop()[2] if opened else "}")
            continue
        opened.append((len(out), m[0], "}" if m[0] == "{" else ")" if m[1] == "footnote" else ""))
        out.append("{" if m[0] == "{" else " (" if m[1] == "footnote" else "")
    for place, sign, _ in opened:  # never closed
        out[place] = sign
    return "".join(out) + t[at:]


def clean(text: str | None) -> str | None:
    """Clean text that keeps structure in one light notation: headings as ``#`` lines, list items as ``-`` or
    ``1.`` lines, code blocks between ``` fences unchanged, formulas as ``$...$``; emphasis, links, tables,
    comments and entities become their plain text; of lines that end in more than 40 spaces these go. Null stays null; text without markup stays as it is.
    """
    if text is None or not found(text):
        return text
    kept: list[str] = []

    # what is kept as it is gives way to its number between two signs that no reading of the text holds
    every = text + html.unescape(text) + html.unescape(html.unescape(text))
    mark = next((ch for ch in map(chr, _PRIVATE) if ch not in every), None)
    if mark is None:
        return text

    def keep(s: str) -> str:
        kept.append(s)
        return f"{mark}{len(kept) - 1}{mark}"

    def long_space(m: re.Match) -> str:
        return "" if m.end() == len(m.string) or m.string[m.end()] == "\n" else m[0][:40] + keep(m[0][40:])

    def block(code: str, tongue: str = "") -> str:
        return "\n" + keep(f"```{tongue}\n{code.strip(chr(10))}\n```") + "\n"

    parts, code, tongue = [], [], None
    for row in prose.lines(text):
        if row.kind == "fence":
            if tongue is None:
                tongue = prose.FENCE.match(row.text)[2].strip()
            else:
                parts.append(block("\n".join(code), tongue).strip("\n"))
                code, tongue = [], None
        elif row.kind == "fenced":
            code.append(row.text)
        else:
            parts.append(row.text)
    if tongue is not None:
        parts.append(block("\n".join(code), tongue).strip("\n"))
    t = "\n".join(parts)
    t = _PRE.sub(lambda m: block(html.unescape(_HTML_TAG.sub("", m[1]))), t)
    t = _WIKI_CODE.sub(lambda m: block(m[2] or m[3] or ""), t)
    t = _LST.sub(lambda m: block(m[2] or ""), t)
    t = re.sub(r"\\begin\{(equation|align|displaymath)\*?\}(.*?)\\end\{\1\*?\}", lambda m: keep(f"${m[2].strip()}$"), t, flags=re.S)
    t = _TEX_MATH.sub(lambda m: keep("$" + m[0].strip("$").removeprefix("\\(").removesuffix("\\)").removeprefix("\\[").removesuffix("\\]").strip() + "$"), t)
    t = prose.LONG_SPACE.sub(long_space, t)
    # code outside of fences is kept as it is
    t = "\n".join(keep(r.text) if r.kind == "code" and not _HTML_TAG.search(r.text) and mark not in r.text else r.text for r in prose.lines(t))
    t = _HEAD_TAG.sub(lambda m: "\n" + "#" * int(m[1]) + " " + m[2].strip() + "\n", t)
    t = re.sub(r"<li[^>]*>", "\n- ", t, flags=re.I)
    t = re.sub(r"<(?:br|/p|/div|/tr|/ul|/ol|p|div|blockquote|/blockquote)\b[^>]*>", "\n", t, flags=re.I)
    t = re.sub(r"</(?:td|th)>\s*<(?:td|th)[^>]*>", " ", t, flags=re.I)
    t = html.unescape(_HTML_TAG.sub("", t))
    t = re.sub(r"\\(chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}\n]*)\}", lambda m: "\n" + "#" * _SECTION[m[1]] + " " + m[2] + "\n", t)
    t = re.sub(r"\\(?:label|cite[tp]?|ref|eqref|usepackage|documentclass|includegraphics)(?:\[[^\]]*\])?\{[^{}\n]*\}", "", t)
    t = re.sub(r"\\item\b\s*", "- ", t)
    t = _TEX_ENV.sub("", t)
    t = _unwrapped(t)
    t = re.sub(r"(?<=\S)\s*\\\\\s*$|~(?=\s|$)", "", t, flags=re.M)
    out = []
    for line in t.split("\n"):
        if m := re.match(r"^\s*(={2,6})\s*(.*?)\s*\1\s*$", line):
            line = "#" * (len(m[1]) - 1) + " " + m[2]
        elif m := re.match(r"^\s*h([1-6])\.\s+(.*)$", line):
            line = "#" * int(m[1]) + " " + m[2]
        elif m := re.match(r"^\s*((?:[*#]+|-{2}))\s+(.*[.。!?])\s*$", line):
            line = "  " * (len(m[1]) - 1) + ("1. " if m[1][-1] == "#" else "- ") + m[2]
        elif re.match(r"^\s*[*+]\s+\S", line):
            line = re.sub(r"^(\s*)[*+]\s+", r"\1- ", line)
        elif _MD_SETEXT.match(line) and out and out[-1].strip() and not out[-1].startswith(("#", "-")):
            out[-1], line = "# " + out[-1].strip(), None
        elif _MD_RULE.match(line) or _MD_LINE["table"].match(line) or re.match(r"^\s*(?:\{\|.*|\|\}|\|-+|-{4,}|~{3,}|\{(?:quote|panel|color|info|note|tip|warning)[^}]*\})\s*$", line):
            line = None
        elif re.match(r"^\s*(?:\|.*\||!\s.*!!.*|\|\s.*\|\|.*)\s*$", line):
            line = " ".join(x for x in re.split(r"\s*(?:\|+|!+)\s*", line) if x)
        elif re.match(r"^[;:]\s*\S", line):
            line = ("# " if line[0] == ";" else "  ") + line[1:].strip()
        elif _MD_LINE["quote"].match(line):
            line = re.sub(r"^ {0,3}>+\s?", "", line)
        if line is not None:
            out.append(line)
    t = "\n".join(out)
    t = re.sub(r"!?\[([^\]\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)", r"\1", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", r"\1", t)
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+\s([^\]\n]*)\]", r"\1", t)
    t = re.sub(r"\{\{(?!\s)(?:[^{}|\n]*\|)?([^{}\n]*)\}\}", r"\1", t)
    t = re.sub(r"'{2,5}(?=\S)(.*?)'{2,5}", r"\1", t)
    t = re.sub(r"\*\*(?=\S)([^*\n]+?)\*\*|~~(?=\S)([^~\n]+?)~~|(?<![\w_])__(?=[^\s_])([^_\n]*?[^\s_])__(?![\w_])", lambda m: m[1] or m[2] or m[3], t)
    t = re.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])|(?<!`)`([^`\n]+)`(?!`)", lambda m: m[1] or m[2], t)
    t = re.sub(r"\s~{3,5}(?=\s|$)", "", t)
    # what was kept holds only what was kept before it
    for i in range(len(kept)):
        if mark in kept[i]:
            kept[i] = re.sub(f"{mark}(\\d+){mark}", lambda m: kept[int(m[1])], kept[i])
    t = re.sub(f"{mark}(\\d+){mark}", lambda m: kept[int(m[1])], t)
    return re.sub(r"\n{3,}", "\n\n", t).strip("\n")


def tag(raw: DataFrame, with_text: bool = False, marked_only: bool = False) -> DataFrame:
    """(row_id, msg_pos, markups array) for every message, with its clean text where asked; ``marked_only``: of those with a sign of markup.

    A pass over each message where it lies; nothing is shuffled. Null content gives no markup and null text.
    """
    rows = messages(raw, "row_id").select(F.col("row_id").cast("long").alias("row_id"), "msg_pos", "content")
    if marked_only:
        rows = rows.where(F.col("content").rlike(_ENGINE_SIGN))
    schema = "row_id long, msg_pos int, markups array<string>" + (", clean_text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            columns = [b.column(0), b.column(1), pa.array([found(t) for t in texts], pa.list_(pa.string()))]
            if with_text:
                columns.append(pa.array([clean(t) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "msg_pos", "markups", "clean_text"][: len(columns)])

    return spread(rows).mapInArrow(run, schema)


def found_rows(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, markup): one row per message and markup; repeated rows come out once."""
    return tag(raw, marked_only=True).select("row_id", "msg_pos", F.explode("markups").alias("markup")).distinct()


def clean_rows(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, clean_text) of every message."""
    return tag(raw, with_text=True).select("row_id", "msg_pos", "clean_text")
