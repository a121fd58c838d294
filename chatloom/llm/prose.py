"""Lines of prose and lines of code in a message."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Longer runs of white space tell nothing more; patterns see them shortened.
LONG_SPACE = re.compile(r"[^\S\n]{41,}")
FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[ \t]*([^`~\n]*)$")
_KEYWORD = (
    r"def|class|function|func|fn|const|let|var|return|import|from|export|public|private|protected|static|package|using|namespace|"
    r"if|elif|else|for|while|try|except|finally|with|raise|throw|switch|case|async|await|yield|assert|del|do|echo|sudo|cd|"
    r"curl|git|npm|pip|docker|kubectl|FROM|COPY|RUN|ENV|CMD|WORKDIR|EXPOSE"
)
_STRONG = re.compile(
    r"""^\s*(?:
      [{}\[\]();,]+\s*$                                   # only brackets
    | (?:\#include|\#define|\#!|//|/\*|\*/|@\w+|%%|<\?|<!DOCTYPE)   # directives and comments
    | \$\s\S | \$\w+\s*= | \./\S | >>>\s | PS>             # shell
    | (?:SELECT|INSERT\ INTO|UPDATE|DELETE\ FROM|CREATE|GRANT|ALTER|DROP|FROM|WHERE|GROUP\ BY|HAVING|ORDER\ BY|LIMIT|(?:LEFT|INNER|OUTER)?\ ?JOIN|VALUES)\ \S
    | make\ [\w-]+\s*$
    | \d{4}-\d\d-\d\d[T\ ]\d\d:\d\d(?::\d\d)?\S*\s+\S | [A-Z][a-z]+-[A-Z]\w+\s+-\w | \w+\s+-\w+\s+\$\w
    | (?i:Traceback\ \(most) | File\ " | (?i:\w+(?:error|exception):\s)
    | [\w.\[\]"'$@:/-]+\s*(?:=|:=|<-|\+=|=>|==)\s*\S
    | (?:export|set|setenv|declare|local)\s+\w+=
    | "[^"]*"\s*:\s | '[^']*'\s*:\s
    | \[[\w.\- ]+\]\s*$                                   # section of a settings file
    | (?:fi|done|then|esac|end|else:?|try:|pass|break|continue)\s*;?\s*$
    | (?<=\s\s)(?:return|print|echo|raise|yield|exit)\s\w+\s*$
    | -----(?:BEGIN|END)\ [A-Z ]+-----
    | (?:commit|tree|parent|md5|sha1|sha256|blob|index|digest)[\s:=]+[0-9a-f]{7,}
    | [0-9a-f]{16,}\s*$ | [A-Za-z0-9+/]{40,}={0,2}\s*$
    | \d+(?:\.\d+){1,3}(?:-\w+)?\s*$                       # a version
    | (?:GET|POST|PUT|DELETE|HEAD|PATCH)\s/\S*\sHTTP
    | [\w.-]+\t(?:[^\t]*\t)*[\d.]+\s*$                     # rows of a table with tabs
    | \w+(?:;\w*){2,}$
    | diff\ --git|^@@\s|^[+-]{3}\s[ab]/
    | <(?:\?xml|!--)
    )""",
    re.X,
)
_ENDS = re.compile(r"[;{]\s*$|\)\s*[{;,]\s*$|^\s.*[,(\[]\s*$|\\\s*$|(?<!\w)[}\])]+[;,)]*\s*$")
_WORDLIKE = re.compile(r"[^\W\d_]{2,}")
_YAML = re.compile(r"^\s*(?:-\s+)?[A-Za-z_][\w.-]*:(?:\s+(?P<v>\S.*))?$")
_STATEMENT = re.compile(rf"^\s*(?:{_KEYWORD})\b.*(?:[:;{{(=]|\bimport\b|\w\.\w|\(\)|\./|\w/\w|--\w)")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&\w{2,8};")
_SENTENCE = re.compile(r"(?<!\w)\w++(?:[ ,;'’]++\w++){3,}|[぀-ヿ一-鿿]{6,}")
_WORDS = re.compile(r"(?<!\w)[^\W\d_]++(?:[ ,;'’]++\w++){2,}|[぀-ヿ一-鿿]{6,}")
_MATH = re.compile(r"\$[^$\s](?:[^$\n]*[^$\s])?\$(?!\w)")
_CALL = re.compile(r"^\s*[\w.$]+(?:\([^()]*\)|\(.*\))\s*;?\s*$")
_SIGNS_CODE = re.compile(r"[{}\[\];=<>$]|\w\(|::")
_SIGNS = re.compile(r"[{}\[\]();=<>|&$\\/@#*_:\"'`+^%~]")


class Line(NamedTuple):
    """A line: where it starts in the text, what it is (fence, fenced, code, text or blank), itself."""

    start: int
    kind: str
    text: str


def looks_like_code(line: str) -> bool:
    line = LONG_SPACE.sub(" " * 40, line)
    if "<" in line or "&" in line or "$" in line:
        rest = _MATH.sub(" ", line)
        words = _WORDS if rest != line else _SENTENCE
        if (rest != line or _TAG.search(line)) and any(words.search(x) for x in _TAG.split(rest) if not _SIGNS_CODE.search(x)):
            return False
    if line.startswith(("{{", "# ")) and re.search(r"[.。!?][}\s]*$", line) and _SENTENCE.search(line):
        return False
    if _STRONG.match(line):
        return True
    words = len(_WORDLIKE.findall(line))
    if _STATEMENT.match(line) or _CALL.match(line):
        return not re.search(r"[.!?。！？]\s*$", line) or line.startswith((" ", "\t"))
    if _ENDS.search(line) and not re.match(r"^\s*(?:[-*+>]|\d+[.)])\s", line):
        return words <= 3 or len(_SIGNS.findall(line)) >= words
    m = _YAML.match(line)
    if m:
        v = m["v"] or ""
        return line[:1] == " " or (len(v.split()) <= 2 and bool(v)) or (not v and line.strip().islower() and line.isascii() and " " not in line.strip())
    if line.startswith(("    ", "\t")) and words <= 8 and _SIGNS.search(line):
        return True
    if line.startswith("  ") and re.match(r"^\s+-\s+[\w.:/-]+\s*$", line):
        return True
    return False


def lines(text: str) -> list[Line]:
    """The lines of ``text`` in order, each with its place and kind; an open fence runs to the end."""
    out: list[Line] = []
    at, fence = 0, ""
    for raw in text.split("\n"):
        line = raw[:-1] if raw.endswith("\r") else raw
        m = FENCE.match(line)
        if fence:
            closing = m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip()
            out.append(Line(at, "fence" if closing else "fenced", line))
            if closing:
                fence = ""
        elif m:
            fence = m[1]
            out.append(Line(at, "fence", line))
        elif not line.strip():
            out.append(Line(at, "blank", line))
        else:
            out.append(Line(at, "code" if looks_like_code(line) else "text", line))
        at += len(raw) + 1
    # a comment above code, and a short line between lines of code, belong to the code
    for i in range(len(out) - 1, -1, -1):
        if out[i].kind != "text":
            continue
        line = out[i].text
        after = next((x.kind for x in out[i + 1 : i + 4] if x.kind != "blank"), "")
        before = out[i - 1].kind if i else ""
        if line.lstrip().startswith(("# ", "-- ", "// ")) and after == "code" and not (line.startswith("# ") and re.search(r"[.。!?]\s*$", line)):
            out[i] = out[i]._replace(kind="code")
        elif before == after == "code" and len(_WORDLIKE.findall(line)) <= 4 and not re.search(r"[.!?:。！？]\s*$", line):
            out[i] = out[i]._replace(kind="code")
        elif before == "code" and line.startswith(" ") and len(_WORDLIKE.findall(line)) <= 4 and not re.match(r"^\s*(?:[-*+>]|\d+[.)])\s+\S+\s\S+\s", line):
            out[i] = out[i]._replace(kind="code")
    return out
