"""Column functions with the text semantics of Python's ``str``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points for which Python's str.isspace holds.
WS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: Fixed value: the line boundaries of Python's str.splitlines.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def py_strip(c: Column) -> Column:
    """``str.strip()``: null stays null."""
    return F.btrim(c, F.lit(WS))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space text."""
    return F.coalesce(py_strip(c) == "", F.lit(True))


def split_lines(c: Column) -> Column:
    """``str.splitlines()``: no empty element after a final line break; null and '' give an empty array."""
    parts = F.split(c, LINE_BREAK, -1)
    n = F.size(parts)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(whole)


def label_script(c: Column) -> Column:
    """A language label in the batch filter's form: stripped, lower case, ``_`` and space as ``-``."""
    return F.translate(F.lower(py_strip(c)), "_ ", "--")


def label_notebook(c: Column) -> Column:
    """A language label in the exploratory policy's form: stripped, lower case, ``_`` as ``-``."""
    return F.translate(F.lower(py_strip(c)), "_", "-")


def is_english_notebook(c: Column) -> Column:
    """English in the exploratory policy: en, eng, english or any ``en-`` label; null is not."""
    x = label_notebook(c)
    return F.coalesce(x.isin("en", "eng", "english") | x.startswith("en-"), F.lit(False))


def try_int(c: Column) -> Column:
    """``int(value)`` where it works, else null: numbers are cut, strings must be whole numbers, padding allowed."""
    return c.try_cast("int")


def is_missing(c: Column, dtype: str) -> Column:
    """Null; for strings blank as well, for doubles NaN, for arrays and maps empty."""
    if dtype == "string":
        return is_blank(c)
    if dtype in ("double", "float"):
        return c.isNull() | F.isnan(c)
    if dtype.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def prompt_hash(c: Column) -> Column:
    """SHA-256 of the stripped prompt as hex; null counts as the empty text."""
    return F.sha2(py_strip(F.coalesce(c, F.lit(""))), 256)


def word_count(c: Column) -> Column:
    """``len(str.split())``: runs of other signs than white space."""
    return F.size(F.filter(F.split(c, f"[{WS}]+"), lambda w: w != ""))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether ``c`` contains one of ``words``; null is not."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return F.coalesce(out, F.lit(False))
