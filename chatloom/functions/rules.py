"""Ordered rules on texts, as data: one table is evaluated as a column expression and, outside of Spark, on a string."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import WS, contains_any, py_strip


class Rule(NamedTuple):
    """What a stripped text gives when it equals, starts with, contains (in lower case) or matches one of the things named.

    ``matches`` is a pattern of Java, ``like`` the same for Python; ``lower`` applies it to the lower-case text,
    ``open_end`` asks that the text doesn't end so; ``only_if`` that the flag of the evaluation is set.
    """

    gives: str
    equals: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    matches: str | None = None
    like: str | None = None
    lower: bool = False
    open_end: str | None = None
    only_if: bool = False


def column(rules: tuple[Rule, ...], otherwise: str, text: Column, flag: Column | None = None) -> Column:
    """The first rule that holds for each text; null texts have none."""
    s = py_strip(text)
    low = F.lower(s)
    out = None
    for r in rules:
        hit = F.lit(False)
        for x in r.starts:
            hit = hit | s.startswith(x)
        if r.equals:
            hit = hit | low.isin(*r.equals)
        if r.contains:
            hit = hit | contains_any(low, list(r.contains))
        if r.matches:
            hit = hit | (low if r.lower else s).rlike(r.matches)
        if r.open_end:
            hit = hit & ~s.endswith(r.open_end)
        if r.only_if:
            hit = hit & flag
        out = F.when(hit, r.gives) if out is None else out.when(hit, r.gives)
    return out.otherwise(otherwise)


def value(rules: tuple[Rule, ...], otherwise: str, text: str, flag: bool = False) -> str:
    """The same for one string."""
    s = text.strip(WS)
    low = s.lower()

    def holds(r: Rule) -> bool:
        if (r.only_if and not flag) or (r.open_end and s.endswith(r.open_end)):
            return False
        return s.startswith(r.starts) if r.starts else low in r.equals if r.equals else any(map(low.__contains__, r.contains)) if r.contains else bool(r.like and re.search(r.like, low if r.lower else s))

    return next((r.gives for r in rules if holds(r)), otherwise)
