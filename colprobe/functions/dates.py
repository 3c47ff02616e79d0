"""strftime formats in the notation of Spark's datetime parser."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FORMAT = "%Y-%m-%d"

# Format directives and their counterparts. Single letters accept one or
# two digits, as strptime does.
DIRECTIVES = {
    "Y": "yyyy",
    "y": "yy",
    "m": "M",
    "d": "d",
    "H": "H",
    "I": "h",
    "M": "m",
    "S": "s",
    "f": "SSSSSS",
    "p": "a",
    "b": "MMM",
    "B": "MMMM",
    "j": "D",
    "z": "xx",
    "T": "H:m:s",
    "F": "yyyy-M-d",
    "D": "M/d/yy",
    "R": "H:m",
    "%": "%",
}
# Directives that stand for others.
SHORTHANDS = {
    "c": "%a %b %d %H:%M:%S %Y",
    "x": "%m/%d/%y",
    "X": "%H:%M:%S",
    "T": "%H:%M:%S",
    "F": "%Y-%m-%d",
    "D": "%m/%d/%y",
    "R": "%H:%M",
}
# Directives that a date has to show but that say nothing about which it is.
ASIDE = {
    "a": "(?:mon|tue|wed|thu|fri|sat|sun)",
    "A": "(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)",
    "w": "[0-6]",
    "u": "[1-7]",
    "U": "(?:5[0-3]|[0-4][0-9]|[0-9])",
    "W": "(?:5[0-3]|[0-4][0-9]|[0-9])",
    "Z": "(?:utc|gmt)",
}
# What the other directives look like.
SHAPES = {
    "Y": "[0-9]{4}",
    "y": "[0-9]{2}",
    "m": "(?:1[0-2]|0[1-9]|[1-9])",
    "d": "(?:3[01]|[12][0-9]|0[1-9]|[1-9])",
    "H": "(?:2[0-3]|[01][0-9]|[0-9])",
    "I": "(?:1[0-2]|0[1-9]|[1-9])",
    "M": "[0-5]?[0-9]",
    "S": "(?:6[01]|[0-5]?[0-9])",
    "f": "[0-9]{1,6}",
    "p": "(?:am|pm)",
    "b": "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    "B": "(?:january|february|march|april|may|june|july|august|september|october|november|december)",
    "j": "(?:36[0-6]|3[0-5][0-9]|[12][0-9][0-9]|0[0-9][0-9]|[0-9]{1,2})",
    "z": "(?:[+-][0-9]{2}:?[0-9]{2}|z)",
}
# ISO years and weeks, which name a date only with each other and a weekday.
WEEK_SHAPES = {"G": "[0-9]{4}", "V": "(?:5[0-3]|[0-4][0-9]|[0-9])"}
WEEKDAYS = frozenset("aAwu")


class IllegalFormat(ValueError):
    """The format uses a directive that does not exist."""


def to_spark_format(fmt: str) -> str:
    """Translate, quoting literal text.

    >>> to_spark_format("%d/%m/%Y at %H")
    "d/M/yyyy 'at' H"
    """
    parts: list[tuple[bool, str]] = []  # (is literal letter run, text)
    pieces = iter(fmt)
    for char in pieces:
        if char != "%":
            parts.append((char.isalpha() or char in "'[]{}#", char))
            continue
        directive = next(pieces, "")
        if directive not in DIRECTIVES:
            raise IllegalFormat(fmt)
        parts.append((False, DIRECTIVES[directive]))
    out, quoted = [], False
    for literal, text in parts:
        if literal != quoted:
            out.append("'")
            quoted = literal
        out.append(text.replace("'", "''") if literal else text)
    if quoted:
        out.append("'")
    return "".join(out)


def follows(text: Column, fmt: str) -> Column:
    """Whether a text is a date in a strptime format.

    Formats with parts that Spark's parser lacks are taken apart by a pattern: all parts
    have to look right, and those that name the date are put together and parsed.
    """
    found = set(re.findall("%(.)", fmt.replace("%%", ""), re.DOTALL))
    weeks = found & set(WEEK_SHAPES)
    if weeks and (len(weeks) == 1 or not found & WEEKDAYS or "j" in found):
        raise IllegalFormat(fmt)
    if not found & ({"c", "x", "X"} | set(ASIDE) | weeks):
        return F.try_to_timestamp(text, F.lit(to_spark_format(fmt))).isNotNull()
    pattern, groups = [], []
    pieces = iter(re.sub("%([cxXTFDR])", lambda m: SHORTHANDS[m[1]], fmt))
    for char in pieces:
        directive = next(pieces, "") if char == "%" else None
        if directive is None or directive == "%":
            pattern.append("\\s+" if char.isspace() else re.escape(char))
        elif directive in ASIDE:
            pattern.append(ASIDE[directive])
        elif directive in SHAPES or directive in WEEK_SHAPES:
            pattern.append(f"({SHAPES.get(directive) or WEEK_SHAPES[directive]})")
            groups.append(directive)
        else:
            raise IllegalFormat(fmt)
    whole = f"(?i)^{''.join(pattern)}$"
    every = {n: F.regexp_extract(text, whole, n + 1) for n in range(len(groups))}
    kept = [groups[n] for n in every if groups[n] not in WEEK_SHAPES]
    # months and halves of the day are read in one spelling only
    named = [
        F.initcap(part) if groups[n] in "bB" else F.upper(part) if groups[n] in "pz" else part
        for n, part in every.items()
        if groups[n] not in WEEK_SHAPES
    ]
    shown = F.coalesce(F.rlike(text, F.lit(whole)), F.lit(False))
    if weeks:
        year, week = (every[groups.index(d)].try_cast("int") for d in "GV")
        # the 28th of December lies in the last week of its year
        last = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
        shown = shown & F.coalesce((year >= 1) & (week >= 1) & (week <= last), F.lit(False))
    if not kept:
        return shown
    parser = "|".join(DIRECTIVES[d] for d in kept)
    return shown & F.try_to_timestamp(F.concat_ws("|", *named), F.lit(parser)).isNotNull()
