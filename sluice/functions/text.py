"""Sensitive-text predicates. For names, fields and lines a bank of patterns is one alternation, which keeps plans small. In whole documents a pattern is searched
only if the words that it needs are there: nearly all documents lack most of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import fixed
from sluice.functions.once import let

#: What ends a line: CR, LF, CRLF, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def pattern(name: str) -> str:
    flags, body = fixed.PATTERNS[name]
    return f"(?{'iuU' if flags else 'U'}:{body})"


def _lower(text: Column) -> Column:
    """Lower case, with all letters that a pattern of any case takes for one from a to z."""
    odd, plain = fixed.ODD_LETTERS
    has_odd = reduce(Column.__or__, (text.contains(c) for c in odd))
    return F.lower(F.when(has_odd, F.translate(text, odd, plain)).otherwise(text))


def _searched(text: Column, names: list[str], body: Callable[[list[Column]], Column]) -> Column:
    """body of whether each pattern is in the text. The text is lowered once for all; null for null."""

    def each(both: Column) -> Column:
        whole, low = both["whole"], both["low"]
        out = []
        for name in names:
            needed = [reduce(Column.__or__, (low.contains(word) for word in words)) for words in fixed.NEEDS.get(name, [])]
            if name in fixed.NEEDS_LIKE:
                needed.append(low.rlike(fixed.NEEDS_LIKE[name]))
            out.append(reduce(Column.__and__, [*needed, whole.rlike(pattern(name))]))
        return body(out)

    return let(text, lambda t: let(F.struct(t.alias("whole"), _lower(t).alias("low")), each))


def bank(names: list[str]) -> str:
    return "|".join(map(pattern, names))


def hits(text: Column, names: list[str]) -> Column:
    return F.coalesce(text.rlike(bank(names)), F.lit(False))


def long_hits(text: Column, names: list[str]) -> Column:
    """The same as hits, for long texts."""
    return F.coalesce(_searched(text, names, lambda found: reduce(Column.__or__, found)), F.lit(False))


def patterns_in(text: Column, names: list[str]) -> Column:
    """The names of all patterns that are in the text."""
    return _searched(text, names, lambda found: F.array_compact(F.array(*(F.when(f, n) for f, n in zip(found, names, strict=True)))))


def risky_text(text: Column) -> Column:
    """Any sensitive pattern of retained content."""
    return hits(text, fixed.RETAINED_BANK)


def risky_document(text: Column) -> Column:
    """The same for long texts."""
    return long_hits(text, fixed.RETAINED_BANK)


def risky_policy_text(text: Column) -> Column:
    """The same for documents that may speak of secrets and production."""
    return hits(text, fixed.NAME_BANK)


def risky_token(text: Column) -> Column:
    return F.coalesce(text.rlike(fixed.SENSITIVE_TOKEN), F.lit(False))


def safe_token(text: Column) -> Column:
    return F.coalesce((F.char_length(text) <= fixed.MAX_TOKEN) & text.rlike(fixed.SAFE_TOKEN) & ~risky_token(text) & ~risky_text(text), F.lit(False))


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def infrastructure_risk(text: Column) -> Column:
    """Any line, but for the lines known as safe, with a pattern of the infrastructure bank."""

    def bad(line: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"(?U)\A\s+|\s+\z", ""), r",+\z", ""), r"\A[\"']+|[\"']+\z", "")
        return ~bare.isin(fixed.SAFE_INFRASTRUCTURE_LINES) & hits(line, fixed.INFRASTRUCTURE_BANK)

    return F.coalesce(F.exists(lines(text), bad), F.lit(False))


def retained_text(value: Column, kind: Column, label: str, nullable: bool = False) -> Column:
    """The issue of a text field, null without one. value: the string; kind: the JSON type of the field."""
    risk = f"{label} contains retained-text risk"  # long texts are not scanned
    issue = F.when(kind != "STRING", f"{label} must be retained text").when(F.char_length(value) > fixed.MAX_TEXT, risk).when(risky_text(value), risk)
    return F.when(kind.isin("VOID", "MISSING"), F.lit(None)).otherwise(issue) if nullable else issue
