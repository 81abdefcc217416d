"""Strict JSON and typed access to VARIANT values.

``try_parse_json`` rejects duplicate keys, comments, NaN and raw control characters, but takes text after the value; ``strict`` does not.
Missing and null fields are different: ``kind`` is MISSING for the one and VOID for the other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import fixed
from sluice.functions.once import let

#: One JSON string, and a colon if it is a key. A scan from the text's start can't fall into the middle of a string.
_STRING = r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?'


def strict(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else; null otherwise."""
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}"))).isNotNull()
    return F.when(whole, F.try_parse_json(text))


def field(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, DECIMAL, DOUBLE, OBJECT, ARRAY, VOID (null) or MISSING."""
    return F.coalesce(F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1), F.lit("MISSING"))


def text_of(value: Column, kind: Column) -> Column:
    """The string of a value whose kind is known, null for other types."""
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


def text(value: Column) -> Column:
    """The string, null for other types."""
    return text_of(value, kind(value))


def integer_of(value: Column, kind: Column) -> Column:
    return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def integer(value: Column) -> Column:
    """The integer, null for other types: true, 1.0 and "1" are none."""
    return integer_of(value, kind(value))


def count_of(value: Column, kind: Column) -> Column:
    return let(integer_of(value, kind), lambda n: F.when(n.between(0, fixed.MAX_COUNT), n))


def count(value: Column) -> Column:
    """A bounded non-negative integer, null for everything else."""
    return count_of(value, kind(value))


def items(value: Column) -> Column:
    """The elements, null for what is no array."""
    return F.try_variant_get(value, "$", "array<variant>")


def entries(value: Column) -> Column:
    """The members, null for what is no object."""
    return F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))


def keys(value: Column) -> Column:
    return F.transform(entries(value), lambda e: e["key"])


def _tokens(json: Column) -> Column:
    return F.regexp_extract_all(json, F.lit(f"({_STRING})"), 1)


def _unquoted(token: Column) -> Column:
    """A string without its quotes and colon; only one with escapes has to be parsed."""
    parsed = F.try_variant_get(F.try_parse_json(F.regexp_replace(token, r"\s*:\z", "")), "$", "string")
    return F.when(token.contains("\\"), parsed).otherwise(F.substring_index(F.substring(token, 2, 2**31 - 1), '"', 1))


def deep_keys(json: Column) -> Column:
    """The keys at any depth of a valid JSON text, without recursion."""
    return F.transform(F.filter(_tokens(json), lambda t: t.endswith(":")), _unquoted)


def deep_strings(json: Column) -> Column:
    """The string values at any depth of a valid JSON text."""
    return F.transform(F.filter(_tokens(json), lambda t: ~t.endswith(":")), _unquoted)
