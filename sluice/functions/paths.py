"""What a relative path says about an artifact: its parts, kind and partition, and whether its name may be there or be shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import fixed
from sluice.functions.once import let as _let
from sluice.functions.text import hits


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1)


def stem(name: Column) -> Column:
    """The name without its text and compression suffixes, however many."""
    return F.regexp_replace(name, fixed.STRIPPABLE_SUFFIXES, "")


#: Between the forms of a name that are searched at once: a character that no pattern has in it and all take for an edge.
EDGE = "\0"
#: Forms of short letters and digits only: no pattern of a name's bank can be in them.
PLAIN = rf"\A(?:[A-Za-z0-9]{{0,63}}+(?:{EDGE}|\z))+\z"

#: Forms of letters, digits, dots, dashes and low lines, and the patterns that can be in them: the others need a blank or another sign.
WORDY = rf"\A[A-Za-z0-9_.{EDGE}-]*+\z"
WORDY_BANK = ["api_key", "bare_token", "hex64", "uuid", "rollout_name", "private_ipv4", "raw_id_token", "reserved_domain"]


def _sensitive(name: Column, *forms: Column) -> Column:
    """A sensitive pattern in the name or one of its forms, or a sensitive token in a form. One search for all forms, by the patterns that can be in them."""
    bank = lambda every: F.when(every.rlike(PLAIN), False).when(every.rlike(WORDY), hits(every, WORDY_BANK)).otherwise(hits(every, fixed.NAME_BANK))
    found = _let(F.concat_ws(EDGE, name, *forms), bank)
    for form in forms:
        found = found | F.coalesce(form.rlike(fixed.SENSITIVE_TOKEN), F.lit(False))
    return found


def forbidden_name(name: Column) -> Column:
    parts = "|".join(fixed.FORBIDDEN_COMPACT_NAME_PARTS)

    def by_words(bare: Column, words: Column) -> Column:
        compact = F.translate(words, "_", "")
        return words.isin(fixed.FORBIDDEN_NAME_STEMS) | compact.rlike(rf"\A{fixed.FORBIDDEN_COMPACT_NAME_PREFIX}|{parts}") | _sensitive(name, bare, words)

    def of(bare: Column) -> Column:
        apart = F.lower(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2"))
        return _let(F.regexp_replace(F.regexp_replace(apart, "[^a-z0-9]+", "_"), "^_+|_+$", ""), lambda words: by_words(bare, words))

    return _let(stem(name), of)


def forbidden(parts: Column) -> Column:
    name = F.lower(F.element_at(parts, -1))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    by_folder = F.exists(F.transform(folders, F.lower), lambda p: p.isin(fixed.FORBIDDEN_COMPONENTS) | forbidden_name(p))
    return by_folder | name.isin(fixed.FORBIDDEN_FILENAMES) | forbidden_name(name) | name.startswith("rollout")


def shown_part(part: Column) -> Column:
    return _let(stem(part), lambda bare: F.when(_sensitive(part, bare), F.concat(F.lit("[redacted]"), F.substr(part, F.char_length(bare) + 1))).otherwise(part))


def shown(parts: Column) -> Column:
    """The path for messages; sensitive parts keep their suffixes only."""
    return F.array_join(F.transform(parts, shown_part), "/")


def _at(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def infrastructure(path: Column, parts: Column) -> Column:
    n, first, end = F.size(parts), _at(parts, 0), F.lower(suffix(F.element_at(parts, -1)))
    return F.coalesce(
        path.isin(fixed.ROOT_DOC_FILES)
        | ((first == ".github") & (n >= 3) & (_at(parts, 1) == "workflows") & end.isin(".yaml", ".yml"))
        | (first.isin("scripts", "tests") & (n == 2) & (end == ".py"))
        | ((first == "schemas") & (n == 2) & _at(parts, 1).isin(fixed.SCHEMA_FILES)),
        F.lit(False),
    )


def real_date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", y, m, d)
    return F.coalesce(text.rlike(r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def real_month(y: Column, m: Column) -> Column:
    """A month whose first day and next month are dates."""
    return F.coalesce(y.rlike(r"\A(?!0000)[0-9]{4}\z") & m.rlike(r"\A(?:0[1-9]|1[0-2])\z") & ~((y == "9999") & (m == "12")), F.lit(False))


def baseline_report(name: Column) -> Column:
    a, b = (F.try_to_date(F.regexp_extract(name, r"\A([0-9-]{10})_to_([0-9-]{10})\.md\z", i), "yyyy-MM-dd") for i in (1, 2))
    return F.coalesce(name.rlike(r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}_to_(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\.md\z") & (F.datediff(b, a) == 90), F.lit(False))


def text_report(path: Column, parts: Column) -> Column:
    n, name = F.size(parts), F.element_at(parts, -1)
    dated = (n == 5) & (_at(parts, 0) == "reports") & _at(parts, 1).isin("daily", "weekly") & (F.lower(suffix(name)) == ".md") & real_date(_at(parts, 2), _at(parts, 3), F.regexp_replace(name, r"(?i)\.md\z", ""))
    base = (n == 4) & (_at(parts, 0) == "reports") & (_at(parts, 1) == "baseline") & (_at(parts, 2) == "90-day-windows") & baseline_report(name)
    return F.coalesce(path.isin(fixed.POLICY_DOCS) | dated | base, F.lit(False))


def in_export(parts: Column) -> Column:
    return F.coalesce((F.size(parts) == 3) & (_at(parts, 0) == "retained") & _at(parts, 1).isin(fixed.EXPORT_DIRS), F.lit(False))


def kind(parts: Column) -> Column:
    """episode, turn_flag, trend or manifest by the place of a retained record file; null elsewhere."""
    name, month = F.element_at(parts, -1), (F.size(parts) == 5) & (_at(parts, 0) == "data") & real_month(_at(parts, 2), _at(parts, 3))
    out = F.lit(None).cast("string")
    for label, folder, file in (("episode", "episodes", "episodes.jsonl"), ("turn_flag", "turn_flags", "turn_flags.jsonl"), ("trend", "trends", "trend_report.json"), ("manifest", "manifests", "retained_manifest.json")):
        here = (name == file) & (in_export(parts) | (month & (_at(parts, 1) == folder)))
        out = F.when(F.coalesce(here, F.lit(False)), label).otherwise(out)
    return out


def export_key(parts: Column) -> Column:
    return F.when(in_export(parts), F.concat_ws("/", _at(parts, 0), _at(parts, 1)))


def month_key(parts: Column) -> Column:
    """data/YYYY/MM of files in the four month trees, whatever their names."""
    here = (F.size(parts) == 5) & (_at(parts, 0) == "data") & _at(parts, 1).isin("episodes", "turn_flags", "trends", "manifests") & real_month(_at(parts, 2), _at(parts, 3))
    return F.when(here, F.concat_ws("/", F.lit("data"), _at(parts, 2), _at(parts, 3)))
