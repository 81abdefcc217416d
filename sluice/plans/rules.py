"""The rules of the four record kinds: from a VARIANT to an ordered array of issue messages.

Each function returns an array expression, so any DataFrame or stream with a document column can be checked by a projection. The document
and its keys and strings at any depth should be columns, not expressions: they are used in many places.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import fixed, jsonv, times
from sluice.functions.once import let
from sluice.functions.text import retained_text, risky_text, risky_token, safe_token


class Typed(NamedTuple):
    """A field, its kind and, if it is a string, its text."""

    value: Column
    kind: Column
    text: Column


def _typed(doc: Column, names: list[str], body: Callable[[dict[str, Typed]], Column]) -> Column:
    """body of the fields, each taken out of the document once however many rules use it: the rules are too large to be compiled, and nothing else shares them."""
    each = lambda of: F.struct(*(of(n).alias(n) for n in names))
    texts = lambda v, k: let(each(lambda n: jsonv.text_of(v[n], k[n])), lambda t: body({n: Typed(v[n], k[n], t[n]) for n in names}))
    return let(each(lambda n: jsonv.field(doc, n)), lambda v: let(each(lambda n: jsonv.kind(v[n])), lambda k: texts(v, k)))


def _when(bad: Column, message: str | Column) -> Column:
    """One issue or none, as an array. An unknown condition counts as bad."""
    return F.when(F.coalesce(bad, F.lit(True)), F.array(F.lit(message) if isinstance(message, str) else message)).otherwise(F.array().cast("array<string>"))


def _maybe(issue: Column) -> Column:
    return F.when(issue.isNotNull(), F.array(issue)).otherwise(F.array().cast("array<string>"))


def _not_in(value: Column, allowed: list[str]) -> Column:
    return ~F.coalesce(value.isin(allowed), F.lit(False))


def _not_like(value: Column, pattern: str) -> Column:
    return ~F.coalesce(value.rlike(pattern), F.lit(False))


def unexpected_keys(keys: Column, allowed: list[str]) -> Column:
    return _when(F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0, "unexpected field is not allowed")


def missing_keys(keys: Column, required: list[str]) -> Column:
    gone = F.array_except(F.array(*map(F.lit, sorted(required))), keys)
    return F.transform(gone, lambda k: F.concat(F.lit("missing required field: "), k))


def token_array(value: Column, label: str, least: int = 0) -> Column:
    """Of issue flags: safe tokens, at most MAX_ITEMS, from the allowed ones, none twice; the first offending item decides which of the last two is said."""

    def of(strings: Column, odd: Column, twice: Column) -> Column:
        size = F.size(strings)
        return F.concat(
            _when(size < least, f"{label} must contain at least {least} item"),
            _when(size > fixed.MAX_ITEMS, f"{label} must contain at most {fixed.MAX_ITEMS} items"),
            # an allowed flag is a safe token, and one said twice needs one search
            _when(~F.forall(F.array_except(strings, F.array(*map(F.lit, fixed.ISSUE_FLAGS))), safe_token), f"{label} must be safe-token array"),
            F.when((odd > 0) & ((twice == 0) | (odd <= twice)), F.array(F.lit(f"{label} must use allowed issue flags"))).when(twice > 0, F.array(F.lit(f"{label} must not contain duplicate issue flags"))).otherwise(F.array().cast("array<string>")),
        )

    def found(strings: Column) -> Column:
        first_odd = F.array_position(F.transform(strings, lambda s: F.coalesce(s.isin(fixed.ISSUE_FLAGS), F.lit(False))), False)
        first_twice = F.array_position(F.transform(strings, lambda s, i: F.array_position(strings, s) <= i), True)
        firsts = let(F.struct(first_odd.alias("odd"), first_twice.alias("twice")), lambda at: of(strings, at["odd"], at["twice"]))
        return F.when(strings.isNull(), F.array(F.lit(f"{label} must be safe-token array"))).otherwise(firsts)

    return let(F.transform(jsonv.items(value), jsonv.text), found)


def count_map(value: Column, label: str) -> Column:
    domain = {"hosts": (fixed.EVIDENCE_HOSTS, "hosts key must be an allowed retained host"), "model_eras": (fixed.MODEL_ERAS, "model_eras key must be an allowed retained model era")}.get(label)

    def of(e: Column) -> Column:
        return F.concat(
            _when(~safe_token(e["key"]), f"{label} key must be a safe token"),
            *([_when(_not_in(e["key"], domain[0]), domain[1])] if domain else []),
            _when(jsonv.count(e["value"]).isNull(), f"{label} value must be a bounded non-negative integer"),
        )

    def found(entries: Column) -> Column:
        many = _when(F.size(entries) > fixed.MAX_KEYS, f"{label} must contain at most {fixed.MAX_KEYS} keys")
        flags = [_when(F.exists(entries, lambda e: _not_in(e["key"], fixed.ISSUE_FLAGS)), "flags keys must use allowed issue flags")] if label == "flags" else []
        return F.when(entries.isNull(), F.array(F.lit(f"{label} must be an object"))).otherwise(F.concat(many, F.flatten(F.transform(entries, of)), *flags))

    return let(jsonv.entries(value), found)


def window(value: Column) -> Column:

    def found(keys: Column, mode: Column, a: Column, b: Column) -> Column:
        days = F.element_at(F.create_map(*(F.lit(x) for pair in fixed.MODE_DAYS.items() for x in pair)), mode)
        both = a.isNotNull() & b.isNotNull()
        last = F.when(both & (a >= b), "window.start must be before window.end").when(both & mode.isin(list(fixed.MODE_DAYS)) & ~times.lasts(a, b, F.when(mode.isin(list(fixed.MODE_DAYS)), days)), "window duration must match window.mode")
        return F.concat(
            unexpected_keys(keys, fixed.WINDOW_KEYS),
            missing_keys(keys, fixed.WINDOW_KEYS),
            _when(_not_in(mode, list(fixed.MODE_DAYS)), "window.mode must be an allowed retained mode"),
            _when(a.isNull(), "window.start must be timestamp"),
            _when(b.isNull(), "window.end must be timestamp"),
            let(last, _maybe),
        )

    timed = lambda f, keys: let(F.struct(*(times.key(f[k].text).alias(k) for k in ("start", "end"))), lambda at: found(keys, f["mode"].text, at["start"], at["end"]))
    return _object_or(value, "window must be an object", fixed.WINDOW_KEYS, timed)


def window_identity(doc: Column) -> Column:
    """struct(mode, start, end) of a document's window, null if it isn't valid."""
    w = jsonv.field(doc, "window")
    return times.window(*(jsonv.text(jsonv.field(w, k)) for k in fixed.WINDOW_KEYS))


def coverage_gaps(value: Column) -> Column:

    def of(gap: Column, i: Column) -> Column:
        found = _object_or(gap, "coverage gap must be an object", fixed.GAP_KEYS, lambda f, keys: F.concat(
            unexpected_keys(keys, fixed.GAP_KEYS),
            _when(_not_in(f["host"].text, fixed.COVERAGE_HOSTS), "coverage gap host must be an allowed retained host"),
            _when(_not_in(f["reason"].text, fixed.COVERAGE_REASONS), "coverage gap reason is invalid"),
            _when(f["root_ref"].value.isNotNull() & _not_like(f["root_ref"].text, fixed.PATH_REF), "coverage gap root_ref must be path_ref_v1"),
            _when(f["bytes"].value.isNotNull() & _count(f, "bytes").isNull(), "coverage gap bytes must be a non-negative integer"),
        ))
        return F.transform(found, lambda m: F.concat(F.lit("coverage_gaps["), (i + 1).cast("string"), F.lit("]: "), m))

    def each(items: Column) -> Column:
        many = _when(F.size(items) > fixed.MAX_GAPS, f"coverage_gaps must contain at most {fixed.MAX_GAPS} items")
        return F.when(items.isNull(), F.array(F.lit("coverage_gaps must be an array"))).otherwise(F.concat(many, F.flatten(F.transform(items, of))))

    return let(jsonv.items(value), each)


def sources(value: Column) -> Column:

    def found(f: dict[str, Typed], keys: Column, a: Column, b: Column) -> Column:
        said = f["status"].text
        zero = lambda v: F.coalesce(F.try_variant_get(v.value, "$", "double") == 0, F.lit(False)) & v.kind.isin("BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN")
        return F.concat(
            unexpected_keys(keys, fixed.SOURCE_KEYS),
            missing_keys(keys, fixed.SOURCE_KEYS),
            _when(_not_in(f["host"].text, fixed.EVIDENCE_HOSTS), "source host must be an allowed retained host"),
            _when(_not_like(f["root_ref"].text, fixed.PATH_REF), "source root_ref must be path_ref_v1"),
            _when(_not_in(said, fixed.SOURCE_STATUSES), "source status is invalid"),
            _when(a.isNull(), "source rollout_count must be a bounded non-negative integer"),
            _when(b.isNull(), "source summary_count must be a bounded non-negative integer"),
            _when(F.coalesce(said == "ready", F.lit(False)) & (F.coalesce(a, F.lit(0)) < 1) & (F.coalesce(b, F.lit(0)) < 1), "ready source must have rollout_count or summary_count"),
            _when(F.coalesce(said.isin("empty", "missing", "stale"), F.lit(False)) & ~(zero(f["rollout_count"]) & zero(f["summary_count"])), "non-ready source counts must be zero"),
        )

    counted = lambda f, keys: let(F.struct(_count(f, "rollout_count").alias("a"), _count(f, "summary_count").alias("b")), lambda n: found(f, keys, n["a"], n["b"]))

    def of(source: Column, i: Column) -> Column:
        return F.transform(_object_or(source, "source summary must be an object", fixed.SOURCE_KEYS, counted), lambda m: F.concat(F.lit("sources["), (i + 1).cast("string"), F.lit("]: "), m))

    def each(items: Column) -> Column:
        many = _when(F.size(items) > fixed.MAX_SOURCES, f"manifest sources must contain at most {fixed.MAX_SOURCES} items")
        empty = items.isNull() | (F.size(items) == 0)
        return F.when(empty, F.array(F.lit("manifest sources must be a non-empty array"))).otherwise(F.concat(many, F.flatten(F.transform(items, of))))

    return let(jsonv.items(value), each)


def expected_mode(mode: Column, folder: Column, label: str) -> Column:
    """The mode must be its export directory's; folder is null outside export directories."""
    wanted = F.when(folder == "baseline", "baseline-90d").otherwise(folder)
    return _when(folder.isNotNull() & ~mode.eqNullSafe(wanted), F.concat(F.lit(f"{label} must match retained/"), folder, F.lit(" export directory")))


def _checked(found: Column, deep: Column, keys: list[str], name: str, key_name: str, raw_fields: bool = True) -> list[Column]:
    """Of the keys of a document, found, and those at any depth. The kind's own keys are without risk, so only others are searched for it."""
    others = F.array_except(deep, F.array(*map(F.lit, keys)))
    return [
        unexpected_keys(found, keys),
        missing_keys(found, keys),
        *([_when(F.exists(deep, lambda k: k.isin("root", "path")), f"{name} contains raw root/path field")] if raw_fields else []),
        _when(F.exists(others, lambda k: risky_text(k) | risky_token(k)), f"{key_name} JSON key contains raw/sensitive evidence"),
    ]


def _object_or(doc: Column, message: str, names: list[str], found: Callable[[dict[str, Typed], Column], Column]) -> Column:
    """The issues found in an object's fields and keys, or that it is none."""
    of = lambda keys: F.when(keys.isNull(), F.array(F.lit(message))).otherwise(_typed(doc, names, lambda fields: found(fields, keys)))
    return let(jsonv.keys(doc), of)


def _text_rule(fields: dict[str, Typed], name: str, nullable: bool = False) -> Column:
    return let(retained_text(fields[name].text, fields[name].kind, name, nullable), _maybe)


def _ref(fields: dict[str, Typed], name: str, pattern: str, shape: str, nullable: bool = False) -> Column:
    bad = _not_like(fields[name].text, pattern)
    return _when(bad & ~fields[name].kind.isin("VOID", "MISSING") if nullable else bad, f"{name} must be {shape}")


def _time(fields: dict[str, Typed], name: str, key: Column) -> Column:
    """key: what the field's text is ordered by, null if it is no timestamp."""
    return _when(~fields[name].kind.isin("VOID", "MISSING") & key.isNull(), f"{name} must be timestamp or null")


def _one_of(fields: dict[str, Typed], name: str, allowed: list[str], message: str, nullable: bool = False) -> Column:
    bad = _not_in(fields[name].text, allowed)
    return _when(bad & ~fields[name].kind.isin("VOID", "MISSING") if nullable else bad, message)


def _count(fields: dict[str, Typed], name: str) -> Column:
    return jsonv.count_of(fields[name].value, fields[name].kind)


HOST_ISSUE, ERA_ISSUE = "host must be an allowed retained host", "model_era must be an allowed retained model era"


def episode(doc: Column, deep_keys: Column) -> Column:
    timed = lambda f, at: F.concat(
        _time(f, "start", at["start"]), _time(f, "end", at["end"]), _when(F.coalesce(at["start"] > at["end"], F.lit(False)), "episode start must be before or equal to end")
    )
    return _object_or(doc, "episode row must be an object", fixed.EPISODE_KEYS, lambda f, keys: F.concat(
        *_checked(keys, deep_keys, fixed.EPISODE_KEYS, "episode", "episode"),
        _ref(f, "episode_id", fixed.EPISODE_REF, "episode_ref_v1"),
        _one_of(f, "host", fixed.EVIDENCE_HOSTS, HOST_ISSUE),
        _ref(f, "session_id", fixed.SESSION_REF, "session_ref_v1"),
        let(F.struct(*(times.key(f[k].text).alias(k) for k in ("start", "end"))), lambda at: timed(f, at)),
        _ref(f, "cwd", fixed.PATH_REF, "path_ref_v1 or null", nullable=True),
        _one_of(f, "model_era", fixed.MODEL_ERAS, ERA_ISSUE),
        _text_rule(f, "topic"),
        _when(_count(f, "turn_count").isNull(), "turn_count must be a bounded non-negative integer"),
        token_array(f["friction_flags"].value, "friction_flags"),
        _one_of(f, "outcome", fixed.OUTCOMES, "outcome is invalid"),
        _text_rule(f, "work_report_hint", nullable=True),
    ))


def turn_flag(doc: Column, deep_keys: Column) -> Column:
    return _object_or(doc, "turn flag row must be an object", fixed.TURN_FLAG_KEYS, lambda f, keys: F.concat(
        *_checked(keys, deep_keys, fixed.TURN_FLAG_KEYS, "turn flag", "turn flag"),
        _ref(f, "turn_id", fixed.TURN_REF, "turn_ref_v1"),
        _ref(f, "episode_id", fixed.EPISODE_REF, "episode_ref_v1"),
        _one_of(f, "host", fixed.EVIDENCE_HOSTS, HOST_ISSUE),
        _ref(f, "session_id", fixed.SESSION_REF, "session_ref_v1"),
        _ref(f, "source_path", fixed.PATH_REF, "path_ref_v1"),
        _ref(f, "source_hash", fixed.SOURCE_HASH, "source_hash_v1"),
        _time(f, "timestamp", times.key(f["timestamp"].text)),
        _ref(f, "cwd", fixed.PATH_REF, "path_ref_v1 or null", nullable=True),
        _one_of(f, "model", fixed.MODEL_IDS, "model must be an allowed retained model id or null", nullable=True),
        _one_of(f, "model_era", fixed.MODEL_ERAS, ERA_ISSUE),
        _text_rule(f, "redacted_user_prompt_summary"),
        _text_rule(f, "assistant_action_summary"),
        _text_rule(f, "prompt_improvement", nullable=True),
        token_array(f["issue_flags"].value, "issue_flags", least=1),
    ))


def _version(fields: dict[str, Typed], name: str, label: str) -> Column:
    return _when(~F.coalesce(jsonv.integer_of(fields[name].value, fields[name].kind) == 1, F.lit(False)), f"{label} must be 1")


def trend(doc: Column, deep_keys: Column, folder: Column) -> Column:
    counts = ("turn_count", "flagged_turn_count", "episode_count")
    counted = lambda n: F.concat(
        *(_when(n[k].isNull(), f"{k} must be a non-negative integer") for k in counts),
        _when(F.coalesce(n["flagged_turn_count"] > n["turn_count"], F.lit(False)), "flagged_turn_count must be less than or equal to turn_count"),
    )
    return _object_or(doc, "trend must be an object", fixed.TREND_KEYS, lambda f, keys: F.concat(
        *_checked(keys, deep_keys, fixed.TREND_KEYS, "trend", "trend", raw_fields=False),
        _version(f, "schema_version", "trend schema_version"),
        window(f["window"].value),
        let(jsonv.text(jsonv.field(f["window"].value, "mode")), lambda mode: expected_mode(mode, folder, "trend window.mode")),
        let(F.struct(*(_count(f, k).alias(k) for k in counts)), counted),
        *(count_map(f[k].value, k) for k in ("flags", "hosts", "model_eras")),
        coverage_gaps(f["coverage_gaps"].value),
    ))


def manifest(doc: Column, deep_keys: Column, deep_strings: Column, folder: Column) -> Column:
    def same(mode: Typed, at: Typed) -> Column:
        inner = F.when(at.kind == "OBJECT", jsonv.field(at.value, "mode"))
        return let(inner, lambda i: F.when(mode.kind.isin("VOID", "MISSING"), jsonv.kind(i).isin("VOID", "MISSING")).otherwise(F.to_json(mode.value).eqNullSafe(F.to_json(i))))

    return _object_or(doc, "manifest must be an object", fixed.MANIFEST_KEYS, lambda f, keys: F.concat(
        *_checked(keys, deep_keys, fixed.MANIFEST_KEYS, "manifest", "manifest"),
        _when(F.exists(deep_strings, risky_text), "manifest retained text contains raw/sensitive evidence"),
        _version(f, "schema_version", "manifest schema_version"),
        _one_of(f, "mode", list(fixed.MODE_DAYS), "manifest mode must be an allowed retained mode"),
        window(f["window"].value),
        _when(~same(f["mode"], f["window"]), "manifest mode must match window.mode"),
        expected_mode(f["mode"].text, folder, "manifest mode"),
        sources(f["sources"].value),
        coverage_gaps(f["coverage_gaps"].value),
        _version(f, "redaction_policy_version", "manifest redaction_policy_version"),
        _when(~F.coalesce(f["retention_note"].text == fixed.RETENTION_NOTE, F.lit(False)), "manifest retention_note is invalid"),
        _when(~F.coalesce((f["retention_safe"].kind == "BOOLEAN") & F.try_variant_get(f["retention_safe"].value, "$", "boolean"), F.lit(False)), "manifest retention_safe must be true"),
    ))


def row_issues(kind: Column, doc: Column, deep_keys: Column) -> Column:
    """The issues of an episode or turn flag."""
    return F.when(kind == "episode", episode(doc, deep_keys)).when(kind == "turn_flag", turn_flag(doc, deep_keys))


def document_issues(kind: Column, doc: Column, deep_keys: Column, deep_strings: Column, folder: Column) -> Column:
    """The issues of a trend or manifest; folder is its export directory, null elsewhere."""
    return F.when(kind == "trend", trend(doc, deep_keys, folder)).when(kind == "manifest", manifest(doc, deep_keys, deep_strings, folder))
