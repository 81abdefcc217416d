"""Records to start from, made by a builder: references are digests of what they are for, the rest are the builder's arguments."""

from __future__ import annotations

import copy
import hashlib
import json
from pathlib import Path

from sluice.functions import fixed

DAY, NEXT, LATER, WEEK_BEFORE = "2031-03-04", "2031-03-05", "2031-03-06", "2031-02-26"
HOST, OTHER_HOST, ERA, FLAG, FLAG_B = fixed.EVIDENCE_HOSTS[0], fixed.EVIDENCE_HOSTS[-1], fixed.MODEL_ERAS[-1], fixed.ISSUE_FLAGS[1], fixed.ISSUE_FLAGS[6]


def ref(kind: str, of: object) -> str:
    """An opaque reference of its kind: path, session, episode, turn, or a source's hash."""
    name, digits = ("source_hash", 20) if kind == "source" else (f"{kind}_ref", 16 if kind == "path" else 20)
    return f"{name}_v1:{hashlib.sha1(f'{kind} {of}'.encode()).hexdigest()[:digits]}"


def at(time: str, day: str = DAY) -> str:
    return f"{day}T{time}Z"


def window(mode: str = "daily", start: str = DAY, end: str = NEXT) -> dict:
    return {"mode": mode, "start": at("00:00:00", start), "end": at("00:00:00", end)}


def episode(n: int = 1, **fields) -> dict:
    made = {
        "episode_id": ref("episode", n), "host": HOST, "session_id": ref("session", n), "start": at("08:15:00"), "end": at("09:45:30"), "cwd": ref("path", "cwd"), "model_era": ERA,
        "topic": f"chapter {n}", "turn_count": 3, "friction_flags": [FLAG], "outcome": fixed.OUTCOMES[1], "work_report_hint": "a line",
    }
    return changed(made, **fields)


def turn(n: int = 1, of: int = 1, **fields) -> dict:
    made = {
        "turn_id": ref("turn", n), "episode_id": ref("episode", of), "host": HOST, "session_id": ref("session", of), "source_path": ref("path", n), "source_hash": ref("source", n),
        "timestamp": at(f"08:{20 + n}:00"), "cwd": ref("path", "cwd"), "model": fixed.MODEL_IDS[2], "model_era": ERA, "redacted_user_prompt_summary": f"wanted {n}",
        "assistant_action_summary": f"wrote {n}", "issue_flags": [FLAG, FLAG_B], "prompt_improvement": "say more",
    }
    return changed(made, **fields)


def trend(episodes: list[dict], turns: list[dict], **fields) -> dict:
    """What is true of the rows."""

    def totals(key: str) -> dict:
        out: dict = {}
        for e in episodes:
            out[e[key]] = out.get(e[key], 0) + e["turn_count"]
        return {k: v for k, v in out.items() if v}

    flags = [f for t in turns for f in t["issue_flags"]]
    made = {
        "schema_version": 1, "window": window(), "turn_count": sum(e["turn_count"] for e in episodes), "flagged_turn_count": len(turns), "episode_count": len(episodes),
        "flags": {f: flags.count(f) for f in flags}, "hosts": totals("host"), "model_eras": totals("model_era"), "coverage_gaps": [],
    }
    return changed(made, **fields)


def manifest(**fields) -> dict:
    made = {
        "schema_version": 1, "mode": "daily", "window": window(), "sources": [{"host": OTHER_HOST, "root_ref": ref("path", "root"), "status": "ready", "rollout_count": 0, "summary_count": 5}],
        "coverage_gaps": [{"host": "scope", "reason": fixed.COVERAGE_REASONS[7]}], "redaction_policy_version": 1, "retention_note": fixed.RETENTION_NOTE, "retention_safe": True,
    }
    return changed(made, **fields)


def changed(record: dict, **fields) -> dict:
    """A copy with other fields; ... takes one away."""
    out = copy.deepcopy(record)
    for k, v in fields.items():
        if v is ...:
            del out[k]
        else:
            out[k] = v
    return out


EPISODE, TURN, MANIFEST = episode(), turn(), manifest()
TREND = trend([EPISODE], [TURN])


def put(root: Path, path: str, content) -> None:
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    if isinstance(content, bytes):
        file.write_bytes(content)
    elif isinstance(content, str):
        file.write_text(content, encoding="utf-8")
    elif isinstance(content, list):
        file.write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in content), encoding="utf-8")
    else:
        file.write_text(json.dumps(content), encoding="utf-8")


def export(root: Path, folder: str, episodes: list, turns: list, trend: dict, manifest: dict) -> None:
    for name, content in (("episodes.jsonl", episodes), ("turn_flags.jsonl", turns), ("trend_report.json", trend), ("retained_manifest.json", manifest)):
        put(root, f"retained/{folder}/{name}", content)


def month(root: Path, at: str, episodes=None, turns=None, trend=None, manifest=None) -> None:
    for folder, name, content in (("episodes", "episodes.jsonl", episodes), ("turn_flags", "turn_flags.jsonl", turns), ("trends", "trend_report.json", trend), ("manifests", "retained_manifest.json", manifest)):
        if content is not None:
            put(root, f"data/{folder}/{at}/{name}", content)
