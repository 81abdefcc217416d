"""Whole trees through the gate: a valid one, one of faulty files and one of faulty partitions. Issues are compared as lists: their order is part of the result."""

import subprocess

import fixtures as X

from sluice.plans import gate


def found(spark, root):
    return [gate.display(x) for x in gate.issues(spark, str(root)).collect()]


def test_valid_tree_and_missing_root(spark, tmp_path):
    episodes, turns = [X.episode(1), X.episode(2, turn_count=0, host=X.OTHER_HOST)], [X.turn(1), X.turn(2), X.turn(3)]
    trend = X.trend(episodes, turns)
    X.export(tmp_path, "daily", episodes, turns, trend, X.MANIFEST)
    X.month(tmp_path, "2031/03", episodes, turns, trend, X.MANIFEST)
    X.put(tmp_path, "reports/weekly/2031/03/08.md", "# calm\nnothing to tell\n")
    X.put(tmp_path, "data/README.md", "what production may keep\n")
    X.put(tmp_path, "README.md", "hello\n")
    assert found(spark, tmp_path) == []
    assert found(spark, tmp_path / "nowhere") == ["root must be an existing directory"]


def test_faulty_files_as_version_control_shows_them(spark, tmp_path):
    local = "ht" + "tp://localhost/x"
    X.put(tmp_path, ".gitignore", "hidden/\n")
    X.put(tmp_path, "hidden/raw.txt", "x")
    X.put(tmp_path, ".github/workflows/check.yml", "on: push\n")
    X.put(tmp_path, "README.md", f"sessions/\nsee {local}\n")
    X.put(tmp_path, "schemas/retained-manifest-v1.schema.json", '{"a": ["' + local.replace("h", "\\u0068", 1) + '"]}')
    X.put(tmp_path, "scripts/tool.py", "print(1)\n")
    X.put(tmp_path, "tests/x.py", b"# \xff\n")
    X.put(tmp_path, "data/bad.json", b'"\xff"')
    X.put(tmp_path, "data/twice.json", '{"a":1,"a":2}')
    X.put(tmp_path, "data/episodes/2031/03/episodes.jsonl", '{"a": 1}\n\n{"a": 1} {}\n{"b"\n')
    X.put(tmp_path, "data/misc/rows.jsonl", [X.EPISODE])
    X.put(tmp_path, "data/notes.md", "mail some" + "one@post.org")
    X.put(tmp_path, "data/x.json", {"deep": [{"my.to" + "ken": "mail some" + "one@post.org"}]})
    X.put(tmp_path, "other/thing.bin", b"\xff")
    X.put(tmp_path, "other/session_id_abcdef123.txt.gz", b"\xff")
    X.put(tmp_path, "reports/daily/2031/02/30.md", "no such day")
    X.put(tmp_path, "reports/daily/2031/03/04.md", "fine")
    X.put(tmp_path, "reports/table.csv", b"\xff")
    (tmp_path / "reports/link.md").symlink_to(tmp_path / "README.md")
    X.put(tmp_path, "sessions/x.md", "x")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    bad = "raw/sensitive evidence"
    assert found(spark, tmp_path) == [
        f"README.md: infrastructure text contains {bad}",
        "data/bad.json: UnicodeDecodeError: failed to decode as UTF-8",
        "data/episodes/2031/03/episodes.jsonl: line 3: invalid JSONL: not strict JSON",
        "data/misc/rows.jsonl: unexpected JSONL artifact",
        "data/notes.md: unexpected retained text artifact location",
        f"data/notes.md: retained text contains {bad}",
        "data/twice.json: JSONDecodeError: not strict JSON",
        "data/x.json: unexpected JSON artifact",
        f"data/x.json: JSON key contains {bad}",
        f"data/x.json: retained text contains {bad}",
        "other/[redacted].txt.gz: forbidden raw/transient artifact",
        "other/thing.bin: unexpected retained artifact location",
        "reports/daily/2031/02/30.md: unexpected retained text artifact location",
        "reports/link.md: symlink artifact is not allowed",
        "reports/table.csv: unexpected retained artifact suffix",
        f"schemas/retained-manifest-v1.schema.json: infrastructure text contains {bad}",
        "sessions/x.md: forbidden raw/transient artifact",
        "tests/x.py: UnicodeDecodeError: failed to decode as UTF-8",
    ]


def test_faulty_partitions(spark, tmp_path):
    # rows of one directory that disagree with each other, and a report that disagrees with them
    episodes = [X.episode(1), X.episode(1), X.episode(2, turn_count=1)]
    turns = [
        X.turn(1, host=X.OTHER_HOST, session_id=X.ref("session", 9)), X.turn(2, host=X.OTHER_HOST, timestamp=X.at("09:45:30.000000001")), X.turn(2, of=2), X.turn(4, of=2), X.turn(5, of=7),
    ]
    X.export(tmp_path, "daily", episodes, turns, X.trend(episodes, turns, episode_count=4, hosts={X.HOST: 6}), X.MANIFEST)
    # report and manifest of different windows, and rows outside the report's
    episodes = [X.episode(1), X.episode(2, start="2031-03-03T23:59:59.999999999Z")]
    turns = [X.turn(1), X.turn(2, timestamp=X.at("00:00:00", X.NEXT))]
    X.export(tmp_path, "weekly", episodes, turns, X.trend(episodes, turns), X.manifest(mode="weekly", window=X.window("weekly", X.WEEK_BEFORE)))
    X.put(tmp_path, "retained/baseline/episodes.jsonl", [X.EPISODE, X.episode(2)])
    X.put(tmp_path, "retained/baseline/notes.txt", "fine")
    # a month: windows beside it and over its end, rows before it
    episodes = [X.episode(1), X.episode(2, start="2031-02-28T10:00:00Z", end="2031-03-01T00:00:00Z")]
    turns = [X.turn(1), X.turn(2, of=2, timestamp="2031-02-28T11:00:00Z")]
    noon = {"mode": "daily", "start": "2031-03-31T12:00:00Z", "end": "2031-04-01T12:00:00Z"}
    X.month(tmp_path, "2031/03", episodes, turns, X.trend(episodes, turns, window=X.window("daily", "2031-04-04", "2031-04-05")), X.manifest(window=noon))
    # a week that began in the month before excuses its rows
    episodes, turns = [X.episode(1, start="2031-03-30T08:00:00Z", end="2031-03-30T09:00:00Z")], [X.turn(1, timestamp="2031-03-30T08:30:00Z")]
    X.month(tmp_path, "2031/04", episodes, turns, X.trend(episodes, turns, window=X.window("weekly", "2031-03-28", "2031-04-04")))
    # a manifest alone: an end may be the window's end, a start may not
    day = [f"2031-05-0{d}T00:00:00Z" for d in (2, 3)]
    X.month(tmp_path, "2031/05", [X.episode(1, start=day[0], end=day[1]), X.episode(2, start=day[1], end=day[1]), X.episode(3, start=None, end=None)], manifest=X.manifest(window=X.window("daily", "2031-05-02", "2031-05-03")))
    # a count that is none withholds the totals, not the flags; other rows than objects have no line of their own in the partition
    episodes = [7, X.episode(1, start="2031-06-02T00:00:00Z", end=None, turn_count=True), X.episode(1, start=None, end=None)]
    X.month(tmp_path, "2031/06", episodes, trend=X.trend([], [], window=X.window("daily", "2031-06-02", "2031-06-03"), episode_count=2, turn_count=99, flagged_turn_count=1, hosts={X.HOST: 5}, flags={X.FLAG: 2}))
    flat, month = "retained", "data"
    within = "must be within"
    assert found(spark, tmp_path) == [
        f"{month}/episodes/2031/06/episodes.jsonl:1: episode row must be an object",
        f"{month}/episodes/2031/06/episodes.jsonl:2: turn_count must be a bounded non-negative integer",
        f"{flat}/baseline/notes.txt: unexpected retained artifact location",
        f"{flat}/weekly/trend_report.json: trend window.mode must match retained/weekly export directory",
        f"{flat}/baseline: retained export directory is incomplete or has extra files",
        f"{flat}/daily/episodes.jsonl:2: duplicate episode_id",
        f"{flat}/daily/turn_flags.jsonl:3: duplicate turn_id",
        f"{flat}/daily/turn_flags.jsonl:1: host must match referenced episode",
        f"{flat}/daily/turn_flags.jsonl:1: session_id must match referenced episode",
        f"{flat}/daily/turn_flags.jsonl:2: host must match referenced episode",
        f"{flat}/daily/turn_flags.jsonl:2: timestamp {within} referenced episode",
        f"{flat}/daily/turn_flags.jsonl:5: episode_id is missing from episodes export",
        f"{flat}/daily/turn_flags.jsonl: flagged turns must not exceed referenced episode turn_count",
        f"{flat}/daily/trend_report.json: episode_count must match episodes.jsonl",
        f"{flat}/daily/trend_report.json: hosts must match episodes.jsonl turn_count totals",
        f"{flat}/weekly: retained export mode differs between trend and manifest",
        f"{flat}/weekly: retained export window differs between trend and manifest",
        f"{flat}/weekly/turn_flags.jsonl:2: timestamp {within} referenced episode",
        f"{flat}/weekly/episodes.jsonl:2: episode start/end {within} trend window",
        f"{flat}/weekly/turn_flags.jsonl:2: timestamp {within} trend window",
        f"{month}/2031/03: retained export window differs between trend and manifest",
        f"{month}/trends/2031/03/trend_report.json: window must overlap data month",
        f"{month}/manifests/2031/03/retained_manifest.json: window end {within} data month",
        f"{month}/episodes/2031/03/episodes.jsonl:2: episode start/end {within} data month",
        f"{month}/turn_flags/2031/03/turn_flags.jsonl:2: timestamp {within} data month",
        f"{month}/episodes/2031/03/episodes.jsonl:1: episode start/end {within} trend window",
        f"{month}/episodes/2031/03/episodes.jsonl:2: episode start/end {within} trend window",
        f"{month}/turn_flags/2031/03/turn_flags.jsonl:1: timestamp {within} trend window",
        f"{month}/turn_flags/2031/03/turn_flags.jsonl:2: timestamp {within} trend window",
        f"{month}/episodes/2031/05/episodes.jsonl:2: episode start/end {within} manifest window",
        f"{month}/episodes/2031/06/episodes.jsonl:2: duplicate episode_id",
        f"{month}/trends/2031/06/trend_report.json: flagged_turn_count must match turn_flags.jsonl",
        f"{month}/trends/2031/06/trend_report.json: flags must match turn_flags.jsonl issue_flags",
    ]
