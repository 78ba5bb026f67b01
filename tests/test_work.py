"""Boundary cases of the work-item operators and text scalars, on tiny relations."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as s
from sparkloom.operators import lifecycle as lc
from sparkloom.operators import readiness

C = F.col


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (s.clone_url, {"https://github.com/a/b": "https://github.com/a/b.git", "https://github.com/a/b.git": "https://github.com/a/b.git", "https://GitHub.com/a/b/tree/x?y#z": "https://github.com/a/b.git", "http://github.com/a/b": None, "https://gitlab.com/a/b": None, "https://github.com/a": None, "https://github.com//b": None, "": None, None: None}),
        (s.clone_folder, {"https://github.com/a b/c+d.git": "a-b-c-d", "git@github.com:a/b": None}),
        (s.title, {" \n\t\n  Fix it \nmore": "Fix it", "a" * 90: "a" * 80, "": None, None: None}),
        (s.brief, {"<think>x\ny</think>\nSure! Here it is:\n# Goal\nDo": "# Goal\nDo", "```markdown\n# A\n```": "# A", "Refined mission brief:\n\nDo it": "Do it", "plain ": "plain", None: None}),
        (lambda x: s.shortened(x, 6), {"abcdef": "abcdef", "abcdefg": "abc..."}),
        (s.safe_command, {"npm run test:unit": True, "npm:x": False, "npm run test": True, "cat ../x": False, "a; b": False, None: False}),
        (s.hopeless, {"No such provider": True, "requires unitId": True, "timed out": False, None: False}),
        (lambda x: s.manifest(F.lit(None).cast("string"), x), {"cargo": "Cargo.toml", "Go": "go.mod", "javascript": "pom.xml", None: "package.json"}),
        (lambda x: s.issue_id(F.lit("high"), x, F.lit("1.0"), F.lit(""), F.lit(None).cast("string"), F.lit("f")), {"@a/b": "package-high-_a_b-1_0-finding-f"}),
    ],
)
def test_texts(spark, f, cases):
    for given, want in cases.items():
        assert one(spark, f(C("x")), given) == want, given


def test_numbers(spark):
    for given, want in {999.0: "999", 0.5: "0.5", 0.0: "0", 1000.0: "1K", 1150.0: "1.1K", 1250.0: "1.3K", 1550.0: "1.6K", 999_950.0: "1000K", 1_500_000.0: "1.5M", None: None}.items():
        assert one(spark, s.compact_number(C("x")), given, "double") == want, given
    for given, want in {0: None, 999: "0s", 61_000: "1m 1s", 3_661_000: "1h 1m 1s", None: None}.items():
        assert one(spark, s.elapsed(C("x")), given, "long") == want
    assert one(spark, s.stamp(C("x")), 946_684_800_000, "long") == "2000-01-01T00:00:00.000Z"
    assert one(spark, s.stamp(C("x")), None, "long") == "live"
    assert [one(spark, s.rounded(C("x")), v, "double") for v in (0.5, 1.5, -0.5)] == [1, 2, 0]
    assert [one(spark, s.backoff_ms(C("x")), v, "int") for v in (0, 1, 19, 20)] == [1000, 1500, 30_000, None]
    assert one(spark, s.valid_durations(C("x"), F.lit(5)), 5, "long") and not one(spark, s.valid_durations(C("x"), F.lit(6)), 5, "long")
    assert one(spark, s.burn_progress(C("x"), F.lit(-5.0)), 10.0, "double") == 100 and one(spark, s.burn_progress(C("x"), F.lit(1.0)), 0.0, "double") == 0
    label = [one(spark, s.supply_label(C("x"), F.lit(c), F.lit(h)), n, "int") for n, c, h in ((1, 0, 0), (3, 1, 2))]
    assert label == ["1 supply-chain finding", "3 supply-chain findings · 1 critical · 2 high"]


def test_costs(spark):
    v = F.try_parse_json(C("x"))
    for given, want in {"0.25": 0.25, '{"total": 2}': 2.0, '"free"': 4e-7, "{}": 4e-7, "0": 4e-7, None: 4e-7}.items():
        assert one(spark, s.cost(v, F.lit(1), F.lit(1)), given) == pytest.approx(want), given


def test_modules_kinds_and_lines(spark):
    paths = ["a/src/auth/login.ts", "src/auth/mod.rs", "src/mod.rs", "lib/db/x.py", "top.md", "x/src"]
    assert one(spark, s.modules(C("x")), paths, "array<string>") == ["auth", "db", "x"]
    none = F.array().cast("array<string>")
    for given, want in {"Run PyTest": "test", "contest": "simple", "docker build": "build", "a mapé": "analysis", "analyse": "analysis", None: "simple"}.items():
        assert one(spark, s.work_kind(C("x"), none, none), given) == want, given
    assert one(spark, s.lines(C("x"), F.lit(""), F.lit("b"), F.lit(None)), "a") == "a\nb"
    assert one(spark, s.sections(Goal=C("x"), Open_points=F.lit(" "), Notes=F.lit("n")), "a") == "## Goal\na\n\n## Notes\nn"
    kind = "array<struct<name:string,command:string>>"
    assert one(spark, s.checks(C("x")), [("build", "b"), ("lint", "l"), ("test", "t"), ("test", "u")], kind) == ["t", "l"]
    assert one(spark, s.checks(C("x")), [("build", "b")], kind) == ["b"] and one(spark, s.checks(C("x")), [], kind) == []


def test_moves(spark):
    allowed = lambda table, op, status: spark.range(1).select(lc.allowed(table, F.lit(op), F.lit(status)).alias("y")).first()["y"]
    assert allowed(lc.JOB_MOVES, "complete", "running") and not allowed(lc.JOB_MOVES, "complete", "queued") and allowed(lc.JOB_MOVES, "other", "queued")
    assert not allowed(lc.SESSION_MOVES, "cancel", "lost")
    move = lambda a, b, c: spark.createDataFrame([(a, b, c)], "a string, b string, c string").select(lc.finding_move(C("a"), C("b"), C("c")).alias("y")).first()["y"]
    assert move("unverified", "verified", "t") is None and move("unverified", "verified", None) and move("expired", "verified", "t") and move("odd", "expired", "t") == "unknown state: odd" and move(None, "expired", None)


def test_stale(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    jobs = spark.createDataFrame([("a", "claimed", at(8), None, 0, 3), ("b", "claimed", at(7), None, 3, 3), ("c", "claimed", None, None, 0, 3), ("d", "running", None, at(4), 1, 3), ("e", "queued", None, None, 0, 3)], "id string, status string, claimed_at string, heartbeat_at string, attempt int, max_attempts int")
    jobs = jobs.withColumns({c: C(c).cast("timestamp") for c in ("claimed_at", "heartbeat_at")})
    now = F.lit(at(10)).cast("timestamp")
    assert {(r["target_id"], r["action"]) for r in lc.stale_jobs(jobs, now).collect()} == {("b", "fail_terminal"), ("c", "release_claim"), ("d", "requeue")}
    sessions = spark.createDataFrame([("s", "m", "running", None, None, 0, 3), ("t", "m", "starting", None, None, 3, 3), ("u", "m", "queued", None, None, 0, 3)], "id string, mission_id string, status string, started_at timestamp, last_heartbeat_at timestamp, attempt int, max_attempts int")
    acts = lc.stale_sessions(sessions, now)
    assert {(r["target_id"], r["action"]) for r in acts.collect()} == {("s", "mark_lost"), ("m", "escalate_to_user"), ("t", "fail_terminal")}
    assert lc.stale_counts(acts.unionByName(lc.stale_jobs(jobs, now))).first().asDict() == {"requeue": 2, "lost": 1, "failed": 2, "escalated": 1}


def test_quota_boundaries(spark):
    rows = [(None, None, 5), (0, None, 99), (0, None, 100), (0, 0, 9), (0, 0, 10), (0, 0, 100), (0, 95, 100)]
    df = spark.createDataFrame(rows, "s long, f long, n long").select(lc.quota(C("s"), C("f"), C("n"), F.lit(100), F.lit(10)).alias("q")).select("q.*")
    assert [(r["ok"], r["reason"], r["remaining_burn_ms"]) for r in df.collect()] == [(True, None, float("inf")), (True, None, 10), (True, "window_expired", 10), (True, None, 1), (False, "quota_exhausted", 0), (True, "window_expired", 10), (True, None, 5)]


def test_todos(spark):
    todos = spark.createDataFrame([("m", 1, "pending", None), ("m", 2, "passed", None), ("m", 3, "pending", None), ("m", 4, "pending", None), ("n", 5, "ready", "validation"), ("o", 6, "cancelled", None), ("p", 7, "merged", None)], "k string, id int, status string, type string")
    needs = spark.createDataFrame([(1, 2), (3, 99), (4, 2), (4, 1)], "id int, needs int")
    assert [r["id"] for r in lc.settled_dependencies(todos, needs).collect()] == [1]
    assert {r["k"]: (r["ledger"], r["next_action"]) for r in lc.ledger(todos, "k").collect()} == {"m": ("planning", "merge"), "n": ("ready", "pause"), "o": ("cancelled", "pause"), "p": ("completed", "complete_mission")}


def test_readiness(spark):
    files = spark.createDataFrame(
        [("a", "package.json", '{"scripts": {"test": "x", "tsc": "y"}, "dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}'), ("a", "pnpm-lock.yaml", None), ("a", "sub/yarn.lock", None), ("a", "src/x.tsx", None), ("a", "packages/p/package.json", "{}"), ("a", ".env", None), ("b", "go.mod", None), ("b", "main.go", None), ("c", "package.json", "broken ["), ("c", "readme.md", None)],
        "repo string, path string, content string",
    )
    got = {r["repo"]: r for r in readiness.profiles(files).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["profile"], a["package_manager"], a["lockfiles"], a["blockers"], a["warnings"]) == ("TypeScript monorepo React", "pnpm", ["pnpm-lock.yaml", "sub/yarn.lock"], [], [readiness.NO_ENV])
    assert [x["command"] for x in a["commands"]] == ["pnpm install", "pnpm test", "pnpm tsc"] and a["frameworks"] == ["React", "Vite"]
    assert (b["profile"], [x["command"] for x in b["commands"]], b["confidence"], b["package_manager"]) == ("Go project", ["go test ./...", "go build ./..."], "medium", None)
    assert (c["blockers"], c["confidence"], c["commands"], c["warnings"]) == ([readiness.NO_TEST], "low", [], [])
    assert readiness.profiles(files.limit(0)).count() == 0


def test_handoffs(spark):
    kind = "r string, runs array<struct<command:string,exitCode:double>>"
    given = {f: F.lit("x") for f in lc.HANDOFF_FIELDS if f != "rationale"} | {"rationale": C("r")}
    df = spark.createDataFrame([("as it broke", [("make", 0.0)]), ("Fixed it", []), (None, [("make", 0.0), (None, 1.0)])], kind)
    got = [r["e"] for r in df.select(lc.handoff_errors(C("runs"), given).alias("e")).collect()]
    assert got[0] == [] and len(got[1]) == 2 and got[2] == ["Missing required field: rationale", "commandsRun[1].command must be a non-empty string"]
