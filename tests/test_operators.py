"""Boundary cases on tiny relations."""

from sparkloom.functions.text import close_json, escape_controls
from sparkloom.operators import ordered as op
from sparkloom.sources import manifests
from sparkloom.streaming import state


def test_latest_ties(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 2, 2), ("a", 1, 3)], "k string, v int, ord int")
    assert op.latest(df, ["k"], "v", "ord", "first").first()["ord"] == 1
    assert op.latest(df, ["k"], "v", "ord", "last").first()["ord"] == 2


def test_repeats_and_last_n(spark):
    df = spark.createDataFrame([("u", i, e) for i, e in enumerate("aabbbb")], "k string, ord int, e string")
    assert [(r["ord"], r["run_length"]) for r in op.repeats(df, ["k"], ["ord"], "e", 3).orderBy("ord").collect()] == [(4, 3), (5, 4)]
    assert sorted(r["ord"] for r in op.keep_last_n(df, ["k"], ["ord"], 2).collect()) == [4, 5]


def test_json_repair():
    assert close_json('{"a": [1, {"b": "x') == '{"a": [1, {"b": "x"}]}'
    assert close_json('{"a": 1,') == '{"a": 1}'
    assert close_json("nonsense") is None and close_json(None) is None
    assert escape_controls('{"a": "x\ny"}\n') == '{"a": "x\\ny"}\n'


def test_manifest_packages(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "package.json").write_text('{"dependencies": {"hidden": "1"}}')
    (tmp_path / "package.json").write_text('{"dependencies": {"@a/b": "^1.2.3", "l": "file:../l"}, "devDependencies": {"c": ">=1.0 <2.0"}}')
    got = manifests.packages(manifests.files(spark, str(tmp_path), "package.json"))
    assert sorted((r["name"], r["version"], r["normalized"]) for r in got.collect()) == [("@a/b", "1.2.3", "b"), ("c", "<2.0", "c")]


def test_scanner_lines_and_chat(spark):
    lines = spark.createDataFrame([('{"record_type": "finding", "severity": ""}',), ("",), ("{broken",)], "value string")
    assert [(r["record_type"], r["severity"]) for r in manifests.scanner_records(lines).collect()] == [("finding", "medium")]
    lines = spark.createDataFrame([(7, '{"record_type": "package", "package_name": "@a/b", "ecosystem": ""}'), (7, '{"record_type": "finding", "record_id": "r", "severity": "low"}'), (8, '{"record_type": "x"}'), (8, "[")], "scan int, value string")
    found = manifests.scanned_findings(lines).collect()
    assert [(r["scan"], r["id"], r["severity"], r["finding_type"], r["confidence"], r["evidence"]) for r in found] == [(7, "r", "low", "package_exposure", "low", "")]
    assert [(r["scan"], len(r["id"]), r["normalized_name"], r["ecosystem"], r["package_manager"]) for r in manifests.scanned_packages(lines).collect()] == [(7, 36, "@a/b", "unknown", None)]
    part = 'data: {"choices": [{"delta": {"content": "%s"}}]}'
    used = '{"usage": {"prompt_tokens": %d, "completion_tokens": 2, "total_tokens": 9}}'
    said = [("a", 3, part % "c"), ("a", 1, part % "a"), ("a", 2, " " + part % "b"), ("a", 4, "data: [DONE]"), ("a", 5, "data: {"), ("a", 6, "data: " + used % 1), ("a", 7, "data: " + used % 7), ("b", 1, 'data: {"choices": [{"finish_reason": "length"}]}'), ("b", 2, "event: x")]
    got = {r["stream"]: (r["content"], r["finish_reason"], tuple(r["usage"])) for r in manifests.chat_stream(spark.createDataFrame(said, "stream string, ord int, value string")).collect()}
    assert got == {"a": ("abc", "stop", (7, 2, 9)), "b": ("", "length", (0, 0, 0))}


def test_listings_and_catalogs(spark):
    paths = ["a.ts", ".github/x", "b/node_modules/c", "1/2/3/4/e", "1/2/3/4/5/f", ".gitignore", "dist", "z"]
    df = spark.createDataFrame([("s", p, i) for i, p in enumerate(paths)] + [("t", "q", 0)], "scope string, path string, ord int")
    assert sorted((r["scope"], r["path"]) for r in manifests.listing(df, most=2).collect()) == [("s", "1/2/3/4/e"), ("s", "a.ts"), ("t", "q")]
    texts = ['{"schema_version": "1", "entries": [{"id": "C", "package": "p", "versions": ["*"]}, {"id": "D"}]}', '{"entries": [{"id": "E"}]}', '{"schema_version": "1", "entries": 3}', "broken", None]
    got = manifests.catalog_entries(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, value string")).collect()
    assert sorted((r["k"], r["ord"], r["id"], r["versions"]) for r in got) == [(0, 0, "C", ["*"]), (0, 1, "D", None)]
    repos = manifests.repositories(spark.createDataFrame([('[{"id": 1, "full_name": "a/b", "private": true, "more": 2}]',), ("{",)], "value string")).collect()
    assert [tuple(r) for r in repos if r["id"] is not None] == [(1, "a/b", None, True, None, None)]


def test_window_edges(spark):
    uses = spark.createDataFrame([(i, 1, ms) for i, ms in enumerate((0, 9, 10, 49, 50))], "id long, key long, ms long")
    got = {r["ms"]: (r["window_start"], r["admitted"]) for r in state.admissions(uses, 50, 10).collect()}
    assert got == {0: (0, True), 9: (0, True), 10: (0, False), 49: (0, False), 50: (50, True)}


def test_stream_counts_match_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type").selectExpr("cast(ts as timestamp) as ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = state.live_counts(stream).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM live").first()[0] == events.count()


def test_capped_sessions(spark):
    uses = spark.createDataFrame([(i, 1, ms) for i, ms in enumerate((0, 8, 16, 24, 30, 60))] + [(9, 2, 5), (10, None, 5)], "id long, key long, ms long")
    got = {(r["key"], r["ms"]): (r["session_start"], r["deadline"]) for r in state.capped_sessions(uses, 10, 25).collect()}
    assert got == {(1, 0): (0, 10), (1, 8): (0, 18), (1, 16): (0, 25), (1, 24): (0, 25), (1, 30): (30, 40), (1, 60): (60, 70), (2, 5): (5, 15)}


def test_walk_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    uses = spark.createDataFrame([(i, i % 2, i * 7 % 1000) for i in range(400)], "id long, key long, ms long")
    whole = sorted(tuple(r) for r in state.admissions(uses, 50, 10).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(tuple(r) for r in state.admissions(uses, 50, 10).collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_live_admissions_match_batch(spark, tmp_path):
    uses = spark.createDataFrame([(i, i % 3, i * 4) for i in range(60)], "id long, key long, ms long")
    for part in range(3):  # one file a micro-batch, in order of time
        uses.where(f"id div 20 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{part}"))
    stream = spark.readStream.schema(uses.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    q = state.live_admissions(stream, 50, 10).writeStream.outputMode("append").format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM admitted").collect()) == sorted(tuple(r) for r in state.admissions(uses, 50, 10).collect())


def test_positions(spark):
    rows = [("b", 3, "x"), ("a", 12, "y"), ("a", -4, "z"), ("a", 12, "w"), ("b", 40, "v"), ("a", 13, "u")]
    got = op.positions(spark.createDataFrame(rows, "c string, o long, f string"), ["c"], "o", ["f"], width=5)
    assert [r["position"] for r in got.orderBy("c", "o", "f").collect()] == list(range(1, 7))


def test_locks(spark):
    manifest = spark.createDataFrame([("a/package.json", '{"dependencies": {"x": "^1.0.0", "y": "2.0.0"}}'), ("b/package.json", '{"dependencies": {"x": "1.5.0"}}'), ("package.json", '{"dependencies": {"r": "3.0.0"}}')], "path string, content string")
    npm = spark.createDataFrame([("a/package-lock.json", '{"dependencies": {"x": {"version": "1.0.9"}, "y": {"version": ""}}}'), ("package-lock.json", '{"dependencies": {"r": {"version": "3.9.9"}}}'), ("c/package-lock.json", "{broken")], "path string, content string")
    assert sorted(tuple(r) for r in manifests.npm_locks(npm).collect()) == [("a/package.json", "x", "1.0.9"), ("package-lock.json", "r", "3.9.9")]
    yarn = spark.createDataFrame([("yarn.lock", 'x@^1:\n  version "1.7.0"\n\n"@s/p@npm:1":\n  a\n"@s/p@1":\n  version "4.0.0"\nx@^2:\n  version "2.2.2"\nx@^1:\n  version "8.8.8"\nfar@1:\n\n\n\n\n  version "1.0.0"\n')], "path string, content string")
    assert sorted(tuple(r) for r in manifests.yarn_locks(yarn).collect()) == [("@s/p", "4.0.0"), ("x", "1.7.0")]
    got = manifests.resolved(manifests.packages(manifest), manifests.npm_locks(npm), manifests.yarn_locks(yarn))
    assert sorted((r["source_file"], r["name"], r["version"]) for r in got.collect()) == [("a/package.json", "x", "1.7.0"), ("a/package.json", "y", "2.0.0"), ("b/package.json", "x", "1.5.0"), ("package.json", "r", "3.0.0")]


def test_every_generator(spark):
    from sparkloom.plans import registry

    got = registry.queries()["flagship_issues"](spark, "/root/testdata/sf0.01").select("gen").distinct().collect()
    assert {r["gen"] for r in got} == set(range(1, 15))


def test_sinks(spark):
    from sparkloom.sources import sinks

    current = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, v int")
    changes = spark.createDataFrame([("a", 9, 1, None), ("a", 8, 2, None), ("b", None, 3, True), ("x", None, 4, True), ("d", 4, 5, False)], "key string, v int, ord int, deleted boolean")
    assert sorted(tuple(r) for r in sinks.upsert(current, changes, ["key"], "ord").collect()) == [("a", 8), ("c", 3), ("d", 4)]
    reports = spark.createDataFrame([(1, [("i", "open"), ("j", "open")]), (2, [("i", "open")]), (3, None)], "id int, issues array<struct<id: string, status: string>>")
    got = {r["id"]: [tuple(i) for i in r["issues"] or []] for r in sinks.updated_issue(reports, 1, "i", "done").collect()}
    assert got == {1: [("i", "done"), ("j", "open")], 2: [("i", "open")], 3: []}
    ids = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    assert [r["id"] for r in sinks.new_index_rows(spark.createDataFrame([(1,)], "id int"), ids).collect()] == [2]
    parts = spark.createDataFrame([("k", 2, "two"), ("k", 1, "one"), ("k", 3, None), ("e", 1, None)], "key string, ord int, t string")
    assert sorted(tuple(r) for r in sinks.joined(parts, ["key"], ["ord"], "t", "|").collect()) == [("e", "", 0), ("k", "one|two", 2)]
    a = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "key string, ord int, line string")
    assert [tuple(r) for r in sinks.transcript([("Later", a), ("First", a.where("ord = 1"))], "key").collect()] == [("k", "## Later\na\nb\n\n## First\na", 2)]


def test_first_of_several(spark):
    found = spark.createDataFrame([("r", "b.json", "{}", 1), ("r", "a.json", "{broken", 2), ("s", "a.json", '{"k": 1}', 3), ("s", "z", "{}", 4)], "scope string, path string, content string, modificationTime int")
    assert sorted((r["scope"], r["path"]) for r in manifests.first_parsed(found, ["a.json", "b.json"], "scope").collect()) == [("r", "b.json"), ("s", "a.json")]
    names = found.withColumnRenamed("path", "name")
    assert sorted(tuple(r) for r in manifests.first_existing(names, ["b.json", "a.json"], "scope").collect()) == [("r", "b.json"), ("s", "a.json")]
    lines = spark.createDataFrame([(1, " "), (2, "x"), (3, None)], "ord int, value string")
    assert [r["ord"] for r in manifests.progress_lines(lines).collect()] == [2]
