"""Live sources against a local server and a local repository, and events as people read them."""

import json
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import events as ev
from sparkloom.sources import live
from sparkloom.streaming import state


@pytest.fixture
def service():
    held = {"/missions?status=open": [{"id": "a"}, {"id": "é"}], "/kv/index": ["x", "gone", "y z"], "/kv/doc/x": {"v": 1}, "/kv/doc/y%20z": {"v": 2}, "/none": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps(held.get(self.path, "no")).encode()
            self.send_response(500 if self.path == "/broken" else 200 if self.path in held else 404)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_state(spark, service):
    rows = live.state(spark, service, ["missions"], {"status": "open"}).orderBy("ord").collect()
    assert [(r["path"], r["ord"], json.loads(r["value"])["id"]) for r in rows] == [("missions", 0, "a"), ("missions", 1, "é")]
    assert live.state(spark, service, ["none", "gone"]).count() == 0 and live.state(spark, service, []).count() == 0
    assert sorted(json.loads(r["value"])["v"] for r in live.looked_up(spark, service, "kv/index", "kv/doc/{}").collect()) == [1, 2]
    with pytest.raises(Exception, match="500"):
        live.state(spark, service, ["broken"]).collect()


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for i in range(3):
        (tmp_path / "f").write_text(f"{i}\n")
        git("add", "f")
        git("commit", "-qm", f"step {i}")
    got = live.changes(spark, [str(tmp_path)], "HEAD~2")
    assert [r["line"].split(" ", 1)[1] for r in got.where("kind = 'commit'").orderBy("ord").collect()] == ["step 2", "step 1"]
    assert got.where("kind = 'diff' and line = '+2'").count() == 1
    with pytest.raises(Exception, match="git failed"):
        live.changes(spark, [str(tmp_path)], "nowhere").collect()
    with pytest.raises(Exception, match="not a revision"):
        live.changes(spark, [str(tmp_path)], "--output=x").collect()


def test_events(spark):
    rows = [
        (1, "cost_update", '{"missionId": "m", "totalCost": 1.5, "totalTokens": 1250}'),
        (2, "agent_status", '{"agentType": "worker", "agentId": "w1", "status": "in_progress"}'),
        (3, "agent_output", '{"eventType": "tool_call", "message": "ls"}'),
        (4, "mission_completed", '{"missionId": "abcdefghij", "finalState": "completed"}'),
        (5, "mission_completed", '{"missionId": "abcdefghij", "finalState": "completed"}'),
        (6, "odd_type", None),
        (7, "escalation", '{"missionId": "abcdefghij"}'),
        (8, "mission_log", '{"phase": "plan", "message": "go"}'),
    ]
    df = spark.createDataFrame(rows, "seq long, type string, p string").withColumn("payload", F.try_parse_json("p"))
    feed = {r["seq"]: (r["kind"], r["label"], r["message"]) for r in ev.feed(df).collect()}
    assert feed[1] == ("cost", "COST", "$1.50 · 1.3K tokens") and feed[2] == ("agent", "AGENT", "worker → in progress") and feed[3][1:] == ("TOOL", "ls")
    assert feed[4] == ("event", "DONE", "mission completed") and feed[6] == ("event", "ODD_TYPE", "odd type") and feed[8] == ("log", "PLAN", "go")
    lines = {r["seq"]: r["s"] for r in df.select("seq", ev.summary(F.col("type"), F.col("payload")).alias("s")).collect()}
    assert lines[2] == "worker w1 -> in_progress" and lines[4] == "abcdefghij" and lines[6] == "<odd_type>" and lines[8] == "[plan] go"
    told = {(r["notice"], r["seq"], r["body"]) for r in ev.notifications(df).collect()}
    assert told == {("completed", 4, "Mission abcdefgh… finished successfully"), ("escalation", 7, "Mission abcdefgh… needs your decision")}


def test_throttle_and_ttl(spark):
    uses = spark.createDataFrame([(i, 1, ms) for i, ms in enumerate((0, 0, 9, 10, 19, 20, 100))] + [(9, None, 0)], "id long, key long, ms long")
    assert [r["id"] for r in state.throttled(uses, 10).where("kept").orderBy("id").collect()] == [0, 3, 5, 6]
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01"), ("c", None)], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r["k"] for r in state.fresh(rows, "t", F.lit("2024-01-01 01:00:01").cast("timestamp"), 3_600_000).collect()] == ["b"]


def test_job_log(spark):
    ops = [("markRunning", "x"), ("enqueue", None), ("claim", "t1"), ("complete", "t1"), ("markRunning", "t0"), ("markRunning", "t1"), ("heartbeat", "t1"), ("requeue", None), ("claim", "t2"), ("claim", "t3"), ("fail", "t1"), ("requeue", None), ("claim", "t4"), ("requeue", None), ("claim", "t5"), ("fail", None), ("cancel", None), ("enqueue", None), ("odd", None)]
    log = spark.createDataFrame([(i, 1, i, op, t) for i, (op, t) in enumerate(ops)] + [(90, 2, 0, "enqueue", None), (91, 2, 1, "cancel", None)], "id long, key long, ms long, op string, token string")
    got = {r["id"]: (r["accepted"], r["status"], r["attempt"]) for r in state.job_log(log).collect()}
    want = [(False, None, 0), (True, "queued", 0), (True, "claimed", 1), (False, "claimed", 1), (False, "claimed", 1), (True, "running", 1), (True, "running", 1), (True, "queued", 1), (True, "claimed", 2), (False, "claimed", 2), (False, "claimed", 2), (True, "queued", 2), (True, "claimed", 3), (True, "queued", 3), (False, "queued", 3), (True, "failed", 3), (False, "failed", 3), (False, "failed", 3), (False, "failed", 3)]
    assert [got[i] for i in range(len(ops))] == want and got[91] == (True, "cancelled", 0)


def test_current_states(spark, tmp_path):
    rows = [("a", 2, "running"), ("a", 1, "queued"), ("b", 1, "aborted"), ("b", 2, "completed"), ("c", 1, None)]
    events = spark.createDataFrame(rows, "key string, seq long, status string")
    want = {("a", "running"), ("b", "aborted")}
    assert {tuple(r) for r in state.current_states(events).collect()} == want
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.current_states(stream).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("SELECT * FROM states").collect()} == want
