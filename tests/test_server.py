"""The management interface, the document listener, restarts of a source, late acknowledgements."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidelog.streaming import runtime, server
from tidelog.streaming.signal_queue import SignalQueue


def call(port, path, body=None, **headers):
    data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", data, {k.replace("_", "-"): v for k, v in headers.items()})) as r:
            text = r.read().decode()
            return r.status, text if "text/plain" in r.headers["Content-Type"] else json.loads(text) if text else None
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read() or b"null")


class Nothing:
    def write(self, batch, batch_id):
        batch.count()


def connector(tmp_path, **k):
    return runtime.Connector("c", Nothing(), runtime.CheckpointStore(str(tmp_path / "s")), {}, **k)


def test_management(tmp_path):
    c, stopped, signals = connector(tmp_path), threading.Event(), SignalQueue()
    with server.management(c, stopped.set, signals, mutations=True, timeout_s=0.3) as s:
        assert call(s.port, "/health/live") == (200, {"status": "live"})
        assert call(s.port, "/health/ready") == (503, {"ready": False, "state": "created"})
        c.open()
        assert call(s.port, "/health/ready")[0] == 200
        assert call(s.port, "/v1/connector/status")[1]["state"] == "snapshotting" and 'tidelog_up{connector="c"} 1' in call(s.port, "/metrics")[1]
        assert call(s.port, "/v1/connector/signals", {"id": "1", "type": "x", "data": {"a": 1}}) == (504, {"id": "1", "stored": False})
        assert [(p.id, p.data) for p in signals.take()] == [("1", '{"a": 1}')]

        def later():
            while not signals.waiting.qsize():
                time.sleep(0.01)
            signals.take()
            signals.acknowledge()

        threading.Thread(target=later, daemon=True).start()
        assert call(s.port, "/v1/connector/signals", {"id": "2", "type": "x"})[0] == 202
        assert call(s.port, "/v1/connector/signals", {"id": " ", "type": "x"})[0] == call(s.port, "/v1/connector/signals", b"nope")[0] == 400
        assert (call(s.port, "/nothing")[0], call(s.port, "/v1/connector/stop")[0]) == (404, 405)
        assert call(s.port, "/v1/connector/stop", {})[0] == 202 and stopped.wait(2)
    with server.management(c, stopped.set, signals) as s:
        assert call(s.port, "/v1/connector/stop", {})[0] == call(s.port, "/v1/connector/signals", {"id": "1", "type": "x"})[0] == 403


def test_listener(spark, tmp_path):
    landing = tmp_path / "in"
    with server.listener(str(landing), token="t", path="/docs", max_body=200) as s:
        auth = {"Authorization": "Bearer t"}
        assert call(s.port, "/docs", {"a": 1})[0] == 401
        assert call(s.port, "/docs", {"a": 1}, **auth) == (204, None) == call(s.port, "/docs", {"a": 1}, **auth)  # a repeat
        assert call(s.port, "/docs", [{"a": "é\n"}, {"a": 3}], **auth)[0] == 204
        assert call(s.port, "/docs", {"a": 4}, x_record_id="9", **auth)[0] == call(s.port, "/docs", {"a": 5}, x_record_id="9", **auth)[0] == 204
        assert call(s.port, "/docs", [1], **auth)[0] == call(s.port, "/docs", b"{", **auth)[0] == 400
        assert call(s.port, "/docs", {"a": "x" * 300}, **auth)[0] == 413
    assert sorted(r[0] for r in spark.read.text(str(landing)).collect()) == ['{"a":"é\\n"}', '{"a":1}', '{"a":3}', '{"a":4}']


def test_a_source_that_fails_for_a_while_is_started_again(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(5).coalesce(1).write.parquet(folder)
    tries = []

    def build():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("Connection refused")
        rows = spark.readStream.schema("id long").parquet(folder)
        return rows.select(F.lit("t").alias("topic"), F.lit("k").alias("key"), F.lit("v").alias("value"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"), F.lit("data").alias("boundary"), F.struct("id").alias("pos"), F.lit(1).alias("source_us"))

    c = connector(tmp_path, retries=3, retry_initial_ms=1)
    c.run(build, str(tmp_path / "cp"), True, lambda e: "refused" in str(e))
    assert (c.status.restarts, c.status.delivered) == (2, 5)
    tries.clear()
    with pytest.raises(OSError):
        connector(tmp_path, retries=1, retry_initial_ms=1).run(build, str(tmp_path / "cp"), True, lambda e: True)
    tries.clear()
    with pytest.raises(OSError):
        connector(tmp_path, retries=9, retry_initial_ms=1).run(build, str(tmp_path / "cp"), True)


@pytest.mark.parametrize("late", ["fail", "warn", "ignore"])
def test_late_acknowledgements(tmp_path, late, recwarn):
    c = connector(tmp_path, acknowledge=lambda p, b: time.sleep(5), acknowledge_timeout_s=0.05, acknowledge_late=late)
    if late == "fail":
        with pytest.raises(TimeoutError):
            c._acknowledge(None, 1)
    else:
        c._acknowledge(None, 1)
    assert c.status.late_acknowledgements == 1 and bool([w for w in recwarn if "acknowledgement" in str(w.message)]) == (late == "warn")
    told = []
    connector(tmp_path, acknowledge=lambda p, b: told.append(b), acknowledge_mode="manual")._acknowledge(None, 1)
    connector(tmp_path, acknowledge=lambda p, b: told.append(b))._acknowledge(None, 2)
    assert told == [2]
