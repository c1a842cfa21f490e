"""Published events that are long, damaged or hold what mustn't be published; retention by size and by children."""

import json
from types import SimpleNamespace

from hslake.operators.incremental import EVENT_BYTES, FIELDS, childless, envelopes, size_status


def published(spark, *docs, **more):
    texts, numbers = FIELDS["endpoint"]
    rows = [{"key": f"k{i}", "revision": 7, "time_us": 9, "computer_name": "h"} | {t: "a" for t in texts} | {n: 1 for n in numbers} | more | {"doc": d if isinstance(d, str) or d is None else json.dumps(d, separators=(",", ":"))} for i, d in enumerate(docs)]
    schema = ", ".join(f"{c} {'long' if isinstance(v, int) else 'string'}" for c, v in rows[0].items())
    return [r.body for r in envelopes(spark.createDataFrame([tuple(r.values()) for r in rows], schema), "endpoint", "doc").collect()]


def test_evidence(spark):
    doc = {"xml": "<secret/>", "mode": 'G"C\\M', "key_bits": 256, "success": True, "local": {"port": 1, "address": "é"}, "role": None, "observation": "x" * 3000}
    event = json.loads(published(spark, doc)[0])
    assert event["payload"]["evidence"] == {"mode": 'G"C\\M', "key_bits": 256, "success": True, "local": {"port": 1, "address": "é"}} and event["truncated"]
    plain = json.loads(published(spark, {"mode": "GCM"})[0])
    assert plain["payload"]["evidence"] == {"mode": "GCM"} and "truncated" not in plain and plain["payload"]["pid"] == 1


def test_unusable_documents(spark):
    for body in published(spark, "{", "[1]", "", None):
        event = json.loads(body)
        assert event["payload"]["metadata_unavailable"] and "truncated" not in event
    event = json.loads(published(spark, {"mode": "x" * 70000})[0])
    assert event["payload"]["metadata_unavailable"] and event["truncated"]


def test_size_bound(spark):
    members = {n: "y" * 2000 for n in ("mode", "algorithm", "signature", "role", "local", "remote", "quic", "transport", "observation")}
    body = published(spark, members)[0]
    event = json.loads(body)
    assert len(body.encode()) <= EVENT_BYTES and event["truncated"] and "evidence" not in event["payload"]
    long = json.loads(published(spark, {}, peer="ü" * 2000, computer_name="c" * 300)[0])
    assert len(long["payload"]["peer"]) == 1024 and len(long["computer"]) == 256 and long["truncated"]
    wide = published(spark, members, peer="ü" * 2000)[0]
    assert len(json.loads(wide)["payload"]["peer"]) == 128 and len(wide.encode()) <= EVENT_BYTES
    assert json.loads(published(spark, {}, peer=None)[0])["payload"]["peer"] is None


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_size_retention(spark):
    connections = frame(spark, [(k, "r", k, k * 10, 1 if k < 3 else None, 1, "x" * 100) for k in range(6)], "id long, run_id string, flow_id long, last_us long, ended_us long, change_revision long, crypto_json string")
    links = frame(spark, [], "run_id string, flow_id long, change_revision long")
    journal = lambda ack: SimpleNamespace(connections=connections, connection_certificates=links, sessions=frame(spark, [("r", None)], "id string, stopped_us long"), consumers=frame(spark, [("c", ack)], "name string, acknowledged long"))
    assert tuple(size_status(journal(1), 1200, 1000).first()) == (1200, False, 0, 0, False)
    assert tuple(size_status(journal(1), 950, 1000).first()) == (1200, True, 2, 400, False)
    assert tuple(size_status(journal(1), 100, 1000).first()) == (1200, True, 3, 600, False)
    assert tuple(size_status(journal(1), 950, 5).first()) == (1200, True, 1, 200, False)
    assert tuple(size_status(journal(0), 950, 1000).first()) == (1200, True, 0, 0, True)


def test_sessions_without_children(spark):
    sessions = frame(spark, [("a", 1, 2, 1), ("b", 1, 2, 1), ("c", 1, 2, 1), ("d", 1, None, 1), ("e", 1, 2, 9), ("f", 1, 99, 1), ("g", 1, 2, 1)], "id string, started_us long, stopped_us long, change_revision long")
    child = lambda *runs: frame(spark, [(r,) for r in runs], "run_id string")
    found = childless(sessions, child("b", "b", None), child("c"), frame(spark, [("x", 5), ("y", 8)], "name string, acknowledged long"), "g", 50)
    assert [r.id for r in found.collect()] == ["a"]
