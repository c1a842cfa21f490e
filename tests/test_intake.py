"""Report contracts, recordings and policy files: what is accepted, what is refused and why."""

import json

import pytest

from hslake.operators.policy import POLICIES, Policy
from hslake.sources import intake, policies

RAW = {"schema": "lab.raw/1", "provider": "p", "pid": 7, "process_started_us": 1, "operation_started_us": 2, "timestamp_us": 3, "local": {"address": "10.0.0.1", "port": 5}, "remote": {"address": "192.0.2.1", "port": 443}, "role": "client", "transport": "TCP", "success": True, "algorithm": "AES", "mode": "GCM", "key_bits": 256}
SIX = {"local": {"address": "fe80::1", "port": 5}, "remote": {"address": "2001:db8:0:0:0:0:0:2", "port": 443}}
CASES = {
    "good": (RAW, []), "six": (RAW | SIX, []), "failed": (RAW | {"success": False, "role": "server", "transport": "UDP"}, []),
    "unknown": (RAW | {"key": "secret"}, ["unknown field"]), "missing": ({k: v for k, v in RAW.items() if k != "mode"}, ["missing field", "mode"]), "schema": (RAW | {"schema": "lab.raw/2"}, ["unsupported schema"]),
    "provider": (RAW | {"provider": ""}, ["provider"]), "long provider": (RAW | {"provider": "x" * 129}, ["provider"]), "pid": (RAW | {"pid": "7"}, ["pid"]), "pid0": (RAW | {"pid": 0}, ["pid"]), "pid big": (RAW | {"pid": 1 << 32}, ["pid"]), "real": (RAW | {"timestamp_us": 3.5}, ["timestamp_us"]),
    "socket": (RAW | {"local": {"address": "10.0.0.1", "port": 5, "name": "x"}}, ["local"]), "port": (RAW | {"remote": {"address": "10.0.0.1", "port": 0}}, ["remote"]), "zero": (RAW | {"local": {"address": "0.0.0.0", "port": 5}}, ["local"]), "name": (RAW | {"local": {"address": "localhost", "port": 5}}, ["local"]), "256": (RAW | {"local": {"address": "10.0.0.256", "port": 5}}, ["local"]),
    "list": (RAW | {"local": ["10.0.0.1", 5]}, ["local"]), "mixed": (RAW | {"local": SIX["local"]}, ["address families differ"]), "role": (RAW | {"role": "unknown"}, ["role"]), "transport": (RAW | {"transport": "QUIC"}, ["transport"]), "success": (RAW | {"success": "true"}, ["success"]),
    "algorithm": (RAW | {"algorithm": "Ä"}, ["algorithm"]), "mode": (RAW | {"mode": "a\nb"}, ["mode"]), "bits": (RAW | {"key_bits": 65537}, ["key_bits"]), "null": (RAW | {"algorithm": None}, ["algorithm"]),
}
BROKEN = {"not json": "{", "array": "[1]", "empty": "", "twice": json.dumps(RAW)[:-1] + ', "pid": 7}'}


def test_raw_reports(spark, tmp_path):
    for name, (doc, _) in CASES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    for name, text in BROKEN.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "large.json").write_text(json.dumps(RAW | {"provider": "x" * (2 << 20)}))
    (tmp_path / "other.txt").write_text("no report")
    judged = intake.raw_reports(intake.report_files(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[-1][:-5].replace("%20", " "): r for r in judged.collect()}
    want = {n: w for n, (_, w) in CASES.items()} | {n: ["not a JSON object with distinct fields"] for n in BROKEN if n != "empty"} | {"large": ["report exceeds 2 MiB"]}
    for name, reasons in want.items():
        assert sorted(got[name].reasons) == sorted(reasons), name
    assert got["good"].local_address == "10.0.0.1" and got["good"].remote_port == 443 and got["good"].pid == 7
    counts = {r.reason: r.n for r in intake.quarantined(judged).collect()}
    assert counts["local"] == 5 and counts["report exceeds 2 MiB"] == 1
    job = intake.raw_reports(intake.report_files(spark, str(tmp_path), stream=True)).writeStream.format("memory").queryName("raw_stream").trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(len(r.reasons) for r in spark.table("raw_stream").collect()) == sorted(len(r.reasons) for r in got.values())


def test_recordings(spark, tmp_path):
    event = lambda kind, at, **more: {"type": kind, "values": {"startTime": at, **more}}
    good = {"pid": 9, "process_started_us": 5, "process_name": "java", "recording": {"events": [event("jdk.TLSHandshake", "2024-01-02T03:04:05.123456789+02:00", peerHost="h", peerPort=70000, protocolVersion="TLSv1.3", cipherSuite="C"), event("jdk.X509Certificate", "2024-01-02T03:04:05Z", certificateId=12), event("jdk.X509Certificate", "2024-01-02T03:04:05Z", certificateId=12), event("jdk.GC", "never"), event("jdk.X509Validation", "2024-01-02T03:04:05.5-00:30")]}}
    docs = {"good": good, "late": good | {"process_started_us": -1}, "text": good | {"process_started_us": "5"}, "time": {"pid": 1, "recording": {"events": [event("jdk.TLSHandshake", "2024-01-02T03:04:05.1")]}}, "none": {"pid": 1}, "name": good | {"process_name": "x" * 257}, "bare": {"recording": {"events": []}}}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    parsed = intake.recordings(intake.report_files(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 1)[-1][:-5]: r.reason for r in parsed.select("path", "reason").collect()} == {"good": None, "bare": None, "late": "invalid process lifetime", "text": "invalid process lifetime", "time": "invalid event time", "none": "no events", "name": "process identity exceeds the field limits"}
    rows = sorted((r.kind, r.timestamp_us, r.peer, r.port, r.certificate_id, r.pid, r.result) for r in intake.recorded_events(parsed).collect())
    base = 1704164645000000
    assert rows == [("jdk.TLSHandshake", base + 123456 - 7200 * 10**6, "h", 65535, "", 9, "Endpoint reported TLS handshake"), ("jdk.X509Certificate", base, "", 0, "12", 9, "JDK parsed certificate"), ("jdk.X509Validation", base + 500000 + 1800 * 10**6, "", 0, "", 9, "JDK validation-chain event")]


def test_policies_round_trip(spark, tmp_path):
    own = [p for p in POLICIES if not p.fingerprints] + [Policy("Prints", "SSH", fingerprints=("a" * 64,))]
    (tmp_path / "p.xml").write_text(policies.policy_xml(own))
    found, mark = policies.load_policies(spark, str(tmp_path / "p.xml"))
    assert found == own and mark == policies.fingerprint(own) and mark != policies.fingerprint(own[1:])
    (tmp_path / "d.xml").write_text('<c><policies><policy name="D"/></policies></c>')
    assert policies.load_policies(spark, str(tmp_path / "d.xml"))[0] == [Policy("D", pq_key_exchange=True, standardized_group=True, completion=True)]


@pytest.mark.parametrize("text,reason", [
    ('<c><policies><policy name="a" speed="1"/></policies></c>', "unknown setting speed"), ('<c><policies><policy name="a"><more/></policy></policies></c>', "more than settings"), ('<c><policies><policy name="a">text</policy></policies></c>', "more than settings"),
    ('<c><policies kind="x"><policy name="a"/></policies></c>', "one policies section"), ('<c><policies><policy name="a"/><rule/></policies></c>', "one policies section"), ("<c><other/></c>", "one policies section"), ('<c><policies><policy name="a"/></policies><policies><policy name="b"/></policies></c>', "one policies section"),
    ('<c><policies><policy name="a"/><policy name="A"/></policies></c>', "unique"), ('<c><policies><policy name="a" minimumTls="5"/></policies></c>', "bound"), ('<c><policies><policy name="a" minimumTls="x"/></policies></c>', "can't be"), ('<c><policies><policy name="a" enabled="maybe"/></policies></c>', "can't be"),
    ('<c><policies><policy name="a" allowedGroups="29,70000"/></policies></c>', "can't be"), ('<c><policies><policy name="a" protocol="Ftp"/></policies></c>', "unsupported protocol"), ('<c><policies><policy name="a" protocol="Smb" minimumSmbDialect="5"/></policies></c>', "dialect"), ('<c><policies><policy name="a" protocol="Ssh" allowedSshHostKeyFingerprints="3F"/></policies></c>', "fingerprints"),
    ('<c><policies><policy name="a" computer=" "/></policies></c>', "scopes"), ("<c><policies>" + "".join(f'<policy name="p{i}"/>' for i in range(129)) + "</policies></c>", "128"), ("<c><policies>" + " " * (256 * 1024) + '<policy name="a"/></policies></c>', "256 KiB"),
])
def test_policy_files_that_are_refused(spark, tmp_path, text, reason):
    (tmp_path / "p.xml").write_text(text)
    with pytest.raises(policies.PolicyFileRefused, match=reason):
        policies.load_policies(spark, str(tmp_path / "p.xml"))
