"""Details of handwritten observations: properties by protocol, damaged documents, times out of range, hellos in wire order."""

import json

import pytest

from hslake.operators.details import CATALOGUE, STORED, details, properties, snake, stages

COLUMNS = {"id": 1, "flow_id": 1, "run_id": "r", "first_us": 1_000_000, "ended_us": None, "source_address": "10.0.0.1", "source_port": 1, "destination_address": "10.0.0.2", "destination_port": 443, "source_pid": None, "destination_pid": 7, "hello_latency_us": None}
TEXTS = sorted({c for c in STORED.values()} - set(COLUMNS) - {"source", "destination"})


def wide(spark, *docs, **more):
    rows = [COLUMNS | {c: "" for c in TEXTS} | more | {"id": k, "detail_json": d if isinstance(d, str) or d is None else json.dumps(d)} for k, d in enumerate(docs)]
    schema = ", ".join(f"{c} {'long' if c in COLUMNS and c != 'run_id' and not c.endswith('address') else 'string'}" for c in rows[0])
    return details(spark.createDataFrame([tuple(r.values()) for r in rows], schema))


def test_catalogue():
    names = [n for n, _, _ in CATALOGUE]
    assert len(set(names)) == len(names) and len({snake(n) for n in names}) == len(names)


def test_values(spark):
    report = {"provider": "A", "peer_verified": 1, "selected_alpn": "h2"}
    doc = {"ems_selected": 0, "compression_method": 0, "client_hello_us": 1_500_000, "server_hello_us": 253402300800000000, "retry_us": 0, "quic_version": 1798521807, "offered_alpn": ["h2", "h3"], "endpoint_confirmations": [report, {"provider": "A"}, report], "negotiation_stages": [{}, {}], "evidence_source": "packet"}
    full, damaged, missing = wide(spark, doc, '{"a":', None, tls_name="TLS 1.2", source_account_sid="S-1").orderBy("id").collect()
    assert (full.ems, full.compression, full.quic_version, full.offered_alpn) == ("Not present", "None", "v2", "h2, h3")
    assert (full.client_hello, full.server_hello, full.retry_time) == ("1970-01-01 00:00:01.500 +00:00", "Invalid timestamp", "Not observed")
    assert (full.endpoint_provider, full.endpoint_peer_verification, full.evidence) == ("A", "Reported verified, Not reported", "packet + endpoint adapter")
    assert (full.negotiation_stages, full.client_owner, full.peer) == ("2", "S-1 (name unavailable)", "10.0.0.2:443")
    assert damaged.ems == "Not observed" and damaged.observed_protocol == "TLS" and damaged[2:] == missing[2:]


def test_sealed_in_tls13(spark):
    row = wide(spark, {"handshake_signature": "x", "ems_selected": 1, "selected_alpn": "h2"}, tls_name="TLS 1.3").first()
    assert (row.signature, row.ems, row.renegotiation, row.selected_alpn) == ("Encrypted", "Not applicable", "Not applicable", "Encrypted")


@pytest.mark.parametrize("protocol,has,lacks", [
    ("TLS", {("Client offers", "Cipher suites"), ("Server selection", "Cipher suite")}, {"DTLS", "SSH", "QUIC", "Raw classification", "Raw endpoint"}),
    ("SSH", {("SSH negotiation", "Cipher"), ("Authentication", "Host-key algorithm"), ("SSH", "SSH visibility")}, {"Client offers", "Extensions", "DTLS", "Server selection"}),
    ("HTTP", {("HTTP", "Protection")}, {"Authentication", "Server selection", "Certificates"}),
    ("Unknown", {("Raw endpoint", "Reported key bits"), ("Raw classification", "Sample bytes")}, {"PQC evidence", "SSH"}),
])
def test_properties_by_protocol(spark, protocol, has, lacks):
    rows = properties(wide(spark, {"protocol": protocol, "ssh_selection_evidence": "both"}, key_exchange="kex")).collect()
    assert has <= {(r.category, r.caption) for r in rows} and not lacks & {r.category for r in rows}
    assert all(r.value for r in rows)
    if protocol == "SSH":
        assert [(r.value, r.evidence) for r in rows if r.caption == "Key exchange"] == [("kex", "both")]


def test_quic_needs_the_transport(spark):
    rows = properties(wide(spark, {"transport": "QUIC"}, {"transport": "TCP"})).where("category = 'QUIC'").collect()
    assert {r.id for r in rows} == {0} and len(rows) == 8


def test_stages(spark):
    hello = {"type": "ClientHello", "ordinal": 0, "cipher_ids": [4865, 460929], "group_ids": [], "cipher_id": 1, "key_shares": [{"group_id": 29, "bytes": 32}]}
    docs = [json.dumps({"negotiation_stages": s}) for s in ([hello, {"type": "ServerHello", "cipher_id": 4865, "cipher_ids": [1]}], [], "none")] + ["{", None]
    a, b = stages(spark.createDataFrame(list(enumerate(docs)), "id long, detail_json string")).orderBy("position").collect()
    assert (a.position, a.ciphers, a.groups, a.selected_cipher, a.key_shares, a.ech, a.versions) == (0, "0x1301, 0x070881", "None", None, "0x001D (32 bytes)", False, None)
    assert (b.position, b.ciphers, b.selected_cipher, b.ech, b.key_shares) == (1, None, "0x1301", None, None)
