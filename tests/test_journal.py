import json

import pytest
from checking import assert_same
from pyspark.sql import functions as F

from hslake.functions import text as T
from hslake.functions.scope import Scope
from hslake.operators.evidence import decoded
from hslake.operators.http import decode_bodies, jwt_tokens, payload_entropy, saml_fields
from hslake.operators.policy import Policy, evaluate
from hslake.plans import registry
from hslake.sources.journal import load_journal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, name):
    assert_same(spark, SF, registry.queries()[name], registry.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


#: Expected outcomes of the ten evidence cases: key class, server authentication, completion, peer verification.
CASES = {
    0: ("Classical", "Not observed", "Not confirmed", "Not reported"), 1: ("Hybrid post-quantum", "Post-quantum", "Completed", "Verified"), 2: ("Hybrid post-quantum", "Classical", "Completed", "Verified"),
    3: ("Post-quantum", "Not observed", "Failed", "Not reported"), 4: ("Unknown", "Unknown", "Completed", "Not reported"), 5: ("PSK only", "PSK selected", "Completed", "Verified"),
    6: ("Hybrid post-quantum", "Post-quantum", "Conflicting", "Verified"), 7: ("Hybrid post-quantum", "Post-quantum", "Completed", "Verified"), 8: ("Classical", "Classical", "Not confirmed", "Not reported"),
    9: ("Not observed", "Not observed", "Not confirmed", "Not reported"),
}


def test_evidence_cases(spark):
    j = load_journal(spark, SF)
    rows = decoded(j).join(j.connections.select("id", "case_id"), "id").where("error = '' and id % 7928 >= 0 and case_id <= 9 and not crypto_json like '%QUIC\",\"group_class\":\"Classical\"}'")
    seen = {(r.case_id, r.key_class, r.server_auth, r.completion, r.peer_verification) for r in rows.select("case_id", "key_class", "server_auth", "completion", "peer_verification").distinct().collect()}
    assert seen == {(k, *v) for k, v in CASES.items()}


def test_json_rules(spark):
    docs = ['{"a":1,"a":2,"b":"x"}', '{"a":"1"}', "[1]", "{", None, '{"a":70000}', '{"a":5}']
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    got = df.select(T.json_scalar_bigint("d", "a", 0, 65535).alias("n"), T.json_scalar_text("d", "b").alias("t"), T.safe_object("d").alias("s")).collect()
    assert [r.n for r in got] == [None, None, None, None, None, None, 5]
    assert [r.t for r in got] == ["x", None, None, None, None, None, None]
    assert [r.s is None for r in got] == [False, False, True, True, True, False, False]


def test_scope_limits():
    with pytest.raises(AssertionError):
        Scope(page_size=10)
    with pytest.raises(AssertionError):
        Scope(conditions=(("Provider", "equals", "x"),))
    with pytest.raises(AssertionError):
        Scope(from_us=5, to_us=1)
    s = Scope(conditions=(("Group", "equals", "X25519"),), search="a")
    assert Scope.from_json(s.to_json()) == s
    with pytest.raises(AssertionError):
        Scope.from_json(json.dumps({"colour": 1}))


def test_policy_limits():
    with pytest.raises(AssertionError):
        Policy("x", "FTP")
    with pytest.raises(AssertionError):
        Policy("")


def test_bodies(spark):
    import os
    import zlib

    raw = b"hello " * 100
    gz = zlib.compressobj(wbits=31)
    rows = [(1, "gzip", gz.compress(raw) + gz.flush()), (2, "deflate", zlib.compress(raw)), (3, "gzip", b"broken"), (4, None, None), (5, "identity", os.urandom(8192))]
    df = spark.createDataFrame(rows, "id int, encoding string, body binary").withColumn("id", F.col("id").cast("long"))
    assert {r.id: r.decoded_bytes for r in decode_bodies(df).collect()} == {1: 600, 2: 600, 3: None, 4: 0, 5: 8192}
    noise = os.urandom(8192)
    packed = spark.createDataFrame([(6, b"\x1f\x8b" + noise), (7, b"PK\x03\x04" + noise), (8, b"\x89PNG" + noise), (9, b"\x01" + noise)], "id long, body binary")
    assert [r.id for r in payload_entropy(df.select("id", "body").union(packed)).where("possible_encryption").orderBy("id").collect()] == [5, 9]


def test_jwt(spark):
    import base64

    enc = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    token = f"{enc({'alg': 'HS256'})}.{enc({'iss': 'lab', 'exp': 1700000000})}.c2ln"
    odd = f"{enc({'alg': 'RS256'})}.{enc({'exp': 'soon'})}."
    df = spark.createDataFrame([(1, f"a {token} b {token}"), (2, "none"), (3, None), (4, "eyJhb.eyJ_w.x"), (5, odd)], "id int, text string")
    assert sorted(map(tuple, jwt_tokens(df).collect())) == [(1, "HS256", "lab", 1700000000), (4, None, None, None), (5, "RS256", None, None)]


def test_saml(spark):
    import base64
    from urllib.parse import quote

    form = lambda x: "a=b&SAMLResponse=" + quote(base64.b64encode(x).decode(), safe="")
    whole = b'<p:Response><Issuer>lab</Issuer><p:StatusCode Value="urn:x:Success"/><NameID>\xc3\xa9</NameID><Signature/></p:Response>'
    rows = [(1, form(whole)), (2, form(b"<Issuer>cut")), (3, form(b"\xff\xfe")), (4, "SAMLResponse=%zz"), (5, "XSAMLResponse=QQ=="), (6, ""), (7, None)]
    got = {r.id: tuple(r)[1:] for r in saml_fields(spark.createDataFrame(rows, "id int, form string")).collect()}
    assert got == {1: ("lab", "Success", "\u00e9", None, True), 2: (None, None, None, None, False), 3: (None,) * 5, 4: (None,) * 5}


def test_tunnel_and_directory_policies(spark):
    rows = [
        (1, "WireGuard", {"encryption": "chacha20-poly1305", "key_exchange": "x25519", "symmetric_key_bits": 256}), (2, "WireGuard", {"encryption": "none"}),
        (3, "OpenVPN", {"vpn_data_cipher": "AES-256-GCM", "openvpn_tls_version": "TLS 1.3", "openvpn_tls": {"selected_cipher": "A"}, "vpn_authentication": "Verified"}), (4, "OpenVPN", {"vpn_data_cipher": "AES-256-GCM", "openvpn_tls_version": "TLS 1.0", "vpn_authentication": "Failed"}), (5, "OpenVPN", {}),
        (6, "LDAP", {"ldap_session_protection": "Sealed"}), (7, "LDAP", {"ldap_session_protection": "None"}), (8, "LDAP", {}),
    ]
    df = spark.createDataFrame([(i, p, json.dumps(d), "HOST", 1, "", "app", "svc", "", "10.0.0.1") for i, p, d in rows], "id long, tls_name string, crypto_json string, computer_name string, first_us long, error string, source_process string, destination_process string, sni string, destination_address string")
    policies = [Policy("w", "WireGuard", ciphers=("chacha20-poly1305",), kex=("x25519",), minimum_bits=256), Policy("o", "OpenVPN", ciphers=("AES-256-GCM",), vpn_authentication=True, control_ciphers=("A",)), Policy("l", "LDAP", sasl_protection=True)]
    got = {r.id: r.status for r in evaluate(df, policies).collect()}
    assert got == {1: "Pass", 2: "Violation", 3: "Pass", 4: "Violation", 5: "Insufficient evidence", 6: "Pass", 7: "Violation", 8: "Insufficient evidence"}


def test_export_order_numbers_every_row_over_ranges(spark):
    from hslake.operators.investigation import numbered

    rows = [(i * 7919 % 3000, i * 31 % 40) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t long")
    for size in (64, 1 << 18):
        got = {(r.t, r.id): r.n for r in numbered(df, "t", rows_a_range=size).collect()}
        assert got == {(t, i): n for n, (t, i) in enumerate(sorted((t, i) for i, t in rows), 1)}
