"""Details of an observation: the wide row of everything recorded, the same as properties with category and evidence, and its retained hellos in wire order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hslake.functions import text as T
from hslake.plans.registry import query

#: Name, caption and category of each property, in the order in which they are shown.
CATALOGUE = [
    ("Peer", "Server / peer", "Connection"), ("Transport", "Transport", "Connection"), ("QuicVersion", "QUIC version", "QUIC"), ("QuicOriginalId", "Original destination ID", "QUIC"),
    ("QuicClientId", "Client source ID", "QUIC"), ("QuicServerId", "Server source ID", "QUIC"), ("QuicRetry", "QUIC Retry", "QUIC"), ("QuicVisibility", "QUIC visibility", "QUIC"),
    ("QuicPathEvidence", "Path association evidence", "QUIC"), ("QuicPathsDropped", "Unretained paths", "QUIC"), ("DtlsCookie", "Cookie exchange", "DTLS"), ("DtlsVisibility", "DTLS visibility", "DTLS"),
    ("EndpointProvider", "Endpoint provider", "Endpoint authentication"), ("EndpointSignature", "Peer endpoint signature", "Endpoint authentication"),
    ("EndpointLocalSignature", "Local endpoint signature", "Endpoint authentication"), ("EndpointLocalAuthClass", "Local endpoint authentication class", "Endpoint authentication"),
    ("EndpointAuthClass", "Endpoint authentication class", "Endpoint authentication"), ("EndpointAlpn", "Endpoint selected ALPN", "Endpoint authentication"),
    ("EndpointPeerVerification", "Endpoint peer verification", "Endpoint authentication"), ("Time", "Observed", "Connection"), ("Sni", "SNI", "Connection"), ("Destination", "Destination", "Connection"),
    ("Tls", "Protocol", "Connection"), ("Cipher", "Cipher suite", "Server selection"), ("Group", "Key-exchange group", "Server selection"), ("GroupClass", "Key classification", "Server selection"),
    ("Process", "Local process", "Processes"), ("Computer", "Collector computer", "Connection"), ("ClientOwner", "Client owner", "Processes"), ("ServerOwner", "Server owner", "Processes"),
    ("State", "Observed messages", "Evidence"), ("SshSelectionEvidence", "Selection evidence", "SSH"), ("SshVisibility", "SSH visibility", "SSH"), ("Classification", "Classification", "Raw classification"),
    ("SampleBytes", "Sample bytes", "Raw classification"), ("SampleEntropy", "Entropy (bits/byte)", "Raw classification"), ("SampleDirection", "Sample direction", "Raw classification"),
    ("ClassificationLimit", "Classification limits", "Raw classification"), ("EndpointRawAlgorithm", "Reported encryption algorithm", "Raw endpoint"), ("EndpointRawMode", "Reported encryption mode", "Raw endpoint"),
    ("EndpointRawKeyBits", "Reported key bits", "Raw endpoint"), ("Source", "Source", "Connection"), ("GroupStatus", "Group registry status", "PQC evidence"), ("GroupComponents", "Group components", "PQC evidence"),
    ("GroupReference", "Group specification", "PQC evidence"), ("ClassificationRules", "Classification rule version", "PQC evidence"), ("NegotiationStages", "Retained hello stages", "PQC evidence"),
    ("NegotiationDropped", "Unretained hello stages", "PQC evidence"), ("NegotiationTruncated", "Stage history truncated", "PQC evidence"), ("KeyExchange", "Key exchange", "Server selection"),
    ("Encryption", "Encryption algorithm", "Server selection"), ("Mode", "Encryption mode", "Server selection"), ("KeyBits", "Symmetric key bits", "Server selection"), ("Hash", "Cipher suite hash", "Server selection"),
    ("RecordMac", "Record protection", "Server selection"), ("PrfHash", "Legacy PRF", "Server selection"), ("HkdfHash", "HKDF / transcript hash", "Server selection"),
    ("Authentication", "Authentication selection", "Authentication"), ("Signature", "Server handshake signature", "Authentication"), ("ClientSignature", "Client handshake signature", "Authentication"),
    ("ClientAuth", "Client certificate authentication", "Authentication"), ("Certificate", "Server certificate SHA-256", "Certificates"), ("CertificateVisibility", "Certificate visibility", "Certificates"),
    ("Psk", "PSK selection", "Session behavior"), ("PskIndex", "Selected PSK index", "Session behavior"), ("PskOffers", "Visible PSK offers", "Session behavior"), ("PskModes", "Offered PSK modes", "Client offers"),
    ("Resumption", "Resumption evidence", "Session behavior"), ("EarlyData", "Early data offered", "Session behavior"), ("EarlyAccepted", "Early data acceptance", "Session behavior"),
    ("Ems", "Extended master secret selected", "Extensions"), ("EmsOffered", "Extended master secret offered", "Client offers"), ("Renegotiation", "Secure renegotiation", "Extensions"),
    ("Ticket", "Session ticket offered", "Client offers"), ("Compression", "TLS compression", "Server selection"), ("Downgrade", "Downgrade sentinel", "Extensions"),
    ("OfferedGroups", "Supported groups", "Client offers"), ("OfferedKeyShares", "Key shares", "Client offers"), ("OfferedSignatures", "Signature algorithms", "Client offers"),
    ("OfferedCertificateSignatures", "Certificate signature algorithms", "Client offers"), ("OfferedCiphers", "Cipher suites", "Client offers"), ("OfferedVersions", "Protocol versions", "Client offers"),
    ("OfferedAlpn", "ALPN offers", "Client offers"), ("SelectedAlpn", "Selected ALPN", "Server selection"), ("ClientExtensions", "Client extension IDs", "Extensions"), ("ServerExtensions", "Server extension IDs", "Extensions"),
    ("Ech", "ECH indication", "Evidence"), ("Visibility", "ClientHello visibility", "Evidence"), ("Confirmation", "Endpoint result", "Evidence"), ("Evidence", "Evidence source", "Evidence"),
    ("DhBits", "DH parameter bits", "Server selection"), ("ClientHello", "ClientHello observed", "Timing"), ("ServerHello", "ServerHello observed", "Timing"), ("HelloLatency", "CH–SH interval", "Timing"),
    ("Retry", "HelloRetryRequest", "Timing"), ("RetryTime", "Retry observed", "Timing"), ("RetryGroup", "Retry requested group", "Timing"), ("Alert", "Plaintext alert", "Diagnostics"),
    ("AlertLevel", "Alert level", "Diagnostics"), ("AlertSide", "Alert sender", "Diagnostics"), ("AlertTime", "Alert observed", "Timing"), ("Ended", "Last lifecycle observation", "Timing"),
    ("Termination", "Connection termination", "Diagnostics"), ("SourcePid", "Client PID", "Processes"), ("ProcessPath", "Client executable", "Processes"), ("ClientAccount", "Client account name", "Processes"),
    ("ClientDomain", "Client account domain", "Processes"), ("ClientSid", "Client account SID", "Processes"), ("ProcessEvidence", "Client attribution evidence", "Processes"), ("DestinationPid", "Server PID", "Processes"),
    ("ServerProcess", "Server process", "Processes"), ("ServerPath", "Server executable", "Processes"), ("ServerAccount", "Server account name", "Processes"), ("ServerDomain", "Server account domain", "Processes"),
    ("ServerSid", "Server account SID", "Processes"), ("ServerProcessEvidence", "Server attribution evidence", "Processes"), ("Note", "Capture note", "Diagnostics"), ("Run", "Capture session", "Evidence"), ("Flow", "Flow ID", "Evidence"),
]
#: What a property rests on, for those that say so.
RESTS_ON = {
    "Peer": "Observed server name, or destination address when a name is unavailable.",
    "GroupClass": "Selected key-exchange group classification; does not assess authentication or handshake success.",
    "Computer": "Computer running the collector. For imported captures, this is the importing computer.",
    "ClientOwner": "Primary process token user as DOMAIN\\account; applies only to an attributed local process.",
    "ServerOwner": "Primary process token user as DOMAIN\\account; applies only to an attributed local process.",
    "State": "Observed protocol messages or a bounded statistical classification; authentication is not implied.",
    "GroupStatus": "Standardization status of the selected group, independent of its cryptographic classification.",
    "ClassificationRules": "Collector rules used to classify this observation's selected group.",
    "NegotiationTruncated": "Whether the collector's bounded history omitted stages; No does not establish complete packet capture.",
    "KeyExchange": "TLS 1.2 cipher-suite family or TLS 1.3 visible key-share/PSK selection; resumption can reuse earlier secrets.",
    "KeyBits": "Algorithm key length, not an overall security-strength estimate.",
    "Confirmation": "Endpoint-reported outcomes matched to socket, process lifetime, timing, and selected parameters.",
    "HelloLatency": "Time between observed complete ClientHello and ServerHello; not full handshake duration.",
}

#: How a property is read. Members of the document: as they are, lists joined, three-valued flags, true or not, times, hidden by encryption in TLS 1.3.
PLAIN = {
    "QuicOriginalId": "quic_original_dcid", "QuicClientId": "quic_client_scid", "QuicServerId": "quic_server_scid", "QuicVisibility": "quic_visibility", "QuicPathEvidence": "quic_path_evidence", "QuicPathsDropped": "quic_paths_dropped",
    "DtlsVisibility": "dtls_visibility", "SshSelectionEvidence": "ssh_selection_evidence", "SshVisibility": "ssh_visibility", "Classification": "classification", "SampleBytes": "sample_bytes", "SampleDirection": "sample_direction",
    "ClassificationLimit": "classification_limit", "GroupClass": "group_class", "GroupStatus": "group_standardization", "GroupReference": "group_reference", "ClassificationRules": "classification_rule_version",
    "NegotiationDropped": "negotiation_stages_dropped", "Mode": "encryption_mode", "KeyBits": "key_bits", "Hash": "hash_name", "RecordMac": "record_mac", "PrfHash": "prf_hash", "HkdfHash": "hkdf_hash", "ClientAuth": "client_authentication",
    "CertificateVisibility": "certificate_visibility", "PskIndex": "selected_psk_index", "PskOffers": "psk_offers", "Resumption": "resumption", "EarlyAccepted": "early_data_accepted", "Downgrade": "downgrade_marker",
    "Visibility": "client_hello_visibility", "Confirmation": "handshake_confirmation", "DhBits": "dh_parameter_bits", "RetryGroup": "retry_group", "AlertSide": "alert_sender", "ProcessEvidence": "source_evidence",
    "ServerPath": "destination_path", "ServerProcessEvidence": "destination_evidence", "Note": "detail",
}
LISTS = {
    "GroupComponents": "group_components", "PskModes": "offered_psk_modes", "OfferedGroups": "offered_groups", "OfferedKeyShares": "offered_key_shares", "OfferedSignatures": "offered_signatures",
    "OfferedCertificateSignatures": "offered_certificate_signatures", "OfferedCiphers": "offered_ciphers", "OfferedVersions": "offered_versions", "OfferedAlpn": "offered_alpn", "ClientExtensions": "client_extensions", "ServerExtensions": "server_extensions",
}
FLAGS = {"EarlyData": "early_data_offered", "EmsOffered": "ems_offered", "Ticket": "session_ticket_offered", "Ems": "ems_selected", "Renegotiation": "secure_renegotiation"}
SEEN = {"QuicRetry": "quic_retry", "DtlsCookie": "dtls_cookie_exchange", "Retry": "retry_seen"}
TIMES = {"ClientHello": "client_hello_us", "ServerHello": "server_hello_us", "RetryTime": "retry_us", "AlertTime": "alert_us"}
SEALED = {"Signature": "handshake_signature", "ClientSignature": "client_handshake_signature", "SelectedAlpn": "selected_alpn"}
REPORTED = {
    "EndpointProvider": "provider", "EndpointSignature": "handshake_signature", "EndpointRawAlgorithm": "algorithm", "EndpointRawMode": "mode", "EndpointRawKeyBits": "key_bits", "EndpointAuthClass": "authentication_class",
    "EndpointLocalSignature": "local_handshake_signature", "EndpointLocalAuthClass": "local_authentication_class", "EndpointAlpn": "selected_alpn",
}
STORED = {
    "Sni": "sni", "Destination": "destination", "Source": "source", "Tls": "tls_name", "Cipher": "cipher_name", "Group": "group_name", "Process": "source_process", "Computer": "computer_name", "State": "state", "KeyExchange": "key_exchange",
    "Encryption": "encryption", "Authentication": "authentication", "Certificate": "certificate_sha256", "Psk": "psk_mode", "HelloLatency": "hello_latency_us", "Alert": "alert", "Termination": "close_reason", "SourcePid": "source_pid",
    "ProcessPath": "source_path", "ClientAccount": "source_account", "ClientDomain": "source_account_domain", "ClientSid": "source_account_sid", "DestinationPid": "destination_pid", "ServerProcess": "destination_process",
    "ServerAccount": "destination_account", "ServerDomain": "destination_account_domain", "ServerSid": "destination_account_sid", "Run": "run_id", "Flow": "flow_id",
}
OTHER = {"transport", "protocol", "quic_version", "sample_entropy", "http_host", "negotiation_stages", "negotiation_history_truncated", "compression_method", "evidence_source", "alert_level", "endpoint_confirmations", "ech_offered"}
MEMBERS = sorted(OTHER | {m for d in (PLAIN, LISTS, FLAGS, SEEN, TIMES, SEALED) for m in d.values()})
FIRST_TIME, LAST_TIME = -62135596800000000, 253402300799999999


def snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def _values(doc) -> dict[str, str]:
    """The SQL of each property's value, '' where nothing is recorded. ``doc`` writes what the two dialects say differently."""
    m, listed, when, reported = doc["member"], doc["list"], doc["time"], doc["reported"]
    sealed = "tls_name in ('TLS 1.3', 'DTLS 1.3')"
    flag = lambda k: f"case when {m(k)} in ('1', 'true') then 'Observed' when {m(k)} in ('0', 'false') then 'Not present' else 'Not observed' end"
    owner = lambda s: f"case when {s}_account <> '' then case when {s}_account_domain = '' then {s}_account else concat({s}_account_domain, {doc['backslash']}, {s}_account) end when {s}_account_sid <> '' then concat({s}_account_sid, ' (name unavailable)') else '' end"
    value = {n: m(k) for n, k in PLAIN.items()} | {n: listed(k) for n, k in LISTS.items()} | {n: flag(k) for n, k in FLAGS.items()}
    value |= {n: f"case when {sealed} then 'Not applicable' else {flag(FLAGS[n])} end" for n in ("Ems", "Renegotiation")}
    value |= {n: f"case when {m(k)} in ('1', 'true') then 'Observed' else 'Not observed' end" for n, k in SEEN.items()}
    value |= {n: when(f"try_cast({m(k)} as bigint)") for n, k in TIMES.items()}
    value |= {n: f"case when {sealed} then 'Encrypted' else {m(k)} end" for n, k in SEALED.items()}
    value |= {n: reported(k) for n, k in REPORTED.items()}
    value |= {n: f"coalesce({doc['text'](c)}, '')" for n, c in STORED.items()}
    return value | {
        "Transport": f"coalesce(nullif({m('transport')}, ''), 'TCP')",
        "QuicVersion": f"case {m('quic_version')} when '1' then 'v1' when '1798521807' then 'v2' else {m('quic_version')} end",
        "EndpointPeerVerification": doc["verification"],
        "Time": when("first_us"),
        "Ended": when("ended_us"),
        "Peer": f"case when sni <> '' then sni when {m('protocol')} = 'HTTP' and {m('http_host')} <> '' then {m('http_host')} else destination end",
        "SampleEntropy": doc["decimal"](m("sample_entropy")),
        "NegotiationStages": doc["stages"],
        "NegotiationTruncated": f"case {m('negotiation_history_truncated')} when 'true' then 'Yes' when 'false' then 'No' else 'Not recorded' end",
        "ClientOwner": owner("source"),
        "ServerOwner": owner("destination"),
        "Compression": f"case {m('compression_method')} when '0' then 'None' else {m('compression_method')} end",
        "Ech": f"case when {m('ech_offered')} in ('1', 'true') then 'Outer hello; ECH offered / possibly GREASE' else 'Not observed' end",
        "Evidence": f"concat({m('evidence_source')}, case when {doc['any_report']} then ' + endpoint adapter' else '' end)",
        "AlertLevel": f"case {m('alert_level')} when '1' then 'Warning' when '2' then 'Fatal' else '' end",
    }


def _time(text: str):
    return lambda e: f"case when coalesce({e}, 0) = 0 then 'Not observed' when {e} not between {FIRST_TIME} and {LAST_TIME} then 'Invalid timestamp' else {text.format(e)} end"


_SPARK = {
    "member": lambda k: f"coalesce(v['{k}'], '')",
    "list": lambda k: f"coalesce(array_join(from_json(v['{k}'], 'array<string>'), ', '), '')",
    "time": _time("concat(date_format(to_utc_timestamp(timestamp_micros({0}), current_timezone()), 'yyyy-MM-dd HH:mm:ss.SSS'), ' +00:00')"),
    "reported": lambda k: f"array_join(array_distinct(filter(transform(reports, r -> coalesce(r['{k}'], '')), x -> x <> '')), ', ')",
    "verification": "array_join(array_distinct(transform(reports, r -> case coalesce(r['peer_verified'], '') when '1' then 'Reported verified' when '0' then 'Reported unverified' else 'Not reported' end)), ', ')",
    "any_report": "size(reports) > 0",
    "stages": "coalesce(cast(size(from_json(nullif(v['negotiation_stages'], ''), 'array<string>')) as string), '')",
    "decimal": lambda e: f"coalesce(cast(cast(try_cast({e} as double) as decimal(18, 3)) as string), '')",
    "text": lambda c: f"cast({c} as string)",
    "backslash": "'\\\\'",
}
_at = {k: i + 1 for i, k in enumerate(MEMBERS)}
_first = lambda e: f"list_transform(list_filter(list_transform({e}, lambda x, i: {{'x': x, 'i': i}}), lambda p: list_position({e}, p.x) = p.i), lambda p: p.x)"
_DUCK = {
    "member": lambda k: f"coalesce(v[{_at[k]}], '')",
    "list": lambda k: f"coalesce(array_to_string(cast(nullif(v[{_at[k]}], '') as varchar[]), ', '), '')",
    "time": _time("concat(strftime(make_timestamp({0}), '%Y-%m-%d %H:%M:%S.%g'), ' +00:00')"),
    "reported": lambda k: f"array_to_string({_first(f"list_filter(list_transform(reports, lambda r: coalesce(json_extract_string(r, '$.{k}'), '')), lambda x: x <> '')")}, ', ')",
    "verification": f"array_to_string({_first("list_transform(reports, lambda r: case coalesce(json_extract_string(r, '$.peer_verified'), '') when '1' then 'Reported verified' when '0' then 'Reported unverified' else 'Not reported' end)")}, ', ')",
    "any_report": "len(reports) > 0",
    "stages": f"coalesce(cast(json_array_length(nullif(v[{_at['negotiation_stages']}], '')) as varchar), '')",
    "decimal": lambda e: f"coalesce(cast(cast(try_cast({e} as double) as decimal(18, 3)) as varchar), '')",
    "text": lambda c: f"cast({c} as varchar)",
    "backslash": "chr(92)",
}
_SAFE = "case when json_valid(detail_json) then detail_json end"
_paths = ", ".join(f"'$.{k}'" for k in MEMBERS)
_OPENED = f"""(select d.*, s.computer_name, concat(source_address, ':', source_port) as source, concat(destination_address, ':', destination_port) as destination, coalesce(json_extract_string({_SAFE}, [{_paths}]), []) as v,
  coalesce(cast(json_extract({_SAFE}, '$.endpoint_confirmations') as json[]), []) as reports from detailed d join sessions s on s.id = d.run_id)"""
_WIDE = "select id, coalesce(nullif(" + _DUCK["member"]("protocol") + ", ''), 'TLS') as observed_protocol, " + ", ".join(f"{_values(_DUCK)[n]} as {snake(n)}" for n, _, _ in CATALOGUE) + f" from {_OPENED} o"


def details(rows: DataFrame) -> DataFrame:
    """Everything recorded of each connection: one text column for each catalogued property, '' where nothing is recorded, and the observed protocol.

    ``rows`` has the connections' columns, ``computer_name`` and ``detail_json``; a damaged document reads as an empty one. The document is parsed once a row.
    """
    doc = F.coalesce(F.from_json(T.safe_object("detail_json"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    opened = rows.withColumn("v", doc).withColumn("reports", F.expr("coalesce(from_json(nullif(v['endpoint_confirmations'], ''), 'array<map<string,string>>'), cast(array() as array<map<string,string>>))"))
    opened = opened.withColumn("source", F.concat_ws(":", "source_address", "source_port")).withColumn("destination", F.concat_ws(":", "destination_address", "destination_port"))
    value = _values(_SPARK)
    return opened.select("id", F.expr("coalesce(nullif(v['protocol'], ''), 'TLS')").alias("observed_protocol"), *[F.expr(value[n]).alias(snake(n)) for n, _, _ in CATALOGUE])


def detailed(j) -> DataFrame:
    return j.detailed.join(F.broadcast(j.sessions.select(F.col("id").alias("run_id"), "computer_name")), "run_id")


@query("connection_detail", _WIDE)
def connection_detail(j):
    return details(detailed(j))


#: Which categories and properties only some protocols have.
TLS_CATEGORIES = ["QUIC", "PQC evidence", "Client offers", "Session behavior", "Extensions", "Certificates", "Endpoint authentication"]
TLS_NAMES = ["ClientHello", "ServerHello", "HelloLatency", "Retry", "RetryTime", "RetryGroup", "Alert", "AlertLevel", "AlertSide", "AlertTime", "Signature", "ClientSignature", "ClientAuth", "Compression", "Visibility", "PrfHash", "HkdfHash", "Ech", "SelectedAlpn", "Hash"]
ONLY = {"Raw classification": "Unknown", "Raw endpoint": "Unknown", "DTLS": "DTLS", "SSH": "SSH"}


def _property(name: str, caption: str, category: str) -> tuple[str, str, str, str]:
    """(whether a row has the property, category, caption, evidence) as conditions over the wide row."""
    p, tests = "observed_protocol", []
    if category in TLS_CATEGORIES or name in TLS_NAMES:
        tests.append(f"{p} in ('TLS', 'DTLS')")
    if category in ONLY:
        tests.append(f"{p} = '{ONLY[category]}'")
    if category == "QUIC":
        tests.append("transport = 'QUIC'")
    if name == "Sni" or category == "Authentication" or category == "Server selection" and name != "Encryption":
        tests.append(f"{p} <> 'HTTP'")
    shown = f"'{category}'"
    if category == "Server selection":
        shown = f"case when {p} = 'SSH' then 'SSH negotiation'" + (f" when {p} = 'HTTP' then 'HTTP'" if name == "Encryption" else "") + f" else {shown} end"
    special = {"Cipher": ("SSH", "Cipher"), "Authentication": ("SSH", "Host-key algorithm"), "Encryption": ("HTTP", "Protection")}
    said = f"case when {p} = '{special[name][0]}' then '{special[name][1]}' else '{caption}' end" if name in special else f"'{caption}'"
    words = RESTS_ON.get(name, "").replace("'", "''")
    return " and ".join(tests) or "true", shown, said, f"'{words}'"


def property_lists(wide: DataFrame) -> DataFrame:
    """(id, observed_protocol, ps): the list of (category, caption, value, evidence) of the properties that the protocol of each wide row has, in their order; one unobserved says so."""
    made = []
    for name, caption, category in CATALOGUE:
        test, shown, said, words = _property(name, caption, category)
        text = _literal(words)
        evidence = F.when(F.col("observed_protocol") == "SSH", F.col("ssh_selection_evidence")).otherwise(text) if name == "KeyExchange" else text
        value = F.coalesce(T.nonempty(snake(name)), F.lit("Not observed"))
        made.append(F.when(F.expr(test), F.struct(F.expr(shown).alias("category"), F.expr(said).alias("caption"), value.alias("value"), evidence.alias("evidence"))))
    return wide.select("id", "observed_protocol", F.array_compact(F.array(*made)).alias("ps"))


def properties(wide: DataFrame) -> DataFrame:
    """The lists as rows: (id, observed_protocol, category, caption, value, evidence).

    A list always has entries. A plain explode would let the optimizer push a test of its size, and with it the whole list and its documents' parsing, below the join.
    """
    return property_lists(wide).select("id", "observed_protocol", F.explode_outer("ps").alias("p")).select("id", "observed_protocol", "p.*")


def _literal(quoted: str) -> Column:
    return F.lit(quoted[1:-1].replace("''", "'"))


def _long_sql() -> str:
    rows = []
    for name, caption, category in CATALOGUE:
        test, shown, said, words = _property(name, caption, category)
        evidence = f"case when observed_protocol = 'SSH' then ssh_selection_evidence else {words} end" if name == "KeyExchange" else words
        rows.append(f"case when {test} then {{'category': {shown}, 'caption': {said}, 'value': coalesce(nullif(w.{snake(name)}, ''), 'Not observed'), 'evidence': {evidence}}} end")
    return f"(select id, observed_protocol, list_filter([{', '.join(rows)}], lambda p: p is not null) as ps from ({_WIDE}) w)"


@query("properties_long", f"select id, len(ps) as n, len(list_filter(ps, lambda p: p.value <> 'Not observed')) as observed, sha256(array_to_string(list_transform(ps, lambda p: concat(p.category, '|', p.caption, '|', p.value, '|', p.evidence)), chr(10))) as properties_sha256 from {_long_sql()} l")
def properties_long(j):
    """The properties of every connection, in order: how many, how many observed, and the digest of their lines (a connection has about a hundred)."""
    lines = F.transform("ps", lambda p: F.concat_ws("|", p["category"], p["caption"], p["value"], p["evidence"]))
    seen = F.filter("ps", lambda p: p["value"] != "Not observed")
    rows = property_lists(details(detailed(j)))
    return rows.select("id", F.size("ps").cast("long").alias("n"), F.size(seen).cast("long").alias("observed"), F.sha2(F.array_join(lines, "\n"), 256).alias("properties_sha256"))


@query("property_profile", f"select observed_protocol, p.category as category, p.caption as caption, count(*) as n, count(*) filter (where p.value <> 'Not observed') as observed from (select observed_protocol, unnest(ps) as p from {_long_sql()} l) x group by 1, 2, 3")
def property_profile(j):
    """How often each property is shown and observed by protocol."""
    return profile(details(detailed(j)))


def profile(wide: DataFrame) -> DataFrame:
    """Counts of the properties of wide rows by protocol, category and caption.

    Whether a row has a property and which value is told by the row alone, category and caption by the protocol: so each property is counted where it stands, and only the counts become rows.
    """
    tests = {name: _property(name, caption, category) for name, caption, category in CATALOGUE}
    seen = lambda n: T.nonempty(snake(n)).isNotNull() & (F.col(snake(n)) != "Not observed")
    counts = [F.struct(F.count_if(F.expr(test)).alias("n"), F.count_if(F.expr(test) & seen(name)).alias("observed")).alias(f"c_{name}") for name, (test, *_) in tests.items()]
    summed = wide.groupBy("observed_protocol").agg(*counts)
    rows = F.array(*[F.struct(F.expr(shown).alias("category"), F.expr(said).alias("caption"), f"c_{name}.n", f"c_{name}.observed") for name, (_, shown, said, _) in tests.items()])
    rows = summed.select("observed_protocol", F.explode(rows).alias("p")).select("observed_protocol", "p.*").where("n > 0")
    return rows.groupBy("observed_protocol", "category", "caption").agg(F.sum("n").alias("n"), F.sum("observed").alias("observed"))


STAGES = "array<struct<type: string, ordinal: int, timestamp_us: bigint, handshake_bytes: bigint, legacy_version: int, extension_ids: array<bigint>, sni: string, ech_offered: boolean, alpn: array<string>, offered_version_ids: array<bigint>, cipher_ids: array<bigint>, group_ids: array<bigint>, signature_ids: array<bigint>, selected_version: int, cipher_id: bigint, selected_group_id: int, key_shares: array<struct<group_id: int, bytes: bigint>>>>"
IDS = {"extensions": "extension_ids", "versions": "offered_version_ids", "ciphers": "cipher_ids", "groups": "group_ids", "signatures": "signature_ids"}
ONE = {"legacy_version": "legacy_version", "selected_version": "selected_version", "selected_cipher": "cipher_id", "selected_group": "selected_group_id"}


def stages(rows: DataFrame) -> DataFrame:
    """One row for each retained hello of (id, detail_json) in wire order: offers of a client's hello, selections of the others, key shares of both. An empty list is None, a missing one null."""
    hexed = lambda e: f"case when {e} > 65535 then printf('0x%06X', {e}) else printf('0x%04X', {e}) end"
    listed = lambda c: F.expr(f"case when size({c}) = 0 then 'None' when {c} is not null then array_join(transform({c}, x -> {hexed('x')}), ', ') end")
    doc = F.coalesce(F.from_json(T.json_value("detail_json", "negotiation_stages"), STAGES), F.array())
    s = rows.select("id", F.posexplode(doc).alias("position", "s")).select("id", F.col("position").cast("long").alias("position"), "s.*")
    client = F.col("type") == "ClientHello"
    offers = [(F.when(client, listed(c)) if n != "extensions" else listed(c)).alias(n) for n, c in IDS.items()]
    chosen = [(F.when(~client, F.expr(f"case when {c} is not null then {hexed(c)} end")) if n != "legacy_version" else F.expr(f"case when {c} is not null then {hexed(c)} end")).alias(n) for n, c in ONE.items()]
    shares = F.expr("case when size(key_shares) = 0 then 'None' when key_shares is not null then array_join(transform(key_shares, k -> concat(printf('0x%04X', k.group_id), ' (', k.bytes, ' bytes)')), ', ') end")
    return s.select("id", "position", "ordinal", "type", "timestamp_us", "handshake_bytes", F.when(client, F.col("sni")).alias("sni"), F.when(client, F.coalesce("ech_offered", F.lit(False))).alias("ech"), F.when(client, F.array_join("alpn", ", ")).alias("alpn"), *offers, *chosen, shares.alias("key_shares"))


def _stages_sql() -> str:
    hexed = lambda e: f"case when {e} > 65535 then printf('0x%06X', {e}) else printf('0x%04X', {e}) end"
    listed = lambda c: f"case when len({c}) = 0 then 'None' when {c} is not null then array_to_string(list_transform({c}, lambda x: {hexed('x')}), ', ') end"
    client = "type = 'ClientHello'"
    offers = [f"{listed(c) if n == 'extensions' else f'case when {client} then {listed(c)} end'} as {n}" for n, c in IDS.items()]
    one = lambda c: f"case when {c} is not null then {hexed(c)} end"
    chosen = [f"{one(c) if n == 'legacy_version' else f'case when not {client} then {one(c)} end'} as {n}" for n, c in ONE.items()]
    shares = "case when len(shares) = 0 then 'None' when shares is not null then array_to_string(list_transform(shares, lambda k: concat(printf('0x%04X', cast(json_extract(k, '$.group_id') as int)), ' (', json_extract_string(k, '$.bytes'), ' bytes)')), ', ') end as key_shares"
    read = [f"cast(json_extract(s, '$.{c}') as bigint[]) as {c}" for c in IDS.values()] + [f"cast(json_extract_string(s, '$.{c}') as bigint) as {c}" for c in [*ONE.values(), "timestamp_us", "handshake_bytes"]]
    read += ["cast(json_extract_string(s, '$.ordinal') as int) as ordinal", "json_extract_string(s, '$.type') as type", "json_extract_string(s, '$.sni') as sni", "cast(json_extract_string(s, '$.ech_offered') as boolean) as ech_offered", "cast(json_extract(s, '$.alpn') as varchar[]) as alpn", "cast(json_extract(s, '$.key_shares') as json[]) as shares"]
    rows = f"(select id, p as position, {', '.join(read)} from (select id, unnest(ss) as s, unnest(range(len(ss))) as p from (select id, cast(json_extract({_SAFE}, '$.negotiation_stages') as json[]) as ss from detailed) a where len(ss) > 0) b)"
    return f"select id, position, ordinal, type, timestamp_us, handshake_bytes, case when {client} then sni end as sni, case when {client} then coalesce(ech_offered, false) end as ech, case when {client} then array_to_string(alpn, ', ') end as alpn, {', '.join(offers)}, {', '.join(chosen)}, {shares} from {rows} c"


@query("negotiation_stages", _stages_sql())
def negotiation_stages(j):
    return stages(j.detailed.select("id", "detail_json"))
