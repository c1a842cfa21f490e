"""The journal of observed network-cryptography evidence, derived from the tables of a folder.

One SQL text describes every journal table; Spark runs it over views of the folder's Parquet tables, and the checking SQL puts it in front
as common table expressions. Macros between @ signs stand for what the two dialects write differently.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hslake.sources.shared import kept, shared_folder, stamp

NOW_US = 996624000000000
BASELINE_US = 893980800000000


def _report(role: str, success: bool, peer_class: str = "", verified: int = -1, peer_id: int = -1, local_class: str = "", local_id: int = -1) -> dict:
    r = {"event_id": f"r-{role}-{success}".lower(), "local_role": role, "success": success, "peer_verified": verified}
    if peer_id >= 0:
        r |= {"handshake_signature_id": peer_id, "authentication_class": peer_class}
    if local_id >= 0:
        r |= {"local_handshake_signature_id": local_id, "local_authentication_class": local_class}
    return r


def _profile(group: int | None, kind: str, status: str, reports: list[dict], **more) -> dict:
    base = {"transport": "TCP", "group_class": kind, "group_standardization": status, "classification_rule_version": "1", "evidence_source": "packet"}
    if group is not None:
        base["selected_group_id"] = group
    return base | more | ({"endpoint_confirmations": reports} if reports else {})


HYBRID = (4588, "Hybrid post-quantum", "Standardized")
#: The evidence of each case: ten TLS ones, then SSH, SMB, HTTP, IKEv2, LDAP, WireGuard and OpenVPN. Names and values as the data model records them (fixed values).
EVIDENCE: dict[int, dict] = {
    0: _profile(29, "Classical", "Assigned", []),
    1: _profile(*HYBRID, [_report("Client", True, "Post-quantum", 1, 2308)]),
    2: _profile(*HYBRID, [_report("Client", True, "Classical", 1, 2052)]),
    3: _profile(512, "Post-quantum", "Draft", [_report("Client", False, verified=1)]),
    4: _profile(65025, "Unknown", "Private use", [_report("Client", True, "Unknown", -1, 65001)]),
    5: _profile(None, "", "", [_report("Client", True, verified=1)], selected_psk_index=0),
    6: _profile(*HYBRID, [_report("Client", True, "Post-quantum", 1, 2308), _report("Client", False)]),
    7: _profile(*HYBRID, [_report("Server", True, "Post-quantum", 1, 2309, "Post-quantum", 2308)], transport="QUIC"),
    8: _profile(23, "Classical", "Assigned", [], handshake_signature="rsa_pss_rsae_sha256"),
    9: _profile(None, "", "", []),
    10: {"transport": "TCP", "ssh_selection": {"key_exchange": "sntrup761x25519-sha512", "host_key": "ssh-ed25519", "cipher_c2s": "aes256-gcm@openssh.com", "cipher_s2c": "aes256-gcm@openssh.com", "mac_c2s": "", "mac_s2c": ""}, "ssh_host_key_bits": 256},
    11: {"transport": "TCP", "ssh_selection": {"key_exchange": "diffie-hellman-group1-sha1", "host_key": "ssh-rsa", "cipher_c2s": "3des-cbc", "cipher_s2c": "3des-cbc", "mac_c2s": "hmac-md5", "mac_s2c": "hmac-md5"}, "ssh_host_key_bits": 1024},
    12: {"transport": "TCP", "smb_selected_dialect": 785, "smb_server_signing_required": True, "smb_signed_message_observed": True, "smb_encrypted_transform_observed": True, "smb_selected_cipher": [2], "smb_selected_signing_algorithm": [2]},
    13: {"transport": "TCP", "smb_selected_dialect": 514, "smb_server_signing_required": False, "smb_selected_cipher": [1, 2], "ntlm_authenticate": {"nt_response": "NTLMv1", "lm_response": "LM"}},
    14: {"transport": "TCP", "http_host": "www.example.test", "http_hosts": ["www.example.test", "API.example.test"]},
    15: {"transport": "UDP", "encryption": "aes-gcm-16", "key_exchange": "curve25519", "symmetric_key_bits": 256},
    16: {"transport": "TCP", "ldap_session_protection": "None", "ldap_plaintext_password": True, "krb_ticket": {"encryption": "rc4-hmac"}},
    17: {"transport": "UDP", "encryption": "chacha20-poly1305", "key_exchange": "x25519", "symmetric_key_bits": 256},
    18: {"transport": "UDP", "vpn_data_cipher": "AES-256-GCM", "openvpn_tls_version": "TLS 1.1", "vpn_authentication": "Failed", "openvpn_tls": {"selected_cipher": "TLS_RSA_WITH_RC4_128_SHA"}},
}
DAMAGED, DUPLICATED = '{"transport":"TCP","group_class":', '{"transport":"TCP","transport":"QUIC","group_class":"Classical"}'


def _json(doc: dict) -> str:
    return json.dumps(doc, separators=(",", ":"))


_HELLO = {"type": "ClientHello", "ordinal": 0, "timestamp_us": "FIRST", "handshake_bytes": 517, "legacy_version": 771, "extension_ids": [0, 43, 51, 65281], "sni": "hello.test", "ech_offered": True, "alpn": ["h2", "http/1.1"], "offered_version_ids": [772, 771], "cipher_ids": [4865, 4866, 460929], "group_ids": [4588, 29], "signature_ids": [2308, 1027], "key_shares": [{"group_id": 4588, "bytes": 1216}, {"group_id": 29, "bytes": 32}]}
_RETRY = {"type": "HelloRetryRequest", "ordinal": 1, "timestamp_us": "FIRST", "handshake_bytes": 88, "legacy_version": 771, "extension_ids": [43, 51], "selected_version": 772, "cipher_id": 4866, "selected_group_id": 4588}
_SECOND = _HELLO | {"ordinal": 2, "sni": "", "ech_offered": False, "alpn": [], "key_shares": []}
_REPLY = {"type": "ServerHello", "ordinal": 3, "handshake_bytes": 122, "legacy_version": 771, "extension_ids": [], "selected_version": 772, "cipher_id": 4866, "selected_group_id": 4588, "key_shares": [{"group_id": 4588, "bytes": 1120}]}
_OFFERS = {"offered_groups": ["X25519MLKEM768", "X25519"], "offered_key_shares": ["X25519MLKEM768"], "offered_signatures": ["mldsa65", "ecdsa_secp256r1_sha256"], "offered_ciphers": ["TLS_AES_128_GCM_SHA256"], "offered_versions": ["TLS 1.3", "TLS 1.2"], "offered_alpn": ["h2"], "client_extensions": [0, 43], "client_hello_us": "FIRST", "server_hello_us": "LAST", "early_data_offered": 0, "ems_offered": 1, "session_ticket_offered": 1, "psk_offers": 1, "client_hello_visibility": "Complete", "key_bits": 256, "hash_name": "SHA384", "record_mac": "AEAD"}
#: What a case's document holds beside the evidence: hellos in wire order, offers, and the members of QUIC, DTLS, SSH, HTTP and unclassified traffic.
DETAILS: dict[int, dict] = {k: _OFFERS for k in range(9)} | {
    0: _OFFERS | {"negotiation_stages": [_HELLO, _RETRY, _SECOND, _REPLY], "negotiation_stages_dropped": 0, "negotiation_history_truncated": False, "retry_seen": 1, "retry_us": "FIRST", "retry_group": "X25519MLKEM768"},
    1: _OFFERS | {"negotiation_stages": [_HELLO, _REPLY], "negotiation_history_truncated": True, "group_components": ["ML-KEM-768", "X25519"], "group_reference": "RFC 10024", "hkdf_hash": "SHA384"},
    5: _OFFERS | {"offered_psk_modes": ["psk_dhe_ke", "psk_ke"], "resumption": "PSK selected", "early_data_accepted": "Not visible", "early_data_offered": 1, "negotiation_stages": []},
    7: _OFFERS | {"quic_version": 1, "quic_original_dcid": "8394C8F03E515708", "quic_client_scid": "", "quic_server_scid": "F067A5502A4262B5", "quic_retry": True, "quic_paths_dropped": 0},
    8: _OFFERS | {"ems_selected": 0, "secure_renegotiation": 1, "compression_method": 0, "prf_hash": "SHA256", "selected_alpn": "h2", "alert_level": 2, "alert_sender": "Server", "alert_us": "LAST", "dh_parameter_bits": 1024, "client_authentication": "Requested"},
    9: {"protocol": "DTLS", "dtls_cookie_exchange": True, "dtls_visibility": "Fragments joined", "ech_offered": True, "client_hello_us": 253402300800000000, "alert_level": 1},
    10: {"protocol": "SSH", "ssh_selection_evidence": "Both key-exchange messages", "ssh_visibility": "Complete"}, 11: {"protocol": "SSH"}, 12: {"protocol": "SMB"}, 13: {"protocol": "SMB"}, 14: {"protocol": "HTTP"}, 15: {"protocol": "IKEv2"}, 16: {"protocol": "LDAP", "detail": "first packets missing"},
    17: {"protocol": "Unknown", "classification": "High entropy", "sample_bytes": 4096, "sample_entropy": 7.9375, "sample_direction": "Client", "endpoint_confirmations": [{"provider": "lab", "algorithm": "AES", "mode": "GCM", "key_bits": 256}, {"provider": "lab", "algorithm": "AES", "mode": "CTR", "peer_verified": 0}]},
    18: {"protocol": "OpenVPN"},
}


_crypto = "case when l_orderkey%997=0 then '" + DAMAGED + "' when l_orderkey%991=0 then '" + DUPLICATED + "' else case (l_partkey+l_linenumber)%19 " + " ".join(f"when {k} then '{_json(v)}'" for k, v in EVIDENCE.items()) + " end end"
_case = "(l_partkey+l_linenumber)%19"
_id = "(l_orderkey*8+l_linenumber)"

TABLES: dict[str, str] = {
    "sessions": """
select concat('run-',@STR(n_nationkey)@) as id, concat('HOST-',n_name) as computer_name,
  788918400000000 + n_nationkey*cast(3600000000 as bigint) as started_us, 996710400000000 + n_nationkey as updated_us,
  case when n_nationkey%5=0 then null else 996710400000000 + n_nationkey end as stopped_us,
  case when n_nationkey%5=0 then 'running' when n_nationkey%7=3 then 'failed: source' else 'stopped' end as status,
  cast(1000*(n_nationkey+1) as bigint) as packets, cast(n_nationkey%3 as bigint) as capture_lost, cast(n_nationkey%2 as bigint) as queue_lost, cast(0 as bigint) as storage_lost,
  cast(n_nationkey%4 as bigint) as process_events_lost, cast(0 as bigint) as telemetry_lost, cast(n_nationkey%6 as bigint) as truncated, cast(n_nationkey%2 as bigint) as flow_limit,
  cast(n_nationkey%3 as bigint) as reassembly_limit, cast(n_nationkey+1 as bigint) as change_revision
from #nation#""",
    "past_sessions": """
select id, started_us, stopped_us, change_revision from sessions
union all select concat('idle-',@STR(r_regionkey)@), 788918400000000 + r_regionkey*cast(34560000000000 as bigint), case when r_regionkey=3 then null else 788918403600000 + r_regionkey*cast(34560000000000 as bigint) end, cast(r_regionkey*12+1 as bigint) from #region#""",
    "lines": """
select l.*, row_number() over (partition by l_orderkey,l_linenumber order by l_shipdate desc,l_partkey desc,l_suppkey desc,l_extendedprice desc,l_quantity desc) as rn from #lineitem# l""",
    "connections": f"""
select {_id} as id, concat('run-',@STR(c_nationkey)@) as run_id, {_id} as flow_id,
  @US(o_orderdate)@ + ({_id}%86400)*1000000 as first_us, @US(o_orderdate)@ + ({_id}%86400)*1000000 + 500 + cast(floor(l_quantity) as bigint)*1000 as last_us,
  concat('10.',@STR(o_custkey%200)@,'.0.',@STR(l_linenumber)@) as source_address, 40000+l_orderkey%20000 as source_port,
  case when l_suppkey%10=0 then '127.0.0.1' else concat('192.0.2.',@STR(l_suppkey%250)@) end as destination_address,
  case when l_suppkey%3=0 then 8443 else 443 end as destination_port, 4 as ip_version,
  case when {_case}<=7 then 772 when {_case}=8 then 771 end as tls_version,
  case when {_case}<=7 then 'TLS 1.3' when {_case}=8 then 'TLS 1.2' when {_case}=9 then '' when {_case}<=11 then 'SSH 2.0' when {_case}<=13 then 'SMB' when {_case}=14 then 'HTTP' when {_case}=15 then 'IKEv2' when {_case}=16 then 'LDAP' when {_case}=17 then 'WireGuard' else 'OpenVPN' end as tls_name,
  case when {_case}<=8 then 'hellos_observed' when {_case}=9 then 'client_hello_only' when {_case}<=11 then 'ssh_kex_selection' when {_case}<=13 then 'smb_negotiation' when {_case}=14 then 'http_observed' when {_case}=15 then 'ike_sa_selection' when {_case}=16 then 'ldap_observed' when {_case}=17 then 'wireguard_observed' else 'openvpn_observed' end as state,
  case when {_case}<=7 then case when l_suppkey%2=0 then 'TLS_AES_256_GCM_SHA384' else 'TLS_CHACHA20_POLY1305_SHA256' end when {_case}=8 then 'TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256' else '' end as cipher_name,
  case when l_suppkey%11=0 then '' else concat('svc-',@STR(l_suppkey%50)@,'.test') end as sni,
  case when o_custkey%6=0 then null else 1000+o_custkey%500 end as source_pid,
  case when o_custkey%6=0 then '' else concat('app-',@STR(o_custkey%20)@,'.exe') end as source_process,
  case when o_custkey%4=0 or o_custkey%6=0 then '' else concat('C:/apps/app-',@STR(o_custkey%20)@,'.exe') end as source_path,
  case when l_suppkey%3=0 then null else 2000+l_suppkey%100 end as destination_pid,
  case when l_suppkey%3=0 then '' else concat('svc-',@STR(l_suppkey%7)@,'.exe') end as destination_process,
  case when {_case}=9 then null else cast(floor(l_extendedprice) as bigint)%50000 end as hello_latency_us,
  case when l_returnflag='R' and l_linestatus='O' then 'handshake_failure' else '' end as alert,
  case when l_linestatus='F' then @US(l_shipdate)@ end as ended_us, case when l_linestatus='F' then 'FIN' else '' end as close_reason,
  case when {_case}=0 then 'X25519' when {_case}=8 then 'secp256r1' when {_case}<=7 and {_case}<>5 then 'X25519MLKEM768' else '' end as group_name,
  case when {_case}=9 then 1 else 0 end as ech_offered, @SHA(concat('cert-',@STR(l_suppkey)@))@ as certificate_sha256, l_suppkey as supplier,
  case when o_custkey%6=0 or o_custkey%7=0 then '' else concat('user',@STR(o_custkey%30)@) end as source_account, case when o_custkey%6=0 or o_custkey%7=0 then '' else 'LAB' end as source_account_domain,
  case when o_custkey%6=0 or o_custkey%7=0 then '' else concat('S-1-5-21-',@STR(o_custkey%30)@) end as source_account_sid,
  case when l_suppkey%3=0 or l_suppkey%4=0 then '' else concat('service',@STR(l_suppkey%9)@) end as destination_account, case when l_suppkey%3=0 or l_suppkey%4=0 then '' else 'SRV' end as destination_account_domain,
  case when l_suppkey%3=0 or l_suppkey%4=0 then '' else concat('S-1-5-22-',@STR(l_suppkey%9)@) end as destination_account_sid,
  case when {_case}=8 then 'ECDHE' when {_case}<=7 and {_case}<>5 then '(EC)DHE' when {_case} in (10,11) then 'SSH exchange' else '' end as key_exchange,
  case when {_case}=8 then 'RSA certificate' when {_case}=5 then 'PSK' when {_case}=10 then 'ssh-ed25519' when {_case}=11 then 'ssh-rsa' else '' end as authentication, case when {_case}=5 then 'psk_dhe_ke' else '' end as psk_mode,
  case when {_case}<=8 then case when l_suppkey%2=0 then 'AES-256-GCM' else 'ChaCha20-Poly1305' end when {_case}=15 then 'aes-gcm-16' when {_case}=17 then 'chacha20-poly1305' else '' end as encryption,
  @IDIV(l_orderkey,256)@+1 as change_revision, {_case} as case_id, {_crypto} as crypto_json
from lines join #orders# on o_orderkey=l_orderkey join #customer# on c_custkey=o_custkey where rn=1""",
    "detailed": "select c.*, case when flow_id%997=0 or flow_id%991=0 then '" + DAMAGED + "' else replace(replace(case case_id " + " ".join(f"when {k} then '{_json(v | DETAILS[k])}'" for k, v in EVIDENCE.items()) + """ end,'"FIRST"',@STR(first_us)@),'"LAST"',@STR(last_us)@) end as detail_json from connections c""",
    "certificates": """
select @SHA(concat('cert-',@STR(s_suppkey)@))@ as sha256, s_suppkey as supplier, concat('CN=svc-',@STR(s_suppkey)@) as subject, concat('CN=CA-',@STR(s_suppkey%5)@) as issuer,
  case when s_suppkey%4=0 then 'Post-quantum' when s_suppkey%4=3 then 'Unknown' else 'Classical' end as public_key_class,
  case when s_suppkey%4=0 then 'Post-quantum' else 'Classical' end as certificate_signature_class, @SHA(concat('key-',@STR(s_suppkey%80)@))@ as spki_sha256,
  @US(timestamp '2000-01-01 00:00:00')@ + s_suppkey*cast(86400000000 as bigint) as not_before_us,
  @US(timestamp '2001-08-01 00:00:00')@ + (s_suppkey-50)*cast(86400000000 as bigint) as not_after_us, s_suppkey%16+1 as change_revision
from #supplier#""",
    "connection_certificates": """
select run_id, flow_id, 'Server' as role, 0 as chain_index, certificate_sha256 as sha256, change_revision from connections where case_id in (1,2,6,7,8)
union all select run_id, flow_id, 'Server' as role, 1 as chain_index, @SHA(concat('cert-',@STR((supplier+1)%(select count(*) from #supplier#))@))@ as sha256, change_revision from connections where case_id=7""",
    "endpoint_events": """
select concat('ev-',@STR(event_id)@) as id, concat('run-',@STR(c_nationkey)@) as run_id, @US(ts)@ as timestamp_us,
  case when user_id%3=0 then 'Adapter A' when user_id%3=1 then 'Adapter B' else 'Schannel' end as provider, event_type as kind,
  case when event_type='error' then 'Endpoint reported failure' else 'Endpoint reported completion' end as result, 1000+user_id%500 as pid,
  concat('svc-',@STR(user_id%50)@,'.test') as peer, 443 as port, case when event_type='view' then 'TLS 1.2' else 'TLS 1.3' end as protocol,
  case when event_id%3=0 then concat('run-',@STR(c_nationkey)@) end as matched_run_id, case when event_id%3=0 then event_id*8+1 end as matched_flow_id,
  case when event_id%2=0 then 'Client' when event_id%5=0 then 'Unknown' else 'Server' end as local_role, event_id%10<>9 as assessed,
  case when event_id%7=0 then @US(ts)@ - 60000000 end as operation_us, @IDIV(event_id,128)@+1 as change_revision
from #events# join #orders# on o_orderkey=event_id join #customer# on c_custkey=o_custkey""",
    "endpoint_certificates": """
select id as event_id, sha256 from endpoint_events join certificates on supplier=pid%(select count(*) from #supplier#) where assessed and kind='purchase'""",
    "exchanges": """
select page_id as id, concat('run-',@STR(page_id%25)@) as run_id, page_id*8+1 as flow_id, 1704067200000000+page_id*1000000 as started_us,
  1704067200000000+page_id*1000000+page_id%7*1000 as request_end_us, case when page_id%11=0 then null else 1704067200000000+page_id*1000000+page_id%7*1000+page_id%13*1500 end as response_start_us,
  1704067200000000+page_id*1000000+40000 as ended_us, concat('10.',@STR(page_id%200)@,'.0.1') as client_address, 40000+page_id%20000 as client_port,
  concat('192.0.2.',@STR(page_id%250)@) as server_address, 443 as server_port, 'GET' as method, regexp_extract(url, '^([a-z]+):', 1) as scheme,
  regexp_extract(url, '://([^/?#]*)', 1) as host, regexp_extract(url, '://[^/?#]*([^#]*)', 1) as target,
  case page_id%5 when 0 then 200 when 1 then 304 when 2 then 404 when 3 then 500 else 200 end as status,
  concat('Content-Type: text/html', chr(10), 'Server: s', @STR(page_id%4)@, chr(10), 'X-Id: ', @STR(page_id)@) as response_headers,
  html as response_body, case when page_id%9=0 then 'encrypted' when page_id%8=0 then 'partial' else 'complete' end as state
from #pages#""",
    "markup": """
select page_id as id, case when page_id%3=0 then html else concat('<form><input type="hidden" name="token" value="',@STR(page_id)@,'"><INPUT value=''a&amp;b &lt;',@STR(page_id%9)@,''' name=''next''><input name=query><input data-name="x" value="name=no > yes" id=i name="odd">',
  case when page_id%4=0 then '<input name=raw value=7 name=last/>' else '' end,'</form>',html) end as body from #pages#""",
    "authorizations": """
select page_id as id, case when page_id%4=3 then '' else concat('Authorization: Bearer ',jwt,chr(10),'Cookie: sid=',jwt) end as text,
  case when page_id%5=0 then null else concat('RelayState=x&SAMLResponse=',replace(replace(replace(@B64(xml)@,'+','%2B'),'/','%2F'),'=','%3D')) end as form
from (select page_id,
  concat(@URL64(concat('{"alg":"',case page_id%3 when 0 then 'HS256' when 1 then 'RS256' else 'none' end,'","typ":"JWT"}'))@,'.',
    @URL64(concat('{"iss":"idp-',@STR(page_id%5)@,'","iat":',@STR(1704067200+page_id)@,case when page_id%7=0 then '' else concat(',"exp":',@STR(1704067500+page_id)@) end,'}'))@,'.c2ln') as jwt,
  concat('<samlp:Response><saml:Issuer>idp-',@STR(page_id%5)@,'</saml:Issuer>',case when page_id%2=0 then '<ds:Signature>x</ds:Signature>' else '' end,
    '<samlp:Status><samlp:StatusCode Value="urn:oasis:names:tc:SAML:2.0:status:',case when page_id%6=1 then 'Requester' else 'Success' end,'"/></samlp:Status>',
    case when page_id%6=1 then '' else concat('<saml:Assertion><saml:Subject><saml:NameID Format="u">user-',@STR(page_id%50)@,'</saml:NameID></saml:Subject><saml:Audience>sp-',@STR(page_id%3)@,'</saml:Audience></saml:Assertion>') end,'</samlp:Response>') as xml
  from #pages#) p""",
    "reports": """
select concat('rep-',@STR(flow_id)@,'-',@STR(copy)@) as report_id, run_id, source_address, source_port, destination_address, destination_port, tls_name as protocol,
  case when flow_id%5=1 then last_us+300000 else first_us end as started_us, case when flow_id%5=1 then last_us+400000 else last_us end as timestamp_us,
  case when flow_id%5=2 then source_pid+1 else source_pid end as pid, flow_id as true_flow
from connections cross join (select 0 as copy union all select 1 as copy) n where source_pid is not null and flow_id%5<=2 and (copy=0 or flow_id%35=0)""",
    "lifetimes": """
select pid, day*cast(86400000000 as bigint)-1000000 as start_us, lead(day*cast(86400000000 as bigint)-1000000) over (partition by pid order by day) as end_us
from (select distinct source_pid as pid, @IDIV(first_us,86400000000)@ as day from connections where source_pid is not null) d""",
    "socket_events": """
select flow_id, source_address, source_port, source_pid as pid, 'open' as kind, first_us-1000 as at_us from connections where source_pid is not null
union all select flow_id, source_address, source_port, source_pid as pid, 'close' as kind, last_us+1000 as at_us from connections where source_pid is not null and flow_id%13<>0
union all select flow_id, source_address, source_port, source_pid+7 as pid, 'open' as kind, first_us-500 as at_us from connections where source_pid is not null and flow_id%17=0""",
    "identified": """
select c.*, case when source_pid is not null then cast(700000000000000 as bigint)+source_pid*1000000+flow_id%2*400 end as source_started_us,
  case when destination_pid%9=0 then null else cast(700000000000000 as bigint)+destination_pid*1000000 end as destination_started_us, case when case_id in (17,18) then 'Unknown' else 'TLS' end as protocol
from connections c""",
    "endpoint_reports": """
select concat('er-',@STR(flow_id)@) as report_id, run_id, case flow_id%4 when 0 then 'exact' when 1 then case when case_id in (17,18) then 'raw' else 'exact' end else 'partial' end as kind, client, flow_id%7<>0 as role_known,
  local_address, local_port, case when flow_id%8 in (3,6) then '' else remote_address end as remote_address, case when flow_id%4>1 and flow_id%10=3 then 0 else remote_port end as remote_port, upper(sni) as peer_name,
  pid, cast(700000000000000 as bigint)+pid*1000000+case when flow_id%11=0 then 5000 else 0 end as process_started_us,
  case when flow_id%31=0 then last_us+300000 else first_us+flow_id%5*40000 end as started_us, case when flow_id%31=0 then last_us+400000 else last_us+flow_id%3*900000 end as timestamp_us,
  case when flow_id%13=0 then 'QUIC' when case_id in (17,18) then 'UDP' else 'TCP' end as transport, case when flow_id%6=0 then 0 else coalesce(tls_version,0) end as version, case when flow_id%8=0 then '' else cipher_name end as cipher_name,
  case when flow_id%17=0 then 23 when case_id=0 then 29 when case_id in (1,2,6,7) then 4588 else -1 end as group_id
from (select *, flow_id%3<>0 or destination_pid is null as client, case when flow_id%3<>0 or destination_pid is null then source_pid else destination_pid end as pid,
  case when flow_id%3<>0 or destination_pid is null then source_address else destination_address end as local_address, case when flow_id%3<>0 or destination_pid is null then source_port else destination_port end as local_port,
  case when flow_id%3<>0 or destination_pid is null then destination_address else source_address end as remote_address, case when flow_id%3<>0 or destination_pid is null then destination_port else source_port end as remote_port
  from connections where source_pid is not null and flow_id%5<=3) c""",
    "http_flows": """
select flow_id*4+k as id, source_address as client_address, source_port as client_port, destination_address as server_address, destination_port as server_port, first_us-k*2000000 as flow_started_us, first_us+k*4000000-5000000 as started_us
from connections cross join (select 0 as k union all select 1 as k union all select 3 as k) n where case_id in (0,14)""",
    "lifespans": """
select pid, start_us, case when pid%5=0 and start_us%7=0 then null else coalesce(end_us, start_us+cast(86400000000 as bigint)*400) end as ended_us, start_us+cast(86400000000 as bigint)*3 as verified_us from lifetimes
union all select pid, start_us+cast(21600000000 as bigint) as start_us, start_us+cast(25200000000 as bigint) as ended_us, start_us+cast(25200000000 as bigint) as verified_us from lifetimes where pid%11=0""",
    "socket_history": """
select source_address, source_port, pid, kind, at_us, case when flow_id%4=0 then 0 else flow_id end as socket_id, flow_id*8+case when kind='close' then 1 when pid%2=0 then 2 else 3 end as seq from socket_events
union all select source_address, source_port, source_pid as pid, 'close' as kind, first_us-2000000 as at_us, 1 as socket_id, flow_id*8+4 as seq from connections where source_pid is not null and flow_id%23=0
union all select source_address, source_port, source_pid as pid, 'open' as kind, first_us+100 as at_us, 2 as socket_id, flow_id*8+5 as seq from connections where source_pid is not null and flow_id%29=0""",
    "changes": """
select l_orderkey*8+l_linenumber as flow_id, l_orderkey, l_linenumber, rn, @US(l_shipdate)@ as at_us, l_suppkey as supplier, case when l_linestatus='F' then @US(l_shipdate)@ end as ended_us,
  case when l_linestatus='F' then 'FIN' else '' end as close_reason, @IDIV(l_orderkey,256)@+1 as change_revision from lines""",
    "raw_bodies": """
select flow_id, source_pid, destination_port, case when flow_id%8=6 then '[1]' else concat('{"schema":"lab.raw/1","provider":"lab","pid":',case when flow_id%8=2 then concat('"',@STR(source_pid)@,'"') else @STR(source_pid)@ end,
  ',"process_started_us":5,"operation_started_us":',@STR(first_us)@,',"timestamp_us":',@STR(last_us)@,',"local":{"address":"',case when flow_id%8=5 then 'localhost' else source_address end,'","port":',@STR(source_port)@,'},"remote":{"address":"',destination_address,
  '","port":',@STR(destination_port)@,'},"role":"client","transport":"',case when flow_id%8=4 then 'QUIC' else 'TCP' end,'","success":true,"algorithm":"AES","mode":"GCM","key_bits":',case when flow_id%8=3 then '0' else '256' end,case when flow_id%8=1 then ',"secret":1' else '' end,'}') end as body
from connections where source_pid is not null""",
    "recorded": """
select id, pid, peer, timestamp_us, iso, bad, concat('{"pid":',@STR(pid)@,',"process_started_us":',case when bad=1 then '-1' else '7' end,',"recording":{"events":[{"type":"jdk.TLSHandshake","values":{"startTime":"',iso,'.123456789+02:00","peerHost":"',peer,'","peerPort":443}},{"type":"jdk.GC","values":{}},{"type":"jdk.X509Validation","values":{"startTime":"',iso,'Z","peerPort":443}}]}}') as body
from (select id, pid, peer, timestamp_us, concat(substr(@STR(ts)@,1,10),'T',substr(@STR(ts)@,12,8)) as iso, case when event_id%9=0 then 1 else 0 end as bad from endpoint_events join #events# on concat('ev-',@STR(event_id)@)=id) e""",
    "endpoint_details": """
select concat('ev-',@STR(event_id)@) as id, event_id as n, case when event_id%9=4 then 1 else 0 end as bad,
  case when event_id%9=4 then '{"tls_version":' else concat('{"tls_version":772,"alpn":["h2","h3"],"xml":"<Event><System>7</System><EventData><Data Name=''User''>u',@STR(event_id)@,'</Data><Channel>A&amp;B</Channel><Empty></Empty></EventData></Event>","last_member":{"a":1}}') end as detail_json from #events#""",
    "endpoint_assessments": """
select concat('ev-',@STR(event_id)@) as id, case when event_id%3=0 then 'TLS_AES_128_GCM_SHA256' else '' end as cipher,
  case when event_id%6=5 then '{"assessment":' else concat('{"assessment":{"process":"tool-',@STR(event_id%8)@,'.exe","path":"D:/tools","server_name":"Api-',@STR(event_id%40)@,'.test","group_name":"',case when event_id%2=0 then 'X25519' else 'secp384r1' end,'","key_exchange":"ECDHE","authentication":"ECDSA-',@STR(event_id%13)@,'","crypto":{"group_class":"Classical","transport":"QUIC-',@STR(event_id%17)@,'"}}}') end as detail_json from #events#""",
    "owner_updates": """
select flow_id, k as seq, last_us + case when flow_id%5=0 then -1 else k*10 end as last_us, flow_id%3<>1 as source_given, flow_id%7=2 and k=1 as source_ambiguous, 3000+flow_id%90+k as source_pid, concat('new-',@STR(flow_id%9)@,'.exe') as source_process, concat('fresh',@STR(flow_id%4)@) as source_account,
  flow_id%4=k as destination_given, flow_id%8=0 as destination_ambiguous, 4000+flow_id%50 as destination_pid, concat('srv-',@STR(flow_id%6)@,'.exe') as destination_process, '' as destination_account
from connections cross join (select 0 as k union all select 1 as k) n where flow_id%6<>5""",
    "health": """
select concat('run-',@STR(user_id%25)@) as run_id, @US(ts)@ as time_us, case when event_type='error' or event_id%97<4 then 'failed: source' else 'running' end as status, cast(case when event_id%41<8 then event_id%3 else 0 end as bigint) as losses, event_id as id from #events#""",
    "consumers": """
select concat('consumer-',@STR(r_regionkey)@) as name, cast(40+r_regionkey*3 as bigint) as acknowledged from #region#""",
}

BASE = "region nation customer supplier orders lineitem events pages".split()
_SPARK = {"STR": "cast({} as string)", "US": "unix_micros(cast({} as timestamp))", "SHA": "upper(sha2({},256))", "IDIV": "({} div {})", "B64": "base64(encode({},'UTF-8'))", "URL64": "replace(translate(base64(encode({},'UTF-8')),'+/','-_'),'=','')"}
_DUCK = {"STR": "cast({} as varchar)", "US": "epoch_us({})", "SHA": "upper(sha256({}))", "IDIV": "({} // {})", "B64": "base64(encode({}))", "URL64": "replace(translate(base64(encode({})),'+/','-_'),'=','')"}


def _render(text: str, macros: dict[str, str]) -> str:
    """Expand @NAME(args)@ from the inside out."""
    found = re.compile(r"@(\w+)\(((?:[^@])*)\)@")
    while m := found.search(text):
        args = [m[2]] if m[1] != "IDIV" else m[2].rsplit(",", 1)
        text = text[: m.start()] + macros[m[1]].format(*args) + text[m.end() :]
    return text


def _needs(text: str, names: list[str]) -> set[str]:
    words = set(re.findall(r"\b\w+\b", text))
    found = {n for n in names if n in words}
    return found | {x for n in found for x in _needs(TABLES[n], [k for k in TABLES if k != n and list(TABLES).index(k) < list(TABLES).index(n)])}


def oracle(body: str) -> str:
    """``body`` with the derivations of the journal tables that it names in front, for the checking engine."""
    need = _needs(body, list(TABLES))
    parts = [f"{n} as ({_render(re.sub(r'#(\w+)#', r'\1', t), _DUCK).strip()})" for n, t in TABLES.items() if n in need]
    body = body.strip()
    if not parts:
        return body
    if body.lower().startswith("with "):
        body, joined = body[5:], ",\n"
        recursive = body.lower().startswith("recursive ")
        return "with " + ("recursive " if recursive else "") + ",\n".join(parts) + joined + (body[10:] if recursive else body)
    return "with " + ",\n".join(parts) + "\n" + body


#: Derived tables that are written once for a folder, and the tables that each comes from.
WRITTEN = {"connections": ["orders", "lineitem", "customer"]}


@dataclass
class Journal:
    """The journal tables of one folder; each is read when first asked for.

    ``connections``, from which most others derive, is written once in the shared folder and found again by the stamp of its input files, so that queries read the
    columns they need and filters reach the files.
    """

    spark: SparkSession
    sf_dir: str

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def written(self, name: str) -> DataFrame:
        mark = stamp(self.spark, [f"{self.sf_dir}/{b}.parquet" for b in WRITTEN[name]])
        return kept(self.spark, shared_folder(self.spark), name, mark, lambda: self.derived(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.written(name) if name in WRITTEN else self.derived(name)

    def derived(self, name: str) -> DataFrame:
        mark = f"{zlib.crc32(self.sf_dir.encode()):08x}"
        order = list(TABLES)
        need = {name} | self._needs_of(name)
        text = ""
        for n in (k for k in order if k in need):
            if n in WRITTEN and n != name:
                self.written(n).createOrReplaceTempView(f"{n}_{mark}")
                text += ("," if text else "") + f"{n} as (select * from {n}_{mark})"
                continue
            body = TABLES[n]
            for b in re.findall(r"#(\w+)#", body):
                self.base(b).createOrReplaceTempView(f"{b}_{mark}")
            body = re.sub(r"#(\w+)#", rf"\1_{mark}", body)
            if n == name:
                return self.spark.sql((f"with {text} " if text else "") + _render(body, _SPARK))
            text += ("," if text else "") + f"{n} as ({_render(body, _SPARK)})"
        raise AttributeError(name)

    def _needs_of(self, name: str) -> set[str]:
        """The tables that ``name`` is derived from, those behind a written one left out."""
        order, found = list(TABLES), set()
        words = set(re.findall(r"\b\w+\b", TABLES[name]))
        for n in order[: order.index(name)]:
            if n in words:
                found |= {n} | (set() if n in WRITTEN else self._needs_of(n))
        return found


#: Spark's setting for the largest generated method, its default, and HotSpot's bound: a longer method is never compiled and runs many times slower. Wide projections of long cases pass it.
METHOD_LIMIT, DEFAULT_LIMIT, COMPILED_LIMIT = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"


def load_journal(spark: SparkSession, sf_dir: str) -> Journal:
    if spark.conf.get(METHOD_LIMIT) == DEFAULT_LIMIT:
        spark.conf.set(METHOD_LIMIT, COMPILED_LIMIT)
    return Journal(spark, sf_dir)
