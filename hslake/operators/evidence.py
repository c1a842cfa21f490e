"""Evidence decoding: one row per connection with the classes, outcomes and gaps that its recorded evidence supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hslake.functions import text as T
from hslake.functions.nested import by_document
from hslake.operators.certificates import FACTS, cert_facts
from hslake.operators.investigation import FLOWS, SAFE, flows
from hslake.plans.registry import query
from hslake.sources.journal import Journal

REPORT = "struct<event_id:string,local_role:string,success:string,peer_verified:int,handshake_signature_id:int,authentication_class:string,local_handshake_signature_id:int,local_authentication_class:string>"
PROFILE = f"transport string, selected_group_id int, group_class string, group_standardization string, classification_rule_version string, selected_psk_index string, handshake_signature string, evidence_source string, endpoint_confirmations array<{REPORT}>"


def classify(values: Column) -> Column:
    """One class for a set of classes."""
    seen = F.array_distinct(values)
    odd = F.exists(seen, lambda v: ~v.isin("Classical", "Post-quantum"))
    return F.when(F.size(seen) == 0, "Not observed").when(odd, "Unknown").when(F.size(seen) > 1, "Mixed classical/PQ").otherwise(seen[0])


def _role_classes(role: str, other: str) -> Column:
    """Authentication classes of one side, from successful reports of either role."""
    ok = F.filter("p.endpoint_confirmations", lambda r: r["success"].isin("true", "True", "1") & r["local_role"].isin("Client", "Server"))
    peer = F.transform(F.filter(ok, lambda r: (r["local_role"] == other) & (r["handshake_signature_id"] >= 0)), lambda r: F.coalesce(r["authentication_class"], F.lit("")))
    own = F.transform(F.filter(ok, lambda r: (r["local_role"] == role) & (r["local_handshake_signature_id"] >= 0)), lambda r: F.coalesce(r["local_authentication_class"], F.lit("")))
    return F.coalesce(F.concat(peer, own), F.array().cast("array<string>"))


def signature_class(name: Column) -> Column:
    """Class of a recorded TLS 1.2 signature name."""
    lower = F.lower(name)
    return F.when(F.startswith(lower, F.lit("mldsa")) | F.startswith(lower, F.lit("slhdsa")), "Post-quantum").when(F.rlike(lower, F.lit("rsa|ecdsa|ed25519|ed448|dsa")), "Classical").otherwise("Unknown")


def recorded(rows: DataFrame, members: str | None = None) -> DataFrame:
    """``rows`` with what their documents alone tell, and of these the ``members`` as ``e``."""
    names = rows.columns
    rows = rows.withColumn("safe", T.safe_object("crypto_json"))
    rows = rows.withColumn("p", F.from_json("safe", PROFILE)).withColumn("error", F.when(F.col("safe").isNull() & (F.col("crypto_json") != ""), "Cryptographic evidence is unavailable").otherwise(""))
    text = lambda f: F.coalesce(F.col(f"p.{f}"), F.lit(""))
    outcome = lambda *v: F.exists(F.coalesce("p.endpoint_confirmations", F.array().cast(f"array<{REPORT}>")), lambda r: r["success"].isin(*v))
    ok, bad = outcome("true", "True", "1"), outcome("false", "False", "0")
    checks = F.transform(F.filter(F.coalesce("p.endpoint_confirmations", F.array().cast(f"array<{REPORT}>")), lambda r: r["success"].isin("true", "True", "1") | (r["peer_verified"] == 0)), lambda r: F.coalesce(r["peer_verified"], F.lit(-1)))
    has = lambda v: F.array_contains(checks, v)
    key_class = F.when(~text("group_class").isin("", "Not observed"), text("group_class")).when(text("selected_psk_index") != "", "PSK only").otherwise("Not observed")
    more = [F.from_json("safe", members).alias("e")] if members else []
    return rows.select(
        *names, "error", F.coalesce(T.nonempty(text("transport")), F.lit("TCP")).alias("transport"), F.coalesce("p.selected_group_id", F.lit(-1)).alias("group_id"), text("group_standardization").alias("group_status"),
        F.coalesce(T.nonempty(text("classification_rule_version")), F.lit("Not recorded")).alias("rule_version"), F.coalesce(T.nonempty(text("evidence_source")), F.lit("Packet")).alias("evidence_source"), key_class.alias("key_class"),
        _role_classes("Server", "Client").alias("_server"), text("handshake_signature").alias("_signature"), (~text("selected_psk_index").isin("", "-1", "null")).alias("_psk"), classify(_role_classes("Client", "Server")).alias("client_auth"),
        F.when(ok & bad, "Conflicting").when(ok, "Completed").when(bad, "Failed").otherwise("Not confirmed").alias("completion"),
        F.when(has(1) & has(0), "Conflicting").when(has(0), "Unverified").when(has(1) & F.forall(checks, lambda v: v == 1), "Verified").otherwise("Not reported").alias("peer_verification"), *more,
    )


def decoded(j: Journal, members: str | None = None) -> DataFrame:
    """Classes and outcomes of every connection; damaged evidence gives a row of unknowns with its error. The ``members`` of the document, if any are asked for, are in ``e``."""
    rows = by_document(flows(j), "crypto_json", lambda df: recorded(df, members)).join(cert_facts(j), ["run_id", "flow_id"], "left")
    named = F.when((F.col("tls_version") < 772) & (F.col("_signature") != ""), F.array(signature_class(F.col("_signature")))).otherwise(F.array().cast("array<string>"))
    server = F.concat("_server", named)
    facts = F.when(F.coalesce("facts", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split("facts", ",")))
    mine = F.filter(facts, lambda f: F.startswith(f, F.lit("server|")))
    part = lambda i: F.transform(mine, lambda f: F.split(f, r"\|")[i])
    out = rows.select(
        "id", "run_id", "flow_id", "computer_name", "source_process", "destination_process", "destination_address", "destination_port", "source_path", "sni", "first_us", "last_us", "tls_version", "tls_name", "ech_offered", "error", "crypto_json",
        "transport", "group_id", "group_status", "rule_version", "evidence_source", "key_class", F.when((F.size(server) == 0) & F.col("_psk"), "PSK selected").otherwise(classify(server)).alias("server_auth"), "client_auth",
        "completion", "peer_verification", classify(part(2)).alias("chain_signatures"), classify(part(1)).alias("certificate_keys"), *(["e"] if members else []),
    )
    gaps = [
        (F.col("key_class").isin("Unknown", "Not observed", "PSK only"), F.lit("Key establishment is unknown or PSK provenance is unavailable")),
        (F.col("server_auth").isin("Unknown", "Not observed", "PSK selected"), F.when(F.col("tls_version") == 772, "Server authentication requires endpoint evidence").otherwise("Server authentication was not established from observed messages")),
        (F.col("chain_signatures").isin("Unknown", "Not observed"), F.lit("Server certificate signature evidence is absent or unsupported")),
        (F.col("completion") == "Not confirmed", F.lit("Handshake completion requires endpoint evidence")),
        (F.col("ech_offered") != 0, F.lit("ECH may conceal the actual server name")),
    ]
    return out.withColumn("missing", F.filter(F.array(*[F.when(t, m) for t, m in gaps]), lambda m: m.isNotNull()))


_R = f"unnest(cast(json_extract({SAFE}, '$.endpoint_confirmations') as json[]))"
DECODED = f"""(with r as (select flow_id, {_R} as r from connections), x as (select flow_id, json_extract_string(r, '$.success') = 'true' as ok, json_extract_string(r, '$.local_role') as role,
  coalesce(cast(json_extract_string(r, '$.peer_verified') as int), -1) as v, cast(json_extract_string(r, '$.handshake_signature_id') as int) as hs, json_extract_string(r, '$.authentication_class') as ac,
  cast(json_extract_string(r, '$.local_handshake_signature_id') as int) as lhs, json_extract_string(r, '$.local_authentication_class') as lac from r),
 a as (select flow_id, bool_or(ok) as ok, bool_or(not ok) as bad, coalesce(bool_or(v = 1) filter (where ok or v = 0), false) as v1, coalesce(bool_or(v = 0) filter (where ok or v = 0), false) as v0, coalesce(bool_and(v = 1) filter (where ok or v = 0), true) as vall,
  list_distinct(list(ac) filter (where ok and role = 'Client' and hs >= 0) || coalesce(list(lac) filter (where ok and role = 'Server' and lhs >= 0), [])) as s1, list_distinct(coalesce(list(ac) filter (where ok and role = 'Client' and hs >= 0), []) || coalesce(list(lac) filter (where ok and role = 'Server' and lhs >= 0), [])) as server,
  list_distinct(coalesce(list(ac) filter (where ok and role = 'Server' and hs >= 0), []) || coalesce(list(lac) filter (where ok and role = 'Client' and lhs >= 0), [])) as client from x group by 1),
 f as (select run_id, flow_id, list_distinct(list(public_key_class)) as ks, list_distinct(list(certificate_signature_class)) as ss from connection_certificates l join certificates c on c.sha256 = l.sha256 group by 1, 2),
 b as (select c.*, coalesce(json_extract_string({SAFE}, '$.group_class'), '') as gc, coalesce(json_extract_string({SAFE}, '$.selected_psk_index'), '') as psk, coalesce(json_extract_string({SAFE}, '$.handshake_signature'), '') as hsn from {FLOWS} c),
 g as (select b.*, a.ok, a.bad, v1, v0, vall, list_distinct(coalesce(server, []) || case when tls_version < 772 and hsn <> '' then ['Classical'] else [] end) as server, coalesce(client, []) as client, coalesce(ks, []) as ks, coalesce(ss, []) as ss from b left join a on a.flow_id = b.flow_id left join f on f.run_id = b.run_id and f.flow_id = b.flow_id),
 d as (select id, run_id, flow_id, computer_name, source_process, destination_process, destination_address, destination_port, source_path, sni, first_us, last_us, tls_version, tls_name, ech_offered, crypto_json, case when json_valid(crypto_json) then '' else 'Cryptographic evidence is unavailable' end as error, coalesce(list_last(regexp_extract_all({SAFE}, '"transport":"([^"]*)"', 1)), 'TCP') as transport,
  coalesce(cast(json_extract_string({SAFE}, '$.selected_group_id') as int), -1) as group_id, coalesce(json_extract_string({SAFE}, '$.group_standardization'), '') as group_status, coalesce(json_extract_string({SAFE}, '$.classification_rule_version'), 'Not recorded') as rule_version,
  coalesce(json_extract_string({SAFE}, '$.evidence_source'), 'Packet') as evidence_source, case when gc not in ('', 'Not observed') then gc when psk <> '' then 'PSK only' else 'Not observed' end as key_class,
  case when len(server) = 0 and psk not in ('', '-1') then 'PSK selected' else @CL(server)@ end as server_auth, @CL(client)@ as client_auth,
  case when ok and bad then 'Conflicting' when ok then 'Completed' when bad then 'Failed' else 'Not confirmed' end as completion,
  case when v1 and v0 then 'Conflicting' when v0 then 'Unverified' when v1 and vall then 'Verified' else 'Not reported' end as peer_verification, @CL(ss)@ as chain_signatures, @CL(ks)@ as certificate_keys from g)
 select *, [m for m in [case when key_class in ('Unknown', 'Not observed', 'PSK only') then 'Key establishment is unknown or PSK provenance is unavailable' end,
  case when server_auth in ('Unknown', 'Not observed', 'PSK selected') then case when tls_version = 772 then 'Server authentication requires endpoint evidence' else 'Server authentication was not established from observed messages' end end,
  case when chain_signatures in ('Unknown', 'Not observed') then 'Server certificate signature evidence is absent or unsupported' end, case when completion = 'Not confirmed' then 'Handshake completion requires endpoint evidence' end,
  case when ech_offered <> 0 then 'ECH may conceal the actual server name' end] if m is not null] as missing from d)"""
for _name in ("server", "client", "ss", "ks"):
    DECODED = DECODED.replace(f"@CL({_name})@", f"case when len({_name}) = 0 then 'Not observed' when len(list_filter({_name}, lambda v: v not in ('Classical', 'Post-quantum'))) > 0 then 'Unknown' when len({_name}) > 1 then 'Mixed classical/PQ' else {_name}[1] end")

CLASSES = ["key_class", "server_auth", "client_auth", "completion", "peer_verification", "chain_signatures", "certificate_keys"]


@query("evidence_decode", f"select id, transport, group_id, group_status, rule_version, evidence_source, {', '.join(CLASSES)} from {DECODED} d")
def evidence_decode(j):
    return decoded(j).select("id", "transport", "group_id", "group_status", "rule_version", "evidence_source", *CLASSES)


@query("evidence_error", f"select id, error from {DECODED} d where error <> ''")
def evidence_error(j):
    return decoded(j).where("error <> ''").select("id", "error")


@query("missing_evidence", f"select id, missing from {DECODED} d")
def missing_evidence(j):
    return decoded(j).select("id", "missing")


@query("classify_set", f"select flow_id, chain_signatures, certificate_keys from {DECODED} d where chain_signatures <> 'Not observed'")
def classify_set(j):
    return decoded(j).where("chain_signatures <> 'Not observed'").select("flow_id", "chain_signatures", "certificate_keys")


#: Histogram categories and the column of each.
CATEGORIES = {"Key establishment": "key_class", "Server authentication": "server_auth", "Client authentication": "client_auth", "Presented server-chain signatures": "chain_signatures", "Presented server certificate keys": "certificate_keys", "Completion": "completion", "Peer verification": "peer_verification", "Evidence source": "evidence_source"}


def count_keys() -> Column:
    """Exclusive (category, value) pairs of a decoded row, and its evidence gaps."""
    fixed = [F.struct(F.lit(k).alias("category"), F.col(c).alias("value")) for k, c in CATEGORIES.items()]
    status = F.struct(F.lit("Group standardization").alias("category"), F.coalesce(T.nonempty("group_status"), F.lit("Not recorded")).alias("value"))
    gaps = F.transform("missing", lambda m: F.struct(F.lit("Evidence gaps").alias("category"), m.alias("value")))
    return F.concat(F.array(*fixed, status), gaps)


KEYS = f"(select d.*, unnest([{', '.join(f'{{category: {chr(39)}{k}{chr(39)}, value: {c}}}' for k, c in CATEGORIES.items())}, {{category: 'Group standardization', value: coalesce(nullif(group_status, ''), 'Not recorded')}}] || list_transform(missing, lambda m: {{category: 'Evidence gaps', value: m}})) as k from {DECODED} d)"


@query("count_keys", f"select k.category as category, k.value as value, count(*) as n from {KEYS} x group by 1, 2")
def count_keys_query(j):
    return decoded(j).select(F.explode(count_keys()).alias("k")).groupBy("k.category", "k.value").agg(F.count("*").alias("n"))


@query("rule_versions", f"select distinct rule_version from {DECODED} d")
def rule_versions(j):
    return decoded(j).select("rule_version").distinct()


@query("endpoint_confirmation_rows", f"select flow_id, json_extract_string(r, '$.event_id') as event_id, json_extract_string(r, '$.local_role') as local_role, json_extract_string(r, '$.success') as success from (select flow_id, {_R} as r from connections) x")
def endpoint_confirmation_rows(j):
    rows = j.connections.select("flow_id", F.from_json(T.safe_object("crypto_json"), PROFILE).alias("p"))
    return rows.select("flow_id", F.explode("p.endpoint_confirmations").alias("r")).select("flow_id", "r.event_id", "r.local_role", "r.success")


@query("evidence_profiles", f"select computer_name, tls_name, {', '.join(CLASSES)}, min(id) as id, min(first_us) as first_us, max(last_us) as last_us, count(*) as n from {DECODED} d group by all")
def evidence_profiles(j):
    return profiles(decoded(j), ["computer_name", "tls_name", *CLASSES])


def profiles(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("id").alias("id"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.count("*").alias("n"))


COHORT = "lower(computer_name), lower(source_process), lower(coalesce(nullif(sni, ''), destination_address))"
MEASURES = {
    "pq_keys": "contains(lower(key_class), 'post-quantum')", "classical_keys": "key_class = 'Classical'", "pq_auth": "server_auth = 'Post-quantum'", "classical_auth": "server_auth in ('Classical', 'Mixed classical/PQ')",
    "complete": "completion = 'Completed'", "failures": "completion in ('Failed', 'Conflicting')",
}


def cohorts(df: DataFrame) -> DataFrame:
    """Readiness of (computer, application, peer), keyed without case; unknown is what is left of the total."""
    peer = F.coalesce(T.nonempty("sni"), "destination_address")
    keyed = df.select("*", F.lower("computer_name").alias("computer"), F.lower("source_process").alias("application"), F.lower(peer).alias("peer"))
    out = keyed.groupBy("computer", "application", "peer").agg(F.count("*").alias("total"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *[F.count_if(F.expr(e)).alias(n) for n, e in MEASURES.items()])
    return out.withColumn("unknown_keys", F.expr("total - pq_keys - classical_keys")).withColumn("unknown_auth", F.expr("total - pq_auth - classical_auth"))


def cohort_sql(where: str = "true") -> str:
    sums = ", ".join(f"count(*) filter (where {e}) as {n}" for n, e in MEASURES.items())
    return f"(select *, total - pq_keys - classical_keys as unknown_keys, total - pq_auth - classical_auth as unknown_auth from (select lower(computer_name) as computer, lower(source_process) as application, lower(coalesce(nullif(sni, ''), destination_address)) as peer, count(*) as total, min(first_us) as first_us, max(last_us) as last_us, {sums} from {DECODED} d where {where} group by 1, 2, 3) c)"


TLS = "(tls_name like 'TLS%' or tls_name = '')"


CLIENT, SERVER_APP = "coalesce(nullif(source_path, ''), source_process)", "destination_process"
PEER = "concat(coalesce(nullif(sni, ''), destination_address), case when destination_port > 0 then concat(':', cast(destination_port as @TEXT@)) else '' end)"
#: Each dimension's application and peer, and what attributes an observation to a process.
COHORT_BY = {"client_application": (CLIENT, PEER, CLIENT), "server_application": (SERVER_APP, PEER, SERVER_APP), "collector_computer": ("''", "''", f"concat({CLIENT}, {SERVER_APP})"), "server_name": ("''", PEER, f"concat({CLIENT}, {SERVER_APP})")}
COHORT_KEY = ["computer", "application", "peer", "transport"]


def _cohort_columns(dimension: str, text: str) -> dict[str, str]:
    application, peer, attributed = (e.replace("@TEXT@", text) for e in COHORT_BY[dimension])
    named = f"case when {application} = '' then 'unattributed' else lower({application}) end" if dimension.endswith("application") else "''"
    return {"computer": "lower(computer_name)", "application": named, "peer": f"lower({peer})", "transport": "transport", "attribution": f"case when {attributed} <> '' then 'Attributed' else 'Unattributed' end"}


def in_cohorts(df: DataFrame, dimension: str) -> DataFrame:
    """Decoded rows with their cohort's key by a dimension, in lower case, and whether a process is known."""
    return df.withColumns({"computer" if n == "computer" else n: F.expr(e) for n, e in _cohort_columns(dimension, "string").items()})


def _keyed_sql(dimension: str, rows: str) -> str:
    return f"(select x.* exclude (transport), {', '.join(f'{e} as {n}' for n, e in _cohort_columns(dimension, 'varchar').items())} from {rows} x where {TLS})"


def _cohort_query(dimension: str) -> None:
    sums = ", ".join(f"count(*) filter (where {e}) as {n}" for n, e in MEASURES.items())
    name = "readiness_cohorts" if dimension == "client_application" else f"readiness_cohorts_{dimension}"

    @query(name, f"select {', '.join(COHORT_KEY)}, count(*) as total, min(first_us) as first_us, max(last_us) as last_us, count(*) filter (where attribution = 'Attributed') as attributed, {sums} from {_keyed_sql(dimension, DECODED)} c group by all")
    def readiness(j):
        keyed = in_cohorts(decoded(j).where(TLS), dimension)
        return keyed.groupBy(*COHORT_KEY).agg(F.count("*").alias("total"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.count_if(F.col("attribution") == "Attributed").alias("attributed"), *[F.count_if(F.expr(e)).alias(n) for n, e in MEASURES.items()])


for _dimension in COHORT_BY:
    _cohort_query(_dimension)


PERCENTS = ["pq_keys", "classical_keys", "unknown_keys", "pq_auth", "classical_auth", "unknown_auth", "complete", "failures"]


@query("readiness_measures", f"select computer, application, peer, {', '.join(f'round(100.0 * {c} / total, 4) as {c}' for c in PERCENTS)} from {cohort_sql(TLS)} c")
def readiness_measures(j):
    c = cohorts(decoded(j).where(TLS))
    return c.select("computer", "application", "peer", *[F.round(F.lit(100.0) * F.col(x) / F.col("total"), 4).alias(x) for x in PERCENTS])


@query("readiness_totals", f"select sum(total) as total, {', '.join(f'sum({c}) as {c}' for c in PERCENTS)} from {cohort_sql(TLS)} c")
def readiness_totals(j):
    return cohorts(decoded(j).where(TLS)).agg(F.sum("total").alias("total"), *[F.sum(c).alias(c) for c in PERCENTS])


@query("cohort_order", f"select computer, application, peer, total from {cohort_sql(TLS)} c order by total desc, computer, application, peer limit 1000")
def cohort_order(j):
    return cohorts(decoded(j).where(TLS)).orderBy(F.desc("total"), "computer", "application", "peer").limit(1000).select("computer", "application", "peer", "total")
