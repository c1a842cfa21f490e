"""Investigation: scans, filters, projections, pages and exports of the journal."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hslake.functions import text as T
from hslake.functions.labels import STATE_LABELS
from hslake.functions.scope import HTTP_NAMES, PARTIAL_STATES, SEARCHED, SEARCHED_ASSESSMENT, SEARCHED_EVENTS, Scope, account, any_http_host, search_connections, search_endpoints, server_name
from hslake.plans.registry import query
from hslake.sources.journal import NOW_US, Journal
from hslake.sources.shared import stored

SAFE = "case when json_valid(crypto_json) then crypto_json end"


def js(path: str) -> str:
    return f"json_extract_string({SAFE}, '$.{path}')"


FLOWS = "(select c.*, s.computer_name from connections c join sessions s on s.id = c.run_id)"
EVENTS = "(select e.*, s.computer_name from endpoint_events e join sessions s on s.id = e.run_id)"
SERVER = f"coalesce(nullif(sni, ''), {js('http_host')}, destination_address)"


def flows(j: Journal) -> DataFrame:
    """Connections with their session's computer."""
    return j.connections.join(j.sessions.select(F.col("id").alias("run_id"), "computer_name"), "run_id")


def events(j: Journal) -> DataFrame:
    return j.endpoint_events.join(j.sessions.select(F.col("id").alias("run_id"), "computer_name"), "run_id")


def scoped(*conditions: tuple[str, str, str], **more) -> Column:
    return Scope(conditions=conditions, **more).column(NOW_US)


@query("journal_scan", "select 'sessions' as t, count(*) as n from sessions union all select 'connections', count(*) from connections union all select 'certificates', count(*) from certificates union all select 'links', count(*) from connection_certificates union all select 'events', count(*) from endpoint_events union all select 'event_links', count(*) from endpoint_certificates")
def journal_scan(j):
    parts = [("sessions", j.sessions), ("connections", j.connections), ("certificates", j.certificates), ("links", j.connection_certificates), ("events", j.endpoint_events), ("event_links", j.endpoint_certificates)]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = one if out is None else out.union(one)
    return out


@query("journal_validate", "select id, started_us <= updated_us and (stopped_us is null or stopped_us >= started_us) as valid, status in ('running', 'stopped') or status like 'failed:%' as known_status from sessions")
def journal_validate(j):
    return j.sessions.select("id", ((F.col("started_us") <= F.col("updated_us")) & (F.col("stopped_us").isNull() | (F.col("stopped_us") >= F.col("started_us")))).alias("valid"), (F.col("status").isin("running", "stopped") | F.startswith("status", F.lit("failed:"))).alias("known_status"))


def _filter(name: str, sql: str, *conditions, **more):
    query(name, f"select id, first_us from {FLOWS} f where {sql}")(lambda j: flows(j).where(scoped(*conditions, **more)).select("id", "first_us"))


_filter("filter_contains", "contains(lower(source_process), 'app-1')", ("ClientProcess", "contains", "APP-1"))
_filter("filter_equals", "lower(group_name) = 'x25519' and destination_port = 443", ("Group", "equals", "x25519"), ("ServerPort", "equals", "443"))
_filter("filter_starts_with", "starts_with(lower(destination_address), '192.0.2.1')", ("ServerAddress", "starts_with", "192.0.2.1"))
_filter("filter_not_equals", "coalesce(cipher_name, '') <> '' and lower(cipher_name) <> 'tls_aes_256_gcm_sha384'", ("Cipher", "not_equals", "tls_aes_256_gcm_sha384"))
_filter("filter_observed", "source_pid is not null or destination_pid is not null", ("ProcessId", "observed", ""))
_filter("filter_not_observed", "coalesce(source_process, '') = '' and coalesce(source_path, '') = ''", ("ClientProcess", "not_observed", ""))
_filter("filter_fields_connections", f"lower(computer_name) = 'host-nation_1' and contains(lower({SERVER}), 'svc-1') and coalesce({js('transport')}, 'TCP') = 'TCP' and {js('group_class')} = 'Hybrid post-quantum'", ("Computer", "equals", "host-nation_1"), ("ServerName", "contains", "SVC-1"), ("Transport", "equals", "tcp"), ("KeyClass", "equals", "hybrid post-quantum"))
_filter("filter_time_range", "first_us between 800000000000000 and 850000000000000", from_us=800000000000000, to_us=850000000000000)
_filter("filter_rolling_window", f"first_us >= {NOW_US - 2880000 * 60_000_000}", since_minutes=2880000)
_filter("filter_protocol", "tls_name = 'TLS 1.3'", protocol="TLS 1.3")
_filter("filter_incomplete", "state in (" + ", ".join(f"'{s}'" for s in PARTIAL_STATES) + ")", incomplete=True)
_filter("filter_hide_http", "coalesce(tls_name, '') not in ('HTTP', 'HTTP/1.0', 'HTTP/1.1')", include_http=False)
_filter("filter_hide_loopback", "not (starts_with(source_address, '127.') or starts_with(destination_address, '127.') or source_address = destination_address)", include_loopback=False)


@query("filter_any_http_host", f"select id from connections where json_valid(crypto_json) and len(list_filter(cast(json_extract({SAFE}, '$.http_hosts') as varchar[]), lambda h: contains(lower(h), 'api'))) > 0")
def filter_any_http_host(j):
    return j.connections.where(any_http_host("Api")).select("id")


def _search_sql(term: str) -> str:
    names = [*SEARCHED, *(f"concat({s}_account_domain, chr(92), {s}_account)" for s in ("source", "destination")), f"coalesce({js('transport')}, 'TCP')", *(js(p) for p in ("handshake_confirmation", "group_class", "http_host")), f"array_to_string(cast(json_extract({SAFE}, '$.http_hosts') as varchar[]), chr(10))"]
    return " or ".join(f"coalesce(contains(lower({n}), '{term}'), false)" for n in names)


for _name, _term in (("search_connections", "svc-3"), ("search_accounts", "lab\\user2"), ("search_record", "hybrid")):
    query(_name, f"select id from {FLOWS} f where {_search_sql(_term)}")(lambda j, t=_term: flows(j).where(search_connections(t.upper())).select("id"))


@query("filter_fields_endpoints", f"select id from {EVENTS} e where lower(provider) = 'schannel' and starts_with(computer_name, 'HOST-') and local_role = 'Client' and cast(pid as varchar) like '%1%'")
def filter_fields_endpoints(j):
    return events(j).where(scoped(("Provider", "equals", "schannel"), ("Computer", "starts_with", "host-"), ("ClientProcess", "contains", "1"), endpoints=True)).select("id")


ASSESSED = f"(select e.*, a.cipher, a.detail_json from {EVENTS} e join endpoint_assessments a on a.id = e.id)"
_members = [f"json_extract_string(case when json_valid(detail_json) then detail_json end, '$.assessment.{p}')" for p in SEARCHED_ASSESSMENT]


def _search_events(name: str, term: str) -> None:
    sql = " or ".join(f"coalesce(contains(lower({n}), '{term}'), false)" for n in [*SEARCHED_EVENTS, *_members])
    query(name, f"select id from {ASSESSED} e where {sql}")(lambda j: events(j).join(j.endpoint_assessments, "id").where(search_endpoints(term.upper())).select("id"))


for _name, _term in (("search_endpoints", "svc-4"), ("search_assessments", "quic-1")):
    _search_events(_name, _term)


@query("filter_endpoint_time", "select id, coalesce(operation_us, timestamp_us) as at_us from endpoint_events where coalesce(operation_us, timestamp_us) between 1704067200000000 and 1705000000000000")
def filter_endpoint_time(j):
    at = F.coalesce("operation_us", "timestamp_us")
    return j.endpoint_events.where(at.between(1704067200000000, 1705000000000000)).select("id", at.alias("at_us"))


@query("filter_cert_presets", f"""select sha256, unnest([x for x in [case when not_after_us between {NOW_US} and {NOW_US + 30 * 86400000000} then 'expiring' end, case when not_after_us < {NOW_US} then 'expired' end,
 case when public_key_class = 'Post-quantum' then 'pq' end, case when public_key_class = 'Classical' then 'classical' end, case when uses > 1 then 'reused' end] if x is not null]) as preset
 from (select *, count(*) over (partition by spki_sha256) as uses from certificates) c""")
def filter_cert_presets(j):
    reuse = j.certificates.groupBy("spki_sha256").agg(F.count("*").alias("uses"))
    c, month = F.col, 30 * 86400000000
    presets = [("expiring", c("not_after_us").between(NOW_US, NOW_US + month)), ("expired", c("not_after_us") < NOW_US), ("pq", c("public_key_class") == "Post-quantum"), ("classical", c("public_key_class") == "Classical"), ("reused", c("uses") > 1)]
    return j.certificates.join(reuse, "spki_sha256").select("sha256", F.explode(F.filter(F.array(*[F.when(t, n) for n, t in presets]), lambda x: x.isNotNull())).alias("preset"))


@query("scope_key", "select 1 as one, true as equal_windows, false as equal_filters")
def scope_key(j):
    a, b = Scope(from_us=1000, to_us=2000, protocol="TLS 1.3"), Scope(from_us=5000, to_us=6000, protocol="TLS 1.3")
    one = j.sessions.agg(F.lit(1).alias("one"))
    return one.select("one", F.lit(a.key() == b.key()).alias("equal_windows"), F.lit(a.key() == Scope(protocol="SMB").key()).alias("equal_filters"))


@query("literal_escape", "select id from connections where source_process like '%app-1_.exe' and contains(source_process, 'app-1')")
def literal_escape(j):
    return j.connections.where(F.col("source_process").like("%" + T.literal_pattern("app-1") + "_.exe")).select("id")


@query("fold_case", "select id, lower(destination_process) as folded, lower(computer_name) as computer from " + FLOWS + " f")
def fold_case(j):
    return flows(j).select("id", T.fold("destination_process").alias("folded"), T.fold("computer_name").alias("computer"))


@query("json_value", f"select id, {js('transport')} as transport, {js('ssh_selection.host_key')} as host_key, {js('smb_selected_dialect')} as dialect from connections")
def json_value(j):
    return j.connections.select("id", T.json_value("crypto_json", "transport").alias("transport"), T.json_value("crypto_json", "ssh_selection.host_key").alias("host_key"), T.json_value("crypto_json", "smb_selected_dialect").alias("dialect"))


@query("json_safe_object", f"select id, {SAFE} as doc from connections")
def json_safe_object(j):
    return j.connections.select("id", T.safe_object("crypto_json").alias("doc"))


@query("json_scalar_text", f"select id, case when len(list_filter(json_keys({SAFE}), lambda k: k = 'transport')) = 1 then {js('transport')} end as transport, case when json_type({SAFE}, '$.selected_group_id') in ('UBIGINT', 'BIGINT') then cast({js('selected_group_id')} as bigint) end as group_id from connections")
def json_scalar(j):
    return j.connections.select("id", T.json_scalar_text("crypto_json", "transport").alias("transport"), T.json_scalar_bigint("crypto_json", "selected_group_id", 0, 65535).alias("group_id"))


@query("json_has_property", "select id from connections where contains(crypto_json, '\"http_host\"')")
def json_has_property(j):
    return j.connections.where(F.contains("crypto_json", F.lit('"http_host"'))).select("id")


def endpoint_text(address: str, port: str) -> Column:
    return F.when(F.col("ip_version") == 6, F.concat(F.lit("["), address, F.lit("]:"), port)).otherwise(F.concat(address, F.lit(":"), port))


@query("endpoint_text", "select id, concat(source_address, ':', source_port) as source, concat(destination_address, ':', destination_port) as destination from connections")
def endpoint(j):
    return j.connections.select("id", endpoint_text("source_address", "source_port").alias("source"), endpoint_text("destination_address", "destination_port").alias("destination"))


def owner_text() -> Column:
    side = lambda name, pid: F.when(F.col(name) != "", F.when(F.col(pid).isNotNull(), F.concat(name, F.lit(" ("), pid, F.lit(")"))).otherwise(F.col(name)))
    return F.coalesce(T.nonempty(F.concat_ws(" / ", side("source_process", "source_pid"), side("destination_process", "destination_pid"))), F.lit("Unattributed"))


OWNER = "coalesce(nullif(concat_ws(' / ', case when source_process <> '' then case when source_pid is not null then concat(source_process, ' (', source_pid, ')') else source_process end end, case when destination_process <> '' then case when destination_pid is not null then concat(destination_process, ' (', destination_pid, ')') else destination_process end end), ''), 'Unattributed')"
STATE = "case state " + " ".join(f"when '{k}' then '{v}'" for k, v in STATE_LABELS.items()) + " else state end"


@query("owner_text", f"select id, {OWNER} as owner from connections")
def owner(j):
    return j.connections.select("id", owner_text().alias("owner"))


def state_label() -> Column:
    labels = F.create_map(*[F.lit(x) for x in chain(*STATE_LABELS.items())])
    return F.coalesce(labels[F.col("state")], F.col("state"))


@query("state_label", f"select state, {STATE} as label, count(*) as n from connections group by state")
def state(j):
    return j.connections.groupBy("state").agg(F.count("*").alias("n")).select("state", state_label().alias("label"), "n")


PAGE = f"id, first_us, concat(source_address, ':', source_port) as source, concat(destination_address, ':', destination_port) as destination, coalesce(nullif(tls_name, ''), '—') as protocol, coalesce(nullif(cipher_name, ''), '—') as cipher, case when sni = '' then '—' when ech_offered <> 0 then concat(sni, ' [ECH]') else sni end as server_name, {OWNER} as process, {STATE} as state_text"


def page_rows(df: DataFrame) -> DataFrame:
    shown = lambda c: F.coalesce(T.nonempty(c), F.lit("—"))
    sni = F.when(F.col("sni") == "", "—").when(F.col("ech_offered") != 0, F.concat("sni", F.lit(" [ECH]"))).otherwise(F.col("sni"))
    return df.select("id", "first_us", endpoint_text("source_address", "source_port").alias("source"), endpoint_text("destination_address", "destination_port").alias("destination"), shown("tls_name").alias("protocol"), shown("cipher_name").alias("cipher"), sni.alias("server_name"), owner_text().alias("process"), state_label().alias("state_text"))


@query("connection_page_row", f"select {PAGE} from connections")
def connection_page_row(j):
    return page_rows(j.connections)


@query("hello_latency", "select id, case when hello_latency_us >= 0 then hello_latency_us end as latency_us from connections")
def hello_latency(j):
    """From the client's hello to the server's; null where one of them wasn't seen."""
    return j.connections.select("id", F.when(F.col("hello_latency_us") >= 0, F.col("hello_latency_us")).alias("latency_us"))


@query("sni_or_address", f"select id, {SERVER} as server from connections")
def sni_or_address(j):
    return j.connections.select("id", server_name().alias("server"))


@query("protocol_name", "select id, case when starts_with(tls_name, 'DTLS') then 'DTLS' when starts_with(tls_name, 'TLS') then 'TLS' when starts_with(tls_name, 'SSH') then 'SSH' else nullif(tls_name, '') end as family from connections")
def protocol_name(j):
    name = F.col("tls_name")
    family = F.when(name.startswith("DTLS"), "DTLS").when(name.startswith("TLS"), "TLS").when(name.startswith("SSH"), "SSH").otherwise(T.nonempty(name))
    return j.connections.select("id", family.alias("family"))


@query("event_id", "select id, upper(sha256(concat_ws('|', 'db', cast(change_revision as varchar), 'connection', cast(id as varchar)))) as event_id from connections")
def event_id(j):
    return j.connections.select("id", F.upper(F.sha2(F.concat_ws("|", F.lit("db"), F.col("change_revision").cast("string"), F.lit("connection"), F.col("id").cast("string")), 256)).alias("event_id"))


@query("clip_text", "select id, substr(response_headers, 1, 40) as clipped, length(response_headers) > 40 as truncated from exchanges")
def clip_text(j):
    return j.exchanges.select("id", F.substring("response_headers", 1, 40).alias("clipped"), (F.length("response_headers") > 40).alias("truncated"))


@query("sha256_verify", "select sha256, sha256 = upper(sha256(concat('cert-', cast(supplier as varchar)))) and length(concat('cert-', cast(supplier as varchar))) <= 1048576 as verified from certificates")
def sha256_verify(j):
    der = F.encode(F.concat(F.lit("cert-"), F.col("supplier").cast("string")), "UTF-8")
    return j.certificates.select("sha256", ((F.col("sha256") == F.upper(F.sha2(der, 256))) & (F.octet_length(der) <= 1 << 20)).alias("verified"))


#: Words that labels write in their own way.
ACRONYMS = {"tls": "TLS", "sni": "SNI", "ssh": "SSH", "smb": "SMB", "http": "HTTP", "ike": "IKE", "sa": "SA", "psk": "PSK"}


@query("humanize_label", "select state, array_to_string(list_transform(string_split(state, '_'), lambda w, i: case w " + " ".join(f"when '{k}' then '{v}'" for k, v in ACRONYMS.items()) + " else case when i = 1 then upper(w[1]) || w[2:] else w end end), ' ') as label from (select distinct state from connections) s")
def humanize_label(j):
    words = F.create_map(*[F.lit(x) for x in chain(*ACRONYMS.items())])
    label = F.array_join(F.transform(F.split("state", "_"), lambda w, i: F.coalesce(words[w], F.when(i == 0, F.initcap(w)).otherwise(w))), " ")
    return j.connections.select("state").distinct().select("state", label.alias("label"))


@query("valid_time", "select sha256, case when not_after_us = 0 then 'Not observed' when not_after_us not between -62135596800000000 and 253402300799999999 then 'Invalid timestamp' else strftime(make_timestamp(not_after_us), '%Y-%m-%d %H:%M:%S') end as expires from certificates")
def valid_time(j):
    t = F.col("not_after_us")
    shown = F.when(t == 0, "Not observed").when(~t.between(-62135596800000000, 253402300799999999), "Invalid timestamp").otherwise(F.date_format(F.timestamp_micros(t), "yyyy-MM-dd HH:mm:ss"))
    return j.certificates.select("sha256", shown.alias("expires"))


@query("wildcard_match", "select id from connections where regexp_matches(lower(source_process), '^app-1.[.]exe$') or regexp_matches(lower(destination_process), '^svc-[0-9]*[.]exe$')")
def wildcard_match(j):
    hit = lambda c, p: F.rlike(F.col(c), T.wildcard_regex(F.lit(p)))
    return j.connections.where(hit("source_process", "APP-1?.exe") | hit("destination_process", "svc-*.EXE")).select("id")


@query("id_list_parse", "select v, list_transform(string_split(v, ','), lambda x: case when starts_with(trim(x), '0x') then cast(trim(x) as integer) else cast(trim(x) as integer) end) as ids from (select distinct concat(destination_port, ', ', cast(source_port as varchar)) as v from connections) t")
def id_list_parse(j):
    lists = j.connections.select(F.concat("destination_port", F.lit(", "), F.col("source_port").cast("string")).alias("v")).distinct()
    number = lambda x: F.when(F.startswith(F.lower(F.trim(x)), F.lit("0x")), F.conv(F.substring(F.trim(x), 3, 20), 16, 10)).otherwise(F.trim(x)).try_cast("int")
    return lists.select("v", F.transform(F.split("v", ","), number).alias("ids"))


@query("join_sessions", f"select computer_name, count(*) as n, min(first_us) as first_us from {FLOWS} f group by computer_name")
def join_sessions(j):
    return flows(j).groupBy("computer_name").agg(F.count("*").alias("n"), F.min("first_us").alias("first_us"))


def page(df: DataFrame, time: str, size: int, before: tuple | None = None) -> DataFrame:
    """Newest first, one row more than ``size`` if there are more."""
    if before:
        df = df.where(F.struct(F.col(time).alias("t"), F.col("id").alias("i")) < F.struct(F.lit(before[0]).cast("long").alias("t"), F.lit(before[1]).cast(df.schema["id"].dataType).alias("i")))
    return df.orderBy(F.desc(time), F.desc("id")).limit(size + 1)


@query("page_connections", "select id, first_us from connections where (first_us, id) < (880000000000000, 1000) order by first_us desc, id desc limit 251")
def page_connections(j):
    return page(j.connections, "first_us", 250, (880000000000000, 1000)).select("id", "first_us")


@query("page_endpoints", "select id, timestamp_us from endpoint_events where (timestamp_us, id) < (1705000000000000, 'ev-5') order by timestamp_us desc, id desc limit 251")
def page_endpoints(j):
    return page(j.endpoint_events, "timestamp_us", 250, (1705000000000000, "ev-5")).select("id", "timestamp_us")


@query("page_certificates", "select sha256, subject from certificates where sha256 > '4' order by sha256 limit 26")
def page_certificates(j):
    return j.certificates.where(F.col("sha256") > "4").orderBy("sha256").limit(26).select("sha256", "subject")


def numbered(df: DataFrame, time: str, rows_a_range: int = 1 << 18) -> DataFrame:
    """``df`` (with ``id``) in order of (time, id), each row with its number from 1: ranges are sorted apart and written once, rows before each range counted from what was written.

    Only the sizes of the ranges, one number for 2^18 rows, meet in one task.
    """
    ranges = max(1, -(-df.count() // rows_a_range))
    dealt = stored(df.repartitionByRange(ranges, time, "id").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("c"))
    sizes = sizes.select("range", F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = dealt.join(sizes, "range").withColumn("n", F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy(time, "id")))
    return rows.drop("range", "base")


@query("export_order", "select id, first_us, row_number() over (order by first_us, id) as n from connections")
def export_order(j):
    """Every connection with its place in the whole export."""
    return numbered(j.connections.select("id", "first_us"), "first_us")


def csv_quote(c: Column) -> Column:
    """A quoted CSV field; text that a sheet would run is led by an apostrophe."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    guarded = F.when(F.rlike(text, F.lit(r"^\s*[=+@\-\t\r]")), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


@query("export_csv", f"""select id, concat_ws(',', '"' || id || '"', '"' || source || '"', '"' || destination || '"', '"' || protocol || '"', '"' || server_name || '"', '"' || process || '"') as line from (select {PAGE} from connections) p""")
def export_csv(j):
    rows = page_rows(j.connections)
    return rows.select("id", F.concat_ws(",", *[csv_quote(F.col(c)) for c in ("id", "source", "destination", "protocol", "server_name", "process")]).alias("line"))


@query("export_jsonl", f"select id, cast(to_json(p) as varchar) as line from (select {PAGE} from connections) p")
def export_jsonl(j):
    rows = page_rows(j.connections)
    return rows.select("id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


@query("syslog_lines", "select id, concat('<', 16 * 8 + case when kind = 'error' then 4 else 6 end, '>1 ', strftime(make_timestamp(timestamp_us), '%Y-%m-%dT%H:%M:%S'), 'Z ', computer_name, ' hslake ', pid, ' ENDPOINT - ', id) as line from " + EVENTS + " e")
def syslog_lines(j):
    severity = F.when(F.col("kind") == "error", 4).otherwise(6)
    line = F.concat(F.lit("<"), (16 * 8 + severity).cast("string"), F.lit(">1 "), F.date_format(F.timestamp_micros("timestamp_us"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), F.col("computer_name"), F.lit(" hslake "), F.col("pid").cast("string"), F.lit(" ENDPOINT - "), F.col("id"))
    return events(j).select("id", line.alias("line"))


@query("requested_values", "select v.role, c.sha256, c.subject from (values ('server 0', 1), ('server 1', 2), ('client 0', 3)) v(role, supplier) left join certificates c on c.supplier = v.supplier")
def requested_values(j):
    wanted = j.spark.sql("select * from values ('server 0', 1L), ('server 1', 2L), ('client 0', 3L) as v(role, supplier)")
    return wanted.join(j.certificates, "supplier", "left").select("role", "sha256", "subject")


@query("account_text", "select id, case when source_account = '' then '' when source_account_domain = '' then source_account else concat(source_account_domain, chr(92), source_account) end as client, case when destination_account = '' then '' when destination_account_domain = '' then destination_account else concat(destination_account_domain, chr(92), destination_account) end as server from connections")
def account_text(j):
    text = lambda s: F.when(F.col(f"{s}_account") == "", "").when(F.col(f"{s}_account_domain") == "", F.col(f"{s}_account")).otherwise(account(s))
    return j.connections.select("id", text("source").alias("client"), text("destination").alias("server"))
