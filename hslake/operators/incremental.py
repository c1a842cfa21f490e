"""Incremental work: change batches, upserts, the published feed and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hslake.operators.investigation import FLOWS, events, flows
from hslake.plans.registry import query
from hslake.sources.journal import NOW_US

AFTER, UPPER = 20, 40


@query("latest_wins", "select flow_id, at_us, supplier from changes where rn = 1")
def latest_wins(j):
    """The last of the changes of each flow; rn orders them, 1 the latest."""
    return j.changes.groupBy("flow_id").agg(F.min_by(F.struct("at_us", "supplier"), "rn").alias("r")).select("flow_id", "r.*")


@query("revision_boundary", "select distinct change_revision from (select change_revision from connections union select change_revision from connection_certificates union select change_revision from certificates union select change_revision from endpoint_events union select change_revision from sessions) t where change_revision > 5 order by 1 limit 4")
def revision_boundary(j):
    return revisions(j).where("change_revision > 5").orderBy("change_revision").limit(4)


def revisions(j) -> DataFrame:
    out = None
    for df in (j.connections, j.connection_certificates, j.certificates, j.endpoint_events, j.sessions):
        one = df.select("change_revision").distinct()
        out = one if out is None else out.union(one)
    return out.distinct()


@query("union_distinct_revisions", "select change_revision from connections union select change_revision from connection_certificates union select change_revision from certificates union select change_revision from endpoint_events union select change_revision from sessions")
def union_distinct_revisions(j):
    return revisions(j)


@query("change_batch", f"select id, change_revision from connections where change_revision > {AFTER} and change_revision <= {UPPER}")
def change_batch(j):
    return j.connections.where((F.col("change_revision") > AFTER) & (F.col("change_revision") <= UPPER)).select("id", "change_revision")


CHANGED = f"(select run_id, flow_id from connections where change_revision > {AFTER} and change_revision <= {UPPER} union select run_id, flow_id from connection_certificates where change_revision > {AFTER} and change_revision <= {UPPER})"


@query("change_closure", f"select 'connection' as kind, cast(flow_id as varchar) as key from {CHANGED} c union select 'session', run_id from {CHANGED} c union select 'certificate', l.sha256 from connection_certificates l join {CHANGED} c on c.run_id = l.run_id and c.flow_id = l.flow_id")
def change_closure(j):
    fresh = (F.col("change_revision") > AFTER) & (F.col("change_revision") <= UPPER)
    changed = j.connections.where(fresh).select("run_id", "flow_id").union(j.connection_certificates.where(fresh).select("run_id", "flow_id")).distinct()
    certs = j.connection_certificates.join(changed, ["run_id", "flow_id"], "left_semi")
    parts = [changed.select(F.lit("connection").alias("kind"), F.col("flow_id").cast("string").alias("key")), changed.select(F.lit("session"), "run_id"), certs.select(F.lit("certificate"), "sha256")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("merge_connections", """with old as (select * from changes where rn > 1 qualify row_number() over (partition by flow_id order by rn) = 1), new as (select * from changes where rn = 1)
 select coalesce(n.flow_id, o.flow_id) as flow_id, coalesce(n.supplier, o.supplier) as supplier, coalesce(n.ended_us, o.ended_us) as ended_us, coalesce(nullif(n.close_reason, ''), o.close_reason, '') as close_reason from new n full join old o on o.flow_id = n.flow_id""")
def merge_connections(j):
    """Upsert: newest values, but an end and a close reason once seen stay."""
    new = j.changes.where("rn = 1").select("flow_id", F.struct("supplier", "ended_us", "close_reason").alias("n"))
    old = j.changes.where("rn > 1").groupBy("flow_id").agg(F.min_by(F.struct("supplier", "ended_us", "close_reason"), "rn").alias("o"))
    both = new.join(old, "flow_id", "full_outer")
    return both.select("flow_id", F.coalesce("n.supplier", "o.supplier").alias("supplier"), F.coalesce("n.ended_us", "o.ended_us").alias("ended_us"), F.coalesce(F.nullif("n.close_reason", F.lit("")), "o.close_reason", F.lit("")).alias("close_reason"))


@query("merge_dimension", "select sha256 from certificates where change_revision <= 8 union all select sha256 from certificates c where change_revision > 8 and not exists (select 1 from certificates o where o.change_revision <= 8 and o.sha256 = c.sha256)")
def merge_dimension(j):
    have, new = j.certificates.where("change_revision <= 8").select("sha256"), j.certificates.where("change_revision > 8").select("sha256")
    return have.union(new.join(have, "sha256", "left_anti"))


@query("merge_lifecycle", "select c.flow_id, coalesce(n.ended_us, c.ended_us) as ended_us, coalesce(nullif(n.close_reason, ''), c.close_reason) as close_reason from connections c left join (select * from changes where rn = 1) n on n.flow_id = c.flow_id")
def merge_lifecycle(j):
    n = j.changes.where("rn = 1").select("flow_id", F.col("ended_us").alias("e"), F.col("close_reason").alias("r"))
    out = j.connections.select("flow_id", "ended_us", "close_reason").join(n, "flow_id", "left")
    return out.select("flow_id", F.coalesce("e", "ended_us").alias("ended_us"), F.coalesce(F.nullif("r", F.lit("")), "close_reason").alias("close_reason"))


OWNED = ["pid", "process", "account"]


def _owner_sql(side: str) -> str:
    held = {"pid": f"c.{side}_pid", "process": f"c.{side}_process", "account": f"c.{side}_account"}
    revoked = {"pid": "null", "process": "''", "account": "''"}
    newest = lambda e: f"arg_max({e}, u.last_us * 2 + u.seq) filter (where u.{side}_given)"
    return ", ".join(f"case when bool_or(coalesce(u.{side}_given, false)) then case when {newest(f'u.{side}_ambiguous')} then {revoked[n]} else {newest(f'u.{side}_{n}')} end else {held[n]} end as {side}_{n}" for n in OWNED)


@query("merge_owners", f"select c.flow_id, {_owner_sql('source')}, {_owner_sql('destination')} from connections c left join owner_updates u on u.flow_id = c.flow_id and u.last_us >= c.last_us group by c.flow_id, " + ", ".join(f"c.{s}_{n}" for s in ("source", "destination") for n in OWNED))
def merge_owners(j):
    """Each side's owner after the updates that saw the whole connection: the newest one that tells of that side counts, an ambiguous one revokes the owner, older ones change nothing."""
    sides = ("source", "destination")
    c = j.connections.select("flow_id", F.col("last_us").alias("seen_us"), *[F.col(f"{s}_{n}").alias(f"held_{s}_{n}") for s in sides for n in OWNED])
    u = j.owner_updates.join(c.select("flow_id", "seen_us"), "flow_id").where("last_us >= seen_us")
    newest = [F.max(F.when(F.col(f"{s}_given"), F.struct("last_us", "seq", f"{s}_ambiguous", *[f"{s}_{n}" for n in OWNED]))).alias(s) for s in sides]
    merged = c.join(u.groupBy("flow_id").agg(*newest), "flow_id", "left")
    empty = {"pid": F.lit(None), "process": F.lit(""), "account": F.lit("")}
    out = [F.when(F.col(s).isNull(), F.col(f"held_{s}_{n}")).when(F.col(f"{s}.{s}_ambiguous"), empty[n]).otherwise(F.col(f"{s}.{s}_{n}")).alias(f"{s}_{n}") for s in sides for n in OWNED]
    return merged.select("flow_id", *out)


FEED = f"""(select change_revision as revision, 'connection' as kind, cast(id as varchar) as key, first_us as time_us, computer_name, case when alert <> '' then 4 else 6 end as severity from {FLOWS} f
 union all select change_revision, 'endpoint', id, timestamp_us, run_id, case when result like '%failure' then 4 else 6 end from endpoint_events
 union all select change_revision, 'health', id, updated_us, computer_name, case when capture_lost + queue_lost > 0 or status like 'failed%' then 4 else 6 end from sessions)"""


def feed(j) -> DataFrame:
    """Connection, endpoint and health events of the journal's changes."""
    c = flows(j).select(F.col("change_revision").alias("revision"), F.lit("connection").alias("kind"), F.col("id").cast("string").alias("key"), F.col("first_us").alias("time_us"), "computer_name", F.when(F.col("alert") != "", 4).otherwise(6).alias("severity"))
    e = j.endpoint_events.select(F.col("change_revision").alias("revision"), F.lit("endpoint").alias("kind"), F.col("id").alias("key"), F.col("timestamp_us").alias("time_us"), F.col("run_id").alias("computer_name"), F.when(F.col("result").endswith("failure"), 4).otherwise(6).alias("severity"))
    lost = (F.col("capture_lost") + F.col("queue_lost") > 0) | F.col("status").startswith("failed")
    h = j.sessions.select(F.col("change_revision").alias("revision"), F.lit("health").alias("kind"), F.col("id").alias("key"), F.col("updated_us").alias("time_us"), "computer_name", F.when(lost, 4).otherwise(6).alias("severity"))
    return c.unionByName(e).unionByName(h)


@query("event_feed", f"select * from {FEED} f")
def event_feed(j):
    return feed(j)


@query("feed_order", f"select revision, kind, key from {FEED} f where (revision, kind, key) > (10, 'connection', '5') order by revision, kind, key limit 128")
def feed_order(j):
    after = F.struct("revision", "kind", "key") > F.struct(F.lit(10).cast("long"), F.lit("connection"), F.lit("5"))
    return feed(j).where(after).orderBy("revision", "kind", "key").limit(128).select("revision", "kind", "key")


@query("event_severity", f"select kind, severity, count(*) as n from {FEED} f group by all")
def event_severity(j):
    return feed(j).groupBy("kind", "severity").agg(F.count("*").alias("n"))


#: Members of a record's document that may be published; everything else (provider XML, certificates, raw bodies) stays.
PUBLISHED = ["group_class", "group_status", "signature", "signature_class", "dh_bits", "transport", "quic", "dtls_version", "success", "peer_verified", "selected_alpn", "group_id", "signature_scheme", "local_signature_scheme", "confirmation", "endpoint_confirmations", "local", "remote", "role", "process_started_us", "handshake_started_us", "operation_started_us", "algorithm", "mode", "key_bits", "correlation", "observation"]
DATABASE = "db"
EVENT_BYTES, DOCUMENT_CHARS, MEMBER_CHARS, FIELD_CHARS, SMALL_CHARS, COMPUTER_CHARS = 16384, 65536, 2048, 1024, 128, 256
#: The published fields of each kind of event, texts first, then numbers.
FIELDS = {
    "connection": (["run_id", "source_address", "destination_address", "tls_name", "cipher_name", "group_name", "sni", "source_process", "destination_process", "alert"], ["flow_id", "source_port", "destination_port", "source_pid", "destination_pid", "first_us", "last_us", "ended_us"]),
    "endpoint": (["run_id", "provider", "kind", "result", "peer", "protocol", "local_role"], ["pid", "port"]),
    "health": (["status"], ["packets", "capture_lost", "queue_lost", "storage_lost", "process_events_lost", "telemetry_lost", "truncated", "flow_limit", "reassembly_limit", "stopped_us"]),
}


def envelopes(rows: DataFrame, kind: str, doc: str | None = None) -> DataFrame:
    """(id, body): the published event of each row (key, revision, time_us, computer_name, the kind's fields, and ``doc``, its JSON document).

    The payload holds the kind's fields and, of the document, the members that may be published. Long fields are cut, long members and whole documents over 65,536 characters left
    out, and the event says so (``truncated``); a document that isn't an object or is too long says ``metadata_unavailable``. An event over 16 KiB is written again without the document and with
    short fields; those are few, so it then fits.
    """
    texts, numbers = FIELDS[kind]
    cut = lambda n: F.to_json(F.struct(*[F.substring(c, 1, n).alias(c) for c in texts], *numbers), {"ignoreNullFields": "false"})
    long = reduce(lambda a, b: a | b, [F.coalesce(F.length(c) > n, F.lit(False)) for c, n in [*[(t, FIELD_CHARS) for t in texts], ("computer_name", COMPUTER_CHARS)]])
    more, dropped = F.lit(""), F.lit(False)
    if doc:
        # Parsed once as text and once for the types: texts are quoted again, other members stand as they were recorded.
        rows = rows.withColumn("_fits", F.length(doc) <= DOCUMENT_CHARS).withColumn("_doc", F.when(F.col("_fits") & F.json_object_keys(doc).isNotNull(), F.col(doc)))
        rows = rows.withColumn("_text", F.from_json("_doc", "map<string,string>")).withColumn("_typed", F.from_json("_doc", "map<string,variant>"))
        quoted = lambda e: F.regexp_replace(F.to_json(F.array(e)), r"^\[|\]\z", "")
        member = lambda n: F.when(F.schema_of_variant(F.col("_typed")[n]) == "STRING", quoted(F.col("_text")[n])).otherwise(F.col("_text")[n])
        rows = rows.withColumn("_members", F.filter(F.array(*[F.struct(F.lit(n).alias("n"), member(n).alias("raw")) for n in PUBLISHED]), lambda m: m["raw"].isNotNull()))
        kept = F.filter("_members", lambda m: F.length(m["raw"]) <= MEMBER_CHARS)
        listed = F.array_join(F.transform(kept, lambda m: F.concat(F.lit('"'), m["n"], F.lit('":'), m["raw"])), ",")
        more = F.when(F.col("_doc").isNull(), F.lit(',"metadata_unavailable":true')).otherwise(F.concat(F.lit(',"evidence":{'), listed, F.lit("}")))
        dropped = ~F.coalesce("_fits", F.lit(True)) | (F.size("_members") > F.size(kept))
    number = {"connection": 1, "endpoint": 2, "health": 3}[kind]
    ident = F.upper(F.sha2(F.concat_ws("|", F.lit(DATABASE), "revision", F.lit(number), "key"), 256))
    head = F.to_json(F.struct(F.lit("hslake.event/1").alias("schema"), ident.alias("id"), F.lit(DATABASE).alias("database_id"), "revision", F.lit(kind).alias("type"), F.col("time_us").alias("timestamp_us"), F.substring(F.coalesce("computer_name", F.lit("")), 1, COMPUTER_CHARS).alias("computer")), {"ignoreNullFields": "false"})
    open_ = lambda e: F.regexp_replace(e, r"\}\z", "")
    body = lambda fields, extra, mark: F.concat(open_(head), F.lit(',"payload":'), open_(fields), extra, F.lit("}"), mark, F.lit("}"))
    mark = F.lit(',"truncated":true')
    rows = rows.withColumn("_full", body(cut(FIELD_CHARS), more, F.when(long | dropped, mark).otherwise("")))
    # What is unavailable is still said in the short form; the document isn't.
    said = F.when(F.startswith(more, F.lit(',"metadata')), more).otherwise("") if doc else F.lit("")
    return rows.select(ident.alias("id"), F.when(F.octet_length("_full") <= EVENT_BYTES, F.col("_full")).otherwise(body(cut(SMALL_CHARS), said, mark)).alias("body"))


def _envelope_sql(kind: str, rows: str, doc: str | None = None) -> str:
    texts, numbers = FIELDS[kind]
    number = {"connection": 1, "endpoint": 2, "health": 3}[kind]
    cut = lambda n: "concat('{', " + ", ',', ".join([f"'\"{c}\":', to_json(left({c}, {n}))" for c in texts] + [f"'\"{c}\":', coalesce(cast({c} as varchar), 'null')" for c in numbers]) + ")"
    long = " or ".join([f"coalesce(length({c}) > {FIELD_CHARS}, false)" for c in texts] + [f"length(computer_name) > {COMPUTER_CHARS}"])
    ident = f"upper(sha256(concat_ws('|', '{DATABASE}', revision, {number}, key)))"
    more, dropped, said = "''", "false", "''"
    if doc:
        safe = f"case when json_valid({doc}) then {doc} end"
        raw = f"list_transform([{', '.join(repr(n) for n in PUBLISHED)}], lambda n, i: {{'n': n, 'raw': cast(json_extract({safe}, [{', '.join(repr('$.' + n) for n in PUBLISHED)}])[i] as varchar)}})"
        usable = f"(length({doc}) <= {DOCUMENT_CHARS} and coalesce(json_type({safe}) = 'OBJECT', false))"
        kept = f"list_filter({raw}, lambda m: length(m.raw) <= {MEMBER_CHARS})"
        more = f"case when {usable} then concat(',\"evidence\":{{', array_to_string(list_transform({kept}, lambda m: concat('\"', m.n, '\":', m.raw)), ','), '}}') else ',\"metadata_unavailable\":true' end"
        dropped = f"case when {usable} then len(list_filter({raw}, lambda m: length(m.raw) > {MEMBER_CHARS})) > 0 else length({doc}) > {DOCUMENT_CHARS} end"
        said = f"case when {usable} then '' else ',\"metadata_unavailable\":true' end"
    head = f"concat('{{\"schema\":\"hslake.event/1\",\"id\":\"', {ident}, '\",\"database_id\":\"{DATABASE}\",\"revision\":', revision, ',\"type\":\"{kind}\",\"timestamp_us\":', time_us, ',\"computer\":', to_json(left(coalesce(computer_name, ''), {COMPUTER_CHARS})), ',\"payload\":')"
    body = lambda fields, extra, mark: f"concat({head}, {fields}, {extra}, '}}', {mark}, '}}')"
    mark = "',\"truncated\":true'"
    full = body(cut(FIELD_CHARS), more, f"case when {long} or {dropped} then {mark} else '' end")
    return f"select {ident} as id, case when strlen({full}) <= {EVENT_BYTES} then {full} else {body(cut(SMALL_CHARS), said, mark)} end as body from {rows} r"


_ENVELOPES = " union all ".join([
    _envelope_sql("connection", f"(select *, change_revision as revision, cast(id as varchar) as key, first_us as time_us from {FLOWS} f)", "crypto_json"),
    _envelope_sql("endpoint", "(select e.*, s.computer_name, e.change_revision as revision, e.id as key, timestamp_us as time_us, detail_json from endpoint_events e left join sessions s on s.id = e.run_id left join endpoint_details d on d.id = e.id)", "detail_json"),
    _envelope_sql("health", "(select *, change_revision as revision, id as key, updated_us as time_us from sessions)"),
])


@query("event_envelope", _ENVELOPES)
def event_envelope(j):
    """The published events of all changes."""
    c = flows(j).select("*", F.col("change_revision").alias("revision"), F.col("id").cast("string").alias("key"), F.col("first_us").alias("time_us"))
    computers = j.sessions.select(F.col("id").alias("run_id"), "computer_name")
    e = j.endpoint_events.select("*", F.col("change_revision").alias("revision"), F.col("id").alias("key"), F.col("timestamp_us").alias("time_us"))
    e = e.join(computers, "run_id", "left").join(j.endpoint_details.select("id", "detail_json"), "id", "left")
    h = j.sessions.select("*", F.col("change_revision").alias("revision"), F.col("id").alias("key"), F.col("updated_us").alias("time_us"))
    return envelopes(c, "connection", "crypto_json").union(envelopes(e, "endpoint", "detail_json")).union(envelopes(h, "health"))


@query("safe_revision", "select coalesce(min(acknowledged), 0) as revision from consumers")
def safe_revision(j):
    return j.consumers.agg(F.coalesce(F.min("acknowledged"), F.lit(0)).alias("revision"))


CUTOFF = NOW_US - 1500 * 86400000000
QUIET = NOW_US - 300_000_000
#: Bytes that the connections may take: a row counts its document and a hundred more.
SIZE_LIMIT = 1_000_000
OCTETS = "length(crypto_json) + 100"


def _prunable_sql(cutoff: int) -> str:
    return f"(select c.* from connections c join sessions s on s.id = c.run_id where c.last_us < {cutoff} and (c.ended_us is not null or s.stopped_us is not null) and c.change_revision <= (select coalesce(min(acknowledged), 0) from consumers) and not exists (select 1 from connection_certificates l where l.run_id = c.run_id and l.flow_id = c.flow_id and l.change_revision > (select coalesce(min(acknowledged), 0) from consumers)))"


def prunable(j, cutoff: int = CUTOFF) -> DataFrame:
    """Connections last active before ``cutoff``, ended and acknowledged, whose links are acknowledged too."""
    safe = F.broadcast(j.consumers.agg(F.coalesce(F.min("acknowledged"), F.lit(0)).alias("safe")))
    c = j.connections.join(j.sessions.select(F.col("id").alias("run_id"), "stopped_us"), "run_id").crossJoin(safe)
    c = c.where((F.col("last_us") < cutoff) & (F.col("ended_us").isNotNull() | F.col("stopped_us").isNotNull()) & (F.col("change_revision") <= F.col("safe")))
    late = j.connection_certificates.crossJoin(safe).where("change_revision > safe").select("run_id", "flow_id")
    return c.join(late, ["run_id", "flow_id"], "left_anti")


@query("retention_age", f"select id, last_us from {_prunable_sql(CUTOFF)} p order by last_us, id limit 256")
def retention_age(j):
    return prunable(j).orderBy("last_us", "id").limit(256).select("id", "last_us")


_LIVE = f"(select coalesce(sum({OCTETS}), 0) as live from connections)"
_OLDEST = f"(select id, octet from (select id, octet, sum(octet) over (order by last_us, id) - octet as before from (select id, last_us, {OCTETS} as octet from {_prunable_sql(QUIET)} p) q) r, {_LIVE} l where before < live - {SIZE_LIMIT})"


def oversize(j, limit: int = SIZE_LIMIT, cutoff: int = QUIET) -> DataFrame:
    """(id, octet) of the connections that go when all of them together take more than ``limit`` bytes: of those quiet for five minutes, the oldest until the rest fits.

    Daily totals first, then a running sum within the days that matter, so that no task holds all rows.
    """
    octet = F.expr(OCTETS).cast("long")
    need = F.broadcast(j.connections.agg((F.coalesce(F.sum(octet), F.lit(0)) - limit).alias("need")))
    rows = prunable(j, cutoff).select("id", "last_us", octet.alias("octet"), F.expr("last_us div 86400000000").alias("day"))
    days = rows.groupBy("day").agg(F.sum("octet").alias("d"))
    days = days.withColumn("base", F.coalesce(F.sum("d").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).crossJoin(need).where("base < need")
    w = Window.partitionBy("day").orderBy("last_us", "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(days, "day").withColumn("before", F.col("base") + F.coalesce(F.sum("octet").over(w), F.lit(0))).where("before < need").select("id", "octet")


@query("retention_size", f"select id from {_OLDEST} o")
def retention_size(j):
    return oversize(j).select("id")


@query("retention_status", f"select live, live > {SIZE_LIMIT} as over, n as pruned, freed, live > {SIZE_LIMIT} and n = 0 as blocked from {_LIVE} l, (select count(*) as n, cast(coalesce(sum(octet), 0) as bigint) as freed from {_OLDEST} o) p")
def retention_status(j):
    return size_status(j)


def size_status(j, limit: int = SIZE_LIMIT, cutoff: int = QUIET) -> DataFrame:
    """One row: bytes held, whether that is too much, what goes, and whether nothing may go although it is too much."""
    live = j.connections.agg(F.coalesce(F.sum(F.expr(OCTETS).cast("long")), F.lit(0)).alias("live"))
    gone = oversize(j, limit, cutoff).agg(F.count("*").alias("pruned"), F.coalesce(F.sum("octet"), F.lit(0)).alias("freed"))
    over = F.col("live") > limit
    return live.crossJoin(F.broadcast(gone)).select("live", over.alias("over"), "pruned", "freed", (over & (F.col("pruned") == 0)).alias("blocked"))


@query("retention_events", f"select id from endpoint_events e where timestamp_us < 1705000000000000 and change_revision <= (select coalesce(min(acknowledged), 0) from consumers)")
def retention_events(j):
    safe = F.broadcast(j.consumers.agg(F.coalesce(F.min("acknowledged"), F.lit(0)).alias("safe")))
    return j.endpoint_events.crossJoin(safe).where("timestamp_us < 1705000000000000 and change_revision <= safe").select("id")


@query("retention_sessions", f"select id from past_sessions s where id <> 'run-24' and stopped_us < {CUTOFF} and started_us < {CUTOFF} and change_revision <= (select coalesce(min(acknowledged), 0) from consumers) and not exists (select 1 from connections c where c.run_id = s.id) and not exists (select 1 from endpoint_events e where e.run_id = s.id)")
def retention_sessions(j):
    return childless(j.past_sessions, j.connections, j.endpoint_events, j.consumers, "run-24")


def childless(sessions: DataFrame, connections: DataFrame, events: DataFrame, consumers: DataFrame, current: str, cutoff: int = CUTOFF) -> DataFrame:
    """Ids of the acknowledged sessions, other than the current one, that began and stopped before ``cutoff`` and have neither connections nor endpoint events left."""
    safe = F.broadcast(consumers.agg(F.coalesce(F.min("acknowledged"), F.lit(0)).alias("safe")))
    old = sessions.where((F.col("id") != current) & (F.col("stopped_us") < cutoff) & (F.col("started_us") < cutoff)).crossJoin(safe).where("change_revision <= safe").select(F.col("id").alias("run_id"))
    # The children are many, the sessions few: their runs are made distinct in each task before they travel.
    for children in (connections, events):
        old = old.join(children.select("run_id").distinct(), "run_id", "left_anti")
    return old.withColumnRenamed("run_id", "id")


@query("retention_http", "select id from (select id, sum(strlen(response_body)) over (order by id desc) as after from exchanges where started_us >= 1704067200000000) x where after > 200000")
def retention_http(j):
    """Oldest first until what stays is within the size: totals of id blocks, then a running sum within each block."""
    rows = j.exchanges.where("started_us >= 1704067200000000").select("id", F.octet_length("response_body").cast("long").alias("b"), F.expr("id div 4096").alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("b").alias("t"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("block").orderBy(F.desc("id"))
    return rows.join(blocks, "block").withColumn("after", F.col("base") + F.sum("b").over(w)).where("after > 200000").select("id")
