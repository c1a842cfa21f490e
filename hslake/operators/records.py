"""Details, inventories and record checks: wide projections, report validation, metadata typing, sets of rows over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hslake.functions import text as T
from hslake.functions.scope import Scope
from hslake.operators.investigation import FLOWS, SAFE, flows, js
from hslake.operators.analytics import DIMENSIONS
from hslake.plans.registry import query


@query("json_scalar_bigint", f"select id, case when len(list_filter(json_keys({SAFE}), lambda k: k = 'ssh_host_key_bits')) = 1 and try_cast({js('ssh_host_key_bits')} as bigint) between 0 and 65535 then try_cast({js('ssh_host_key_bits')} as bigint) end as bits from connections")
def json_scalar_bigint(j):
    return j.connections.select("id", T.json_scalar_bigint("crypto_json", "ssh_host_key_bits", 0, 65535).alias("bits"))


def report_reasons() -> Column:
    """Why a report is refused; an empty list accepts it."""
    rules = [(F.col("pid").isNull() | ~F.col("pid").between(1, 4294967295), "pid is out of range"), (F.col("started_us") > F.col("timestamp_us"), "operation ends before it starts"), (~F.col("protocol").isin("TLS 1.2", "TLS 1.3"), "protocol is not supported"), (F.col("source_port") > 65535, "port is out of range")]
    return F.filter(F.array(*[F.when(t, r) for t, r in rules]), lambda r: r.isNotNull())


REASONS = "[r for r in [case when pid is null or not pid between 1 and 4294967295 then 'pid is out of range' end, case when started_us > timestamp_us then 'operation ends before it starts' end, case when protocol not in ('TLS 1.2', 'TLS 1.3') then 'protocol is not supported' end, case when source_port > 65535 then 'port is out of range' end] if r is not null]"


@query("report_validate", f"select report_id, len({REASONS}) = 0 as accepted, array_to_string({REASONS}, '; ') as reasons from reports")
def report_validate(j):
    return j.reports.select("report_id", (F.size(report_reasons()) == 0).alias("accepted"), F.array_join(report_reasons(), "; ").alias("reasons"))


@query("provider_normalize", "select id, case local_role when 'Client' then 'client' when 'Server' then 'server' else 'unknown' end as role, case protocol when 'TLS 1.2' then 771 when 'TLS 1.3' then 772 end as version, lower(peer) as peer, port from endpoint_events")
def provider_normalize(j):
    versions = F.create_map(F.lit("TLS 1.2"), F.lit(771), F.lit("TLS 1.3"), F.lit(772))
    role = F.when(F.col("local_role").isin("Client", "Server"), F.lower("local_role")).otherwise("unknown")
    return j.endpoint_events.select("id", role.alias("role"), versions[F.col("protocol")].alias("version"), F.lower("peer").alias("peer"), "port")


@query("cert_metadata_fields", "select sha256, subject, issuer, not_before_us, greatest(not_before_us, not_after_us) as not_after_us from certificates")
def cert_metadata_fields(j):
    """Fields read back from a certificate's JSON document, each used only if it occurs once with the right type."""
    doc = j.certificates.select("sha256", F.to_json(F.struct("subject", "issuer", "not_before_us", F.greatest("not_before_us", "not_after_us").alias("not_after_us"))).alias("doc"))
    low, high = -62135596800000000, 253402300799999999
    return doc.select("sha256", T.json_scalar_text("doc", "subject").alias("subject"), T.json_scalar_text("doc", "issuer").alias("issuer"), T.json_scalar_bigint("doc", "not_before_us", low, high).alias("not_before_us"), T.json_scalar_bigint("doc", "not_after_us", low, high).alias("not_after_us"))


@query("oid_list_parse", "select issuer, list_sort(list_distinct(list(concat('1.2.840.', supplier % 7)))) as oids from certificates group by issuer")
def oid_list_parse(j):
    """Distinct valid object identifiers of a comma list."""
    text = j.certificates.groupBy("issuer").agg(F.array_join(F.collect_list(F.concat(F.lit(" 1.2.840."), (F.col("supplier") % 7).cast("string"))), ",").alias("v"))
    valid = F.filter(F.transform(F.split("v", ","), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(r"^[0-2](\.[0-9]+)+$")))
    return text.select("issuer", F.sort_array(F.array_distinct(valid)).alias("oids"))


@query("dimensions", "select dimension, count(distinct value) as n_values from (" + " union all ".join(f"select '{n}' as dimension, coalesce({sql}, '') as value from {FLOWS} f" for n, (_, sql) in DIMENSIONS.items()) + ") x group by 1")
def dimensions(j):
    """How many values each dimension has, unobserved ones counted as one; a connection's values are exploded and repeated ones dropped before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(c(), F.lit("")).alias("value")) for n, (c, _) in DIMENSIONS.items()])).alias("p")
    return flows(j).select(pairs).select("p.*").distinct().groupBy("dimension").agg(F.count("*").alias("n_values"))


@query("consumer_ack", "select c.name, c.acknowledged, max(r.change_revision) - c.acknowledged as behind from consumers c cross join connections r group by 1, 2")
def consumer_ack(j):
    top = j.connections.agg(F.max("change_revision").alias("top"))
    return j.consumers.crossJoin(F.broadcast(top)).select("name", "acknowledged", (F.col("top") - F.col("acknowledged")).alias("behind"))


@query("cursor_guard", "select c.name, c.acknowledged <= max(r.change_revision) as valid from consumers c cross join connections r group by c.name, c.acknowledged")
def cursor_guard(j):
    """A cursor beyond the journal's last revision shows that the source was replaced."""
    top = j.connections.agg(F.max("change_revision").alias("top"))
    return j.consumers.crossJoin(F.broadcast(top)).select("name", (F.col("acknowledged") <= F.col("top")).alias("valid"))


INPUT = r"""(?i)(<input\b[^'">]*(?:"[^"]*"[^'">]*|'[^']*'[^'">]*)*>)"""
ATTRIBUTE = r"""([A-Za-z_:][A-Za-z0-9_:.-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))"""
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _said(name: str) -> str:
    one = f"list_filter(attrs, lambda a: lower(trim(split_part(a, '=', 1))) = '{name}')[-1]"
    e = f"""regexp_replace(trim(substr({one}, strpos({one}, '=') + 1)), '^["'']|["'']$', '', 'g')"""
    for k, v in ENTITIES.items():
        e = f"replace({e}, '{k}', {_quoted(v)})"
    return e


@query("html_form_fields", f"select id, name, value from (select id, position, {_said('name')} as name, {_said('value')} as value from (select id, position, regexp_extract_all(tag, {_quoted(ATTRIBUTE)}, 1) as attrs from (select id, unnest(tags) as tag, unnest(range(len(tags))) as position from (select id, regexp_extract_all(body, {_quoted(INPUT)}, 1) as tags from markup) a) b) c) d where name is not null and value is not null")
def html_form_fields(j):
    return form_fields(j.markup.select("id", F.col("body").alias("html")))


def form_fields(df: DataFrame) -> DataFrame:
    """(id, name, value) of the inputs in each (id, html) that have both.

    Attributes may come in any order and with either quotes or none; text in quotes isn't read as attributes or as a tag's end; of repeated attributes the last counts, and character references are decoded.
    """
    tags = df.select("id", F.explode(F.regexp_extract_all("html", F.lit(INPUT), F.lit(1))).alias("tag"))
    rows = tags.select("id", F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(1)).alias("attrs"))

    def said(name: str) -> Column:
        one = F.try_element_at(F.filter("attrs", lambda a: F.lower(F.trim(F.split_part(a, F.lit("="), F.lit(1)))) == name), F.lit(-1))
        out = F.regexp_replace(F.trim(F.substr(one, F.instr(one, "=") + 1)), r"""^["']|["']\z""", "")
        for k, v in ENTITIES.items():
            out = F.replace(out, F.lit(k), F.lit(v))
        return out

    return rows.select("id", said("name").alias("name"), said("value").alias("value")).where("name is not null and value is not null")


SAVED = Scope(protocol="TLS 1.3", conditions=(("ServerPort", "equals", "8443"), ("Process", "observed", "")), include_loopback=False)


@query("saved_search_io", f"select id from {FLOWS} f where tls_name = 'TLS 1.3' and destination_port = 8443 and (source_process <> '' or source_path <> '' or destination_process <> '') and not (starts_with(source_address, '127.') or starts_with(destination_address, '127.') or source_address = destination_address)")
def saved_search_io(j):
    """The rows that a search selects after it was written as JSON and read back."""
    return flows(j).where(Scope.from_json(SAVED.to_json()).column()).select("id")
