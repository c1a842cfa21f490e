"""Certificate inventory: uses, key reuse, applications and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hslake.functions import text as T
from hslake.operators.investigation import EVENTS, FLOWS, events, flows
from hslake.plans.registry import query

USES = f"""(select l.sha256, 'packet' as source, l.role, f.computer_name, f.source_process as app, f.destination_process as app2, coalesce(nullif(f.sni, ''), f.destination_address) as peer, f.first_us, f.last_us, concat('c', f.flow_id) as observation
 from connection_certificates l join {FLOWS} f on f.run_id = l.run_id and f.flow_id = l.flow_id
 union all select l.sha256, 'endpoint', e.local_role, e.computer_name, e.provider, '', e.peer, coalesce(e.operation_us, e.timestamp_us), e.timestamp_us, concat('e', e.id) from endpoint_certificates l join {EVENTS} e on e.id = l.event_id)"""


def certificate_uses(j) -> DataFrame:
    """Uses seen in packets and reported by endpoints, in one shape."""
    packet = j.connection_certificates.select("run_id", "flow_id", "role", "sha256").join(flows(j).drop("certificate_sha256"), ["run_id", "flow_id"])
    packet = packet.select("sha256", F.lit("packet").alias("source"), "role", "computer_name", F.col("source_process").alias("app"), F.col("destination_process").alias("app2"), F.coalesce(T.nonempty("sni"), "destination_address").alias("peer"), "first_us", "last_us", F.concat(F.lit("c"), "flow_id").alias("observation"))
    told = j.endpoint_certificates.withColumnRenamed("event_id", "id").join(events(j), "id")
    told = told.select("sha256", F.lit("endpoint").alias("source"), F.col("local_role").alias("role"), "computer_name", F.col("provider").alias("app"), F.lit("").alias("app2"), "peer", F.coalesce("operation_us", "timestamp_us").alias("first_us"), F.col("timestamp_us").alias("last_us"), F.concat(F.lit("e"), "id").alias("observation"))
    return packet.unionByName(told)


@query("certificate_uses", f"select * from {USES} u")
def uses(j):
    return certificate_uses(j)


@query("union_all_uses", f"select source, count(*) as n, count(distinct sha256) as certificates from {USES} u group by source")
def union_all_uses(j):
    return certificate_uses(j).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("sha256").alias("certificates"))


@query("distinct_uses", f"select distinct sha256, source, role, computer_name, app, peer from {USES} u")
def distinct_uses(j):
    return certificate_uses(j).select("sha256", "source", "role", "computer_name", "app", "peer").distinct()


@query("key_reuse", "select spki_sha256, count(*) as certificates from certificates where length(spki_sha256) > 0 group by 1")
def key_reuse(j):
    return j.certificates.where(F.length("spki_sha256") > 0).groupBy("spki_sha256").agg(F.count("*").alias("certificates"))


def usage(j) -> DataFrame:
    seen = certificate_uses(j).groupBy("sha256", "observation", "computer_name").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return seen.groupBy("sha256").agg(F.count_distinct("observation").alias("observations"), F.count_distinct("computer_name").alias("computers"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


USAGE = f"(select sha256, count(distinct observation) as observations, count(distinct computer_name) as computers, min(first_us) as first_us, max(last_us) as last_us from {USES} u group by 1)"


@query("cert_usage", f"select * from {USAGE} u")
def cert_usage(j):
    return usage(j)


def applications(j) -> DataFrame:
    names = certificate_uses(j).select("sha256", F.explode(F.array("app", "app2")).alias("app"))
    return names.groupBy("sha256").agg(F.count_distinct(T.nonempty("app")).alias("applications"))


APPS = f"(select sha256, count(distinct nullif(app, '')) as applications from (select sha256, app from {USES} u union all select sha256, app2 from {USES} u) t group by 1)"


@query("cert_applications", f"select * from {APPS} a")
def cert_applications(j):
    return applications(j)


@query("union_apps", f"select app, count(*) as n from (select app from {USES} u union all select app2 from {USES} u) t where app <> '' group by 1")
def union_apps(j):
    return certificate_uses(j).select(F.explode(F.array("app", "app2")).alias("app")).where("app <> ''").groupBy("app").agg(F.count("*").alias("n"))


@query("cert_inventory_join", f"select c.sha256, c.subject, coalesce(u.observations, 0) as observations, coalesce(a.applications, 0) as applications, count(*) over (partition by c.spki_sha256) as same_key from certificates c left join {USAGE} u on u.sha256 = c.sha256 left join {APPS} a on a.sha256 = c.sha256")
def cert_inventory_join(j):
    reuse = j.certificates.groupBy("spki_sha256").agg(F.count("*").alias("same_key"))
    out = j.certificates.join(usage(j), "sha256", "left").join(applications(j), "sha256", "left").join(reuse, "spki_sha256")
    return out.select("sha256", "subject", F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("applications", F.lit(0)).alias("applications"), "same_key")


@query("cert_use_groups", f"select sha256, source, role, app, peer, count(*) as n, min(first_us) as first_us, max(last_us) as last_us from (select distinct * from {USES} u) t group by all order by last_us desc, sha256, source, role, app, peer limit 250")
def cert_use_groups(j):
    keys = ["sha256", "source", "role", "app", "peer"]
    groups = certificate_uses(j).distinct().groupBy(*keys).agg(F.count("*").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return groups.orderBy(F.desc("last_us"), *keys).limit(250)


@query("search_certificates", f"select sha256 from certificates c where contains(lower(subject), 'svc-7') or exists (select 1 from {USES} u where u.sha256 = c.sha256 and contains(lower(u.peer), 'svc-7'))")
def search_certificates(j):
    used = certificate_uses(j).where(T.contains(F.col("peer"), "SVC-7")).select("sha256").distinct()
    direct = j.certificates.where(T.contains(F.col("subject"), "SVC-7")).select("sha256")
    return direct.union(j.certificates.select("sha256").join(used, "sha256", "left_semi")).distinct()


@query("cert_lookup", "select flow_id, list({'role': role, 'chain_index': chain_index, 'subject': subject, 'public_key_class': public_key_class} order by role, chain_index)[1:64] as chain from connection_certificates l join certificates c on c.sha256 = l.sha256 group by flow_id")
def cert_lookup(j):
    rows = j.connection_certificates.join(j.certificates.drop("change_revision"), "sha256")
    listed = F.sort_array(F.collect_list(F.struct("role", "chain_index", "subject", "public_key_class")))
    return rows.groupBy("flow_id").agg(F.slice(listed, 1, 64).alias("chain"))


FACTS = "(select run_id, flow_id, string_agg(concat(lower(role), '|', public_key_class, '|', certificate_signature_class), ',' order by role, chain_index) as facts from connection_certificates l join certificates c on c.sha256 = l.sha256 group by 1, 2)"


def cert_facts(j) -> DataFrame:
    """The ordered certificate facts of each connection."""
    rows = j.connection_certificates.select("run_id", "flow_id", "role", "chain_index", "sha256").join(j.certificates.drop("change_revision"), "sha256")
    fact = F.concat_ws("|", F.lower("role"), "public_key_class", "certificate_signature_class")
    listed = rows.groupBy("run_id", "flow_id").agg(F.sort_array(F.collect_list(F.struct("role", "chain_index", fact.alias("fact")))).alias("l"))
    return listed.select("run_id", "flow_id", F.array_join("l.fact", ",").alias("facts"))


@query("cert_facts", f"select c.flow_id, coalesce(facts, '') as facts from connections c left join {FACTS} f on f.run_id = c.run_id and f.flow_id = c.flow_id")
def cert_facts_query(j):
    return j.connections.select("run_id", "flow_id").join(cert_facts(j), ["run_id", "flow_id"], "left").select("flow_id", F.coalesce("facts", F.lit("")).alias("facts"))


@query("certificate_refs", "select flow_id, list(concat(lower(role), ' ', chain_index, '|', sha256) order by role, chain_index) as refs from connection_certificates group by 1")
def certificate_refs(j):
    ref = F.concat(F.lower("role"), F.lit(" "), "chain_index", F.lit("|"), "sha256")
    listed = j.connection_certificates.groupBy("flow_id").agg(F.sort_array(F.collect_list(F.struct("role", "chain_index", ref.alias("ref")))).alias("l"))
    return listed.select("flow_id", F.array_distinct("l.ref").alias("refs"))


@query("orphan_certs", "select sha256 from certificates c where not exists (select 1 from connection_certificates l where l.sha256 = c.sha256) and not exists (select 1 from endpoint_certificates l where l.sha256 = c.sha256)")
def orphan_certs(j):
    return j.certificates.select("sha256").join(j.connection_certificates, "sha256", "left_anti").join(j.endpoint_certificates, "sha256", "left_anti")
