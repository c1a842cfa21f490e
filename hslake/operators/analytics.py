"""Analytics over a scope: totals, top values of each dimension, zero-filled timeline, shares, coverage and capture health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hslake.functions import text as T
from hslake.functions.scope import account
from hslake.operators.investigation import FLOWS, flows, js
from hslake.plans.registry import query
from hslake.sources.journal import NOW_US

#: Dimension: (its column, the checking SQL).
DIMENSIONS: dict[str, tuple] = {
    "transport": (lambda: F.coalesce(T.json_value("crypto_json", "transport"), F.lit("TCP")), f"coalesce({js('transport')}, 'TCP')"),
    "group_classification": (lambda: T.json_value("crypto_json", "group_class"), js("group_class")),
    "evidence_source": (lambda: T.json_value("crypto_json", "evidence_source"), js("evidence_source")),
    "cipher_suite": (lambda: F.col("cipher_name"), "cipher_name"),
    "key_exchange_group": (lambda: F.col("group_name"), "group_name"),
    "protocol": (lambda: F.col("tls_name"), "tls_name"),
    "server_name": (lambda: F.coalesce(T.nonempty("sni"), T.json_value("crypto_json", "http_host"), F.lit("")), f"coalesce(nullif(sni, ''), {js('http_host')}, '')"),
    "client_process": (lambda: F.col("source_process"), "source_process"),
    "server_process": (lambda: F.col("destination_process"), "destination_process"),
    "collector_computer": (lambda: F.col("computer_name"), "computer_name"),
    **{f"{n}_owner": (lambda s=s: F.when(F.col(f"{s}_account") == "", "").otherwise(account(s)), f"case when {s}_account = '' then '' else concat({s}_account_domain, chr(92), {s}_account) end") for n, s in (("client", "source"), ("server", "destination"))},
    "endpoint_confirmation": (lambda: T.json_value("crypto_json", "handshake_confirmation"), js("handshake_confirmation")),
    "key_exchange": (lambda: F.col("key_exchange"), "key_exchange"),
    "authentication": (lambda: F.col("authentication"), "authentication"),
    "encryption": (lambda: F.col("encryption"), "encryption"),
    "psk_selection": (lambda: F.col("psk_mode"), "psk_mode"),
    "plaintext_alert": (lambda: F.col("alert"), "alert"),
    "certificate_fingerprint": (lambda: F.col("certificate_sha256"), "certificate_sha256"),
    "observation_state": (lambda: F.col("state"), "state"),
}


def scope(j) -> DataFrame:
    """The narrow rows that all charts of a scope read."""
    return flows(j).where(F.col("first_us") >= 800000000000000)


SCOPE = f"(select * from {FLOWS} f where first_us >= 800000000000000)"


def topk(df: DataFrame, dimension: Column, k: int) -> DataFrame:
    label = F.coalesce(T.nonempty(dimension), F.lit("Not observed"))
    out = df.groupBy(label.alias("value")).agg(F.count("*").alias("observations"), F.avg("hello_latency_us").alias("mean_us"), F.max("hello_latency_us").alias("max_us"))
    return out.withColumn("mean_us", F.round("mean_us", 3)).orderBy(F.desc("observations"), "value").limit(k)


def _topk_sql(sql: str, k: int) -> str:
    return f"select coalesce(nullif({sql}, ''), 'Not observed') as value, count(*) as observations, round(avg(hello_latency_us), 3) as mean_us, max(hello_latency_us) as max_us from {SCOPE} s group by 1 order by observations desc, value limit {k}"


for _name, (_column, _sql) in DIMENSIONS.items():
    query(f"dimension_{_name}", _topk_sql(_sql, 20))(lambda j, c=_column: topk(scope(j), c(), 20))


@query("topk_breakdown", _topk_sql("destination_process", 5))
def topk_breakdown(j):
    return topk(scope(j), F.col("destination_process"), 5)


@query("topk_protocols", _topk_sql("tls_name", 10))
def topk_protocols(j):
    return topk(scope(j), F.col("tls_name"), 10)


@query("topk_groups", _topk_sql("group_name", 10))
def topk_groups(j):
    return topk(scope(j), F.col("group_name"), 10)


def summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count("tls_version").alias("selections"), F.count_if(F.col("alert") != "").alias("alerts"), F.round(F.avg("hello_latency_us"), 3).alias("mean_us"), F.min("first_us").alias("first_us"), F.max("first_us").alias("last_us"))


@query("analytics_summary", f"select count(*) as total, count(tls_version) as selections, count(*) filter (where alert <> '') as alerts, round(avg(hello_latency_us), 3) as mean_us, min(first_us) as first_us, max(first_us) as last_us from {SCOPE} s")
def analytics_summary(j):
    return summary(scope(j))


@query("analytics_scope", f"select id, first_us, tls_name, group_name, hello_latency_us, alert from {SCOPE} s")
def analytics_scope(j):
    return scope(j).select("id", "first_us", "tls_name", "group_name", "hello_latency_us", "alert")


def timeline(df: DataFrame, buckets: int = 60) -> DataFrame:
    """Observations in equal buckets from the first to the last, empty ones too; the width comes from the scope itself."""
    ends = df.agg(F.min("first_us").alias("a"), F.max("first_us").alias("b")).withColumn("width", F.expr(f"greatest(1000000, (b - a) div {buckets} + 1)"))
    ends = ends.select("width", F.expr("a div width").alias("a"), F.expr("b div width").alias("b"))
    slots = ends.select("width", F.explode(F.sequence("a", "b")).alias("slot"))
    counted = df.crossJoin(F.broadcast(ends.select("width"))).groupBy(F.expr("first_us div width").alias("slot")).agg(F.count("*").alias("n"))
    return slots.join(counted, "slot", "left").select((F.col("slot") * F.col("width")).alias("bucket_us"), F.coalesce("n", F.lit(0)).alias("n"))


@query("timeline", f"""with s as (select first_us from {SCOPE} x), e as (select greatest(1000000, (max(first_us) - min(first_us)) // 60 + 1) as width, min(first_us) as a, max(first_us) as b from s),
 slots as (select width, unnest(range(a // width, b // width + 1)) as slot from e), n as (select first_us // width as slot, count(*) as n from s, e group by 1)
 select slot * width as bucket_us, coalesce(n, 0) as n from slots left join n using (slot)""")
def timeline_query(j):
    return timeline(scope(j))


@query("share_percent", f"select tls_name, round(100.0 * count(*) / (select count(*) from {SCOPE} s), 6) as percent from {SCOPE} s group by tls_name")
def share_percent(j):
    rows = scope(j)
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy("tls_name").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("tls_name", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 6).alias("percent"))


@query("topn_tiebreak", f"select destination_port, n from (select destination_port, count(*) as n from {SCOPE} s group by 1) t order by n desc, destination_port limit 1")
def topn_tiebreak(j):
    return scope(j).groupBy("destination_port").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "destination_port").limit(1)


_GUARDED = r"replace(case when regexp_matches(value, '^\s*[=+@\-\t\r]') then concat(chr(39), value) else value end, chr(34), chr(34) || chr(34))"
_MS = "coalesce(cast(cast(round({e}, 3) as decimal(18, 3)) as varchar), '')"
_TOPS = " union all ".join(f"select * from (select '{n}' as dimension, coalesce(nullif({sql}, ''), 'Not observed') as value, count(*) as n, avg(hello_latency_us) / 1000 as mean_ms, max(hello_latency_us) / 1000 as max_ms from {SCOPE} s group by 2 order by n desc, value limit 20)" for n, (_, sql) in DIMENSIONS.items())


@query("export_analytics_csv", f"select dimension, value, concat(chr(34), dimension, chr(34), ',', chr(34), {_GUARDED}, chr(34), ',', n, ',', (select count(*) from {SCOPE} s), ',', {_MS.format(e='mean_ms')}, ',', {_MS.format(e='max_ms')}) as line from ({_TOPS}) t")
def export_analytics_csv(j):
    """Dimension, value, observations, scope total, mean and maximum hello in milliseconds (empty if none was measured) of the twenty commonest values of every dimension."""
    return analytics_csv(scope(j), 20)


def analytics_csv(rows: DataFrame, k: int) -> DataFrame:
    """One pass for all dimensions: each row's values are exploded and summed in the tasks before they travel, and the tops are cut off before the sort."""
    from hslake.operators.investigation import csv_quote

    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(T.nonempty(c()), F.lit("Not observed")).alias("value")) for n, (c, _) in DIMENSIONS.items()])).alias("p")
    sums = rows.select("hello_latency_us", pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"), F.avg("hello_latency_us").alias("mean"), F.max("hello_latency_us").alias("max"))
    top = sums.withColumn("place", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))).where(F.col("place") <= k)
    ms = lambda c: F.coalesce(F.round(F.col(c) / 1000, 3).cast("decimal(18,3)").cast("string"), F.lit(""))
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    return top.crossJoin(total).select("dimension", "value", F.concat_ws(",", csv_quote(F.col("dimension")), csv_quote(F.col("value")), "n", "total", ms("mean"), ms("max")).alias("line"))


LOSSES = "capture_lost + queue_lost + storage_lost + process_events_lost + telemetry_lost"


@query("coverage_by_computer", f"select computer_name, count(*) as sessions, sum(packets) as packets, sum({LOSSES}) as losses, sum(truncated) as truncated, sum(flow_limit + reassembly_limit) as limits, max(updated_us) as updated_us from sessions where started_us <= 790000000000000 and coalesce(stopped_us, updated_us) >= 788918400000000 group by 1")
def coverage_by_computer(j):
    inside = (F.col("started_us") <= 790000000000000) & (F.coalesce("stopped_us", "updated_us") >= 788918400000000)
    s = lambda e, name: F.sum(F.expr(e)).alias(name)
    return j.sessions.where(inside).groupBy("computer_name").agg(F.count("*").alias("sessions"), s("packets", "packets"), s(LOSSES, "losses"), s("truncated", "truncated"), s("flow_limit + reassembly_limit", "limits"), F.max("updated_us").alias("updated_us"))


@query("capture_health", f"select id, case when status = 'running' and 996710420000000 - updated_us > 10000000 then 'No recent heartbeat' else status end as health, {LOSSES} as losses from sessions order by updated_us desc, id limit 1")
def capture_health(j):
    last = j.sessions.orderBy(F.desc("updated_us"), "id").limit(1)
    stale = (F.col("status") == "running") & (F.lit(996710420000000) - F.col("updated_us") > 10_000_000)
    return last.select("id", F.when(stale, "No recent heartbeat").otherwise(F.col("status")).alias("health"), F.expr(LOSSES).alias("losses"))


@query("heartbeat_upsert", "select computer_name, max(updated_us) as updated_us, max_by(packets, updated_us) as packets from sessions group by 1")
def heartbeat_upsert(j):
    return j.sessions.groupBy("computer_name").agg(F.max("updated_us").alias("updated_us"), F.max_by("packets", "updated_us").alias("packets"))


@query("http_capture_summary", "select s.id as run_id, s.computer_name, count(x.id) as exchanges, count(*) filter (where x.state = 'complete') as complete, count(*) filter (where x.state = 'partial') as partial, count(*) filter (where x.state = 'encrypted') as encrypted, coalesce(sum(strlen(x.response_body)), 0) as bytes from (select * from sessions order by started_us desc, id desc limit 1) s left join exchanges x on x.run_id = s.id group by 1, 2")
def http_capture_summary(j):
    """The latest session's exchanges by state; zeros if it has none."""
    latest = F.broadcast(j.sessions.select(F.struct("started_us", F.col("id").alias("run_id"), "computer_name").alias("s")).agg(F.max("s").alias("s")).select("s.run_id", "s.computer_name"))
    of = lambda state: F.count_if(F.col("state") == state).alias(state)
    sums = j.exchanges.join(F.broadcast(latest.select("run_id")), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("exchanges"), of("complete"), of("partial"), of("encrypted"), F.sum(F.octet_length("response_body").cast("long")).alias("bytes"))
    return latest.join(sums, "run_id", "left").fillna(0, ["exchanges", "complete", "partial", "encrypted", "bytes"])


@query("recover_sessions", f"select id, case when status = 'running' and {NOW_US + 10**9} - updated_us > 30000000 then 'interrupted' else status end as status, case when status = 'running' and {NOW_US + 10**9} - updated_us > 30000000 then updated_us else stopped_us end as stopped_us from sessions")
def recover_sessions(j):
    dead = (F.col("status") == "running") & (F.lit(NOW_US + 10**9) - F.col("updated_us") > 30_000_000)
    return j.sessions.select("id", F.when(dead, "interrupted").otherwise(F.col("status")).alias("status"), F.when(dead, F.col("updated_us")).otherwise(F.col("stopped_us")).alias("stopped_us"))
