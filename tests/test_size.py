"""What large tables need: shuffle files that go with their job, connections that travel once, busy cells and rounds that change no row."""

import os
from pathlib import Path

import pytest
from checking import assert_same, shown, tables
from pyspark.sql import functions as F

import __spark_entry__
from hslake.functions.nested import by_document
from hslake.operators import correlation, details, ownership, taking
from hslake.sources.journal import load_journal, oracle
from hslake.sources.shared import CLEANUP, shared_folder, stored

SMALL = "/root/testdata/sf0.001"


def shuffles(spark) -> set:
    return {f for d in {os.environ.get("SPARK_LOCAL_DIRS"), spark.conf.get("spark.local.dir")} - {None} for f in Path(d).rglob("shuffle_*.data")}


def test_stored_tables_leave_no_shuffle_files(spark):
    rows, before = spark.range(1000).repartition(3, "id"), shuffles(spark)
    kept = stored(rows)
    assert not shuffles(spark) - before and spark.conf.get(CLEANUP) == "false" and kept.count() == 1000
    rows.write.format("noop").mode("overwrite").save()
    assert shuffles(spark) - before


def test_rounds_and_busy_cells_find_the_same_pairs(spark):
    j = load_journal(spark, SMALL)
    sql = oracle(f"select report_id, flow_id, timestamp_us from {correlation.CANDIDATES} x")
    want = sorted(map(shown, tables(SMALL).execute(sql).fetchall()))
    for many, rows in ((0, 1000), (1, 10**9)):
        got = sorted(shown(tuple(r)) for r in correlation.found(j.endpoint_reports, correlation.observed(j), many, rows).collect())
        assert got == want and len(want) > 1000


def test_a_busy_process_makes_no_pairs_of_other_peers(spark):
    n = 400
    c = spark.range(n).selectExpr("'r' run_id", "concat('s', id) source_address", "1L source_port", "concat('d', id) destination_address", "2L destination_port", "id flow_id", "5000000L first_us", "5000100L last_us", "7L source_pid", "0L source_started_us",
        "7L destination_pid", "9999L destination_started_us", "0 tls_version", "'' own_cipher", "concat('N', id) sni", "'TLS' protocol", "'TCP' own_transport", "1L own_group")
    r = c.selectExpr("concat('p', flow_id) report_id", "run_id", "'partial' kind", "true client", "true role_known", "source_address local_address", "source_port local_port", "if(flow_id % 2 = 0, '', destination_address) remote_address", "if(flow_id % 3 = 0, 0L, 2L) remote_port",
        "upper(sni) peer_name", "7L pid", "0L process_started_us", "first_us started_us", "last_us timestamp_us", "'TCP' transport", "0 version", "'' cipher_name", "-1L group_id")
    for many in (10, 10**9):
        assert sorted((x.report_id, x.flow_id) for x in correlation.found(r, c, many).collect()) == sorted((f"p{i}", i) for i in range(n))


def test_socket_rounds_find_the_same_owners_and_leave_only_them(spark):
    j = load_journal(spark, SMALL)
    c = j.connections.selectExpr("id", "source_address", "source_port", "first_us", "last_us")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    names = lambda: {x for x in folder.iterdir() if x.name.split("-")[0] in ("sockets", "stretches", "found")}
    before = names()
    one, many = (ownership.socket_owners(c, j.socket_history, j.lifespans, n) for n in (10**9, 2000))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() > 1000
    assert len({f.rpartition("/")[0] for f in many.inputFiles()}) > 2 and names() == before


def test_documents_are_read_once_where_they_are_few(spark):
    docs = ['{"http_hosts":["a",{"b":1}],"krb_ticket":{"e":"x"}}', "{", None, '{"http_hosts":[]}', ""]
    rows = spark.createDataFrame([(i, docs[i % 5]) for i in range(40)], "id long, crypto_json string")
    seen = []
    read = lambda df: (seen.append(df.count()), taking.components(df))[1]
    few, many = (sorted((x.id, x.path, x.value) for x in by_document(rows, "crypto_json", read, n).collect()) for n in (10**6, 0))
    assert few == many and len(few) == 8 * 3 + 8 and seen == [5, 40]


def test_profile_counts_properties_where_they_stand(spark):
    wide = details.details(details.detailed(load_journal(spark, SMALL)))
    counts = details.properties(wide).groupBy("observed_protocol", "category", "caption").agg(F.count("*").alias("n"), F.count_if(F.col("value") != "Not observed").alias("observed"))
    made = details.profile(wide)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, counts.collect()))
    # Only counts become rows.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate", plan.index("Generate"))


@pytest.mark.parametrize("name", ["policy_summary", "readiness_histogram", "nested_evidence_rows"])
def test_queries_equal_their_sql(spark, name):
    assert_same(spark, SMALL, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
