"""Baselines, nested documents, event properties and the server's tables."""

import pytest
from pyspark.sql import functions as F

from hslake.functions.nested import leaves, xml_leaves
from hslake.operators.taking import UNREADABLE, event_properties
from hslake.sources import baseline, fleet
from hslake.sources.shared import write_text

ROW = dict(computer="h", application="a", peer="p", total=10, first_us=1, last_us=2, pq_keys=4, classical_keys=3, unknown_keys=3, pq_auth=10, classical_auth=0, unknown_auth=0, complete=6, failures=4)
ABOUT = dict(database="d", scope="s", minutes=60, rules=["1"])


def frame(spark, *changes):
    rows = [ROW | c for c in changes]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in ROW.items()))


def test_baseline_round_trip(spark, tmp_path):
    path = str(tmp_path / "b")
    baseline.save_baseline(frame(spark, {}, {"peer": "q"}), path, **ABOUT)
    rows, about = baseline.load_baseline(spark, path)
    assert sorted(r.peer for r in rows.collect()) == ["p", "q"] and about == ABOUT | {"schema": 1}
    baseline.comparable(about, scope="s", minutes=60, rules=["1"])
    for other, reason in ((dict(scope="t", minutes=60, rules=["1"]), "scope"), (dict(scope="s", minutes=5, rules=["1"]), "window"), (dict(scope="s", minutes=60, rules=["2"]), "rules")):
        with pytest.raises(baseline.BaselineRefused, match=reason):
            baseline.comparable(about, **other)
    with pytest.raises(ValueError, match="exists"):
        baseline.save_baseline(frame(spark, {}), path, **ABOUT)
    baseline.save_baseline(frame(spark), str(tmp_path / "empty"), **ABOUT)
    assert baseline.load_baseline(spark, str(tmp_path / "empty"))[0].count() == 0
    with pytest.raises(baseline.BaselineRefused, match="no baseline"):
        baseline.load_baseline(spark, str(tmp_path / "none"))
    write_text(spark, f"{path}/about.json", "{")
    with pytest.raises(baseline.BaselineRefused, match="unreadable"):
        baseline.load_baseline(spark, path)


@pytest.mark.parametrize("changes,about,reason", [
    (({}, {"computer": "H"}), {}, "unique"), (({"pq_keys": 8},), {}, "key establishment"), (({"unknown_auth": 1},), {}, "server authentication"), (({"failures": 5},), {}, "completion"), (({"total": -1},), {}, "counts"), (({"pq_keys": 11},), {}, "counts"),
    (({"last_us": 0},), {}, "times"), (({"first_us": -1},), {}, "times"), (({"peer": "x" * 4097},), {}, "keys"), (({"peer": None},), {}, "keys"), (({}, {"peer": "q"}, {"peer": "r"}), {}, "narrow"),
    (({},), {"rules": [""]}, "rules"), (({},), {"minutes": -1}, "window"), (({},), {"database": ""}, "database"), (({},), {"scope": "x" * 40000}, "scope"),
])
def test_broken_baselines_are_refused(spark, tmp_path, changes, about, reason):
    with pytest.raises(baseline.BaselineRefused, match=reason):
        baseline.save_baseline(frame(spark, *changes), str(tmp_path / "b"), **(ABOUT | about), most_rows=2)
    assert not list(tmp_path.iterdir())


def test_leaves(spark):
    docs = ['{"b":{"y":[1,{"z":null}],"x":"t"},"a":true,"e":{},"l":[]}', "7", "{", None, '[["q"]]', '{"d":{"d":{"d":{"d":{"d":1}}}}}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    rows = sorted((r.id, r.path, r.value) for r in leaves(df.select("id", "doc"), F.col("doc"), 4).collect())
    assert rows == sorted([(0, "b.y[0]", "1"), (0, "b.y[1].z", ""), (0, "b.x", "t"), (0, "a", "true"), (0, "e", ""), (0, "l", ""), (1, "", "7"), (4, "[0][0]", "q"), (5, "d.d.d.d", '{"d":1}')])


def test_event_properties(spark):
    xml = "<E xmlns='x'><System>s</System><Data Name='User'>a &amp; b</Data><n:Deep xmlns:n='y'>v</n:Deep><Empty/></E>"
    got = [(r.name, r.value) for r in spark.createDataFrame([(xml,)], "d string").select(F.explode(xml_leaves(F.col("d"))).alias("l")).select("l.*").collect()]
    assert got == [("User", "a & b"), ("Deep", "v")]
    many = "{" + ",".join(f'"m{i}":{i}' for i in range(400)) + "}"
    rows = [(k, "HOST", "p", "k", None, 1, "peer", 443, "TLS", "run", d) for k, d in (("good", '{"z_y":"t","n":{"a":[1]}}'), ("bad", "{"), ("null", None), ("list", "[1]"), ("many", many), ("large", '{"a":"' + "x" * (2 << 20) + '"}'))]
    df = spark.createDataFrame(rows, "id string, computer_name string, provider string, kind string, result string, pid long, peer string, port long, protocol string, run_id string, detail_json string")
    by = {}
    for r in event_properties(df).orderBy("id", "place").collect():
        by.setdefault(r.id, []).append((r.category, r.caption, r.value))
    assert by["good"][0] == ("Endpoint evidence", "Collector computer", "HOST") and by["good"][1] == ("Endpoint evidence", "Provider", "p") and by["good"][-2:] == [("Provider metadata", "Z y", "t"), ("Provider metadata", "N", '{"a":[1]}')]
    for k in ("bad", "null", "list", "large"):
        assert len(by[k]) == 11 and by[k][1] == ("Endpoint evidence", "Provider metadata", UNREADABLE)
    assert len(by["many"]) == 256 and by["many"][-1][1] == "M245"


def test_fleet(spark, tmp_path):
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(500).selectExpr("id", "concat('n', id) as name", "id % 7 + 1 as change_revision")
    rows.write.format("jdbc").options(**options).option("dbtable", "flows").save()
    df = fleet.load_fleet(spark, "flows", options, parts=4)
    assert df.rdd.getNumPartitions() == 4 and sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.collect()))
    plan = df.where("change_revision = 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(CHANGE_REVISION), *EqualTo(CHANGE_REVISION,3)]" in plan.replace("change_revision", "CHANGE_REVISION")
    more = spark.createDataFrame([(3, "new", 9), (4, "old", 1), (600, "added", 2)], "id long, name string, change_revision long")
    assert fleet.merge_fleet(more, "flows", options, key=["id"]) == 2
    assert fleet.merge_fleet(more, "flows", options, key=["id"]) == 0
    now = {r.id: r.name for r in fleet.newest(fleet.load_fleet(spark, "flows", options), key=["id"]).collect()}
    assert len(now) == 501 and now[3] == "new" and now[4] == "n4" and now[600] == "added"
    spark.createDataFrame([], "id long, name string").write.format("jdbc").options(**options).option("dbtable", "empty").save()
    assert fleet.load_fleet(spark, "empty", options).count() == 0
