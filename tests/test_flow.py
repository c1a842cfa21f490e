"""Interval joins, ownership, streams, replication, pacing and publishing against brute force, with restarts and crashes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hslake.functions.intervals import binned_pairs, covering, next_in_key
from hslake.operators import ownership
from hslake.sources import shared
from hslake.streaming import matching, pacing
from hslake.streaming.replication import Replica, SourceRolledBack


def test_covering_is_exact_and_linear_for_a_hot_key(spark):
    rng = random.Random(1)
    spans = [(k, s, s + rng.choice([1, 5_000, 3_000_000, 10**10])) for k in "ab" for s in (rng.randrange(10**11) for _ in range(150))] + [("a", 5, None)]
    rows = [(i, rng.choice("aaab"), rng.randrange(11 * 10**10)) for i in range(300)]
    left, right = spark.createDataFrame(rows, "id long, k string, at long"), spark.createDataFrame(spans, "k string, s long, e long")
    got = sorted((r.id, r.s) for r in covering(left, right, ["k"], "at", "s", "e").collect())
    assert got == sorted((i, s) for i, k, t in rows for q, s, e in spans if k == q and s <= t and (e is None or t < e))
    day = 86_400_000_000
    for n in (200, 400):
        lives = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * day).alias("s"), F.when(F.col("id") % 3 > 0, (F.col("id") + 1) * day).otherwise(F.col("id") * day + day // 50).alias("e"))
        seen = spark.range(n * 10).select(F.lit("hot").alias("k"), F.expr(f"id * {day // 10}").alias("at"))
        assert binned_pairs(seen, lives, ["k"], "at", "s", "e").count() <= 4 * n * 10
    assert covering(left.where("false"), right, ["k"], "at", "s", "e").count() == 0 == covering(left, right.where("false"), ["k"], "at", "s", "e").count()


def test_next_in_key_crosses_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(60)) for _ in range(80)]
    got = sorted((r.k, r.t, r.n or -1) for r in next_in_key(spark.createDataFrame(rows, "k string, t long"), ["k"], "t", "n", 7).collect())
    assert got == sorted((k, t, min((u for q, u in rows if q == k and u > t), default=-1)) for k, t in rows)


def owner_of(lives, first, last):
    """The rule said plainly: one lifetime overlaps, it contains the interval, and no newer one starts before the interval's end."""
    until = lambda s, e, v: e if e is not None else v
    over = [x for x in lives if x[0] <= last and until(*x) >= first and (x[1] is None or x[1] > first)]
    whole = [x for x in over if x[0] <= first and until(*x) >= last and (x[1] is None or last < x[1])]
    if len(over) != 1 or not whole or any(whole[0][0] < x[0] <= last for x in lives):
        return None
    return whole[0][0]


def test_lifetimes(spark):
    rng = random.Random(3)
    lives = [(p, s, rng.choice([None, s + rng.randint(0, 30)]), s + rng.randint(0, 40)) for p in range(4) for s in rng.sample(range(120), 9)]
    rows = [(i, rng.randrange(5), f, f + rng.choice([0, 1, 9])) for i, f in enumerate(rng.randrange(130) for _ in range(400))]
    got = {r.id: r.start_us for r in ownership.owned(spark.createDataFrame(rows, "id long, pid long, f long, l long"), spark.createDataFrame(lives, "pid long, start_us long, ended_us long, verified_us long"), "f", "l").collect()}
    for i, p, f, last in rows:
        assert got.get(i) == owner_of([x[1:] for x in lives if x[0] == p], f, last), (p, f, last)


def socket_of(events, first, last):
    """The rule said plainly, over one endpoint's events in order: (open's number, its pid, its time) or None."""
    ended, unmatched, stuck = {}, [], {}
    pending: dict = {}
    for at, kind, pid, sid, seq in events:
        if kind == "open":
            pending.setdefault((pid, sid), []).append(seq)
        elif len(pending.get((pid, sid), [])) == 1:
            ended[pending.pop((pid, sid))[0]] = at
        else:
            unmatched.append(at)
    opens = [(at, pid, seq) for at, kind, pid, sid, seq in events if kind == "open"]
    live = [o for o in opens if o[0] <= last and not (o[2] in ended and ended[o[2]] <= first)]
    if len(live) != 1 or any(kind == "close" and first <= at <= last for at, kind, *_ in events):
        return None
    at, pid, seq = live[0]
    if (seq in ended and ended[seq] <= last) or any(at <= u <= last for u in unmatched):
        return None
    return pid, at


@pytest.mark.parametrize("seed", [4, 5])
def test_sockets(spark, seed):
    rng = random.Random(seed)
    events, n = [], 0
    for port in range(30):
        t = 0
        for _ in range(rng.randint(1, 9)):
            t += rng.randint(1, 6) * 1_000_000_000
            n += 1
            events.append((f"h{port % 3}", port, rng.randint(1, 2), rng.choice(["open", "open", "close"]), t, rng.choice([0, 7]), n))
    rows = [(i, f"h{p % 3}", p, f, f + rng.choice([0, 500_000_000, 4_000_000_000])) for i, (p, f) in enumerate((rng.randrange(31), rng.randrange(45) * 1_000_000_000) for _ in range(600))]
    df = spark.createDataFrame(events, "source_address string, source_port long, pid long, kind string, at_us long, socket_id long, seq long")
    lives = spark.createDataFrame([(1, 0, None, 10**15), (2, 0, None, 20_000_000_000)], "pid long, start_us long, ended_us long, verified_us long")
    got = {r.id: (r.pid, r.start_us) for r in ownership.socket_owners(spark.createDataFrame(rows, "id long, source_address string, source_port long, first_us long, last_us long"), df, lives).collect()}
    found = 0
    for i, host, port, f, last in rows:
        own = [(at, kind, pid, sid, seq) for h, p, pid, kind, at, sid, seq in sorted(events, key=lambda e: (e[4], e[6])) if p == port]
        want = socket_of(own, f, last)
        found += want is not None
        assert (got.get(i) or (None, None))[0] == (want or (None,))[0], (own, f, last)
        if want:
            assert got[i][1] == owner_of([(0, None, 10**15 if want[0] == 1 else 20_000_000_000)], min(f, want[1]), last)
    assert found > 50


S = 1_000_000


def test_matching_survives_restarts(spark, tmp_path):
    rng = random.Random(6)
    base = dict(run_id="r", source_address="a", destination_address="b", destination_port=443)
    reports = [dict(base, report_id=f"p{i}", source_port=i % 17, protocol="TLS", pid=1, started_us=(1000 + 10 * i) * S, timestamp_us=(1000 + 10 * i) * S + rng.choice([0, 400_000])) for i in range(60)]
    flows = [dict(base, flow_id=i, source_port=i % 17, first_us=(1000 + 10 * i) * S + rng.choice([-100_000, 0, 50_000, 900_000]), last_us=(1010 + 10 * i) * S, source_pid=rng.choice([1, 1, 1, 2]), tls_name="TLS") for i in range(60) if i % 5]
    kinds = {"reports": "report_id string, run_id string, source_address string, source_port long, destination_address string, destination_port long, protocol string, pid long, started_us long, timestamp_us long", "flows": "run_id string, source_address string, source_port long, destination_address string, destination_port long, flow_id long, first_us long, last_us long, source_pid long, tls_name string"}
    # A connection of the first minutes comes in the last batch: it is late by then, its report has left.
    late = flows.pop(0)
    end = dict(run_id="end", source_address="-", source_port=0, destination_address="-", destination_port=0)
    batches = [(reports[:20], flows[:16]), (reports[20:40], flows[16:32]), (reports[40:], [*flows[32:], late])]
    batches += [([dict(end, report_id="end", protocol="-", pid=0, started_us=9_000 * S + k, timestamp_us=9_000 * S + k)], [dict(end, flow_id=-1, first_us=9_000 * S + k, last_us=0, source_pid=0, tls_name="-")]) for k in range(2)]
    for k, (r, c) in enumerate(batches):
        for name, rows in (("reports", r), ("flows", c)):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        streams = [spark.readStream.schema(kinds[n]).json(str(tmp_path / n)) for n in ("reports", "flows")]
        job = matching.pending_matches(*streams).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        job.awaitTermination()
    got = sorted((r.report_id, r.flow_id) for r in spark.read.parquet(str(tmp_path / "out")).where("report_id <> 'end'").collect())
    want = []
    for r in reports:
        hits = [c["flow_id"] for c in flows if c["source_port"] == r["source_port"] and c["source_pid"] == 1 and r["started_us"] - 250_000 <= c["first_us"] <= r["timestamp_us"] + 100_000 and c["last_us"] >= r["started_us"] - 100_000]
        want += [(r["report_id"], h) for h in hits] or [(r["report_id"], None)]
    assert got == sorted(want, key=lambda x: (x[0], x[1] or -1)) and any(h is None for _, h in want) and late["flow_id"] not in [h for _, h in got]


def test_replica(spark, tmp_path):
    schema = "k long, v string, change_revision long"
    rep = Replica(spark, str(tmp_path / "t"), {"rows": ["k"]}, compact_every=3)
    frame = lambda *rows: {"rows": spark.createDataFrame(list(rows), schema)}
    content = lambda: sorted((r.source, r.k, r.v, r.target_revision) for r in rep.table("rows").collect())
    assert rep.table("rows") is None and rep.cursor("a") == 0
    rep.apply("a", frame((1, "x", 1), (2, "y", 2)))
    rep.apply("b", frame((1, "bx", 5)))
    want = [("a", 1, "x", 1), ("a", 2, "y", 1), ("b", 1, "bx", 2)]
    assert content() == want
    rep.apply("a", frame((1, "x", 1), (2, "y", 2)))
    assert content() == want and rep.state()["revision"] == 2

    def crash():
        raise RuntimeError("lost between data and pointer")

    with pytest.raises(RuntimeError):
        rep.apply("a", frame((1, "x", 1), (2, "lost", 3)), before_pointer=crash)
    assert content() == want and rep.cursor("a") == 2
    rep.apply("a", frame((1, "x", 1), (2, "z", 3), (3, "w", 4)))
    assert content() == [("a", 1, "x", 1), ("a", 2, "z", 3), ("a", 3, "w", 3), ("b", 1, "bx", 2)] and rep.state()["base"] == 3
    take = rep.sink("b", "rows")
    for number in (0, 0, 7):
        take(spark.createDataFrame([(1, "new", 6 + number)], schema), number)
    assert ("b", 1, "new", 5) in content() and rep.cursor("b") == 13
    with pytest.raises(SourceRolledBack):
        rep.apply("b", frame((1, "old", 2)), available=2)
    assert Replica(spark, str(tmp_path / "t"), {"rows": ["k"]}).cursor("a") == 4


def paced(times, limit, per):
    out = []
    for i, t in enumerate(times):
        out.append(max(t, out[i - limit] + per) if i >= limit else t)
    return out


def test_release_times(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), rng.randrange(4000), i) for i in range(300)]
    got = pacing.release_times(spark.createDataFrame(rows, "d string, at long, n long"), "d", "at", ["n"], 3, 100, width_us=500).collect()
    for d in "ab":
        own = sorted((t, n) for k, t, n in rows if k == d)
        mine = sorted((r.at, r.n, r.release_us) for r in got if r.d == d)
        assert [r[2] for r in mine] == paced([t for t, _ in own], 3, 100)
        assert all(sum(r <= x[2] < r + 100 for x in mine) <= 3 for r in {x[2] for x in mine})


def test_paced_and_throttled_streams(spark, tmp_path):
    rng = random.Random(8)
    times = sorted(rng.randrange(60) * S for _ in range(80))
    health = [("r%d" % (i % 2), t, rng.choice(["ok", "ok", "ok", "bad"]), rng.choice([0, 0, 0, 2])) for i, t in enumerate(sorted(rng.sample(range(200), 80)))]
    for k in range(4):
        for name, rows in (("events", [dict(d="x", n=i, at=t) for i, t in enumerate(times)][k * 20 : k * 20 + 20]), ("health", [dict(zip(("run_id", "time_us", "status", "losses"), h)) for h in health[k * 20 : k * 20 + 20]])):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        events = spark.readStream.schema("d string, n long, at long").json(str(tmp_path / "events")).withColumn("when", F.timestamp_micros("at")).withWatermark("when", "1 hour")
        reports = spark.readStream.schema(pacing.HEALTH).json(str(tmp_path / "health"))
        for name, df in (("paced", pacing.paced_stream(events, "d", "at", "n", 3, 5 * S)), ("sent", pacing.throttled_stream(reports, 20))):
            df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [r.release_us for r in spark.read.parquet(str(tmp_path / "paced")).orderBy("at", "n").collect()]
    assert got == paced(times, 3, 5 * S)
    batch = sorted(map(tuple, pacing.throttled(spark.createDataFrame(health, pacing.HEALTH), 20).collect()))
    assert batch == sorted(map(tuple, spark.read.parquet(str(tmp_path / "sent")).select("run_id", "time_us", "status", "losses").collect()))
    want = []
    for run in ("r0", "r1"):
        sent = None
        for h in [h for h in health if h[0] == run]:
            if sent is None or sent[2] != h[2] or (sent[3] == 0) != (h[3] == 0) or h[1] - sent[1] >= 20:
                sent = h
                want.append(h)
    assert batch == sorted(want)


def test_publish_shows_only_whole_tables(spark, tmp_path):
    df, name = spark.range(10), str(tmp_path / "out")
    broken = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        shared.publish(df.select(broken("id")), name)
    assert not list(tmp_path.iterdir())
    shared.publish(df, name)
    with pytest.raises(ValueError, match="exists"):
        shared.publish(df, name)
    with pytest.raises(Exception, match="ZeroDivision"):
        shared.publish(df.select(broken("id")), name, replace=True)
    assert spark.read.parquet(name).count() == 10
    shared.publish(spark.range(3), name, replace=True)
    assert spark.read.parquet(name).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]
    for bad in (name, name + "/inner", str(tmp_path)):
        with pytest.raises(ValueError, match="source"):
            shared.publish(df, bad, sources=(name,), replace=True)
    assert spark.read.parquet(name).count() == 3


def test_kept_tables_start_no_job_until_the_stamp_changes(spark, tmp_path):
    source, folder, built = str(tmp_path / "in"), str(tmp_path / "kept"), []
    spark.range(5).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("count(*) as n")

    sc = spark.sparkContext
    read = lambda: shared.kept(spark, folder, "counts", shared.stamp(spark, [source]), build)
    assert read().first().n == 5
    sc.setJobGroup("again", "again")
    schema = read().schema
    assert len(built) == 1 and schema.names == ["n"]
    spark.range(2).write.mode("append").parquet(source)
    assert read().first().n == 7 and len(built) == 2
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_refreshed_cohorts_equal_a_full_run(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randrange(3), rng.randrange(1, 100), rng.randint(1, 9)) for _ in range(200)] + [("d", 1, 1, 1), ("e", 1, 1, 9)]
    df = spark.createDataFrame(rows, "k string, m long, v long, change_revision long")
    asked = []

    def total(part):
        asked.append(part.count())
        return part.groupBy("k", "m").agg(F.count("*").alias("n"), F.max("v").alias("v"))

    old = total(df.where("change_revision <= 8 and (k is null or k <> 'a' or change_revision < 99)"))
    got = shared.refreshed(old, df, ["k", "m"], 8, total)
    plain = df.groupBy("k", "m").agg(F.count("*").alias("n"), F.max("v").alias("v"))
    show = lambda x: sorted(map(str, x.collect()))
    assert show(got) == show(plain) and asked[1] < len(rows)
