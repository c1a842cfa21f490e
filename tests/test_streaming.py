import json

from pyspark.sql import functions as F

from hslake.streaming import jobs


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def _reports(folder, rows):
    for i, r in enumerate(rows):
        (folder / f"{i}.json").write_text(json.dumps(r))


def _report(i, at, **more):
    return {"id": f"r{i}", "provider": "A", "pid": 10, "timestamp_us": at, "role": "Client", "success": True, "protocol": "TLS 1.3"} | more


def test_intake_and_duplicates(spark, tmp_path):
    _reports(tmp_path, [_report(1, 10**15), _report(1, 10**15), _report(2, 10**15, role="Nobody"), _report(3, 10**15, pid=None)])
    _run(jobs.validated(jobs.deduplicated(jobs.report_stream(spark, str(tmp_path)))).select("id", F.size("reasons").alias("n")), "intake", "append")
    assert sorted(tuple(r) for r in spark.table("intake").collect()) == [("r1", 0), ("r2", 1), ("r3", 1)]


def test_live_counts_and_sessions(spark, tmp_path):
    _reports(tmp_path, [_report(i, (1000 + s) * 10**6) for i, s in enumerate([0, 10, 130, 300, 5000])])
    rows = jobs.report_stream(spark, str(tmp_path))
    _run(jobs.live_counts(rows), "live", "complete")
    assert spark.table("live").agg(F.sum("n")).first()[0] == 5
    _run(jobs.sessions(rows, ["provider"]), "sess", "append")
    assert sorted(r.n for r in spark.table("sess").collect())[:2] == [1, 3]


def test_merge_versions(spark, tmp_path):
    merge = jobs.merge_version(str(tmp_path / "t"), ["k"], "rev")
    merge(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, rev int"), 0)
    for _ in range(2):
        merge(spark.createDataFrame([(1, "c", 2), (3, "d", 2)], "k int, v string, rev int"), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t" / "v=1")).collect()) == [(1, "c"), (2, "b"), (3, "d")]


def test_replay_restarts_and_closes_windows(spark):
    rows = spark.createDataFrame([(k, k * 60_000_000) for k in range(40)], "k long, at_us long")
    job = lambda stream: jobs.windows(stream, "at", "10 minutes", delay="1 minute")
    out = jobs.replayed(spark, rows, "at_us", job, "start_us long, n long", slices=3).where("start_us < 2400000000")
    assert sorted(map(tuple, out.collect())) == [(k * 600_000_000, 10) for k in range(4)]
    assert jobs.replayed(spark, rows.where("k < 0"), "at_us", job, "start_us long, n long").count() == 0
