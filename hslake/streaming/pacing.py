"""Sending no faster than a destination takes: release times in batch as a running maximum, and in a stream with a state per destination."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def release_times(rows: DataFrame, key: str, at: str, order: list[str], limit: int, per_us: int = 1_000_000, width_us: int = 86_400_000_000) -> DataFrame:
    """``rows`` with ``release_us``: in the order (at, order) of each key, and never more than ``limit`` within ``per_us``.

    Row i waits for its own time and for ``per_us`` after row i - limit. Unrolled, that is a running maximum over every limit-th row: row number i = q * limit + m goes
    at q * per_us + max over the rows up to it of the same m of (at - q * per_us). A key's rows are numbered by blocks of time, and their running maximum is dealt over
    the ``limit`` remainders.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(at) / width_us))
    inner = Window.partitionBy(key, "_block").orderBy(at, *order)
    sizes = blocked.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    sizes = sizes.select(key, "_block", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = blocked.withColumn("_own", F.row_number().over(inner) - 1).join(sizes, [key, "_block"]).withColumn("_i", F.col("_own") + F.col("_before"))
    numbered = numbered.withColumns({"_q": F.expr(f"_i div {limit}"), "_m": F.col("_i") % limit})
    chain = Window.partitionBy(key, "_m").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.select(*rows.columns, (F.col("_q") * per_us + F.max(F.col(at) - F.col("_q") * per_us).over(chain)).alias("release_us"))


def paced_stream(rows: DataFrame, key: str, at: str, order: str, limit: int, per_us: int = 1_000_000) -> DataFrame:
    """The streaming form: (key, order, at, release_us) by arrival; the state of a key is its last ``limit`` release times, and it ends when they have all passed.

    Rows of one micro-batch are ordered by (at, order); batches follow each other. ``rows`` need a watermark for the states to end.
    """
    out = f"{key} string, {order} long, {at} long, release_us long"

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(frames)).sort_values([at, order])
        released = []
        for t in batch[at].tolist():
            go = max(int(t), last[0] + per_us if len(last) == limit else int(t), last[-1] if last else int(t))
            last = [*last, go][-limit:]
            released.append(go)
        state.update((last,))
        state.setTimeoutTimestamp(max(last[-1] // 1000 + per_us // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: name[0], order: batch[order], at: batch[at], "release_us": released})

    return rows.groupBy(key).applyInPandasWithState(run, out, "last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


HEALTH = "run_id string, time_us long, status string, losses long"


def throttled_stream(rows: DataFrame, every_us: int) -> DataFrame:
    """Health rows (run_id, time_us, status, losses) without those that repeat what was last sent of their run less than ``every_us`` before.

    A row repeats if its status is that of the row last sent and both lost something or both nothing. A run's state is that row.
    """

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = tuple(state.get) if state.exists else None
        rows = []
        for t, status, losses in pd.concat(list(frames)).sort_values("time_us")[["time_us", "status", "losses"]].itertuples(index=False):
            if sent is None or sent[1] != status or sent[2] != (losses == 0) or t - sent[0] >= every_us:
                sent = (int(t), str(status), bool(losses == 0))
                rows.append((name[0], t, status, losses))
        if sent is not None:
            state.update(sent)
        yield pd.DataFrame(rows, columns=["run_id", "time_us", "status", "losses"])

    return rows.groupBy("run_id").applyInPandasWithState(run, HEALTH, "time_us long, status string, whole boolean", "append", GroupStateTimeout.NoTimeout)


def throttled(rows: DataFrame, every_us: int) -> DataFrame:
    """The batch form of ``throttled_stream``: tasks walk their runs in order of time and hold one row each."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: tuple | None = None
        for frame in frames:
            keep = []
            for r in frame.itertuples(index=False):
                go = sent is None or sent[0] != r.run_id or sent[2] != r.status or sent[3] != (r.losses == 0) or r.time_us - sent[1] >= every_us
                sent = (r.run_id, r.time_us, r.status, r.losses == 0) if go else sent
                keep.append(go)
            yield frame[keep]

    ordered = rows.select("run_id", "time_us", "status", "losses").repartition("run_id").sortWithinPartitions("run_id", "time_us", "status", "losses")
    return ordered.mapInPandas(walk, HEALTH)
