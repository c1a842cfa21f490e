"""Joins and sweeps over time intervals whose work grows with the rows, also for a key that holds most of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The narrowest bin: spans shorter than 2^20 microseconds share its size class.
LEAST_CLASS = 20


def covering(rows: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """``rows`` with every span of the same ``on`` keys that has start <= at < end; a null end covers all later times. The spans' keys and other columns must not clash with the rows'.

    A span lies in the bins of its size class: 2^k wide, k even, for a length of at most 2^k, so it has two of them at most, and a row is looked up in one bin of each class
    that occurs (a dozen or two at most). Rows and spans meet by equality of keys, class and bin: spans that don't overlap make a number of pairs that is linear in
    the rows, and a hot key's pairs are dealt over its bins.
    """
    pairs = binned_pairs(rows, spans, on, at, start, end)
    return pairs.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col("_end"))).drop("_end")


def binned_pairs(rows: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """The pairs that ``covering`` looks at: rows and spans of one bin, with the span's exclusive ``_end``."""
    horizon = rows.agg(F.max(at).alias("_last"))
    closed = spans.crossJoin(F.broadcast(horizon)).where(F.col("_last").isNotNull() & (F.col(start) <= F.col("_last")))
    closed = closed.withColumn("_end", F.least(F.coalesce(F.col(end), F.col("_last") + 1), F.col("_last") + 1)).where(F.col(start) < F.col("_end"))
    closed = closed.withColumn("_class", 2 * F.ceil(F.log2(F.greatest(F.col("_end") - F.col(start), F.lit(1 << LEAST_CLASS))) / 2).cast("int"))
    binned = closed.withColumn("_bin", F.explode(F.sequence(F.expr(f"shiftright({start}, _class)"), F.expr("shiftright(_end - 1, _class)"))))
    classes = sorted(r[0] for r in closed.select("_class").distinct().collect())
    if not classes:
        return rows.join(spans.where("false"), on).withColumn("_end", F.lit(0).cast("long"))
    asked = rows.withColumn("_class", F.explode(F.array(*[F.lit(c) for c in classes]))).withColumn("_bin", F.expr(f"shiftright({at}, _class)"))
    return asked.join(binned, [*on, "_class", "_bin"]).drop("_class", "_bin", "_last")


def sweep(events: DataFrame, key: list[str], at: str, tie: list[str], sums: dict[str, Column], maxima: dict[str, Column], following: list[str], earlier: dict[str, Column] | None = None, width_us: int = 3_600_000_000) -> DataFrame:
    """``events`` with running sums and maxima by (at, tie) within ``key``, the event itself included, those of ``earlier`` over the events before it, and the next two events' ``following``
    as ``next`` and ``second``.

    Blocks of ``width_us`` are totalled first; running values within a block start from the totals before it, so a key's events aren't gathered in one task.
    """
    block, earlier = F.floor(F.col(at) / width_us), earlier or {}
    tops = {**maxima, **earlier}
    inner = Window.partitionBy(*key, "_block").orderBy(at, *tie)
    outer = Window.partitionBy(*key).orderBy("_block")
    entry = F.struct(*following)
    rows = events.withColumn("_block", block).withColumns({f"_{n}": e for n, e in {**sums, **tops}.items()})
    rows = rows.withColumn("_rank", F.row_number().over(inner)).withColumn("_entry", entry)
    heads = F.sort_array(F.collect_list(F.when(F.col("_rank") <= 2, F.struct("_rank", "_entry"))))
    blocks = rows.groupBy(*key, "_block").agg(*[F.sum(f"_{n}").alias(f"_t_{n}") for n in sums], *[F.max(f"_{n}").alias(f"_t_{n}") for n in tops], heads.alias("_heads"))
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    later = F.transform(F.slice(F.concat(*[F.coalesce(F.lead("_heads", k).over(outer), F.expr("slice(_heads, 1, 0)")) for k in (1, 2)]), 1, 2), lambda x: x["_entry"])
    blocks = blocks.select(*key, "_block", *[F.sum(f"_t_{n}").over(before).alias(f"_b_{n}") for n in sums], *[F.max(f"_t_{n}").over(before).alias(f"_b_{n}") for n in tops], later.alias("_later"))
    held = inner.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_r_{n}": F.sum(f"_{n}").over(held) for n in sums} | {f"_r_{n}": F.max(f"_{n}").over(held if n in maxima else inner.rowsBetween(Window.unboundedPreceding, -1)) for n in tops} | {"_n1": F.lead("_entry", 1).over(inner), "_n2": F.lead("_entry", 2).over(inner)})
    out = out.join(blocks, [*key, "_block"])
    first, other = F.get("_later", F.lit(0)), F.get("_later", F.lit(1))
    values = {n: F.col(f"_r_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in sums} | {n: F.greatest(f"_r_{n}", f"_b_{n}") for n in tops}
    return out.select(*events.columns, *[v.alias(n) for n, v in values.items()], F.coalesce("_n1", first).alias("next"), F.when(F.col("_n1").isNull(), other).otherwise(F.coalesce("_n2", first)).alias("second"))


def next_in_key(rows: DataFrame, key: list[str], at: str, name: str, width_us: int = 86_400_000_000) -> DataFrame:
    """``rows`` with the next greater ``at`` of their key as ``name``, null for the last; by blocks of ``width_us`` as in ``sweep``."""
    blocked = rows.withColumn("_block", F.floor(F.col(at) / width_us))
    inner = Window.partitionBy(*key, "_block").orderBy(at).rangeBetween(1, Window.unboundedFollowing)
    blocks = blocked.groupBy(*key, "_block").agg(F.min(at).alias("_first"))
    blocks = blocks.select(*key, "_block", F.lead("_first").over(Window.partitionBy(*key).orderBy("_block")).alias("_later"))
    return blocked.withColumn("_own", F.min(at).over(inner)).join(blocks, [*key, "_block"]).withColumn(name, F.coalesce("_own", "_later")).drop("_block", "_own", "_later")
