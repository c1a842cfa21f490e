"""Chat formatting with cumulative-snapshot collapse.

Logs hold a conversation once more each time it grows. Every turn gets a rolling hash of all turns up to it (two sums of 64-bit hashes of
position, role and text). A conversation whose last rolling hash is an earlier one of another is a snapshot of it; an anti-join drops it.
Of equal conversations the least id stays. What is left is rendered in segments of ``segment`` turns, which concatenate to the whole.

Sums over blocks of turns come before the running sums within a block, so a conversation that holds a third of all rows is dealt over
its blocks. Turns are ordered by number, then role, then text hash; equal rows count once; a null turn number comes first; null role or
text is the empty one, for hashes too. A text is hashed and rendered whole, however long. Extra columns, whatever their names, aren't read. Rows without a conversation id belong to none and give no output. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut

BLOCK = 512
START, END = "<|im_start|>", "<|im_end|>"


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv) of the conversations that prefix no longer one, from (conv, turn, role, text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b")).distinct()
    rows = rows.withColumn("block", F.expr(f"turn div {BLOCK}"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("conv", "block").orderBy("turn", "role", "a", "b")

    def offsets(df: DataFrame, sums: dict) -> DataFrame:
        totals = df.groupBy("conv", "block").agg(*[e.alias(n) for n, e in sums.items()])
        return totals.select("conv", "block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])

    placed = rows.join(offsets(rows, {"n0": F.count("*")}), ["conv", "block"]).withColumn("pos", F.col("n0") + F.row_number().over(within))
    hashed = placed.select("conv", "block", "turn", "role", "a", "b", "pos", F.xxhash64("pos", "a").cast("decimal(38,0)").alias("x"), F.xxhash64("pos", "b").cast("decimal(38,0)").alias("y"))
    hashed = cut(hashed, "turns")
    rolling = hashed.join(offsets(hashed, {"x0": F.sum("x"), "y0": F.sum("y")}), ["conv", "block"])
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    rolling = rolling.select("conv", "pos", (F.col("x0") + F.sum("x").over(running)).cast("decimal(38,0)").alias("x"), (F.col("y0") + F.sum("y").over(running)).cast("decimal(38,0)").alias("y"))
    whole = hashed.groupBy("conv").agg(F.count("*").alias("pos"), F.sum("x").cast("decimal(38,0)").alias("x"), F.sum("y").cast("decimal(38,0)").alias("y"))
    snapshots = rolling.join(whole.select("conv", F.col("pos").alias("n")), "conv").where("pos < n").select("pos", "x", "y").distinct()
    return whole.groupBy("pos", "x", "y").agg(F.min("conv").alias("conv")).join(snapshots, ["pos", "x", "y"], "left_anti").select("conv")


def render_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = 256) -> DataFrame:
    """(conv, segment, n_turns, rendered): maximal conversations in the chat template, one row per segment of turn numbers."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col), F.lit(-1)).cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    longest = maximal_conversations(rows)
    blocks = rows.select("conv", F.expr(f"turn div {segment}").cast("int").alias("segment")).distinct().join(longest, "conv", "left_semi")
    keyed = rows.select("conv", F.expr(f"turn div {segment}").cast("int").alias("segment"), F.struct("turn", "role", F.xxhash64("role", "text").alias("a"), "text").alias("t")).join(blocks, ["conv", "segment"], "left_semi")
    grouped = keyed.groupBy("conv", "segment").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    body = F.array_join(F.transform("ts", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")
    return grouped.select("conv", "segment", F.size("ts").alias("n_turns"), body.alias("rendered"))


def op10_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    return render_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumnRenamed("conv", "conv_id")


ORACLE = rf"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
l as (select conv_id, list((role, text) order by turn, role, text) as ts, string_agg('{START}' || role || chr(10) || text || '{END}' || chr(10), '' order by turn, role, text) as rendered from t group by conv_id),
pre as (select distinct ts[1 : i] as p from (select ts, unnest(range(1, len(ts))) as i from l)),
k as (select min(conv_id) as conv_id, ts, any_value(rendered) as rendered from l where ts not in (select p from pre) group by ts)
select conv_id, cast(0 as integer) as segment, cast(len(ts) as integer) as n_turns, rendered from k"""

QUERIES = {"op10_chat_snapshots": op10_chat_snapshots}
ORACLES = {"op10_chat_snapshots": ORACLE}
