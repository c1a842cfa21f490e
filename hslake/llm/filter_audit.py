"""Filter interaction audit: what each quality filter removes in every order of application, per part, from sorted posting lists.

Rows are ranged by (part, id) over the cluster. A task walks its range and keeps, for blocks of at most ``block`` rows of one part, a sorted
list of the failing rows of each filter and of the good and toxic rows: the posting lists, written once as a table. From the lists alone the audit takes,
for every filter and every set of filters before it, the size of the difference to the union of those sets' lists, alone and within the good and the
toxic list. Unions and differences are galloping k-way merges: cursors advance by doubling steps to the end of a window of the list that
is furthest behind, then whole windows are merged. Sizes are summed over blocks; orders read their steps from those sums.

A part that holds a third of all rows lies in many ranges; rows of one id (null ids too) are ranged further by where they were read.
The duplicate filter compares 128-bit digests of the texts with the least id of each, hot digests by a broadcast of at most 1,000 rows.

Null text: empty; it fails A, and E if a smaller id has an empty text. Null part: ''. Null ids: neither smaller nor greater than others, so they never
fail E. Repeated rows count as often as they occur; rows of one id and text aren't duplicates of each other. Labels of one id are combined by maximum.
Empty table: no rows. Very long texts: whole. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._text import SYMBOLS, chunks, prefix_hash, span_hash, words
from .token_counts import with_hot

FILTERS = "ABCDE"
BLOCK, WINDOW = 1 << 16, 4096
#: Rows that a range has at least: fewer ranges than cores cost nothing, more ranges than rows would.
RANGE_ROWS = 20_000

_upper, _special, _start = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_upper[65:91] = True
_special[list(b"#$%&*|")] = True
_start[128:192] = False


def text_flags(docs: DataFrame) -> DataFrame:
    """(id, part, a, b, c, d, digest) of (id, part, text): the filters that a text alone decides, and its digest."""

    def run(batches):
        for chunk in chunks(batches):
            starts, ends, rows = words(chunk.data, chunk.offsets)
            hashes = span_hash(prefix_hash(chunk.data, SYMBOLS), starts, ends)
            at = np.searchsorted(rows, np.arange(len(chunk) + 1))
            n = np.diff(at)
            distinct = np.zeros(len(chunk), np.int64)
            for i in np.flatnonzero(n):
                own = np.sort(hashes[at[i] : at[i + 1]])
                distinct[i] = 1 + np.count_nonzero(own[1:] != own[:-1])

            def count(table):
                sums = np.concatenate([[0], np.cumsum(table[chunk.data], dtype=np.int64)])
                return np.diff(sums[chunk.offsets])

            flags = [n < 50, 100 * distinct < 65 * n, 100 * count(_upper) > 5 * count(_start), count(_special) > 0]
            digests = [hashlib.blake2b(chunk.text(i), digest_size=16).digest() for i in range(len(chunk))]
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), chunk.batch.column(1), *map(pa.array, flags), pa.array(digests, pa.binary())], names=["id", "part", "a", "b", "c", "d", "digest"])

    return docs.select("id", "part", "text").mapInArrow(run, "id long, part string, a boolean, b boolean, c boolean, d boolean, digest binary")


def failures(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, part, mask): bit k of ``mask`` is set if filter k of ``FILTERS`` fails, bit 5 for good rows, bit 6 for toxic ones."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    flags = cut(text_flags(rows), "flags")
    least = cut(flags.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("least")), "digests")
    known = with_hot(flags, least, "digest", "copies")
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    mask = F.expr("int(a) + 2 * int(b) + 4 * int(c) + 8 * int(d) + 16 * int(coalesce(id > least, false)) + 32 * coalesce(good, 0) + 64 * coalesce(toxic, 0)")
    return known.join(marks, "id", "left").select("id", "part", mask.alias("mask"))


def posting_lists(marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """(part, n, ids, lists) of (id, part, mask): a block's ids in order, and for each of the seven bits the places of its rows, sorted."""
    marked = cut(marked, "marked")
    ranges = max(8, -(-marked.count() // RANGE_ROWS))
    dealt = marked.withColumn("reader", F.spark_partition_id()).repartitionByRange(ranges, "part", "id", "reader", "mask").sortWithinPartitions("part", "id")

    def rows_of(part, ids, masks):
        lists = [np.flatnonzero(masks >> k & 1).astype(np.int32) for k in range(7)]
        return {"part": part, "n": len(ids), "ids": pa.array(ids, pa.int64()), "lists": lists}

    def run(batches):
        held: dict = {"part": None, "ids": [], "masks": [], "n": 0}

        def flush():
            if not held["n"]:
                return []
            ids, masks = pa.concat_arrays(held["ids"]), np.concatenate(held["masks"])
            out = rows_of(held["part"], ids, masks)
            held.update(ids=[], masks=[], n=0)
            return [pa.RecordBatch.from_arrays([pa.array([out["part"]]), pa.array([out["n"]], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([out["lists"]], pa.list_(pa.list_(pa.int32())))], names=["part", "n", "ids", "lists"])]

        for batch in batches:
            part, ids, masks = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy()
            edges = [0, *(i for i in range(1, len(part)) if part[i] != part[i - 1]), len(part)]
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    if held["n"] and (held["part"] != part[a] or held["n"] == block):
                        yield from flush()
                    k = min(b, a + block - held["n"])
                    held["part"] = part[a]
                    held["ids"].append(ids.slice(a, k - a))
                    held["masks"].append(masks[a:k])
                    held["n"] += k - a
                    a = k
        yield from flush()

    return dealt.select("part", "id", "mask").mapInArrow(run, "part string, n long, ids array<long>, lists array<array<int>>")


def gallop(a: np.ndarray, at: int, key: int) -> int:
    """The first place from ``at`` on whose value is over ``key``: doubling steps, then a binary search within the last one."""
    step = 1
    while at + step <= len(a) and a[at + step - 1] <= key:
        at += step
        step *= 2
    return at + int(np.searchsorted(a[at : at + step], key, "right"))


def windows(lists: list[np.ndarray], lead: int | None = None) -> Iterator[list[np.ndarray]]:
    """Windows of sorted lists that cover the same range of values: up to ``WINDOW`` entries of the list that is furthest behind, or of list ``lead``.

    With a lead, the others' values beyond its last aren't visited.
    """
    at = [0] * len(lists)
    while True:
        open_ = [k for k in ([lead] if lead is not None else range(len(lists))) if at[k] < len(lists[k])]
        if not open_:
            return
        key = min(int(lists[k][min(at[k] + WINDOW, len(lists[k])) - 1]) for k in open_)
        ends = [gallop(x, i, key) for x, i in zip(lists, at)]
        yield [x[i:j] for x, i, j in zip(lists, at, ends)]
        at = ends


def union(lists: list[np.ndarray]) -> np.ndarray:
    """The sorted union of sorted lists."""
    parts = []
    for w in windows(lists):
        some = [x for x in w if len(x)]
        parts.append(some[0] if len(some) == 1 else np.unique(np.concatenate(some)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The entries of sorted ``a`` that sorted ``b`` lacks."""
    parts = []
    for x, y in windows([a, b], lead=0):
        parts.append(x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x] if len(y) else x)
    return np.concatenate(parts) if parts else a[:0]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries two sorted lists share; the shorter leads."""
    a, b = sorted((a, b), key=len)
    return len(a) - len(difference(a, b))


def block_sizes(lists: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    """(filter, set of filters before, failing rows outside that set's union, good and toxic ones of those); filter -1: the sizes of the unions."""
    k = len(FILTERS)
    good, toxic = lists[k], lists[k + 1]
    unions = {0: np.zeros(0, np.int32)}
    for s in range(1, 1 << k):
        unions[s] = union([lists[i] for i in range(k) if s >> i & 1])
        yield -1, s, len(unions[s]), 0, 0
    for f in range(k):
        for s in range(1 << k):
            if not s >> f & 1:
                left = difference(lists[f], unions[s])
                yield f, s, len(left), common(left, good), common(left, toxic)


def set_sizes(blocks: DataFrame) -> DataFrame:
    """(part, f, s, n, good, toxic) summed over the blocks of each part; f = -1: the union of set s, and of the empty set all rows of the part."""

    def run(batches):
        for batch in batches:
            for part, n, lists in zip(*(batch.column(i) for i in range(3))):
                found = [(-1, 0, n.as_py(), 0, 0), *block_sizes([np.array(x, np.int32) for x in lists.as_py()])]
                columns = [pa.array([part.as_py()] * len(found)), *(pa.array(c, pa.int64()) for c in zip(*found))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "f", "s", "n", "good", "toxic"])

    sizes = blocks.select("part", "n", "lists").mapInArrow(run, "part string, f long, s long, n long, good long, toxic long")
    return sizes.groupBy("part", "f", "s").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def order_steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filter, set of filters before) of all orders."""
    return [("".join(o), k + 1, FILTERS.index(f), sum(1 << FILTERS.index(x) for x in o[:k])) for o in itertools.permutations(FILTERS) for k, f in enumerate(o)]


def audit(docs: DataFrame, labels: DataFrame, *, block: int = BLOCK, **columns: str) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    sizes = cut(set_sizes(cut(posting_lists(failures(docs, labels, **columns), block), "postings")), "sizes")
    steps = F.broadcast(spark.createDataFrame(order_steps(), "filter_order string, step int, f long, s long"))
    every = (1 << len(FILTERS)) - 1
    one = sizes.where("f >= 0").join(steps, ["f", "s"])
    shapley = one.groupBy("part", "f").agg(F.sum("n").alias("shapley"))
    alone = sizes.where("f >= 0").groupBy("part", "f").agg(F.sum(F.expr("if(s = 0, n, 0)")).alias("fails"), F.sum(F.expr(f"if(s = {every} - (1 << int(f)), n, 0)")).alias("unique_fails"))
    unions = sizes.where("f < 0").select("part", F.col("s").alias("u"), F.col("n").alias("gone"))
    total = unions.where("u = 0").select("part", F.col("gone").alias("total"))
    rows = one.withColumn("u", F.expr("s + (1 << int(f))")).join(unions, ["part", "u"]).join(total, "part").join(alone, ["part", "f"]).join(shapley, ["part", "f"])
    return rows.select("part", "filter_order", "step", F.expr("total - gone").alias("kept"), F.col("n").alias("removed"), F.expr("fails - n").alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
least as (select text, min(doc_id) as least from w group by text),
lab as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
d as (
    select w.part, coalesce(lab.good, 0) as good, coalesce(lab.toxic, 0) as toxic, [
        len(w.ws) < 50, 100 * len(list_distinct(w.ws)) < 65 * len(w.ws), 100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 5 * length(w.text),
        regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > least.least, false)] as fails
    from w join least using (text) left join lab using (doc_id)),
one as (select unnest([1, 2, 3, 4, 5]) as f),
o as (select [a.f, b.f, c.f, d.f, e.f] as fs from one a, one b, one c, one d, one e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select fs, array_to_string(list_transform(fs, lambda x: 'ABCDE'[x]), '') as filter_order, unnest(range(1, 6)) as step from o),
m as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from d group by part, fails),
r as (
    select m.part, s.filter_order, s.step, s.fs[s.step] as f, sum(case when len(list_filter(s.fs[1 : s.step], lambda x: m.fails[x])) = 0 then m.n else 0 end) as kept,
        sum(case when m.fails[s.fs[s.step]] and len(list_filter(s.fs[1 : s.step - 1], lambda x: m.fails[x])) = 0 then m.n else 0 end) as removed,
        sum(case when m.fails[s.fs[s.step]] and len(list_filter(s.fs[1 : s.step - 1], lambda x: m.fails[x])) > 0 then m.n else 0 end) as redundant,
        sum(case when m.fails[s.fs[s.step]] and len(list_filter(m.fails, lambda x: x)) = 1 then m.n else 0 end) as unique_fails,
        sum(case when m.fails[s.fs[s.step]] and len(list_filter(s.fs[1 : s.step - 1], lambda x: m.fails[x])) = 0 then m.good else 0 end) as good_lost,
        sum(case when m.fails[s.fs[s.step]] and len(list_filter(s.fs[1 : s.step - 1], lambda x: m.fails[x])) = 0 then m.toxic else 0 end) as toxic_lost
    from m cross join s group by m.part, s.filter_order, s.step, s.fs[s.step])
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
    cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from r"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": ORACLE}
