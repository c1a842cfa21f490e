"""Best-fit packing of tokenised documents by length patterns.

Each document becomes token ids and an end id; longer ones than ``capacity`` are cut into pieces of ``capacity``, the first maybe shorter.
The histogram of piece lengths (``capacity`` numbers at most, whatever the corpus) goes to the driver: patterns of one to three
lengths that fill a sequence are enumerated, their repeat counts fitted by non-negative least squares, rounded down, and what is
left is packed best-fit decreasing, again by length counts. Pieces then find their place by their rank among pieces of their length;
ranks are summed from hash-dealt parts, so a length that a third of all pieces share isn't gathered.

Null or empty text: the end id alone. Repeated rows: packed as often as they occur. Null ids stay. Very long texts: read whole, one at a time, in
slices that no token crosses; long runs of white space are one token or more like any other.
Text that spells an added token (``<|endoftext|>``) is that token, as the tokenizer has it. No documents: no rows. Ties between lengths go to
the longer, between patterns to the first; other columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _tokens
from ._spark import cut
from ._text import chunks

RANK_ROWS, LEAST_PARTS, CHUNK_BYTES = 50_000, 32, 2 << 20


def token_pieces(docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of (id, text)."""

    def run(batches):
        encoder = _tokens.encoder((tokenizer,))
        for chunk in chunks(batches, most=CHUNK_BYTES):
            rows = []
            for name, ids in zip(chunk.batch.column(0).to_pylist(), encoder.ids_in(chunk.data, chunk.offsets)):
                own = np.append(ids, end_id).astype("<u4")
                edges = [0, *range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)]
                rows += [(name, p, a, b - a, zlib.crc32(own[a:b].tobytes()), *([own[a:b]] * with_ids)) for p, (a, b) in enumerate(zip(edges, edges[1:]))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def length_patterns(have: np.ndarray, capacity: int, partners: int = 32) -> np.ndarray:
    """Rows of one to three lengths (0: none) that fill a sequence exactly, from lengths that occur."""
    there = np.flatnonzero(have)
    often = there[np.argsort(-have[there], kind="stable")][:partners]
    found = [(capacity, 0, 0)] if have[capacity] else []
    found += [(capacity - a, a, 0) for a in there if a <= capacity - a and have[capacity - a]]
    for b in often:
        for a in there:
            c = capacity - a - b
            if c > 0 and have[c]:
                found.append(tuple(sorted((a, b, c), reverse=True)))
    return np.array(sorted(set(found)), np.int64).reshape(-1, 3)


def fit_counts(patterns: np.ndarray, have: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: how often each pattern is used so that its lengths meet the histogram (accelerated projected gradient)."""
    size = len(have)
    x = y = np.zeros(len(patterns))
    t = 1.0
    scale = np.bincount(patterns[patterns > 0], minlength=size).astype(float)
    step = 1 / np.maximum(1, np.where(patterns > 0, scale[patterns], 0).sum(axis=1))
    for _ in range(rounds):
        use = np.zeros(size)
        for k in range(3):
            use += np.bincount(patterns[:, k], weights=y, minlength=size)
        gap = use - have
        gap[0] = 0
        nxt = np.maximum(0, y - step * gap[patterns].sum(axis=1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0, nxt + (t - 1) / t2 * (nxt - x))
        x, t = nxt, t2
    return x


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, each, base sequence, offset): pieces of ``length`` with those ranks go, ``each`` to a sequence, from there on."""
    have = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        have[k] = v
    plan, taken, base = [], np.zeros(capacity + 1, np.int64), 0

    def use(lengths: list[int], times: int) -> None:
        nonlocal base
        offset = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            plan.append((length, int(taken[length]), each * times, each, base, offset))
            taken[length] += each * times
            have[length] -= each * times
            offset += each * length
        base += times

    patterns = length_patterns(have, capacity)
    if len(patterns):
        counts = fit_counts(patterns, have.astype(float))
        for i in np.argsort(-counts, kind="stable"):
            lengths = [int(v) for v in patterns[i] if v]
            times = min(int(counts[i]), *(int(have[v]) // lengths.count(v) for v in lengths))
            if times > 0:
                use(lengths, times)
    while have.any():
        room, lengths, left = capacity, [], have.copy()
        while room and (fit := np.flatnonzero(left[: room + 1])).size:
            v = int(fit[-1])
            k = min(int(left[v]), room // v)
            lengths += [v] * k
            left[v] -= k
            room -= k * v
        use(lengths, min(int(have[v]) // lengths.count(v) for v in set(lengths)))
    return plan


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = cut(token_pieces(texts, tokenizer=tokenizer, end_id=end_id, capacity=capacity, with_ids=with_ids), "pieces")
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(LEAST_PARTS, -(-sum(counts.values()) // RANK_ROWS))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece"))).join(sizes, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") - 1).drop("part", "own", "before")
    plan = spark.createDataFrame(packing_plan(counts, capacity), "length long, first long, ranks long, each long, base long, place long")
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= first and rank < first + ranks")
    spot = F.col("rank") - F.col("first")
    return placed.select("id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("base") + F.expr("(rank - first) div each")).alias("sequence_id"), (F.col("place") + spot % F.col("each") * F.col("length")).alias("offset"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer=default_tokenizer()).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
