"""Toxicity severity by cumulative-link (proportional odds) ordinal regression on sparse word features.

Labels say toxic or not. Severity grades of the training rows: 0 if not toxic, else 1 to ``grades`` - 1 by how many of their distinct
features the labels tie to toxicity, cut at quantiles. Features are hashed words and word beginnings whose presence is associated with the label (``min_z`` standard
errors, ``min_docs`` documents). One weight vector is shared by all ordered thresholds: P(grade <= k) = logistic(threshold_k - w x),
fitted by likelihood with a ridge penalty on a bounded, hash-chosen sample of labelled rows (``train_rows``, half of them toxic if there
are so many; the thresholds are then shifted to the share of toxic rows among all labels). Every document is scored over its whole text: expected severity,
likeliest grade, P(grade >= 1), and whether that is at least one half.

Null or wordless text: severity by the thresholds alone; if only one class is labelled, no model can be fitted and every score is 0.
Documents with several labels are toxic if one says so. Null ids stay; repeated rows are each scored. Very long texts are scored whole: a feature counts
once however often it occurs. Of equally likely grades the lowest counts. An empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._text import FOLDED, Chunk, chunks, mixed, prefix_hash, span_hash, words

BITS = 20
#: Beginnings of longer words, in bytes, are features too, since stems carry meaning in inflected forms.
PREFIXES = (4, 6, 7)
_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of each row: (row, feature), and each row's word count."""
    starts, ends, rows = words(chunk.data, chunk.offsets, _BREAKS)
    if not len(starts):
        return rows, rows, np.zeros(len(chunk), np.int64)
    sums = prefix_hash(chunk.data, FOLDED)
    found = [(rows, span_hash(sums, starts, ends))]
    for n in PREFIXES:
        long = ends - starts > n
        found.append((rows[long], mixed(span_hash(sums, starts[long], starts[long] + n) + np.uint64(n))))
    key = np.concatenate([(r.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for r, h in found])
    key = np.sort(key)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.bincount(rows, minlength=len(chunk))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def probabilities(self, s: np.ndarray) -> np.ndarray:
        """P(grade = k) of scores ``s``."""
        below = np.concatenate((np.zeros((len(s), 1)), logistic(self.thresholds[None, :] - s[:, None]), np.ones((len(s), 1))), axis=1)
        return np.diff(below, axis=1)


def fit(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, grades: int, width: int, ridge: float = 0.02, rounds: int = 400) -> CumulativeLink:
    """Maximum penalised likelihood by Adam; thresholds stay ordered as a first one plus positive gaps."""
    n = len(grade)
    base = np.array([np.mean(grade <= k) for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.log(base / (1 - base))
    p = np.concatenate((np.zeros(width), theta[:1], np.log(np.maximum(1e-2, np.diff(theta)))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    balance = 1.0 / np.bincount(grade, minlength=grades).clip(1)[grade]
    balance *= n / balance.sum() * 0.5
    balance += 0.5
    for t in range(1, rounds + 1):
        theta = np.concatenate((p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))))
        s = np.bincount(rows, weights=p[cols], minlength=n)
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        a, b = logistic(edge[grade + 1] - s), logistic(edge[grade] - s)
        like = np.maximum(a - b, 1e-9)
        ds = balance * (1 - a - b)
        g = np.zeros_like(p)
        g[:width] = np.bincount(cols, weights=ds[rows], minlength=width) / n + ridge * p[:width] / max(1, width) ** 0.5 / 10
        up, down = -balance * a * (1 - a) / like / n, balance * b * (1 - b) / like / n
        dtheta = np.bincount(grade, weights=up, minlength=grades)[: grades - 1] + np.bincount(grade, weights=down, minlength=grades)[1:]
        g[width] = dtheta.sum()
        g[width + 1 :] = np.exp(p[width + 1 :]) * np.cumsum(dtheta[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = np.concatenate((p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))))
    return CumulativeLink(p[:width], theta)


def train(docs: DataFrame, labels: DataFrame, grades: int, train_rows: int, min_docs: int, min_z: float) -> CumulativeLink | None:
    """The model from (id, text) and (id, toxic), with weights over all hashed features; None without both classes."""
    known = cut(labels.groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    share = F.when(F.col("toxic") == 1, train_rows / 2 / n[1]).otherwise(train_rows / 2 / n[0])
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))

    def collect(batches):
        for chunk in chunks(batches):
            row, col, _ = features(chunk)
            cuts = np.searchsorted(row, np.arange(len(chunk) + 1))
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array([col[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])])], names=["toxic", "cols"])

    got = docs.join(F.broadcast(chosen), "id").select("toxic", "text").mapInArrow(collect, "toxic int, cols binary").toPandas()
    toxic = got["toxic"].to_numpy()
    if len(np.unique(toxic)) < 2:
        return None
    cols = [np.frombuffer(b, "<u4").astype(np.int64) for b in got["cols"]]
    rows, flat = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols)
    del got, cols
    one, all_ = np.bincount(flat, weights=toxic[rows], minlength=1 << BITS), np.bincount(flat, minlength=1 << BITS)
    share = toxic.mean()
    z = (one - all_ * share) / np.sqrt(np.maximum(all_ * share * (1 - share), 1e-9))
    use = np.flatnonzero((all_ >= min_docs) & (np.abs(z) >= min_z))
    place = np.full(1 << BITS, -1)
    place[use] = np.arange(len(use))
    strong = (z >= min_z) & (all_ >= min_docs) & (one >= 0.8 * all_)
    severe = np.bincount(rows, weights=strong[flat], minlength=len(toxic))
    levels = np.quantile(severe[toxic == 1], np.linspace(0, 1, grades)[1:-1]) if grades > 2 else np.zeros(0)
    grade = np.where(toxic == 1, 1 + np.searchsorted(levels, severe, "left"), 0)
    keep = place[flat] >= 0
    model = fit(rows[keep], place[flat[keep]], grade, grades, len(use))
    weights = np.zeros(1 << BITS, np.float32)
    weights[use] = model.weights
    prior, seen = n[1] / (n[0] + n[1]), toxic.mean()
    shift = np.log((1 - prior) / prior) - np.log((1 - seen) / seen)
    return CumulativeLink(weights, model.thresholds + shift)


def severity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", grades: int = 4, train_rows: int = 4000, min_docs: int = 4, min_z: float = 4.0) -> DataFrame:
    """(id, expected_severity, grade, p_toxic, toxic), one row per document."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    model = train(texts, known, grades, train_rows, min_docs, min_z)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for chunk in chunks(batches):
            if model is None:
                p = np.zeros((len(chunk), grades))
                p[:, 0] = 1
            else:
                row, col, _ = features(chunk)
                p = model.probabilities(np.bincount(row, weights=model.weights[col], minlength=len(chunk)))
            toxic = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(p @ np.arange(grades)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= 0.5)], names=["id", "expected_severity", "grade", "p_toxic", "toxic"])

    return texts.mapInArrow(run, "id long, expected_severity double, grade int, p_toxic double, toxic boolean")


def op3_toxicity_severity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return severity(docs, labels).withColumnRenamed("id", "doc_id")


QUERIES = {"op3_toxicity_severity": op3_toxicity_severity}
ORACLES: dict[str, str] = {}
