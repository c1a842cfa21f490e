"""Language-model scores by stupid backoff, computed relationally.

Words (A-Z as a-z) are counted over all documents, each by its 64-bit hash. The most frequent ones, at most ``vocabulary``, get short numbers,
which only makes their bigrams smaller; a bigram with another word (a rare one) travels by the hashes of both. Every document is
exploded into bigrams (a start sign before its first word), which go to hash partitions of the bigram space. A partition holds all
occurrences of its bigrams: their sum is the count table's entry, which is joined to the documents they came from. A bigram seen
``min_count`` times or more scores ln(f(ab) / f(a)), else ln(backoff * f(b) / N): a single sighting is the text's own. Partial sums go back by document.

A bigram that a third of all documents hold would fill its partition. So the commonest bigrams of a bounded sample (``sample_words``, ``hot`` of
them at most) are counted by tasks over all documents, with nothing but a count from each task, and scored where they stand. The sample only picks
which bigrams go that way: counts are exact, scores don't depend on it.

Bigrams travel as packed columns: a row for each task's flush and partition, holding the numbers of its documents and their bigrams. Within a
task equal bigrams of a document are summed first, so a frequent bigram costs one entry a document. Nothing is held whole anywhere; the numbered
words (12 bytes a word, ``vocabulary`` words at most) and the common bigrams (16 bytes each) are broadcast. Where a score needs the count of a rare word, the partition asks for it by the
word's hash, and the request is joined to the count table. Scores don't depend on ``vocabulary``.

Null or wordless text: no words, null score. Repeated rows and equal texts: counted as often as they occur, scored alike. Null ids stay. Very long
texts: read whole, a chunk of their own. No documents: no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._text import as_long, chunks, mixed, prefix_hash, span_hash, word_hashes

FLUSH = 1_500_000
BITS = 18
#: Stands for the start sign among word hashes.
START = np.uint64(0x5851F42D4C957F2D)
#: Even a small corpus is dealt over so many hash partitions, so that a text's partial sums don't multiply as it grows.
LEAST_BUCKETS = 64
#: Kinds of packed rows: bigrams of numbered words, bigrams by hash, sums of scores that are known already.
USUAL, RARE, TOLD = 0, 1, 2


def text_keys(chunk) -> np.ndarray:
    """A hash for each row's whole text."""
    return span_hash(prefix_hash(chunk.data), chunk.offsets[:-1], chunk.offsets[1:]) + np.diff(chunk.offsets).astype(np.uint64)


def pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (``START`` before a row's first) and a hash of both."""
    before = np.concatenate(([START], h[:-1]))
    before[np.concatenate(([True], row[1:] != row[:-1]))] = START
    return before, mixed(mixed(before) + h)


def place_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in a sorted table; -1 if it doesn't."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def common_bigrams(docs: DataFrame, fraction: float, most: int) -> pd.DataFrame:
    """(a, b, pair) of the commonest bigrams of a sample of rows, sorted by pair."""

    def run(batches):
        for chunk in chunks(batches):
            h, row = word_hashes(chunk)
            if len(h):
                before, pair = pairs(h, row)
                _, first, n = np.unique(pair, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([as_long(before[first]), as_long(h[first]), pa.array(n)], names=["a", "b", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < int(fraction * 1_000_000)) if fraction < 1 else docs
    seen = sample.select("text").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    top = seen.where("n > 7").orderBy(F.desc("n"), "a", "b").limit(most).select("a", "b").toPandas()
    pair = mixed(mixed(top["a"].to_numpy(np.int64).view(np.uint64)) + top["b"].to_numpy(np.int64).view(np.uint64))
    return top.assign(pair=pair).sort_values("pair", ignore_index=True)


def word_counts(docs: DataFrame, n_buckets: int, common: np.ndarray) -> DataFrame:
    """(h, n, pair) over all documents, counted in each task before the shuffle: a word's hash, or the place of a bigram in ``common`` if ``pair``."""
    part = 4096

    def run(batches):
        held, size, hot = [], 0, np.zeros(len(common), np.uint64)

        def flush():
            h = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n = np.diff(np.concatenate((at, [len(h)]))).astype(np.uint32)
            h = h[at]
            bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1).astype(np.uint64))
            rows = [(k, h[i:j].tobytes(), n[i:j].tobytes()) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "h", "n"])

        for chunk in chunks(batches):
            h, row = word_hashes(chunk)
            if not len(h):
                continue
            at = place_in(common, pairs(h, row)[1])
            hot += np.bincount(at[at >= 0], minlength=len(common)).astype(np.uint64)
            held.append(h)
            size += len(h)
            if size >= 2 * FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        if hot.any():
            at = range(0, len(common), part)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - a // part for a in at], pa.int32()), pa.array([b""] * len(at), pa.binary()), pa.array([hot[a : a + part].tobytes() for a in at], pa.binary())], names=["bucket", "h", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:
            n = np.sum([np.frombuffer(x, np.uint64) for x in pdf["n"]], axis=0)
            return pd.DataFrame({"h": np.arange(len(n)) + (-1 - bucket) * part, "n": n.astype(np.int64), "pair": True})
        h, n = np.frombuffer(b"".join(pdf["h"]), np.uint64), np.frombuffer(b"".join(pdf["n"]), np.uint32)
        h, which = np.unique(h, return_inverse=True)
        return pd.DataFrame({"h": h.view(np.int64), "n": np.bincount(which, weights=n).astype(np.int64), "pair": False})

    return docs.select("text").mapInArrow(run, "bucket int, h binary, n binary").groupBy("bucket").applyInPandas(add, "h long, n long, pair boolean")


def _common_values(spark, common: pd.DataFrame, every: DataFrame, counts: DataFrame, n_docs: int, total: int, min_count: int, backoff: float) -> np.ndarray:
    """Scores of the common bigrams, from their exact counts and those of their words."""
    if not len(common):
        return np.zeros(0)
    f = np.zeros(len(common))
    got = every.where("pair").toPandas()
    f[got["h"].to_numpy()] = got["n"].to_numpy()
    asked = spark.createDataFrame(pd.DataFrame({"h": np.unique(common[["a", "b"]].to_numpy())}))
    found = counts.join(F.broadcast(asked), "h").toPandas()
    n = dict(zip(found["h"].tolist(), found["n"].tolist())) | {int(START.view(np.int64)): n_docs}
    a, b = (np.array([n[x] for x in common[c].tolist()], float) for c in ("a", "b"))
    return np.log(np.where(f >= min_count, f / a, backoff * b / total))


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = (1 << BITS) - 2, min_count: int = 2, backoff: float = 0.4, hot: int = 1 << 16, sample_words: int = 1_000_000) -> DataFrame:
    """(id, n_words, log_score, per_word), one row per document; natural logarithms."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession

    def describe(batches):
        for chunk in chunks(batches):
            _, rows = word_hashes(chunk)
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), as_long(text_keys(chunk)), pa.array(np.bincount(rows, minlength=len(chunk)))], names=["id", "k", "n_words"])

    rows = cut(texts.mapInArrow(describe, "id long, k long, n_words long"), "rows")
    total, n_docs = rows.where("n_words > 0").agg(F.sum("n_words"), F.count("*")).first()
    if not total:
        return rows.select("id", "n_words", F.lit(None).cast("double").alias("log_score"), F.lit(None).cast("double").alias("per_word"))
    common = common_bigrams(texts, min(1.0, sample_words / total), hot)
    every = cut(word_counts(texts, max(8, -(-total // 2_000_000)), common["pair"].to_numpy()), "words")
    counts = every.where("not pair").select("h", "n")
    least, room = 1 << 62, vocabulary
    for r in counts.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.count("*").alias("c"), F.min("n").alias("least")).orderBy(F.desc("size")).collect():
        room -= r.c
        if room < 0:
            break
        least = r.least
    values = _common_values(spark, common, every, counts, n_docs, total, min_count, backoff)
    top = counts.where(F.col("n") >= least).toPandas()
    names = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    seen = np.zeros(len(names) + 2)
    seen[1:-1] = top["n"].to_numpy()[order]
    seen[-1] = n_docs
    shared = spark.sparkContext.broadcast((names[order], seen))
    known = spark.sparkContext.broadcast((common["pair"].to_numpy(), values))
    n_buckets = max(LEAST_BUCKETS, -(-total // 2_500_000))

    def numbered(vocab, h):
        """Numbers of words, from 1; 0 for a rare one."""
        if not len(vocab):
            return np.zeros(len(h), np.uint64)
        at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
        return np.where(vocab[at] == h, at + 1, 0).astype(np.uint64)

    def packed(keys, owner, n, bucket, code, kind):
        """A row for each bucket; ``code`` has the bytes of a bigram in each of its rows."""
        by = np.argsort(bucket.astype(np.uint16 if n_buckets < 65536 else np.uint32), kind="stable")
        bucket, owner, code, n = bucket[by], owner[by], code[by], n[by]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
        rows = []
        for i, j in zip(at, [*at[1:], len(code)]):
            new = np.concatenate(([True], owner[i + 1 : j] != owner[i : j - 1]))
            first = np.flatnonzero(new)
            rows.append((int(bucket[i]), kind, keys[owner[i:j][first]].tobytes(), np.diff(np.concatenate((first, [j - i]))).astype(np.uint32).tobytes(), np.ascontiguousarray(code[i:j]).tobytes(), n[i:j].astype(np.uint32).tobytes()))
        return rows

    def explode(batches):
        vocab, _ = shared.value
        common, values = known.value
        start = np.uint64(len(vocab) + 1)
        held, wide, told, size, base = [], [], [], 0, 0

        def flush():
            keys = np.concatenate([k for k, _, _, _ in held])
            owner, code, n = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            rows = packed(keys, owner, n, mixed(code) % np.uint64(n_buckets), code.view(np.uint8).reshape(-1, 8)[:, :5], USUAL)
            owner, code, n = (np.concatenate([x[i] for x in wide]) for i in (0, 1, 2))
            rows += packed(keys, owner, n, mixed(mixed(code[:, 0]) + code[:, 1]) % np.uint64(n_buckets), code, RARE)
            k, part = (np.concatenate([x[i] for x in told]) for i in (0, 1))
            rows.append((int(mixed(k[:1])[0] % np.uint64(n_buckets)), TOLD, k.tobytes(), b"", part.tobytes(), b""))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["bucket", "kind", "k", "many", "code", "n"])

        for chunk in chunks(batches):
            h, row = word_hashes(chunk)
            if not len(h):
                continue
            before, pair = pairs(h, row)
            at = place_in(common, pair)
            mine = at >= 0
            keys = text_keys(chunk)
            told.append((keys, np.bincount(row[mine], weights=values[at[mine]], minlength=len(chunk))))
            word = numbered(vocab, h)
            left = np.concatenate(([start], word[:-1]))
            left[before == START] = start
            rare = np.flatnonzero(~mine & ((word == 0) | (left == 0)))
            a, b, owner = before[rare], h[rare], row[rare]
            by = np.lexsort((b, a, owner))
            a, b, owner = a[by], b[by], owner[by]
            new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])))) if len(by) else by
            wide.append((owner[new] + base, np.stack((a[new], b[new]), axis=1), np.diff(np.concatenate((new, [len(by)])))))
            size += len(new)
            usual = ~mine & (word != 0) & (left != 0)
            code, row = (left[usual] << np.uint64(BITS)) | word[usual], row[usual]
            by = np.lexsort((code, row)) if len(chunk) >= 1 << 24 else np.argsort((row.astype(np.uint64) << np.uint64(40)) | code)
            code, row = code[by], row[by]
            new = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])))) if len(by) else by
            held.append((keys, row[new] + base, code[new], np.diff(np.concatenate((new, [len(code)])))))
            base += len(chunk)
            size += len(new)
            if size >= FLUSH:
                yield flush()
                held, wide, told, size, base = [], [], [], 0, 0
        if held:
            yield flush()

    def unpacked(pdf, width, kind):
        k, many = np.frombuffer(b"".join(pdf["k"]), np.uint64), np.frombuffer(b"".join(pdf["many"]), np.uint32)
        return k, many, np.frombuffer(b"".join(pdf["code"]), kind).reshape(-1, width), np.frombuffer(b"".join(pdf["n"]), np.uint32)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        vocab, seen = shared.value
        owners, parts = [], []
        asked = pd.DataFrame({"k": np.zeros(0, np.int64), "h": np.zeros(0, np.int64), "part": np.zeros(0)})
        k, many, low, n = unpacked(pdf[pdf["kind"] == USUAL], 5, np.uint8)
        if len(k):
            code = np.zeros((len(low), 8), np.uint8)
            code[:, :5] = low
            table, which = np.unique(code.view(np.uint64).ravel(), return_inverse=True)
            f = np.bincount(which, weights=n)
            a, b = (table >> np.uint64(BITS)).astype(np.int64), (table & np.uint64((1 << BITS) - 1)).astype(np.int64)
            value = np.log(np.where(f >= min_count, f / seen[a], backoff * seen[b] / total))
            owners.append(k)
            parts.append(np.add.reduceat(value[which] * n, np.concatenate(([0], np.cumsum(many[:-1].astype(np.int64))))))
        k, many, pair, n = unpacked(pdf[pdf["kind"] == RARE], 2, np.uint64)
        if len(k):
            by = np.lexsort((pair[:, 1], pair[:, 0]))
            new = np.concatenate(([True], (pair[by][1:] != pair[by][:-1]).any(axis=1)))
            which = np.empty(len(by), np.int64)
            which[by] = np.cumsum(new) - 1
            table = pair[by[new]]
            f = np.bincount(which, weights=n)
            often = f >= min_count
            # ln(f(ab)) - ln(f(a)), or ln(backoff / N) + ln(f(b)): the last term of each is looked up here or asked for
            needs, sign = np.where(often, table[:, 0], table[:, 1]), np.where(often, -1.0, 1.0)
            number = np.where(needs == START, np.uint64(len(vocab) + 1), numbered(vocab, needs)).astype(np.int64)
            known = number > 0
            value = np.where(often, np.log(f), np.log(backoff / total)) + sign * np.log(np.where(known, seen[number], 1))
            owners.append(k)
            parts.append(np.add.reduceat(value[which] * n, np.concatenate(([0], np.cumsum(many[:-1].astype(np.int64))))))
            ask = ~known[which]
            asked = pd.DataFrame({"k": np.repeat(k, many)[ask].view(np.int64), "h": needs[which][ask].view(np.int64), "part": (sign[which] * n)[ask]}).groupby(["k", "h"], as_index=False).sum()
        done = pdf[pdf["kind"] == TOLD]
        owners.append(np.frombuffer(b"".join(done["k"]), np.uint64))
        parts.append(np.frombuffer(b"".join(done["code"]), np.float64))
        names, who = np.unique(np.concatenate(owners), return_inverse=True)
        own = pd.DataFrame({"k": names.view(np.int64), "h": np.int64(0), "part": np.bincount(who, weights=np.concatenate(parts)), "ask": False})
        return pd.concat([own, asked.assign(ask=True)[["k", "h", "part", "ask"]]])

    parts = texts.select("text").mapInArrow(explode, "bucket int, kind int, k binary, many binary, code binary, n binary").groupBy("bucket").applyInPandas(join, "k long, h long, part double, ask boolean")
    parts = cut(parts, "parts")
    rare = counts.where(F.col("n") < least)
    looked = parts.where("ask").join(rare, "h").select("k", (F.col("part") * F.ln("n")).alias("part"))
    sums = parts.where("not ask").select("k", "part").union(looked).groupBy("k").agg(F.sum("part").alias("s"))
    copies = rows.where("n_words > 0").groupBy("k").agg(F.count("*").alias("c"))
    per_text = copies.join(sums, "k").select("k", (F.col("s") / F.col("c")).alias("log_score"))
    scored = rows.join(per_text, "k", "left")
    return scored.select("id", "n_words", "log_score", (F.col("log_score") / F.col("n_words")).alias("per_word"))


def op8_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"), F.round("per_word", 6).alias("per_word"))


ORACLE = r"""
with w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
b as (select doc_id, case when i = 1 then null else ws[i - 1] end as a, ws[i] as b from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w)),
u as (select b, count(*) as n from b group by b), t as (select count(*) as n, count(distinct doc_id) as d from b),
f as (select a, b, count(*) as n from b group by a, b),
s as (select b.doc_id, count(*) as n_words, sum(ln(case when f.n >= 2 then f.n / coalesce(ua.n, t.d) else 0.4 * ub.n / t.n end)) as s
  from b join f on f.a is not distinct from b.a and f.b = b.b left join u ua on ua.b = b.a join u ub on ub.b = b.b cross join t group by b.doc_id)
select w.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, round(s, 4) as log_score, round(s / n_words, 6) as per_word from w left join s using (doc_id)"""

QUERIES = {"op8_stupid_backoff": op8_stupid_backoff}
ORACLES = {"op8_stupid_backoff": ORACLE}
