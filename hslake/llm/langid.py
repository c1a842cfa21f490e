"""Language identification by prediction by partial matching over bytes.

For each language a context tree of orders 0 to ``order`` is counted on a bounded, hash-chosen sample of labelled documents
(``train_docs`` rows a language, every gram of their whole texts) and then frozen: symbol probabilities n / (N + D) and escapes D / (N + D) (method C, no exclusions), down to
1/256. Every gram's exact code length in every language is worked out once. A text's bytes look up their longest known context; where no
language has seen the gram, the escape costs are added and the next shorter context is tried. The language of least total length wins.
ASCII capitals read as small letters.

Null text or text without a letter: ``und``, score 0. No training documents: all ``und``. Null labels aren't learned from; null ids are
neither held out nor learned from. Repeated rows count as often as they occur. Whole texts are coded, however long, in slices of ``PART`` bytes
that see the bytes before them. Ties go to the first language in order. No documents: no rows. Other columns aren't read. The model grows with
the number of languages and ``train_docs``, not with the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import join_measured, cut
from ._text import chunks, mixed

UNKNOWN = "und"
PART = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def grams(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Codes of the byte strings of ``length`` that end at each byte; 0 where the row is too short before it."""
    code = np.zeros(len(data), np.uint64)
    if len(data) >= length:
        for k in range(length):
            code[length - 1 :] = (code[length - 1 :] << np.uint64(8)) | data[k : len(data) - length + 1 + k]
        code |= np.uint64(length << 56)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    code[np.arange(len(data)) - start < length - 1] = 0
    return code


class Model:
    """Frozen statistics: for each known gram its code length in bits in every language, and as a context its escape length."""

    def __init__(self, languages: list[str], counts: pd.DataFrame, order: int):
        self.languages, self.order = languages, order
        every = np.array([(1 << 56) | b for b in range(256)], np.uint64)
        self.keys = np.unique(np.concatenate((every, counts["gram"].to_numpy().astype(np.int64).view(np.uint64))))
        n = np.zeros((len(self.keys), len(languages)))
        number = {name: i for i, name in enumerate(languages)}
        np.add.at(n, (np.searchsorted(self.keys, counts["gram"].to_numpy().astype(np.int64).view(np.uint64)), np.array([number[name] for name in counts["lang"]], int)), counts["n"].to_numpy())
        length = (self.keys >> np.uint64(56)).astype(int)
        low = self.keys & np.uint64((1 << 56) - 1)
        self._index()
        total, kinds = np.zeros_like(n), np.zeros_like(n)
        root_total, root_kinds = n[length == 1].sum(axis=0), (n[length == 1] > 0).sum(axis=0)
        parent = np.full(len(self.keys), -1)
        for m in range(2, order + 2):
            rows = np.flatnonzero(length == m)
            parent[rows] = self.find((low[rows] >> np.uint64(8)) | np.uint64((m - 1) << 56))
            np.add.at(total, parent[rows], n[rows])
            np.add.at(kinds, parent[rows], n[rows] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
            root_escape = np.where(root_kinds > 0, -np.log2(root_kinds / (root_total + root_kinds)), 0.0)
            self.bits = np.zeros_like(n)
            for m in range(1, order + 2):
                rows = np.flatnonzero(length == m)
                if m == 1:
                    own, escape, shorter = n[rows] / (root_total + root_kinds), root_escape, 8.0
                else:
                    own = n[rows] / (total[parent[rows]] + kinds[parent[rows]])
                    escape = self.escape[parent[rows]]
                    shorter = self.bits[self.find((low[rows] & np.uint64((1 << 8 * (m - 1)) - 1)) | np.uint64((m - 1) << 56))]
                self.bits[rows] = np.where(n[rows] > 0, -np.log2(np.maximum(own, 1e-300)), escape + shorter)
        self.bits, self.escape = self.bits.astype(np.float32), self.escape.astype(np.float32)

    def _index(self) -> None:
        """Open addressing by a mixed key: the slot of each gram, found in a few vectorised probes."""
        size = 1 << max(10, int(np.ceil(np.log2(len(self.keys) * 3))))
        self.shift = np.uint64(64 - int(np.log2(size)))
        self.slots = np.full(size + 64, -1, np.int32)
        at, rest = (mixed(self.keys) >> self.shift).astype(np.int64), np.arange(len(self.keys))
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = self.slots[at[rest]] < 0
            take = rest[free]
            self.slots[at[take]] = take
            rest = rest[self.slots[at[rest]] != rest]
            at[rest] += 1
            assert at.max() < len(self.slots)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 if unknown."""
        at = (mixed(codes) >> self.shift).astype(np.int64)
        found = np.full(len(codes), -1, np.int64)
        rest = np.arange(len(codes))
        for _ in range(self.probes):
            slot = self.slots[at[rest]]
            hit = (slot >= 0) & (self.keys[slot] == codes[rest])
            found[rest[hit]] = slot[hit]
            rest = rest[~hit & (slot >= 0)]
            if not len(rest):
                break
            at[rest] += 1
        return found

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row in each language; a row over ``PART`` bytes stands alone and is coded in parts."""
        if len(data) <= PART or len(offsets) > 2:
            return self._code_lengths(data, offsets, 0)
        total = np.zeros((1, len(self.languages)))
        for a in range(0, len(data), PART):
            before = min(a, self.order)
            part = data[a - before : a + PART]
            total += self._code_lengths(part, np.array([0, len(part)]), before)
        return total

    def _code_lengths(self, data: np.ndarray, offsets: np.ndarray, seen: int) -> np.ndarray:
        """The first ``seen`` bytes are only read as context."""
        data = _LOWER[data]
        cost = np.zeros((len(data), len(self.languages)), np.float32)
        todo = np.arange(len(data))
        for m in range(self.order + 1, 0, -1):
            code = grams(data, offsets, m)[todo]
            able = np.flatnonzero(code)
            row = self.find(code[able])
            known = row >= 0
            cost[todo[able[known]]] += self.bits[row[known]]
            missed = able[~known]
            if m > 1 and len(missed):
                low = (code[missed] & np.uint64((1 << 56) - 1)) >> np.uint64(8)
                context = self.find(low | np.uint64((m - 1) << 56))
                cost[todo[missed[context >= 0]]] += self.escape[context[context >= 0]]
            stay = np.ones(len(todo), bool)
            stay[able[known]] = False
            todo = todo[stay]
            if not len(todo):
                break
        cost[:seen] = 0
        sums = np.zeros((len(data) + 1, len(self.languages)))
        np.cumsum(cost, axis=0, dtype=np.float64, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def train(docs: DataFrame, order: int, train_docs: int) -> Model:
    """The model from (id, text, lang) rows: a hash-chosen sample of about ``train_docs`` rows a language, grams counted on Spark."""
    per = cut(docs.groupBy("lang").agg(F.count("*").alias("c")), "languages")
    sample = join_measured(docs, per, "lang").where(F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * train_docs / F.col("c"))

    def count(batches):
        for chunk in chunks(batches):
            langs = np.array(chunk.batch.column(0).to_pylist())
            data = _LOWER[chunk.data]
            owner = np.repeat(np.arange(len(chunk)), np.diff(chunk.offsets))
            for lang in np.unique(langs):
                mine = (langs == lang)[owner]
                for m in range(1, order + 2):
                    code = grams(data, chunk.offsets, m)[mine]
                    g, n = np.unique(code[code > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    total = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    known = total.toPandas()
    return Model(sorted(known["lang"].unique()), known, order)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "ignore")))


def identify(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, train_docs: int = 200) -> DataFrame:
    """(id, lang, score, bits_per_byte), one row per document; ``training`` has the labelled rows that may be learned from."""
    known = training.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    model = train(known, order, train_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for chunk in chunks(batches, most=1 << 18):
            bits = model.code_lengths(chunk.data, chunk.offsets) if model.languages else np.zeros((len(chunk), 0))
            size = np.diff(chunk.offsets)
            plain = np.zeros(len(chunk.data) + 1, np.int64)
            np.cumsum(_LETTER[chunk.data], out=plain[1:])
            lettered = plain[chunk.offsets[1:]] > plain[chunk.offsets[:-1]]
            lang, score, rate = [], [], []
            for i in range(len(chunk)):
                if not model.languages or not (lettered[i] or has_letter(chunk.text(i))):
                    lang.append(UNKNOWN), score.append(0.0), rate.append(None)
                    continue
                best = int(bits[i].argmin())
                lang.append(model.languages[best])
                score.append(float(1 / np.exp2((bits[i, best] - bits[i]) / max(1.0, size[i] / 50)).sum()))
                rate.append(float(bits[i, best] / size[i]))
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["id", "lang", "score", "bits_per_byte"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang string, score double, bits_per_byte double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    out = identify(docs, docs.where(~held_out)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
