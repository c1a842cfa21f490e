"""Benchmark decontamination by latent semantic retrieval, then longest-common-subsequence and answer checks.

1. Terms are the words of the benchmark items (lower case, punctuation dropped). The texts are split once; later passes read the stored
   numbers of their words. Document frequencies are counted over every passage of every document.
2. The TF-IDF passages of all documents and the items give the latent space by a distributed randomised SVD: one pass sums A'(A W) for a
   random W, a second one the Gram matrix of A Q, whose eigenvectors turn the basis Q.
3. Every window of every document is projected: sums over steps of words, then over the steps of a window. One pass over the documents takes its
   cosine with all items, in blocks of ``block_items``; those at or over ``cosine`` are candidates. ``recall`` of this search is measured in the tests.
   Candidates whose term signatures show that no common subsequence can be long enough are dropped at once (an exact bound).
4. A candidate leaks if the longest common subsequence of item and window, computed for all candidates at once in machine words, has
   at least ``verbatim`` of the item's words, or at least ``paraphrase`` of them and ``answer`` of the item's last sentence. An item
   of few words fills less of its window, so the least cosine falls with the root of its length (``FULL``).
5. Items under ``min_words`` words leak where all their words stand in a row.

Items are a stated query set, held by the driver and every task; items over 64 words are asked in parts; an item id with several texts leaks if one
does, and has one row a document: that of the greatest ratio. Words end at ASCII signs and spaces; of scripts without spaces (Chinese, Japanese,
Thai, Lao, Burmese, Khmer) every character is a word. Null or wordless texts leak nothing; repeated rows give repeated results; null ids stay; an
empty benchmark or no documents give no rows. Very long texts: read whole, their windows in slices. Other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, join_measured
from ._text import chunks, words

#: Bytes that end words: ASCII but letters and digits.
TERM_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACED = np.where(TERM_BREAKS, np.uint8(32), _LOWER).tobytes()
STEP, SLICE = 16, 8192
#: When the basis is fitted, the items count so many times as passages, among so many passages; in proportion among more.
OWN_WEIGHT, OWN_PASSAGES = 50.0, 40_000
#: (items of up to so many words, steps in a window, steps between windows): an item lies whole in some window.
WINDOWS = ((24, 3, 1), (64, 6, 2))
#: Items of fewer words are held against a lower cosine.
FULL = 24
#: So many of the commonest terms are multiplied as dense columns, the others by their places.
COMMON = 256
#: Words of 64 bits in a signature: the commonest terms have a bit each in the first half, the others share those of the second.
SIGN = 4
_SENTENCE = re.compile(rb"[.!?\n]+|\xe3\x80\x82|\xef\xbc[\x81\x9f]")


def spaced_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets with spaces around every character of a script without spaces; its punctuation becomes spaces."""
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + 2 < len(data)]
    if not len(at):
        return data, offsets
    a, b, c = data[at], data[at + 1], data[at + 2]
    wide = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b >= 0x9E) & (b <= 0x9F)) | (a == 0xE3) & ((b >= 0x81) & (b <= 0x83) | (b >= 0x90))
    wide |= (a >= 0xE4) & (a <= 0xE9) | (a == 0xEF) & (b >= 0xA4) & (b <= 0xAB) | (a == 0xF0) & (b >= 0xA0)
    signs = at[(a == 0xE3) & (b == 0x80) | (a == 0xEF) & (b == 0xBC) & ((c <= 0x8F) | (c >= 0x9A) & (c <= 0xA0))]
    if not wide.any() and not len(signs):
        return data, offsets
    if len(signs):
        data = data.copy()
        for k in range(3):
            data[signs + k] = 32
    begin = at[wide]
    places = np.sort(np.concatenate((begin, begin + np.where(a[wide] == 0xF0, 4, 3))))
    return np.insert(data, places, 32), offsets + np.searchsorted(places, offsets)


def terms(text: str) -> list[bytes]:
    raw, _ = spaced_out(np.frombuffer((text or "").encode(), np.uint8), np.zeros(1, np.int64))
    low = _LOWER[raw].tobytes()
    return [low[a:b] for a, b in zip(*words(raw, np.array([0, len(raw)]), TERM_BREAKS)[:2])]


def answer_length(text: str) -> int:
    """Words of the item's last sentence, at least four."""
    parts = [len(terms(s.decode(errors="ignore"))) for s in _SENTENCE.split((text or "").encode())]
    last = [n for n in parts if n]
    return max(4, last[-1]) if last else 4


class Items:
    """The query set: its words as numbers, bits for the subsequence check, and term weights. All grow with the items alone."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        self.ids, words, answers, short = [], [], [], []
        for item, text in rows:
            found = terms(text)
            if len(found) < min_words:
                short += [(item, found)] if found else []
                continue
            k = -(-len(found) // 64)
            cuts = [len(found) * i // k for i in range(k + 1)]
            for a, b in zip(cuts, cuts[1:]):
                self.ids.append(item)
                words.append(found[a:b])
                answers.append(min(answer_length(text), b - a) if b == len(found) else 0)
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in [*words, *(f for _, f in short)] for w in ws))}
        self.short = [(item, np.array([self.vocabulary[w] for w in ws])) for item, ws in short]
        self.length = np.array([len(ws) for ws in words], np.int64)
        item = np.repeat(np.arange(len(words)), self.length)
        place = np.arange(len(item)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        term = np.array([self.vocabulary[w] for ws in words for w in ws], np.int64)
        self.keys, which, self.times = np.unique(item * (len(self.vocabulary) + 1) + term, return_inverse=True, return_counts=True)
        self.bits = np.zeros(len(self.keys), np.uint64)
        np.bitwise_or.at(self.bits, which, np.uint64(1) << place.astype(np.uint64))
        full = [(1 << len(ws)) - 1 for ws in words]
        self.full = np.array(full, np.uint64)
        self.answer = np.array([f & ~((1 << (len(ws) - a)) - 1) if a else 0 for f, ws, a in zip(full, words, answers)], np.uint64)
        self.answer_words = np.array(answers, np.int64)

    def weights(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, term, value) of the items' TF-IDF vectors, each of length one."""
        item, term = np.divmod(self.keys, len(self.vocabulary) + 1)
        value = self.times * idf[term]
        norm = np.sqrt(np.bincount(item, weights=value**2, minlength=len(self.ids)))
        return item, term, (value / np.maximum(1e-9, norm)[item]).astype(np.float32)

    def masks(self, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a block of items: the column of each term, and by item and column the bits of the places at which the item holds the term."""
        item, term = np.divmod(self.keys, len(self.vocabulary) + 1)
        own = np.isin(item, mine)
        names, column = np.unique(term[own], return_inverse=True)
        columns = np.full(len(self.vocabulary) + 1, len(names))
        columns[names] = np.arange(len(names))
        table = np.zeros((len(mine), len(names) + 1), np.uint64)
        table[np.searchsorted(mine, item[own]), column] = self.bits[own]
        return columns, table

    def numbers(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        """Term number (the vocabulary's size if none) of every word of a chunk, and where each row's words begin, with the end."""
        data, offsets = spaced_out(chunk.data, chunk.offsets)
        none = len(self.vocabulary)
        spaced = pa.LargeStringArray.from_buffers(len(chunk), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data.tobytes().translate(_SPACED)))
        split = pc.ascii_split_whitespace(spaced)
        names = pa.array([*self.vocabulary, b""], pa.large_binary()).view(pa.large_string())
        found = pc.fill_null(pc.index_in(split.values, value_set=names), none + 1).to_numpy()
        word = found != none
        ends = np.concatenate(([0], np.cumsum(word)))
        return np.minimum(found[word], none), ends[split.offsets.to_numpy()]

    def kind(self) -> str:
        """What stored term numbers are: two bytes if they fit."""
        return "<u2" if len(self.vocabulary) < 1 << 16 else "<i4"

    def signatures(self, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of every term (none for the last row), of every item, and of how many of its words an item's bits say nothing."""
        rank = np.argsort(np.argsort(-df, kind="stable"))
        half = SIGN * 32
        bit = np.where(rank < half, rank, half + rank % half)
        signs = np.zeros((len(self.vocabulary) + 1, SIGN), np.uint64)
        signs[np.arange(len(bit)), bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        item, term = np.divmod(self.keys, len(self.vocabulary) + 1)
        own = np.zeros((len(self.ids), SIGN), np.uint64)
        np.bitwise_or.at(own, item, signs[term])
        return signs, own, self.length - np.bitwise_count(own).sum(1, dtype=np.int64)


def common_subsequence(masks: np.ndarray, full: np.ndarray, row: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Bits of a longest common subsequence's prefix rows: popcounts of ``~v & full`` are its lengths, for all pairs at once."""
    v = full.copy()
    for k in range(window.shape[1]):
        u = v & masks[row, window[:, k]]
        v = ((v + u) | (v - u)) & full
    return ~v & full


def numbered(docs: DataFrame, items: Items) -> DataFrame:
    """(id, numbers): the term numbers of all words of every row, as ``Items.kind``, split from the text once for all passes."""
    kind = items.kind()

    def run(batches):
        for chunk in chunks(batches, most=1 << 21):
            ids, at = items.numbers(chunk)
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunk), [None, pa.py_buffer((at * np.dtype(kind).itemsize).astype(np.int64)), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), body.cast(pa.binary())], names=["id", "numbers"])

    return cut(docs.mapInArrow(run, "id long, numbers binary"), "numbers")


def _numbers(batches, kind: str, most: int = 1 << 18):
    """Chunks of ``numbered`` rows, the term number of every word and where each row's words begin, with the end."""
    for chunk in chunks(batches, "numbers", most):
        yield chunk, np.frombuffer(chunk.data.tobytes(), kind).astype(np.int64), chunk.offsets // np.dtype(kind).itemsize


def _passages(items: Items, ids: np.ndarray, at: np.ndarray, length: int):
    """Numbers of the words that are terms, and the passage each lies in (disjoint runs of ``length`` words in a row)."""
    n = np.diff(at)
    runs = -(-n // length)
    first = np.cumsum(runs) - runs
    passage = (np.arange(len(ids)) - np.repeat(at[:-1], n)) // length + np.repeat(first, n)
    known = ids < len(items.vocabulary)
    return ids[known], passage[known], int(runs.sum())


def document_frequencies(docs: DataFrame, items: Items, length: int) -> tuple[np.ndarray, int]:
    """In how many passages each term occurs, over all ``numbered`` documents, and the number of passages."""
    size, kind = len(items.vocabulary), items.kind()

    def run(batches):
        df, n = np.zeros(size + 1, np.int64), 0
        for _, ids, at in _numbers(batches, kind):
            ids, passage, k = _passages(items, ids, at, length)
            df[:size] += np.bincount(np.unique(passage * size + ids) % size, minlength=size) if len(ids) else 0
            n += k
        if n:
            df[size] = n
            hit = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(df[hit])], names=["term", "n"])

    df = np.zeros(size + 1, np.int64)
    for r in docs.select("numbers").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    return df[:size], int(df[size])


def _add(out: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray, right: np.ndarray, gram: bool, common: np.ndarray) -> None:
    """Add A'(A ``right``), or the Gram matrix of A ``right``, of a sparse A given by its sorted rows, terms and values (each cell once)."""
    if not len(row):
        return
    place = np.full(len(right), -1)
    place[common] = np.arange(len(common))
    column = place[term]
    often = column >= 0
    dense = np.zeros((int(row[-1]) + 1, len(common)), np.float32)
    dense[row[often], column[often]] = value[often]
    y = dense @ right[common]
    row, term, value = row[~often], term[~often], value[~often, None]
    if len(row):
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        y[row[begin]] += np.add.reduceat(value * right[term], begin, axis=0)
    if gram:
        out += y.T @ y
        return
    out[common] += dense.T @ y
    if len(row):
        order = np.argsort(term, kind="stable")
        row, term, value = row[order], term[order], value[order]
        begin = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        out[term[begin]] += np.add.reduceat(value * y[row], begin, axis=0)


def latent_basis(docs: DataFrame, items: Items, idf: np.ndarray, n: int, common: np.ndarray, length: int, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms by rank) of all ``n`` TF-IDF passages and the items, by a two-pass randomised SVD."""
    size, kind = len(items.vocabulary), items.kind()
    width = min(size, rank + 8)
    own = items.weights(idf)

    def summed(right: np.ndarray, gram: bool) -> np.ndarray:
        shape = (width, width) if gram else (size, width)

        def run(batches):
            out = np.zeros(shape, np.float32)
            for _, ids, at in _numbers(batches, kind):
                ids, passage, k = _passages(items, ids, at, length)
                key, n = np.unique(passage * size + ids, return_counts=True)
                passage, term = np.divmod(key, max(1, size))
                value = n * idf[term]
                value /= np.maximum(1e-9, np.sqrt(np.bincount(passage, weights=value**2, minlength=k)))[passage]
                for a in range(0, k, 2048):
                    i, j = np.searchsorted(passage, (a, a + 2048))
                    _add(out, passage[i:j] - a, term[i:j], value[i:j].astype(np.float32), right, gram, common)
            parts = [a for a in range(0, shape[0], 256) if out[a : a + 256].any()]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([out[a : a + 256].tobytes() for a in parts])], names=["part", "sums"])

        def add(pdf):
            total = np.sum([np.frombuffer(b, np.float32) for b in pdf["sums"]], axis=0, dtype=np.float64)
            return pdf.head(1)[["part"]].assign(sums=[total.astype(np.float32).tobytes()])

        total = np.zeros(shape)
        for r in docs.select("numbers").mapInArrow(run, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").collect():
            total[r.part : r.part + 256] = np.frombuffer(r.sums, np.float32).reshape(-1, shape[1])
        mine = np.zeros(shape)
        _add(mine, *own, right, gram, common)
        return total + OWN_WEIGHT * max(1.0, n / OWN_PASSAGES) * mine

    w = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    q, _ = np.linalg.qr(summed(w, False))
    values, turn = np.linalg.eigh(summed(q.astype(np.float32), True))
    return (q @ turn[:, np.argsort(-values)[: min(rank, size)]]).astype(np.float32)


def _step_sums(step: np.ndarray, term: np.ndarray, steps: int, project: np.ndarray, common: np.ndarray, place: np.ndarray, bits_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the projected terms and union of the term bits, by step; ``step`` is sorted."""
    column = place[term]
    often = column >= 0
    counts = np.bincount(step[often] * len(common) + column[often], minlength=steps * len(common)).reshape(steps, len(common))
    sums = counts.astype(np.float32) @ project[common]
    signed = np.zeros((steps, bits_of.shape[1]), np.uint64)
    if len(step):
        begin = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1])))
        signed[step[begin]] = np.bitwise_or.reduceat(bits_of[term], begin, axis=0)
    step, term = step[~often], term[~often]
    if len(step):
        begin = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1])))
        sums[step[begin]] += np.add.reduceat(project[term], begin, axis=0)
    return sums, signed


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rank: int = 96, cosine: float = 0.4, verbatim: float = 0.75, paraphrase: float = 0.6, answer: float = 0.75, min_words: int = 8, block_items: int = 256) -> DataFrame:
    """(id, item_id, cosine, lcs_ratio, answer_ratio, kind): one row per document and item that leaks into it."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = cut(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null"), "items")
    rows = asked.distinct().orderBy("item", "text").collect()
    items = Items([(r.item, r.text) for r in rows], min_words)
    if not items.vocabulary:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    return _search(texts, items, rank, cosine, verbatim, paraphrase, answer, block_items)


_SCHEMA = "id long, item_id long, cosine double, lcs_ratio double, answer_ratio double, kind string"


def _search(texts: DataFrame, items: Items, rank: int, cosine: float, verbatim: float, paraphrase: float, answer: float, block_items: int) -> DataFrame:
    length, kind = STEP * 2, items.kind()
    texts = numbered(texts, items)
    df, n = document_frequencies(texts, items, length)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    common = np.argsort(-df, kind="stable")[:COMMON]
    basis = latent_basis(texts, items, idf, n, common, length, rank)
    project = np.concatenate((basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)))
    item, term, value = items.weights(idf)
    asked = np.zeros((len(items.ids), basis.shape[1]), np.float32)
    np.add.at(asked, item, value[:, None] * basis[term])
    asked /= np.maximum(1e-9, np.linalg.norm(asked, axis=1, keepdims=True))
    item_ids = np.array(items.ids)
    gate = (cosine * np.sqrt(np.minimum(1, items.length / FULL))).astype(np.float32)
    signs = items.signatures(df)
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((items, project, asked, signs, common))

    def run(batches):
        items, project, asked, (bits_of, item_bits, unsaid), common = shared.value
        none = len(items.vocabulary)
        place = np.full(none + 1, -1)
        place[common] = np.arange(len(common))
        least_words = np.minimum(verbatim, paraphrase) * items.length
        held: dict[tuple[int, int], tuple] = {}
        for chunk, ids, at in _numbers(batches, kind):
            if not len(ids):
                continue
            rows = np.repeat(np.arange(len(chunk)), np.diff(at))
            steps = -(-np.diff(at) // STEP)
            first = np.concatenate(([0], np.cumsum(steps)))
            slot = np.arange(len(ids)) - at[rows] + first[rows] * STEP
            grid = np.full((first[-1] + 1) * STEP, none)
            grid[slot] = ids
            known = ids < none
            where = slot[known] // STEP
            known_ids = ids[known]
            row_of = np.repeat(np.arange(len(chunk)), steps)
            best: dict[tuple[int, int], tuple] = {}
            for low in range(0, int(first[-1]), SLICE):
                high = min(low + SLICE, int(first[-1]))
                i, j = np.searchsorted(where, (low, high + WINDOWS[-1][1]))
                sums, signed = _step_sums(where[i:j] - low, known_ids[i:j], high + WINDOWS[-1][1] - low, project, common, place, bits_of)
                least = 0
                for most, reach, stride in WINDOWS:
                    sizes = np.flatnonzero((items.length > least) & (items.length <= most))
                    least = most
                    if not len(sizes):
                        continue
                    begins = low + np.flatnonzero((np.arange(low, high) - first[row_of[low:high]]) % stride == 0)
                    vectors = np.zeros((len(begins), project.shape[1]), np.float32)
                    seen = np.zeros((len(begins), SIGN), np.uint64)
                    for k in range(reach):
                        inside = (begins + k) < first[row_of[begins] + 1]
                        vectors[inside] += sums[begins[inside] + k - low]
                        seen[inside] |= signed[begins[inside] + k - low]
                    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
                    for b in range(0, len(sizes), block_items):
                        mine = sizes[b : b + block_items]
                        near = vectors @ asked[mine].T
                        w, item = np.divmod(np.flatnonzero(near >= gate[mine]), len(mine))
                        # No subsequence is longer than the item's words whose bits the window has, and those of which the bits say nothing.
                        most_words = sum(np.bitwise_count(seen[w, k] & item_bits[mine[item], k]).astype(np.int64) for k in range(SIGN)) + unsaid[mine[item]]
                        able = most_words >= least_words[mine[item]]
                        w, item = w[able], item[able]
                        if not len(w):
                            continue
                        if (most, b) not in held:
                            if len(held) > 1:
                                held.clear()
                            held[most, b] = items.masks(mine)
                        columns, masks = held[most, b]
                        score, row, item = near[w, item], item, mine[item]
                        stop = np.minimum(begins[w] + reach, first[row_of[begins[w]] + 1]) * STEP
                        cells = begins[w][:, None] * STEP + np.arange(STEP * reach)
                        window = np.where(cells < stop[:, None], grid[np.minimum(cells, len(grid) - 1)], none)
                        bits = common_subsequence(masks, items.full[item], row, columns[window])
                        found, m = np.bitwise_count(bits), items.length[item]
                        tail = np.bitwise_count(bits & items.answer[item]) / np.maximum(1, items.answer_words[item])
                        whole = found >= verbatim * m
                        part = (found >= paraphrase * m) & (tail >= answer) & (items.answer_words[item] > 0)
                        for k in np.flatnonzero(whole | part):
                            key = (int(row_of[begins[w[k]]]), int(item_ids[item[k]]))
                            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (float(found[k] / m[k]), float(tail[k]), float(score[k])))
            for item, seq in items.short:
                at_word = np.flatnonzero(ids[: len(ids) - len(seq) + 1] == seq[0]) if len(ids) >= len(seq) else ids[:0]
                for k in range(1, len(seq)):
                    at_word = at_word[ids[at_word + k] == seq[k]]
                for r in np.unique(rows[at_word][rows[at_word] == rows[at_word + len(seq) - 1]]):
                    best[int(r), item] = max(best.get((int(r), item), (0.0, 0.0, 0.0)), (1.0, 1.0, 1.0))
            if best:
                names = chunk.batch.column(0).to_pylist()
                out = [(names[r], i, c, l, t, "verbatim" if l >= verbatim else "paraphrase") for (r, i), (l, t, c) in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()))], names=["id", "item_id", "cosine", "lcs_ratio", "answer_ratio", "kind"])

    return texts.mapInArrow(run, _SCHEMA)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without a leak; rows of null id are judged by their text alone and stay."""
    bad = cut(leaks(docs, benchmark, id_col=id_col, **options).where("id is not null").select(F.col("id").alias(id_col)).distinct(), "leaks")
    return join_measured(docs, bad, id_col, "left_anti")


def op1_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = leaks(docs, bench)
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs_ratio", 4).alias("lcs_ratio"), F.round("answer_ratio", 4).alias("answer_ratio"), "kind")


QUERIES = {"op1_latent_decontamination": op1_latent_decontamination}
ORACLES: dict[str, str] = {}
