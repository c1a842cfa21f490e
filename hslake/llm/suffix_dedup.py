"""Removal of long repeated byte strings: Burrows-Wheeler transforms of shards, merged by interleave refinement.

Every ``length``-byte string holds, among its first ``window`` ``gram``-byte strings (gram + window - 1 = length), one of least hash: its
anchor. Equal strings have equal anchors at equal offsets, so strings are only held together at anchors that occur twice: a filter before
the merge, nothing else can repeat.

1. Each text gives its anchors. Equal texts form a class. Anchors that occur once are left out.
2. Every task is a shard. It reads the bytes from each anchor to the right, and those before it to the left, as two strings of phrases (``phrase``
   bytes each, numbered in the order of their bytes). Equal contexts of a shard become one with several owners. For the bucket that its anchors
   are dealt to, the shard sends the Burrows-Wheeler transforms of both string sets with their ends, the phrases in order, and the owners.
3. A bucket merges its shards' transforms without sorting a suffix: the interleave vector says which shard the next suffix of the merged order
   comes from; each round walks it and sends every suffix to the next place of the phrase before it (an LF step), until no round parts anything.
   The round that parts two neighbours gives their common phrases, the parting phrases the bytes beyond.
4. A string that starts ``o`` bytes before its anchor repeats exactly if another context lies in its interval of common prefix length - o
   to the right and in its interval of common prefix o to the left. The repeated intervals of all ``o`` are read off the two merged orders.
5. Contexts of an anchor with over ``hot`` occurrences aren't gathered in one bucket: their strings are counted by 128-bit hash, which no number of
   occurrences overfills. A shard answers for the strings that it holds twice and sends one witness of each; the others meet by hash. Results are
   the same.

Each byte covered by a string that also starts elsewhere, same text included, is removed; matches never cross texts. Null text: empty,
nothing removed, and kept null where text is asked for. Texts shorter than ``length``: nothing removed. Repeated rows: copies of each other.
Null ids stay. Very long texts: a chunk of their own, whole; their contexts are sent in slices. No documents: no rows. Other columns go
through in a struct, so their names can't clash. Contexts and phrases of a shard are told apart by 64-bit hashes, of shards by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._text import SYMBOLS, as_long, chunks, mixed, prefix_hash, release, span_hash

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9FB21C651E98DF25)
CONTEXTS, SLICE, SHARD_BYTES, HOT_STRINGS = 24_000, 20_000, 2 << 20, 1_000_000
#: Kinds of rows in place of a number of contexts: strings that ask, spans that are known.
ASKED, KNOWN = -1, -2


def anchors(data: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all grams that are least in some window lying within one row."""
    n = len(data) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    h = span_hash(prefix_hash(data), at, at + gram)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    h[at + gram > row_end[:n]] = _TOP

    def sliding(x, op, fill):
        k = -(-len(x) // window)
        blocks = np.full(k * window, fill, np.uint64)
        blocks[: len(x)] = x
        blocks = blocks.reshape(k, window)
        head = op.accumulate(blocks, axis=1).ravel()
        tail = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(x) - window + 1
        return op(tail[:m], head[window - 1 : window - 1 + m])

    least = sliding(h, np.minimum, _TOP)
    least[at[: len(least)] + window + gram - 1 > row_end[: len(least)]] = 0
    side = np.zeros(window - 1, np.uint64)
    most = sliding(np.concatenate((side, least, side)), np.maximum, np.uint64(0))
    pos = np.flatnonzero((most == h) & (h != _TOP))
    return pos, h[pos]


def suffix_order(codes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order of all suffixes of the strings (rows of phrase numbers), by bucket first; suffix j of row r is r * (m + 1) + j, j = m the bare end."""
    n, m = codes.shape
    padded = np.zeros((n, 2 * m), np.uint64)
    padded[:, :m] = codes + 1
    bits = int(codes.max(initial=0) + 1).bit_length()
    per = 63 // bits
    keys = []
    for a in range(0, m, per):
        key = np.zeros((n, m + 1), np.uint64)
        for k in range(a, min(a + per, m)):
            key = (key << np.uint64(bits)) | padded[:, k : k + m + 1] if k < m else key
        keys.append(key.ravel())
    return np.lexsort((*keys[::-1], np.repeat(bucket, m + 1)))


def transform(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform: the phrase before each suffix, in suffix order; -1 where a string begins."""
    m = codes.shape[1]
    row, j = order // (m + 1), order % (m + 1)
    return np.where(j > 0, codes[row, j - 1], -1).astype(np.int32)


def strings_of(last: np.ndarray, shard: np.ndarray, begin: np.ndarray, many: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Undo the shards' transforms by LF steps from the bare ends: the strings, and the row at which each stands whole."""
    to = np.empty(len(last), np.int64)
    to[np.lexsort((last, shard))] = np.arange(len(last))
    at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
    out = np.empty((len(at), m), np.int64)
    for j in range(m - 1, -1, -1):
        out[:, j] = last[at]
        at = to[at]
    return out, at


def merge_transforms(last: np.ndarray, shard: np.ndarray, many: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes, and for each merged suffix how many phrases it has in common with the one before it.

    ``last`` holds the transforms one after the other (shard 0 first), ``many`` each shard's strings, all of ``m`` phrases.
    """
    size, ends = len(last), int(many.sum())
    z, block, common = shard, np.zeros(size, np.int64), np.full(size, -1, np.int64)
    fixed = np.repeat(np.arange(len(many)), many)
    for h in range(m + 1):
        row = np.empty(size, np.int64)
        row[np.argsort(z, kind="stable")] = np.arange(size)
        symbol = last[row]
        source = np.argsort(symbol, kind="stable")[ends:]
        s, b = symbol[source], block[source]
        part = np.zeros(size, bool)
        part[[0, min(ends, size - 1)]] = True
        part[ends + 1 :] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        z, block = np.concatenate((fixed, z[source])), np.cumsum(part)
        fresh = part & (common < 0)
        common[fresh] = h
        if not fresh.any():
            break
    common[common < 0] = m
    return z, common


def merged_contexts(last: list[np.ndarray], words: list[np.ndarray], many: np.ndarray, phrase: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of all shards in merged order, and the bytes each has in common with the one before it (-1 for the first).

    ``words``: each shard's distinct phrases in byte order, ``phrase`` bytes a row, which its transform in ``last`` numbers.
    """
    every = np.concatenate(words)
    key = np.zeros(len(every), np.uint64)
    for k in range(phrase // 8):
        key = mixed(key ^ every.view(np.uint64)[:, k]) + _ODD
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    lead = np.argsort(every[first].view(f"S{phrase}").ravel(), kind="stable")
    number = np.empty(len(lead), np.int64)
    number[lead] = np.arange(len(lead))
    number, table = number[which], every[first[lead]]
    base = np.cumsum([0, *map(len, words)])
    sizes = np.array([len(x) for x in last])
    shard = np.repeat(np.arange(len(last)), sizes)
    flat = np.concatenate(last).astype(np.int64)
    flat = np.where(flat >= 0, number[np.maximum(flat, 0) + base[shard]], -1)
    strings, whole = strings_of(flat, shard, np.cumsum(sizes) - sizes, many, m)
    z, common = merge_transforms(flat, shard, many, m)
    row = np.empty(len(z), np.int64)
    row[np.argsort(z, kind="stable")] = np.arange(len(z))
    name = np.full(len(z), -1, np.int64)
    name[whole] = np.arange(len(whole))
    name = name[row]
    at = np.flatnonzero(name >= 0)
    order = name[at]
    lcp = np.full(len(at), -1, np.int64)
    if len(at) > 1:
        h = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1)
        x, y = (strings[order[k : len(order) - 1 + k], np.minimum(h, m - 1)] for k in (0, 1))
        differ = table[x] != table[y]
        lcp[1:] = np.where(h < m, h * phrase + differ.argmax(axis=1), m * phrase)
    return order, lcp


def repeated_offsets(right: tuple, left: tuple, lead: np.ndarray, follow: np.ndarray, length: int, window: int) -> np.ndarray:
    """Matrix of context by offset: whether the string that starts so many bytes before the anchor repeats.

    ``right`` and ``left`` are (order, common bytes) of the contexts to both sides; ``lead`` and ``follow`` say how many bytes are text.
    """
    n = len(lead)
    hit = np.zeros((n, window), bool)
    (order, lcp), (left_order, lcs) = right, left
    near = np.zeros(n, np.int64)
    for by, common in (right, left):
        near[by] += np.maximum(common, np.concatenate((common[1:], [-1])))
    may = (near >= length) & (lead + follow >= length)
    if not may.any():
        return hit
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(window):
        a[order] = np.cumsum(lcp < length - o)
        b[left_order] = np.cumsum(lcs < o)
        rows = np.flatnonzero(may & (lead >= o) & (follow >= length - o))
        key = a[rows] * (n + 1) + b[rows]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        hit[rows[by[twice]], o] = True
    return hit


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    n, m = hit.shape
    wide = np.zeros((n, m + 2), np.int8)
    wide[:, 1:-1] = hit
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


_SHARD = "bucket int, n int, weight binary, lead binary, follow binary, own binary, names binary, ats binary, r_bwt binary, r_words binary, l_bwt binary, l_words binary"
_FIELDS = [part.split()[0] for part in _SHARD.split(", ")]


def _sides(length: int, window: int) -> tuple[int, int, int]:
    """Bytes of a phrase, phrases to the right of an anchor, phrases to the left."""
    phrase = max(8, length // 7 // 8 * 8)
    return phrase, -(-length // phrase), max(1, -(-(window - 1) // phrase))


def shard_rows(chunk, names: list[bytes], full: np.ndarray, row: np.ndarray, at: np.ndarray, n_buckets: int, length: int, gram: int) -> list[tuple]:
    """A shard's rows for the buckets: contexts of the anchors at byte ``at`` of chunk row ``row``; ``full`` texts need no answer and count twice."""
    window = length - gram + 1
    phrase, m_right, m_left = _sides(length, window)
    data, sums = chunk.data, prefix_hash(chunk.data)
    pos = at + chunk.offsets[row]
    lead, follow = np.minimum(window - 1, at), np.minimum(length, chunk.offsets[row + 1] - pos)
    key = mixed(mixed(span_hash(sums, pos - lead, pos + follow) + lead.astype(np.uint64) * _ODD) + follow.astype(np.uint64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    weight = np.bincount(which, weights=1 + full[row])
    bucket = (mixed(span_hash(sums, pos[first], pos[first] + gram)) % np.uint64(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    bucket, pick, weight = bucket[by], first[by], weight[by]
    p, lead, follow = pos[pick], lead[pick], follow[pick]
    owners = np.flatnonzero(~full[row])
    owners = owners[np.argsort(place[which[owners]], kind="stable")]
    own = np.bincount(place[which[owners]], minlength=len(by))
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    cuts = np.concatenate((begin, [len(bucket)]))
    sides, edged = [], np.pad(data, phrase)
    for m, ahead in ((m_right, True), (m_left, False)):
        steps = phrase * np.arange(m + 1)
        edge = np.minimum(p[:, None] + steps, (p + follow)[:, None]) if ahead else np.maximum(p[:, None] - steps, (p - lead)[:, None])
        low, high = (edge[:, :-1], edge[:, 1:]) if ahead else (edge[:, 1:], edge[:, :-1])
        low, high = low.ravel(), high.ravel()
        _, one, number = np.unique(mixed(span_hash(sums, low, high) + (high - low).astype(np.uint64) * _ODD), return_index=True, return_inverse=True)
        view = np.lib.stride_tricks.sliding_window_view(edged, phrase)
        words = view[low[one] + phrase] if ahead else view[high[one]][:, ::-1].copy()
        words[np.arange(phrase) >= (high - low)[one][:, None]] = 0
        rank = np.argsort(words.view(f"S{phrase}").ravel(), kind="stable")
        place_of = np.empty(len(rank), np.int64)
        place_of[rank] = np.arange(len(rank))
        codes = place_of[number].reshape(-1, m)
        last = transform(codes, suffix_order(codes, bucket))
        used, local = np.unique(bucket[:, None] * len(rank) + codes, return_inverse=True)
        start = np.searchsorted(used, np.unique(bucket) * len(rank))
        which_bucket = np.repeat(np.arange(len(begin)), np.diff(cuts))
        mine = np.repeat(which_bucket, m + 1)
        known = np.searchsorted(used, bucket[begin][mine] * len(rank) + np.maximum(last, 0)) - start[mine]
        sides.append((np.where(last >= 0, known, -1).astype(np.int32), m, words[rank][used % len(rank)], np.concatenate((start, [len(used)]))))
    ends = np.concatenate(([0], np.cumsum(own)))
    rows = []
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        mine = owners[ends[i] : ends[j]]
        packed = [x[i:j].astype(t).tobytes() for x, t in ((weight, np.uint32), (lead, np.int32), (follow, np.int32), (own, np.int32))]
        for last, m, words, start in sides:
            packed += [last[i * (m + 1) : j * (m + 1)].tobytes(), words[start[k] : start[k + 1]].tobytes()]
        rows.append((int(bucket[i]), int(j - i), *packed[:4], b"".join(names[r] for r in row[mine]), at[mine].astype(np.int32).tobytes(), *packed[4:]))
    return rows


def hot_rows(chunk, names: list[bytes], full: np.ndarray, again: np.ndarray, n_buckets: int, hot_buckets: int, length: int, window: int) -> list[tuple]:
    """Rows of the strings through hot anchors: spans of those that this shard holds twice, the hashes of each of the others and of one witness."""
    near = np.zeros(len(chunk.data) + 1, np.int32)
    for i, hots in enumerate(chunk.batch.column("hots").to_pylist()):
        if hots and not again[i]:
            at, n = np.array(hots, np.int64), int(chunk.offsets[i + 1] - chunk.offsets[i])
            low, high = np.maximum(0, at - window + 1), np.minimum(at, n - length)
            fits = low <= high
            np.add.at(near, chunk.offsets[i] + low[fits], 1)
            np.add.at(near, chunk.offsets[i] + high[fits] + 1, -1)
    start = np.flatnonzero(np.cumsum(near) > 0)
    if not len(start):
        return []
    row = np.searchsorted(chunk.offsets, start, "right") - 1
    local = start - chunk.offsets[row]
    one, two = (span_hash(prefix_hash(chunk.data, table), start, start + length) for table in (SYMBOLS, SYMBOLS[::-1].copy()))
    by = np.lexsort((two, one))
    new = np.concatenate(([True], (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])))
    ask, times = by[new], np.diff(np.concatenate((np.flatnonzero(new), [len(by)])))
    sure = np.empty(len(start), bool)
    sure[by] = np.repeat(times > 1, times)
    own = sure & ~full[row]
    begin = own & ~np.concatenate(([False], own[:-1] & (start[1:] == start[:-1] + 1) & (row[1:] == row[:-1])))
    stop = own & np.concatenate((begin[1:] | ~own[1:], [True]))
    label = lambda rows: b"".join(names[r] for r in rows)
    made = lambda bucket, kind, one, two, start, names, stop: (bucket, kind, one, two, start, b"", names, stop, b"", b"", b"", b"")
    rows = [made(n_buckets + int(one[0] % np.uint64(hot_buckets)), KNOWN, b"", b"", local[begin].tobytes(), label(row[begin]), (local[stop] + length).tobytes())]
    plain = ~sure[ask] & ~full[row[ask]]
    bucket = (mixed(one[ask]) % np.uint64(hot_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    ask, plain, bucket = ask[by], plain[by], bucket[by]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for i, j in zip(cuts, cuts[1:]):
        a, p = ask[i:j], plain[i:j]
        rows.append(made(n_buckets + int(bucket[i]), ASKED, one[a].tobytes(), two[a].tobytes(), np.where(p, local[a], -1).tobytes(), label(row[a]), b""))
    return rows


def _merge_hot(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of hot strings that two shards, or one shard twice, hold."""
    ints = lambda rows, column: np.frombuffer(b"".join(rows[column]), np.int64)
    names = lambda rows: np.frombuffer(b"".join(rows["names"]), "V16")
    asked, known = pdf[pdf["n"] == ASKED], pdf[pdf["n"] == KNOWN]
    one, two, start = ints(asked, "weight"), ints(asked, "lead"), ints(asked, "follow")
    by = np.lexsort((two, one))
    new = np.concatenate(([True], (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])))[: len(by)]
    group = np.cumsum(new) - 1
    held = np.bincount(group, weights=np.where(start[by] < 0, 2, 1))
    hit = by[(held[group] > 1) & (start[by] >= 0)]
    release()
    told = np.concatenate((names(asked)[hit], names(known)))
    return pd.DataFrame({"k": [x.tobytes() for x in told], "start": np.concatenate((start[hit], ints(known, "follow"))), "stop": np.concatenate((start[hit] + length, ints(known, "ats")))})


def _merge_bucket(pdf: pd.DataFrame, length: int, window: int) -> pd.DataFrame:
    if pdf["n"].iloc[0] < 0:
        return _merge_hot(pdf, length)
    phrase, m_right, m_left = _sides(length, window)
    many = pdf["n"].to_numpy(np.int64)
    weight, lead, follow, own = (np.frombuffer(b"".join(pdf[c]), t).astype(np.int64) for c, t in (("weight", np.uint32), ("lead", np.int32), ("follow", np.int32), ("own", np.int32)))
    sides = []
    for side, m in (("r", m_right), ("l", m_left)):
        last, words = ([np.frombuffer(x, t) for x in pdf[f"{side}_{c}"]] for c, t in (("bwt", np.int32), ("words", np.uint8)))
        sides.append(merged_contexts(last, [w.reshape(-1, phrase) for w in words], many, phrase, m))
    hit = repeated_offsets(*sides, lead, follow, length, window)
    o = np.arange(window)
    twice = weight > 1
    hit[twice] = (o <= lead[twice, None]) & (length - o <= follow[twice, None])
    hit[own == 0] = False
    context, first, last = _runs(hit)
    names, at = np.frombuffer(b"".join(pdf["names"]), "V16"), np.frombuffer(b"".join(pdf["ats"]), np.int32).astype(np.int64)
    times = own[context]
    run = np.repeat(np.arange(len(context)), times)
    owner = np.repeat((np.cumsum(own) - own)[context] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    release()
    return pd.DataFrame({"k": [x.tobytes() for x in names[owner]], "start": at[owner] - last[run], "stop": at[owner] - first[run] + length})


def repeated_spans(docs: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(k, copies, n_bytes) of every class of equal texts, and (k, spans) of those with repeated strings: [start, stop) pairs, not merged.

    All joins move both sides, at every size: none of the tables is bounded.
    """
    window = length - gram + 1

    def scan(batches):
        for chunk in chunks(batches):
            pos, h = anchors(chunk.data, chunk.offsets, gram, window)
            cuts = np.searchsorted(pos, chunk.offsets)
            row = np.repeat(np.arange(len(chunk)), np.diff(cuts))
            offs = pa.array(cuts.astype(np.int32))
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(np.diff(chunk.offsets)), pa.ListArray.from_arrays(offs, as_long(h)), pa.ListArray.from_arrays(offs, pa.array((pos - chunk.offsets[row]).astype(np.int32)))], names=["k", "n_bytes", "fps", "ats"])

    seen = docs.select("k", "text").mapInArrow(scan, "k binary, n_bytes long, fps array<long>, ats array<int>")
    classes = cut(seen.groupBy("k").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("fps").alias("fps"), F.first("ats").alias("ats")), "anchors")
    often = cut(classes.select(F.explode("fps").alias("fp")).groupBy("fp").agg(F.count("*").alias("df")).where("df > 1"), "often")
    posts = classes.select("k", (F.col("copies") > 1).alias("full"), F.explode(F.arrays_zip("fps", "ats")).alias("p")).select("k", "full", F.col("p.fps").alias("fp"), F.col("p.ats").alias("at"))
    found = posts.join(often.hint("shuffle_merge"), "fp").select("k", "full", "at", (F.col("df") > hot).alias("hot"))
    wanted = cut(found.groupBy("k", "full").agg(F.collect_list(F.when(~F.col("hot"), F.col("at"))).alias("ats"), F.collect_list(F.when(F.col("hot"), F.col("at"))).alias("hots")), "wanted")
    n, n_hot = wanted.agg(F.sum(F.size("ats")), F.sum(F.size("hots"))).first()
    n_buckets = max(8, -(-(n or 0) // CONTEXTS))
    hot_buckets = -(-(n_hot or 0) * window // HOT_STRINGS)
    texts = docs.select("k", "text").hint("shuffle_merge").join(wanted, "k").select("k", "full", "ats", "hots", "text")

    def ship(batches):
        for chunk in chunks(batches, most=SHARD_BYTES):
            names, ats = chunk.batch.column("k").to_pylist(), chunk.batch.column("ats")
            full = chunk.batch.column("full").to_numpy(zero_copy_only=False)
            size = ats.value_lengths().to_numpy()
            row, at = np.repeat(np.arange(len(chunk)), size), ats.flatten().to_numpy().astype(np.int64)
            again = np.array([i > 0 and names[i] == names[i - 1] for i in range(len(names))])
            row, at = row[~again[row]], at[~again[row]]
            packed = [shard_rows(chunk, names, full, row[a : a + SLICE], at[a : a + SLICE], n_buckets, length, gram) for a in range(0, len(at), SLICE)]
            if hot_buckets:
                packed.append(hot_rows(chunk, names, full, again, n_buckets, hot_buckets, length, window))
            for rows in filter(None, packed):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 10))], names=_FIELDS)

    spans = texts.mapInArrow(ship, _SHARD).groupBy("bucket").applyInPandas(lambda pdf: _merge_bucket(pdf, length, window), "k binary, start long, stop long")
    spans = spans.groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return classes.select("k", "copies", "n_bytes"), spans


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64, hot: int = 50_000, as_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256[, carried]), one row per document; ``carried`` is a struct of the columns ``carry``.

    ``kept`` is the text's bytes without the removed runs. With ``as_text`` it is text: a character that a cut has broken is dropped, and null stays null.
    """
    rest = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("k"), F.col(text_col).cast("string").alias("text"), *rest)
    classes, spans = repeated_spans(base, length, gram, hot)
    full = classes.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("k", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"))
    found = cut(full.union(spans).select("k", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")), "spans")

    def clean(batches):
        for chunk in chunks(batches):
            starts, stops = (chunk.batch.column(c).to_pylist() for c in ("starts", "stops"))
            out = []
            for i in range(len(chunk)):
                body = chunk.text(i)
                gone, runs, kept, end = 0, 0, [], 0
                for a, b in sorted(zip(starts[i] or (), stops[i] or ())):
                    if a > end or not runs:
                        runs += 1
                        kept.append(body[end:a])
                        gone += b - a
                        end = b
                    elif b > end:
                        gone += b - end
                        end = b
                kept.append(body[end:])
                whole = b"".join(kept)
                text = (b"".join(k.decode("utf-8", "ignore").encode() for k in kept) if chunk.valid[i] else None) if as_text else whole
                out.append((len(body), gone, runs, text, hashlib.sha256(whole).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            cols = [pa.array(x, t) for x, t in zip(zip(*out), kinds)]
            cols[3] = cols[3].cast(pa.string()) if as_text else cols[3]
            more = [chunk.batch.column("carried")] if carry else []
            yield pa.RecordBatch.from_arrays([chunk.batch.column("id"), *cols, *more], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", *["carried"] * len(more)])

    schema = f"id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, kept_sha256 string" + (f", carried {dict(base.dtypes)['carried']}" if carry else "")
    return base.join(found.hint("shuffle_merge"), "k", "left").drop("k").mapInArrow(clean, schema)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
s as (select doc_id, unnest(range(0, len(x) // 2 - 399)) as i, x from d where len(x) >= 800),
w as (select doc_id, i, md5(substring(x, cast(2 * i + 1 as bigint), 800)) as h from s),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) as c from w) where c > 1),
g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end as new from r),
run as (select doc_id, n, min(i) as a, max(i) + 400 as b from (select *, sum(new) over (partition by doc_id order by i) as n from g) group by doc_id, n),
cuts as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as prev, row_number() over (partition by doc_id order by a desc) as back from run),
kept as (select doc_id, string_agg(substring(x, cast(2 * prev + 1 as bigint), cast(2 * (a - prev) as bigint)), '' order by a) || max(case when back = 1 then substring(x, cast(2 * b + 1 as bigint)) end) as k, sum(b - a) as n_removed, count(*) as n_spans from cuts join d using (doc_id) group by doc_id)
select d.doc_id, cast(len(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, lower(sha256(unhex(coalesce(k, x)))) as kept_sha256
from d left join kept using (doc_id)"""

QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLES = {"op5_suffix_dedup": ORACLE}
