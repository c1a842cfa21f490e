"""Cross-tokenizer alignment by merge-path partitioning.

A text's tokens of two tokenizers end at byte offsets; merging both end lists gives every overlapping pair (one per distinct end) and the groups (between ends
that both share). Merging is divided by diagonals: a binary search on each finds where the merge stands after that many steps, so pieces of
equal work are merged independently of each other. Every document is kept as such pieces in a table; a long document's pieces are dealt over all
tasks, and their open groups are stitched by a pass over the pieces in order.

Pairs are counted by documents: distinct within a piece's document, summed in tasks, then by pair. Pairs of at least ``2^k`` documents are broadcast,
with the least k that leaves at most ``HOT_PAIRS`` of them; links of rarer pairs, fewer than ``2^k`` rows each, are joined by pair.

Null or empty texts, and texts whose tokens' bytes aren't space+text, have no tokens: zeros and ''. Very long texts: whole, encoded in slices that no token
crosses. Repeated rows are documents of their own. Null ids stay. Equal counts are all best. Empty table: no rows. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens
from ._spark import cut
from ._text import chunks

PIECE, HOT_PAIRS = 1 << 16, 1 << 18
#: Entries that a task keeps before it sorts and counts them.
HELD = 1 << 20
PIECES = "part int, row long, id long, piece int, n_a long, n_b long, a binary, b binary, ends_a int, ends_b int, shift int"


def diagonal_cuts(a_end: np.ndarray, b_end: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of A and of B come before each cut of the merge in pieces of ``piece`` steps, first and last cut included.

    Of equal ends A's comes first; a cut never parts two equal ends.
    """
    na, nb = len(a_end), len(b_end)
    d = np.minimum(np.arange(0, na + nb + piece, piece), na + nb)
    low, high = np.maximum(0, d - nb), np.minimum(d, na)
    while (low < high).any():
        i = (low + high) // 2
        j = d - i
        early = (j > 0) & (i < na) & (b_end[np.maximum(j - 1, 0)] >= a_end[np.minimum(i, na - 1)])
        open_ = low < high
        low, high = np.where(open_ & early, i + 1, low), np.where(open_ & ~early, i, high)
    i, j = low, d - low
    j = j + ((i > 0) & (j < nb) & (a_end[np.maximum(i - 1, 0)] == b_end[np.minimum(j, nb - 1)]))
    fresh = np.concatenate([[True], (np.diff(i) > 0) | (np.diff(j) > 0)])
    return i[fresh], j[fresh]


def overlaps(a_end: np.ndarray, b_end: np.ndarray, na: int, nb: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A tokens, B tokens, common ends) of a piece that consumes ``na`` and ``nb`` ends; every distinct end closes one overlap."""
    ea, eb = a_end[:na], b_end[:nb]
    ra, rb = np.searchsorted(eb, ea), np.searchsorted(ea, eb)
    both = np.zeros(nb, bool)
    if na and nb:
        both = ea[np.minimum(rb, na - 1)] == eb
    return np.concatenate([np.arange(na), rb[~both]]), np.concatenate([ra, np.flatnonzero(~both)]), eb[both]


class Vocabularies:
    """Byte lengths and decimal digits of the tokens of both sides, and how a pair of ids makes one number."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = []
        for path in (path_a, path_b):
            tokens = _tokens.open_kind(path, True).tokens()
            names = [str(i).encode() for i in range(len(tokens))]
            width = len(names[-1])
            digits = np.frombuffer(b"".join(n.ljust(width) for n in names), np.uint8).reshape(-1, width)
            self.sides.append((np.array([len(t) for t in tokens], np.int64), digits, np.array([len(n) for n in names], np.int64)))
        #: How ids are kept in the piece table: in two bytes where both vocabularies allow it.
        self.kind = "<u2" if max(len(s[0]) for s in self.sides) <= 1 << 16 else "<u4"
        self.bits = tuple(int(len(s[0]) - 1).bit_length() for s in self.sides)

    def ends(self, ids_a: np.ndarray, ids_b: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.sides[0][0][ids_a]), shift + np.cumsum(self.sides[1][0][ids_b])

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) << self.bits[1] | b.astype(np.int64)

    def rendered(self, ids_a: np.ndarray, ids_b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes ``a1,a2|b1;`` of groups that have tokens of both sides, and where each group begins in them and the last ends; groups count from 0."""
        width = max(s[1].shape[1] for s in self.sides)
        total = len(ids_a) + len(ids_b)
        cells, sizes = np.zeros((total, width + 1), np.uint8), np.zeros(total, np.int64)
        at_a, at_b = np.arange(len(ids_a)) + np.searchsorted(gb, ga), np.arange(len(ids_b)) + np.searchsorted(ga, gb, "right")
        for at, ids, group, side, last in ((at_a, ids_a, ga, self.sides[0], b"|"), (at_b, ids_b, gb, self.sides[1], b";")):
            cells[at, : side[1].shape[1]] = side[1][ids]
            sizes[at] = side[2][ids]
            cells[at, side[2][ids]] = np.where(np.append(group[1:] == group[:-1], False), ord(","), ord(last))
        shown = np.arange(width + 1) <= sizes[:, None]
        begins = np.searchsorted(gb, np.arange(gb[-1] + 1 if len(gb) else 0)) + np.searchsorted(ga, np.arange(ga[-1] + 1 if len(ga) else 0))
        return cells[shown], np.concatenate([[0], np.cumsum(sizes + 1)])[np.append(begins, total)]


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def token_pieces(docs: DataFrame, path_a: str, path_b: str, piece: int) -> DataFrame:
    """The merge pieces of (id, text). A piece has the ids of the tokens whose ends it consumes and of those open at its end; ``shift`` is by how much its
    first B token begins after its first A token. A text without tokens has one empty piece."""

    def run(batches):
        words = vocabularies(path_a, path_b)
        both = _tokens.encoder((path_a, path_b), True, True, True)
        part, row = TaskContext.get().partitionId(), 0
        for chunk in chunks(batches):
            texts = [chunk.text(i).decode() for i in range(len(chunk))]
            out = []
            for name, text, (a, b, fine) in zip(chunk.batch.column(0).to_pylist(), texts, both.ids(texts)):
                row += 1
                if not text or not fine:
                    out.append((part, row, name, 0, 0, 0, b"", b"", 0, 0, 0))
                    continue
                if len(a) + len(b) <= piece:
                    out.append((part, row, name, 0, len(a), len(b), a.astype(words.kind).tobytes(), b.astype(words.kind).tobytes(), len(a), len(b), 0))
                    continue
                a_end, b_end = words.ends(a, b)
                i, j = diagonal_cuts(a_end, b_end, piece)
                for k, (i0, i1, j0, j1) in enumerate(zip(i, i[1:], j, j[1:])):
                    begin_a, begin_b = (int(e[n - 1]) if n else 0 for e, n in ((a_end, i0), (b_end, j0)))
                    out.append((part, row, name, k, len(a), len(b), a[i0 : i1 + 1].astype(words.kind).tobytes(), b[j0 : j1 + 1].astype(words.kind).tobytes(), int(i1 - i0), int(j1 - j0), begin_b - begin_a))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.mapInArrow(run, PIECES)


class Merged:
    """The merged pieces of some rows of the piece table, side by side: one number line for all, a row's tokens between its first and last."""

    def __init__(self, batch: pa.RecordBatch, words: Vocabularies):
        get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.na, self.nb = (get[c].to_numpy().astype(np.int64) for c in ("ends_a", "ends_b"))
        raw = [[np.frombuffer(x.as_buffer(), words.kind) for x in get[c]] for c in ("a", "b")]
        shift = get["shift"].to_numpy()
        self.a, self.b, owner, keys, commons = [], [], [], [], []
        for r, (a, b, na, nb) in enumerate(zip(*raw, self.na, self.nb)):
            self.a.append(a[:na])
            self.b.append(b[:nb])
            if not na + nb:
                commons.append(np.zeros(0, np.int64))
                continue
            a_end, b_end = words.ends(a, b, int(shift[r]))
            i, j, c = overlaps(a_end, b_end, na, nb)
            keys.append(words.pairs(a[i], b[j]))
            owner.append(np.full(len(i), r, np.int64))
            commons.append(c)
        self.commons = commons
        self.words, self.shift, self.raw = words, shift, raw
        self.pairs = np.concatenate([np.zeros(0, np.int64), *keys])
        self.owner = np.concatenate([np.zeros(0, np.int64), *owner])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, links) of the distinct pairs of each row."""
        bits = sum(self.words.bits)
        keys = np.sort(self.owner << bits | self.pairs)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        return keys[first] >> bits, keys[first] & ((1 << bits) - 1), np.diff(np.append(first, len(keys)))

    def groups(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Group numbers within the piece of the tokens that it consumes."""
        a_end, b_end = self.words.ends(self.raw[0][r], self.raw[1][r], int(self.shift[r]))
        return np.searchsorted(self.commons[r], a_end[: self.na[r]]), np.searchsorted(self.commons[r], b_end[: self.nb[r]])


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _small(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def document_pairs(pieces: DataFrame, path_a: str, path_b: str, whole: bool) -> DataFrame:
    """(pair, n): in how many of the documents a pair is linked, summed in tasks; with ``whole`` False (part, row, pair) of pieces."""

    def run(batches):
        words, keys, counts, held = vocabularies(path_a, path_b), [], [], 0
        for batch in batches:
            for some in _small(batch):
                row, pair, _ = Merged(some, words).distinct()
                if not whole:
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row)), pa.array(pair)], names=["part", "row", "pair"])
                    continue
                keys.append(pair)
                counts.append(np.ones(len(pair), np.int64))
                held += len(pair)
                if held > HELD:
                    k, n = _counted(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [k], [n], len(k)
                    if held > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["pair", "n"])
                        keys, counts, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _counted(np.concatenate(keys), np.concatenate(counts))], names=["pair", "n"])

    return pieces.mapInArrow(run, "pair long, n long" if whole else "part int, row long, pair long")


def pair_counts(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n, best) corpus-wide; the best counts of the A ids are at most as many as the vocabulary has ids."""
    alone = "ends_a = n_a and ends_b = n_b"
    spread = pieces.where(f"not ({alone})").repartition("part", "row", "piece")
    apart = document_pairs(spread, path_a, path_b, False).distinct().select("pair", F.lit(1).cast("long").alias("n"))
    counts = cut(document_pairs(pieces.where(alone), path_a, path_b, True).union(apart).groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    bits = vocabularies(path_a, path_b).bits[1]
    best = counts.groupBy(F.shiftright("pair", bits).alias("x")).agg(F.max("n").alias("m"))
    return cut(counts.join(F.broadcast(best), F.shiftright("pair", bits) == F.col("x")).select("pair", "n", (F.col("n") == F.col("m")).alias("best")), "pairs")


def hot_pairs(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least power of two that at most ``most`` pairs reach, and those pairs, sorted, with their counts and whether they are best."""
    sizes = {r.k: r.n for r in counts.groupBy(F.expr("int(floor(log2(n)))").alias("k")).agg(F.count("*").alias("n")).collect()}
    k, total = 64, 0
    while k > 0 and total + sizes.get(k - 1, 0) <= most:
        k -= 1
        total += sizes.get(k, 0)
    limit = 1 << min(k, 62)
    found = counts.where(F.col("n") >= limit).toPandas().sort_values("pair")
    return limit, found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64), found["best"].to_numpy(bool)


SCORED = "part int, row long, id long, piece int, n_a long, n_b long, n_links long, commons long, n_best long, count_sum long, head_a string, head_b string, middle string, tail_a string, tail_b string, whole string, pair long, links long"


def scored_pieces(pieces: DataFrame, path_a: str, path_b: str, hot) -> DataFrame:
    """One row per piece with its links, sums over hot pairs and groups (``whole``: the digest of a one-piece document), and a row for each rare pair of it."""
    names = [c.split()[0] for c in SCORED.split(", ")]

    def line(ids: np.ndarray) -> str:
        return ",".join(map(str, ids.tolist()))

    def run(batches):
        words = vocabularies(path_a, path_b)
        keys, counts, best = hot.value
        for batch in batches:
            for some in _small(batch):
                m = Merged(some, words)
                get = {n: some.column(i).to_pylist() for i, n in enumerate(some.schema.names) if n not in ("a", "b")}
                row, pair, links = m.distinct()
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                found = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                size = len(get["id"])
                of_row = np.searchsorted(row, np.arange(size + 1))
                n_links, n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(x)])[of_row]) for x in (links, *(np.where(found, w[at] * links, 0) if len(keys) else 0 * links for w in (best, counts))))
                out = []
                for r in range(size):
                    ids_a, ids_b, c = m.a[r], m.b[r], len(m.commons[r])
                    head = tail = ("", "")
                    middle = whole = ""
                    alone = get["piece"][r] == 0 and len(ids_a) == get["n_a"][r] and len(ids_b) == get["n_b"][r]
                    if alone and len(ids_a):
                        shown, _ = words.rendered(ids_a, ids_b, *m.groups(r))
                        whole = hashlib.sha256(shown[:-1].tobytes()).hexdigest()
                    elif not alone:
                        ga, gb = m.groups(r)
                        (a1, a2), (b1, b2) = (np.searchsorted(g, [1, max(c, 1)]) for g in (ga, gb))
                        head, tail = (line(ids_a[:a1]), line(ids_b[:b1])), (line(ids_a[a2:]), line(ids_b[b2:]))
                        if a2 > a1:
                            middle = words.rendered(ids_a[a1:a2], ids_b[b1:b2], ga[a1:a2] - 1, gb[b1:b2] - 1)[0][:-1].tobytes().decode()
                    out.append((get["part"][r], get["row"][r], get["id"][r], get["piece"][r], get["n_a"][r], get["n_b"][r], int(n_links[r]), c, int(n_best[r]), int(count_sum[r]), *head, middle, *tail, whole, None, None))
                rare = np.flatnonzero(~found)
                columns = [pa.array(c) for c in zip(*out)]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6, *[pa.string()] * 6, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds)], names=names)
                if len(rare):
                    of = pa.array(row[rare])
                    mine = {"part": some.column(0).take(of), "row": some.column(1).take(of), "pair": pa.array(pair[rare]), "links": pa.array(links[rare].astype(np.int64))}
                    yield pa.RecordBatch.from_arrays([mine[n] if n in mine else pa.nulls(len(rare), t) for n, t in zip(names, kinds)], names=names)

    return pieces.mapInArrow(run, SCORED)


def stitched(pieces: DataFrame) -> DataFrame:
    """(part, row, groups_sha256) of documents of several scored pieces, read in order; only the open group is held."""

    def run(batches):
        now, digest, open_a, open_b, begun = None, None, [], [], False
        done: list = []

        def close():
            return [(*now, digest.hexdigest())] if now is not None else []

        for batch in batches:
            for part, row, c, ha, hb, middle, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if (part, row) != now:
                    done += close()
                    now, digest, open_a, open_b, begun = (part, row), hashlib.sha256(), [], [], False
                open_a += [ha] if ha else []
                open_b += [hb] if hb else []
                if c:
                    digest.update(((";" if begun else "") + ",".join(open_a) + "|" + ",".join(open_b) + (";" + middle if middle else "")).encode())
                    begun, open_a, open_b = True, [ta] if ta else [], [tb] if tb else []
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "row", "groups_sha256"), d)) for d in done], schema=kind)
                done = []
        if close():
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "row", "groups_sha256"), d)) for d in close()], schema=kind)

    kind = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("groups_sha256", pa.string())])
    inner = pieces.select("part", "row", "commons", "head_a", "head_b", "middle", "tail_a", "tail_b", "piece")
    return inner.repartition("part", "row").sortWithinPartitions("part", "row", "piece").drop("piece").mapInArrow(run, "part int, row long, groups_sha256 string")


def align(docs: DataFrame, *, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, hot: int = HOT_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(token_pieces(texts, path_a, path_b, piece), "pieces")
    counts = pair_counts(pieces, path_a, path_b)
    limit, *common = hot_pairs(counts, hot)
    scored = cut(scored_pieces(pieces, path_a, path_b, docs.sparkSession.sparkContext.broadcast(tuple(common))), "scored")
    rows = scored.where("pair is null")
    key = ["part", "row"]
    rare = scored.where("pair is not null").select(*key, "pair", "links").join(counts.where(F.col("n") < limit), "pair")
    rare = rare.groupBy(*key).agg(F.sum(F.expr("if(best, links, 0)")).alias("more_best"), F.sum(F.expr("links * n")).alias("more_sum"))
    alone = "piece = 0 and (n_a = 0 or whole <> '')"
    apart = rows.where(f"not ({alone})")
    sums = apart.groupBy(*key).agg(F.first("id").alias("id"), *[F.max(c).alias(c) for c in ("n_a", "n_b")], *[F.sum(c).alias(c) for c in ("commons", "n_links", "n_best", "count_sum")])
    columns = [*key, "id", "n_a", "n_b", "commons", "n_links", "n_best", "count_sum", "groups_sha256"]
    every = rows.where(alone).withColumnRenamed("whole", "groups_sha256").select(columns).union(sums.join(stitched(apart), key).select(columns))
    more = {n: F.col(n) + F.coalesce(F.col(m), F.lit(0)) for n, m in (("n_best", "more_best"), ("count_sum", "more_sum"))}
    return every.join(rare, key, "left").select("id", "n_a", "n_b", F.col("commons").alias("n_groups"), "n_links", *[v.alias(k) for k, v in more.items()], "groups_sha256")


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, path_a=public_tokenizers.path("byte_bpe_50k.json"), path_b=public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment}
ORACLES: dict[str, str] = {}
