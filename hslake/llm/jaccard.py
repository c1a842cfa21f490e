"""N-gram Jaccard join: exact set-similarity components by T-occurrence search with DivideSkip.

1. Every text becomes its set of word shingles (64-bit hashes). Equal sets form a class; one text of each class goes on.
2. Shingle frequencies over all classes are counted in hash buckets. A class of n shingles needs a partner that shares at least
   T = ceil(t * n) of them, so classes with fewer than T shingles of frequency two or more are out of the search: proven, not sampled.
   A task answers for the shingles that two of its own classes share and sends one witness of each, so a shingle that a third of all
   texts hold costs an entry a task, not one a text.
3. The others fetch their shingles again. Their inverted lists, shortest first, give a candidate graph: two classes that share none of
   the n - T + 1 shortest lists of either can't reach T. Its components are searched independently.
4. In a component, classes are dealt to blocks of near sizes (size bands of ratio t: links only join neighbouring bands). In a task each
   class is a query: its L longest lists are set aside, the short ones are merged (sorted and counted at once, where a heap would take one id
   at a time), ids that occur T - L times are kept, and the long lists are probed for them by binary search until an id reaches the required
   overlap or can't. Classes that are already connected aren't compared; links of a group stay linear.
5. A component of one block is done after that. In a larger one every block is searched together with the first block of its band; then the classes
   outside the component's largest linked group are sent to all blocks of their own and the neighbouring bands: a group of near copies of any size
   costs its classes two or three times, and only classes that link with few others more often.
6. Components of the verified links give every document its class id: the least doc_id of the component.

Null or wordless text: empty set, linked with nothing, its own component. A null id: its row stays and links like any other (two texts may
be joined through it); it names no component, so one of null ids alone is null. Repeated rows: equal sets, same component. One id with several
texts: each row takes the component of its own text. Very long texts: read whole. No documents: no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, cut, join_measured, unused
from ._text import as_long, chunks, mixed, release, shingle_sets

BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_500_000
FLUSH = 1_000_000
#: Stands in a bucket for two or more classes whose task has counted them.
WITNESS = np.uint64(0)
#: Even a small corpus is dealt over so many hash buckets, so that a class's partial counts don't multiply as it grows.
LEAST_BUCKETS = 64
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def _class_hash(s: np.ndarray) -> tuple[int, int]:
    n = np.uint64(len(s))
    return mixed(s ^ _OTHER).sum(dtype=np.uint64) + n, mixed(s + _OTHER).sum(dtype=np.uint64) ^ n


def shingle_classes(docs: DataFrame, n: int) -> DataFrame:
    """(id, k, n_shingles, c1, c2) of (id, k, text): c1 and c2 are equal for equal sets."""

    def run(batches):
        for chunk in chunks(batches):
            sets = [(len(s), *_class_hash(s)) for s in shingle_sets(chunk, n)]
            k, c1, c2 = (np.array(x, np.uint64) for x in zip(*sets))
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), chunk.batch.column(1), pa.array(k.astype(np.int64)), as_long(c1), as_long(c2)], names=["id", "k", "n_shingles", "c1", "c2"])

    return docs.mapInArrow(run, "id long, k long, n_shingles long, c1 long, c2 long")


def shared_counts(docs: DataFrame, n: int, n_buckets: int) -> DataFrame:
    """(c1, shared): how many shingles of a class occur in another class too, at least; copies that several tasks count add up."""

    def pack(batches):
        held, size = [], 0

        def flush():
            cls, number = np.unique(np.array([c for c, _ in held], np.uint64), return_inverse=True)
            toks = np.concatenate([s for _, s in held])
            owner = np.repeat(number.astype(np.uint32), [len(s) for _, s in held])
            by = np.lexsort((owner, toks))
            toks, owner = toks[by], owner[by]
            new = np.concatenate(([True], (toks[1:] != toks[:-1]) | (owner[1:] != owner[:-1])))
            toks, owner = toks[new], owner[new]
            first = np.concatenate(([True], toks[1:] != toks[:-1]))
            alone = first & np.concatenate((first[1:], [True]))
            own = np.bincount(owner[~alone], minlength=len(cls))
            cls = np.append(cls, WITNESS)
            toks, owner = toks[first], np.where(alone, owner, len(cls) - 1)[first]
            bucket = ((toks >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            low = toks.view(np.uint8).reshape(-1, 8)[:, :5]
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            rows, known = [], np.flatnonzero(own)
            parts = np.linspace(0, len(known), len(at) + 1).astype(int)
            for i, j, p, q in zip(at, [*at[1:], len(toks)], parts, parts[1:]):
                by = np.argsort(owner[i:j], kind="stable")
                who, many = np.unique(owner[i:j], return_counts=True)
                rows.append((int(bucket[i]), cls[who].tobytes(), many.astype(np.uint32).tobytes(), np.ascontiguousarray(low[i:j][by]).tobytes(), cls[known[p:q]].tobytes(), own[known[p:q]].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))], names=["bucket", "cls", "many", "toks", "sure", "sure_n"])

        for chunk in chunks(batches):
            for s in shingle_sets(chunk, n):
                if len(s):
                    held.append((_class_hash(s)[0], s))
                    size += len(s)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        cls = np.frombuffer(b"".join(pdf["cls"]), np.uint64)
        many = np.frombuffer(b"".join(pdf["many"]), np.uint32)
        low = np.frombuffer(b"".join(pdf["toks"]), np.uint8).reshape(-1, 5)
        toks = np.zeros((len(low), 8), np.uint8)
        toks[:, :5] = low
        toks = toks.view(np.uint64).ravel()
        names, who = np.unique(cls, return_inverse=True)
        who = np.repeat(who.astype(np.uint64), many)
        if len(names) <= 1 << 24:
            key = np.sort((toks << np.uint64(24)) | who)
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            toks, who = key >> np.uint64(24), key & np.uint64((1 << 24) - 1)
        else:
            order = np.lexsort((who, toks))
            toks, who = toks[order], who[order]
            new = np.concatenate(([True], (toks[1:] != toks[:-1]) | (who[1:] != who[:-1])))
            toks, who = toks[new], who[new]
        same = toks[1:] == toks[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        n_shared = np.bincount(who[shared].astype(np.int64), minlength=len(names))
        hit = (n_shared > 0) & (names != WITNESS)
        sure, sure_n = np.frombuffer(b"".join(pdf["sure"]), np.uint64), np.frombuffer(b"".join(pdf["sure_n"]), np.uint32)
        release()
        return pd.DataFrame({"c1": np.concatenate((names[hit], sure)).view(np.int64), "shared": np.concatenate((n_shared[hit], sure_n)).astype(np.int64)})

    packed = docs.mapInArrow(pack, "bucket int, cls binary, many binary, toks binary, sure binary, sure_n binary")
    return packed.groupBy("bucket").applyInPandas(count, "c1 long, shared long").groupBy("c1").agg(F.sum("shared").alias("shared"))


def divide_skip_links(sizes: np.ndarray, lists: list[np.ndarray], num: int, den: int, linked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect what Jaccard >= num / den connects among sets of the given sizes.

    ``lists``: each set's shingles that may be shared; ``linked``: labels of sets that are connected already. A spanning set of the other links
    is returned, each of them verified exactly.
    """
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    flat = np.concatenate([lists[i] for i in order])
    owner = np.repeat(np.arange(len(order)), [len(lists[i]) for i in order])
    by = np.argsort(flat, kind="stable")
    posts = owner[by]
    _, token, length = np.unique(flat, return_inverse=True, return_counts=True)
    begin = np.concatenate(([0], np.cumsum(length)))
    ends = np.cumsum([len(lists[i]) for i in order])
    comp = np.arange(len(order)) if linked is None else np.unique(linked[order], return_inverse=True)[1]
    links = []
    for q in range(1, len(order)):
        n = int(sizes[order[q]])
        need = -(-num * n // den)
        mine = token[ends[q - 1] : ends[q]]
        mine = mine[length[mine] > 1]
        if len(mine) < need:
            continue
        mine = mine[np.argsort(length[mine], kind="stable")]
        skip = min(need - 1, int(need / (0.0085 * np.log2(max(2, length[mine[-1]])) + 1)))
        short, long = mine[: len(mine) - skip], mine[len(mine) - skip :]
        merged = np.concatenate([posts[begin[t] : begin[t + 1]] for t in short])
        ids, seen = np.unique(merged[merged < q], return_counts=True)
        keep = (seen >= need - skip) & (comp[ids] != comp[q]) & (den * sizes[order[ids]] >= num * n)
        ids, seen = ids[keep], seen[keep]
        goal = -(-num * (n + sizes[order[ids]]) // (num + den))
        for k, t in enumerate(long):
            if not len(ids):
                break
            post = posts[begin[t] : begin[t + 1]]
            at = np.minimum(np.searchsorted(post, ids), len(post) - 1)
            seen = seen + (post[at] == ids)
            done = seen >= goal
            if done.any():
                for i in ids[done]:
                    if comp[i] != comp[q]:
                        links.append((int(order[i]), int(order[q])))
                        comp[comp == comp[i]] = comp[q]
                alive = comp[ids] != comp[q]
            else:
                alive = seen + (len(long) - k - 1) >= goal
            if not alive.all():
                ids, seen, goal = ids[alive], seen[alive], goal[alive]
        for i in ids[seen >= goal]:
            if comp[i] != comp[q]:
                links.append((int(order[i]), int(order[q])))
                comp[comp == comp[i]] = comp[q]
    return links


def _search(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    a, b = [], []
    for _, g in pdf.groupby(["root", "block"], sort=False):
        if len(g) > 1:
            cls = g["cls"].to_numpy()
            for i, j in divide_skip_links(g["n"].to_numpy(), g["lists"].tolist(), num, den, g["linked"].to_numpy()):
                a.append(cls[i])
                b.append(cls[j])
    release()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def component_links(groups: DataFrame, num: int, den: int, block_docs: int, block_shingles: int) -> DataFrame:
    """(a, b) links of the classes (cls, n, lists, root), searched within each root's blocks."""
    band = F.floor(F.log("n") / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("int")
    banded = groups.withColumn("band", band)
    sizes = cut(banded.groupBy("root", "band").agg(F.count("*").alias("c"), F.sum(F.size("lists")).alias("s")), "bands")
    n_tasks = max(8, -(-(sizes.agg(F.sum("s")).first()[0] or 0) // 500_000))
    large = sizes.groupBy("root").agg(F.sum("c").alias("c"), F.sum("s").alias("s")).where((F.col("c") > block_docs) | (F.col("s") > block_shingles)).select("root")
    large = cut(large, "large")

    def searched(rows: DataFrame) -> DataFrame:
        task = F.pmod(F.xxhash64("root", "block"), F.lit(n_tasks))
        rows = rows.select(task.alias("task"), "root", "block", "cls", "n", "lists", "linked")
        return cut(rows.groupBy("task").applyInPandas(lambda pdf: _search(pdf, num, den), "a long, b long"), "links")

    small = groups.join(large, "root", "left_anti").select("root", F.lit("").alias("block"), "cls", "n", "lists", F.col("cls").alias("linked"))
    if not large.head(1):
        return searched(small)
    cuts = sizes.join(large, "root", "left_semi").select("root", "band", F.greatest(F.ceil(F.col("c") / block_docs), F.ceil(F.col("s") / block_shingles)).cast("int").alias("k"))
    placed = cut(banded.join(cuts, ["root", "band"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")), "placed")
    name = lambda band, own: F.concat_ws(":", band, own)
    with_first = placed.withColumn("own", F.explode(F.when(F.col("own") > 0, F.array("own")).otherwise(F.sequence(F.lit(0), F.col("k") - 1))))
    links = searched(small.unionByName(with_first.select("root", name("band", "own").alias("block"), "cls", "n", "lists", F.col("cls").alias("linked"))))
    joined = placed.join(components(links).withColumnsRenamed({"node": "cls", "root": "linked"}), "cls", "left").withColumn("linked", F.coalesce("linked", "cls"))
    joined = cut(joined, "joined")
    largest = joined.groupBy("root", "linked").count().groupBy("root").agg(F.max_by("linked", F.struct("count", "linked")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    largest = cut(largest.select("root", "largest"), "largest")
    open_rows = joined.join(largest, "root")
    home = open_rows.select("root", name("band", "own").alias("block"), "cls", "n", "lists", "linked")
    others = open_rows.where("linked <> largest").select("root", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("at"), F.col("band").alias("was"), F.col("own").alias("mine"), "cls", "n", "lists", "linked")
    others = others.join(cuts.withColumnRenamed("band", "at"), ["root", "at"]).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("at <> was or to <> mine")
    again = searched(home.unionByName(others.select("root", name("at", "to").alias("block"), "cls", "n", "lists", "linked")))
    return links.union(again)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: (id, n_shingles, component_id), linked where den * intersection >= num * union."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("k"), F.col(text_col).cast("string").alias("text"))
    sets = cut(shingle_classes(texts, shingle), "classes")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    need = F.expr(f"(n * {num} + {den - 1}) div {den}")
    classes = sets.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("id").alias("least"), F.min("k").alias("k"), F.first("n_shingles").alias("n"))
    shared = shared_counts(texts, shingle, max(LEAST_BUCKETS, -(-total * 6 // (12 << 20))))
    alive = classes.join(shared, "c1").where(F.col("shared") >= need).select("k", "n", "c1", "c2", "least")
    alive = cut(alive.withColumn("cls", F.monotonically_increasing_id()), "alive")

    def fetch(batches):
        for chunk in chunks(batches):
            rows = [(r, k, s) for r, k, c1, c2, s in zip(*(chunk.batch.column(c).to_pylist() for c in ("cls", "n", "c1", "c2")), shingle_sets(chunk, shingle)) if tuple(np.array(_class_hash(s), np.uint64).view(np.int64)) == (c1, c2)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in rows], pa.int64()), pa.array([k for _, k, _ in rows], pa.int64()), pa.array([s.view(np.int64) for _, _, s in rows], pa.list_(pa.int64()))], names=["cls", "n", "tokens"])

    found = join_measured(texts.select("k", "text"), alive.select("k", "cls", "n", "c1", "c2"), "k").select("cls", "n", "c1", "c2", "text")
    found = cut(found.mapInArrow(fetch, "cls long, n long, tokens array<long>").dropDuplicates(["cls"]), "tokens")
    tokens = found.select("cls", "n", F.explode("tokens").alias("t"))
    often = cut(tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ranked = tokens.join(often, "t").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("l"))
    ranked = cut(ranked.where(F.size("l") >= need).select("cls", "n", F.col("l.t").alias("lists"), F.expr(f"slice(l.t, 1, int(size(l) - ((n * {num} + {den - 1}) div {den}) + 1))").alias("short")), "lists")
    posts = ranked.select("cls", F.explode("short").alias("t"))
    least = cut(posts.groupBy("t").agg(F.min("cls").alias("m"), F.count("*").alias("c")).where("c > 1").select("t", "m"), "least")
    stars = posts.join(least, "t").where("cls <> m").select(F.col("cls").alias("a"), F.col("m").alias("b"))
    groups = cut(ranked.select("cls", "n", "lists").join(components(stars).withColumnRenamed("node", "cls"), "cls"), "groups")
    links = component_links(groups, num, den, block_docs, block_shingles)
    roots = cut(components(links).withColumnRenamed("node", "cls").join(alive.select("cls", "c1", "c2", "least"), "cls"), "roots")
    named = roots.select("c1", "c2", "root").join(roots.groupBy("root").agg(F.min("least").alias("first")), "root").select("c1", "c2", "first", F.lit(True).alias("joined"))
    whole = cut(classes.select("c1", "c2", "least").join(named, ["c1", "c2"], "left").select("c1", "c2", F.when(F.col("joined"), F.col("first")).otherwise(F.col("least")).alias("component")), "components")
    return sets.join(whole, ["c1", "c2"], "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each component, that of least id; rows of null id stay.

    Rows of one id count as one document only if their shingle classes are the same or linked.
    """
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count()
    options = {"text_col": text_col, "shingle": shingle, "num": num, "den": den}
    if not again:
        found = jaccard_components(docs, id_col=id_col, **options)
        gone = cut(found.where("id <> component_id").select(F.col("id").alias(id_col)).distinct(), "gone")
        return join_measured(docs, gone, id_col, "left_anti")
    row = unused("row", docs.columns)
    rows = docs.withColumn(row, F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull()))
    found = cut(jaccard_components(rows, id_col=row, **options).select(F.col("id").alias("r"), "n_shingles", "component_id").distinct(), "rows")
    named = found.join(rows.where(F.col(id_col).isNotNull()).select(F.col(row).alias("r"), F.col(id_col).alias("own")).distinct(), "r")
    alone = F.col("n_shingles") == 0
    best = named.groupBy(alone.alias("alone"), F.when(alone, F.col("own")).otherwise(F.col("component_id")).alias("g")).agg(F.min(F.struct("own", "r")).alias("b"))
    stay = cut(best.select(F.col("b.r").alias(row)), "stay")
    kept = join_measured(rows.where(F.col(id_col).isNotNull()), stay, row, "left_semi").dropDuplicates([row])
    return kept.unionByName(rows.where(F.col(id_col).isNull())).drop(row)


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, shingle=3, num=9, den=10).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select distinct doc_id, array_to_string(ws[i : i + 2], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b using (s) where a.doc_id < b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
e2 as (select x, y from e union all select y, x from e),
r as (select doc_id as a, doc_id as b from documents union select r.a, e2.y from r join e2 on e2.x = r.b)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.c as component_id
from documents d left join n using (doc_id) join (select a, min(b) as c from r group by a) m on m.a = d.doc_id"""

QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLES = {"op2_jaccard_join": ORACLE}
