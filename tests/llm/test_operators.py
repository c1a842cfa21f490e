"""Each text operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from checking import assert_same
from pyspark.sql import functions as F

from hslake.llm import chat, decontam, jaccard, langid, lm_score, packing, quality, queries, suffix_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, k string, rep string, n string"


def documents(spark, rows):
    """(doc_id, text[, lang]) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", "x", "x", "x") for r in rows], DOC)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    rows = [(i, text(rng.choice([1, 2, 3, 30, 80, 200]))) for i in range(n)]
    for i in range(0, n, 4):
        w = rows[i][1].split()
        for _ in range(rng.choice([0, 1, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((1000 + i, " ".join(w)))
    base = text(220).split()
    for i in range(40):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"z{i}"
        rows.append((2000 + i, " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \t\n "), (5003, text(9000)), (0, rows[0][1]), (None, rows[1][1]), (None, None)]


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_oracle(spark, name):
    assert_same(spark, SF, queries.queries()[name], queries.oracles()[name])


def shingles(text, n):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sets, {i: g for g in groups.values() for i in g}


@pytest.mark.parametrize("blocks", [{}, {"block_docs": 7}])
@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard(spark, n, num, den, blocks):
    rows = corpus()
    sets, groups = brute_components(rows, n, num, den)
    want = collections.Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[i] if rows[j][0] is not None]
        want[(doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc)] += 1
    got = jaccard.jaccard_components(documents(spark, rows), shingle=n, num=num, den=den, **blocks)
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0
    kept = jaccard.keep_one_per_group(documents(spark, corpus()))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len([i for i in ids if i is not None and 2000 <= i < 3000]) < 10 and 5000 in ids and ids.count(0) == 1 and None in ids


def test_jaccard_links_through_rows_without_an_id(spark):
    a = [f"w{i}" for i in range(100)]
    x, b = [*a[:97], "x1", "x2", "x3"], [*a[:94], "y1", "y2", "y3", "x1", "x2", "x3"]
    texts = [" ".join(w) for w in (a, x, b)]
    one, two, three = (set(zip(w, w[1:], w[2:])) for w in (a, x, b))
    assert len(one & two) >= 0.9 * len(one | two) and len(two & three) >= 0.9 * len(two | three) and len(one & three) < 0.9 * len(one | three)
    rows = [(1, texts[0]), (None, texts[1]), (3, texts[2]), (7, texts[0]), (7, "another text of the same id")]
    got = sorted((r.id or 0, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows), shingle=3, num=9, den=10).collect())
    assert got == [(0, 1), (1, 1), (3, 1), (7, 1), (7, 7)]


def test_jaccard_hot_shingles_and_large_groups(spark):
    rng = random.Random(8)
    pick = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    rows = [(i, " ".join(["all", "share", "this", *pick(rng.randint(3, 30))])) for i in range(300)]
    for g in range(3):
        base = pick(120)
        for i in range(150):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
            rows.append((1000 * (g + 1) + i, " ".join(w[: rng.randint(100, 120)])))
    sets, groups = brute_components(rows, 5, 4, 5)
    want = {r[0]: min(rows[j][0] for j in groups[i]) for i, r in enumerate(rows)}
    for blocks in ({}, {"block_docs": 20}):
        assert {r.id: r.component_id for r in jaccard.jaccard_components(documents(spark, rows), **blocks).collect()} == want


def test_divide_skip_is_exact():
    rng = random.Random(3)
    base = [rng.sample(range(400), 60) for _ in range(4)]
    lists = [np.array(sorted({x if rng.random() > 0.04 else rng.randrange(400) for x in base[i % 4]}), np.int64) for i in range(60)]
    sizes = np.array([len(x) for x in lists])
    links = jaccard.divide_skip_links(sizes, lists, 4, 5)

    def parts(edges):
        p = list(range(60))
        for a, b in edges:
            p = [p[a] if x == p[b] else x for x in p]
        return sorted(map(tuple, {v: [i for i in range(60) if p[i] == v] for v in p}.values()))

    true = [(i, j) for i in range(60) for j in range(i) if 5 * len(set(lists[i]) & set(lists[j])) >= 4 * len(set(lists[i]) | set(lists[j]))]
    assert parts(links) == parts(true) and all((max(e), min(e)) in true for e in links)


def brute_repeats(rows, length):
    seen = collections.Counter()
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for (doc, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_merged_transforms_order_all_strings():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m, size = int(rng.integers(1, 6)), 8
        many = rng.integers(1, 7, rng.integers(1, 5))
        base, shards, last, words = rng.integers(97, 99, m * size), [], [], []
        for n in many:
            own = np.tile(base, (n, 1))
            own[np.arange(n), rng.integers(0, m * size, n)] = rng.integers(97, 99, n)
            shards.append(own.astype(np.uint8))
            table, codes = np.unique(shards[-1].reshape(-1, size).copy().view("S8").ravel(), return_inverse=True)
            codes = codes.reshape(n, m)
            last.append(suffix_dedup.transform(codes, suffix_dedup.suffix_order(codes, np.zeros(n, np.int64))))
            words.append(np.frombuffer(table.tobytes(), np.uint8).reshape(-1, size))
        order, lcp = suffix_dedup.merged_contexts(last, words, many, size, m)
        flat = [bytes(r) for s in shards for r in s]
        got = [flat[i] for i in order]
        assert got == sorted(flat) and lcp[0] == -1
        for a, b, c in zip(got, got[1:], lcp[1:]):
            assert c == next((i for i in range(m * size) if a[i] != b[i]), m * size)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(spark, hot):
    rng = random.Random(1)
    rand = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, other = rand(60), rand(40)
    rows = [(i, rand(rng.randint(0, 120)) + rng.choice([shared, shared[:39], other, ""]) + rand(rng.randint(0, 120))) for i in range(50)]
    rows += [(100, "a" * 300), (101, "a" * 39), (102, None), (103, ""), (104, rows[3][1]), (104, rows[3][1]), (None, rows[5][1]), (105, "ab" * 90), (106, rand(5000) + shared)]
    got = suffix_dedup.remove_repeats(documents(spark, rows), length=40, gram=8, hot=hot)
    got = sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=repr)
    assert got == sorted(brute_repeats(rows, 40), key=repr)
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_decontamination(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: decontam.terms(r.text) for r in bench.collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        body = b" ".join(decontam.terms(r.text))
        want |= {(r.doc_id, i) for i, w in items.items() if b" ".join(w) in body}
    got = {(r.id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert len(want) > 10 and len(want & got) >= 0.9 * len(want) and len(got - want) <= 2


def test_decontamination_paraphrase_and_edges(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7)))
    vocab = [word() for _ in range(2000)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    item = pick(30)
    item[23] += "."
    changed = [w if i % 5 else word() for i, w in enumerate(item[:24])] + item[24:]
    rows = [(i, " ".join(pick(200))) for i in range(40)]
    rows += [(50, " ".join(pick(100) + item + pick(100)).upper()), (51, " ".join(pick(70) + changed + pick(30))), (52, None), (53, ""), (None, " ".join(item)), (54, " ".join(pick(3000) + item))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (None, " ".join(pick(20)))], "item_id long, text string")
    got = {(r.id, r.kind) for r in decontam.leaks(documents(spark, rows), bench).collect()}
    assert got == {(50, "verbatim"), (51, "verbatim"), (None, "verbatim"), (54, "verbatim")}
    more = bench.union(spark.createDataFrame([(1, " ".join(item[:20])), (9, " ".join(pick(12)))], bench.schema))
    twice = [(r.id, r.item_id) for r in decontam.leaks(documents(spark, rows), more, block_items=1).collect()]
    assert len(twice) == len(set(twice)) == 4
    assert decontam.leaks(documents(spark, rows), bench.where("false")).count() == 0
    assert decontam.leaks(documents(spark, []), bench).count() == 0
    assert decontam.remove_leaks(documents(spark, rows), bench).count() == len(rows) - 3


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(i, x) for i, x in corpus(2)] + [(7000, "it's 'tis <|endoftext|>  don't\n\n 12½ ñ" * 40), (7001, "x " * 5000)]
    got = packing.pack(documents(spark, rows), tokenizer=packing.default_tokenizer(), with_ids=True).collect()
    whole, per_row = collections.Counter(), [t.encode(x or "", add_special_tokens=False).ids + [2] for _, x in rows]
    for (i, _), ids in zip(rows, per_row):
        whole[(i, tuple(ids))] += 1
    by = collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 1024
        by[r.id].append(r)
    for i in {i for i, _ in rows}:
        assert sum(r.length for r in by[i]) == sum(len(ids) for (j, _), ids in zip(rows, per_row) if i == j)
    for r in by[7001]:
        assert per_row[-1][r.start : r.start + r.length] == list(r.ids) and (r.length == 1024 or r.piece == 0)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 1024
    room = []
    for n in sorted((r.length for r in got), reverse=True):
        fit = [i for i, x in enumerate(room) if x >= n]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= n
        else:
            room.append(1024 - n)
    assert len(places) <= len(room)
    assert packing.pack(documents(spark, []), tokenizer=packing.default_tokenizer()).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "e"), (None, "the and of"), (5, "é" * 3000)]
    got = {r.id: r for r in langid.identify(documents(spark, rows), docs).collect()}
    assert [got[i].lang for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang != "und" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang for r in langid.identify(documents(spark, rows), docs.where("false")).collect()} == {"und"}


def test_ppm_code_lengths_by_hand():
    import pandas as pd

    text = b"abracadabra"
    model_rows = []
    for m in (1, 2):
        for i in range(len(text) - m + 1):
            g = (m << 56) | int.from_bytes(text[i : i + m], "big")
            model_rows.append(("x", g, 1))
    counts = pd.DataFrame(model_rows, columns=["lang", "gram", "n"]).groupby(["lang", "gram"], as_index=False).sum()
    model = langid.Model(["x"], counts, 1)
    n1, n2 = collections.Counter(text), collections.Counter(zip(text, text[1:]))

    def zero(b):
        d, n = len(n1), len(text)
        return -math.log2(n1[b] / (n + d)) if n1[b] else -math.log2(d / (n + d)) + 8

    def one(a, b):
        total, d = sum(v for (x, _), v in n2.items() if x == a), sum(x == a for x, _ in n2)
        return zero(b) if not d else -math.log2(n2[(a, b)] / (total + d)) if n2[(a, b)] else -math.log2(d / (total + d)) + zero(b)

    probe = b"abcaz"
    want = zero(probe[0]) + sum(one(a, b) for a, b in zip(probe, probe[1:]))
    assert model.code_lengths(np.frombuffer(probe, np.uint8), np.array([0, 5]))[0, 0] == pytest.approx(want, rel=1e-5)


def test_languages_by_brute_force(spark):
    rng = random.Random(2)
    letters = {"x": "abcd ", "y": "abce ", "z": "cdé "}
    say = lambda lang, n: "".join(rng.choice(letters[lang]) for _ in range(n))
    training = [(i, say(lang, 80), lang) for i, lang in enumerate("xyz" * 5)]
    probes = [(100 + i, say(rng.choice("xyz"), rng.randint(1, 60))) for i in range(30)] + [(200, "Q"), (201, "abcz é")]
    counts = {lang: [collections.Counter() for _ in range(3)] for lang in "xyz"}
    for _, text, lang in training:
        b = text.lower().encode()
        for m in range(3):
            counts[lang][m].update(b[i : i + m + 1] for i in range(len(b) - m))

    def bits(lang, context, symbol):
        if context is None:
            return 8.0
        seen = {g[-1]: n for g, n in counts[lang][len(context)].items() if g[:-1] == context}
        shorter = context[1:] if context else None
        if not seen:
            return bits(lang, shorter, symbol)
        total, kinds = sum(seen.values()), len(seen)
        return -math.log2(seen[symbol] / (total + kinds)) if symbol in seen else -math.log2(kinds / (total + kinds)) + bits(lang, shorter, symbol)

    want = {}
    for i, text in probes:
        b = text.lower().encode()
        cost = [sum(bits(lang, b[max(0, k - 2) : k], b[k]) for k in range(len(b))) for lang in "xyz"]
        best = min(range(3), key=lambda k: cost[k])
        want[i] = ("xyz"[best], 1 / sum(2 ** ((cost[best] - c) / max(1.0, len(b) / 50)) for c in cost))
    rows = [(i, t, lang) for i, t, lang in training]
    for part in (1 << 20, 7):
        langid.PART, kept = part, langid.PART
        try:
            got = {r.id: (r.lang, r.score) for r in langid.identify(documents(spark, probes), documents(spark, rows), order=2).collect()}
        finally:
            langid.PART = kept
        assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
        assert all(abs(got[i][1] - want[i][1]) < 1e-4 for i in want)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.severity(docs, labels.where("doc_id % 2 = 0"), train_rows=4000)
    r = out.join(labels.where("doc_id % 2 = 1"), out.id == labels.doc_id).agg(F.avg(F.col("p_toxic")), F.sum((out.toxic & (labels.toxic == 1)).cast("int")), F.sum((out.toxic & (labels.toxic == 0)).cast("int")), F.sum(labels.toxic)).first()
    assert r[1] >= 0.85 * r[3] and r[2] <= 0.1 * r[3]  # some labelled rows lost their toxic words to junk
    rows = [(1, None), (2, ""), (None, "idiot"), (3, "x " * 9000)]
    got = toxicity.severity(documents(spark, rows), labels.where("false")).collect()
    assert len(got) == 4 and all(x.expected_severity == 0 and not x.toxic for x in got)


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3)) < 0.3
    grade = np.clip(x @ np.array([1, 2, 0]), 0, 3)
    rows, cols = np.nonzero(x)
    m = toxicity.fit(rows, cols, grade, 4, 3)
    assert (np.diff(m.thresholds) > 0).all() and m.weights[1] > m.weights[0] > m.weights[2]
    p = m.probabilities(np.array([0.0, m.weights[0] + m.weights[1]]))
    assert np.allclose(p.sum(axis=1), 1) and p[0].argmax() == 0 and p[1].argmax() == 3


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?x", "x://ex.org/fr/2#f", "http://net/", "http://net", "http://xexample.net/en/", "https://h.com/a/b/c/d/e/f/g/h/i/j/k", "a://b://c/d"]
    pages = spark.createDataFrame([(i if i else None, u, "y") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(8, 0), (8, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = {r.id: r for r in url_filter.filter_urls(pages, labels).collect()}
    assert len(got) == 10 and (got[1].host, got[1].path, got[2].host) == ("", "", "")
    assert (got[3].host, got[3].rule, got[3].verdict) == ("a.example.net", "example.net/en/", "allow")
    assert (got[4].rule, got[5].rule, got[6].rule, got[7].rule) == ("org/fr/", "net/", None, "net/")
    assert (got[9].host, got[9].path) == ("b:", "//c/d") and got[8].template == "/a/b/c/d/e/f/g/h/i/j/k"
    assert url_filter.filter_urls(pages.where("false"), labels).count() == 0
    assert url_filter.filter_urls(pages, labels.where("false")).where("verdict = 'block' and rule is null").count() == 0


def test_url_templates_reject_bad_branches(spark):
    rows = [(i, f"http://h.com/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(0, 300)], "doc_id long, quality int")
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).groupBy("template", "verdict").count().collect()
    assert {(r.template, r.verdict) for r in got} == {("/spam/*", "block"), ("/news/*", "allow")} or {(r.template, r.verdict) for r in got} == {("/spam/{n}.html", "block"), ("/news/{n}.html", "allow")}


def test_url_templates_part_at_any_depth(spark):
    deep = "/".join("abcdefghijkl")
    rows = [(i, f"http://h.com/{deep}/{'spam' if i % 2 else 'news'}") for i in range(200)]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(200)], "doc_id long, quality int")
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).select("id", "verdict").collect()
    assert len(got) == 200 and all((r.verdict == "block") == (r.id % 2 == 1) for r in got)


def test_chat(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", "more")
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [a, c], 6: [b], 7: [a, (None, None)], 8: [("user", "x")] * 3}
    rows = [(k, i, r, t, "z") for k, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(2, 0, "user", "hi", "z"), (None, 0, "user", "lost", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    got = {r.conv: r for r in chat.render_chats(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8} and got[3].n_turns == 3
    assert got[6].rendered == "<|im_start|>assistant\nyo<|im_end|>\n" and got[7].rendered.endswith("<|im_start|>\n<|im_end|>\n")
    long = spark.createDataFrame([(1, i, "user", str(i)) for i in range(1300)] + [(2, i, "user", str(i)) for i in range(1299)], "conv_id long, turn long, role string, text string")
    parts = chat.render_chats(long).collect()
    assert {r.conv for r in parts} == {1} and sum(r.n_turns for r in parts) == 1300 and len(parts) == 6
    assert chat.render_chats(df.where("false")).count() == 0


def test_lm_edges(spark):
    rows = [(1, "a b a b"), (2, "A b c"), (3, None), (4, " "), (1, "a b a b"), (None, "c")]
    got = lm_score.score_documents(documents(spark, rows)).collect()
    uni, bi, start = collections.Counter(), collections.Counter(), 0
    for _, t in rows:
        w = (t or "").lower().split()
        start += bool(w)
        uni.update(w)
        bi.update(zip([None, *w], w))
    total = sum(uni.values())

    def score(t):
        w = t.lower().split()
        return sum(math.log(bi[g] / (uni[g[0]] if g[0] else start) if bi[g] >= 2 else 0.4 * uni[g[1]] / total) for g in zip([None, *w], w))

    assert len(got) == 6
    for r in got:
        text = next((t for i, t in rows if i == r.id), None)
        assert r.log_score is None if not (text or "").split() else r.log_score == pytest.approx(score(text))
    assert lm_score.score_documents(documents(spark, [])).count() == 0


def test_quality_edges(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good), (2, None), (3, ""), (4, "a b c " * 40), (5, good + "\n" + good + "\nx\n\n \nx"), (None, good), (6, good + " ### $$ |"), (1, good)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    got = {(r.id, r.n_words): r for r in quality.quality_rules(documents(spark, rows), labels).collect()}
    assert got[(2, 0)].base_failed and got[(4, 120)].n_repeat_words == 120 and got[(4, 120)].base_failed and got[(1, 60)].kept
    r = got[(5, 122)]
    assert (r.n_dup_lines, r.n_repeat_words) == (2, 120) and got[(6, 63)].n_symbols == 6
    assert quality.quality_rules(documents(spark, []), labels).count() == 0
    assert quality.quality_rules(documents(spark, rows), labels.where("false")).where("kept <> (not base_failed)").count() == 0


def test_binomial_tail(spark):
    cases = [(0, 600), (3, 900), (20, 4000), (500, 60000)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", F.exp(quality.binomial_at_most("k", "n", 0.01)))
    for r in df.collect():
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-6)


def test_lm_counts_every_word(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randint(1, 60)))) for i in range(120)] + [(500, "only once here"), (501, "only once here"), (502, "unique1 unique2 unique3")]
    docs = documents(spark, rows)
    uni, bi = collections.Counter(), collections.Counter()
    for _, t in rows:
        uni.update(t.split())
        bi.update(zip([None, *t.split()], t.split()))
    total = sum(uni.values())
    for vocabulary, hot in ((0, 0), (3, 5), (40, 1000), (100_000, 5)):
        got = {r.id: r.log_score for r in lm_score.score_documents(docs, vocabulary=vocabulary, hot=hot).collect()}
        for i, t in rows:
            want = sum(math.log(bi[g] / (uni[g[0]] if g[0] else len(rows)) if bi[g] >= 2 else 0.4 * uni[g[1]] / total) for g in zip([None, *t.split()], t.split()))
            assert got[i] == pytest.approx(want), (vocabulary, i)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_decontamination_asks_items_of_every_length(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(4, 7))) for _ in range(1500)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: pick(n) for i, n in enumerate([8, 9, 10, 12, 15, 16, 17, 18, 20, 24, 30, 40, 60] * 3)}
    rows, want = [(10_000 + i, " ".join(pick(120))) for i in range(40)], set()
    for i, item in items.items():
        for share in (0.0, 0.2, 0.38):
            told = list(item)
            for k in rng.sample(range(len(item) - 4), min(len(item) - 4, int(share * len(item)))):
                told[k] = f"zz{k}"
            d = i * 3 + int(share * 6)
            rows.append((d, " ".join(pick(rng.randint(0, 90)) + told + pick(rng.randint(0, 90)))))
    for d, t in rows:
        w = t.split()
        for i, item in items.items():
            if len(set(item) & set(w)) >= 0.6 * len(item):
                span = next(s for m, s in ((24, 48), (64, 96)) if len(item) <= m)
                for a in range(0, len(w), 16 if span < 96 else 32):
                    here = w[a : a + span]
                    if subsequence(item, here) >= 0.6 * len(item) and (subsequence(item, here) >= 0.75 * len(item) or subsequence(item[-4:], here) == 4):
                        want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w[:-4]) + ". " + " ".join(w[-4:])) for i, w in items.items()], "item_id long, text string")
    found = decontam.leaks(documents(spark, rows), bench).collect()
    got = {(r.id, r.item_id) for r in found}
    assert sum(r.kind == "paraphrase" and r.lcs_ratio < 0.75 and r.answer_ratio >= 0.75 for r in found) >= 20
    short = {(d, i) for d, i in want if len(items[i]) <= 16}
    assert len(short) >= 45 and len(want) >= 100
    print("recall", len(want & got), len(want), "short", len(short & got), len(short), "extra", len(got - want))
    assert len(short & got) >= 0.98 * len(short) and len(want & got) >= 0.98 * len(want) and len(got - want) <= 2


def test_decontamination_asks_very_short_items_and_scripts_without_spaces(spark):
    chinese = "床前明月光疑是地上霜。举头望明月低头思故乡"
    bench = spark.createDataFrame([(1, "Purple xylophone!"), (2, chinese), (3, "ไม่มี"), (4, " ... ")], "item_id long, text string")
    rows = [(1, "a purple, xylophone plays"), (2, "purple and xylophone"), (3, "purple"), (4, "xylophone"), (5, "他说" + chinese.replace("。", "，").replace("地", "田") + "是诗"), (6, "春眠不觉晓处处闻啼鸟"), (7, "เขาไม่มีเงิน"), (8, None)]
    got = {(r.id, r.item_id, r.kind) for r in decontam.leaks(documents(spark, rows), bench).collect()}
    assert got == {(1, 1, "verbatim"), (5, 2, "verbatim"), (7, 3, "verbatim")}


def test_decontamination_signatures_bound_every_subsequence():
    rng = random.Random(3)
    vocab = [f"w{int(rng.paretovariate(0.15)) % 900}" for _ in range(3000)]
    items = decontam.Items([(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 64)))) for i in range(60)], 8)
    odd = ["", "  ", " W1, w2;w3\t", "other\x1cw4", None, "词w5é W6é.", "w7"]
    texts = odd + [" ".join(rng.choice(vocab + ["other"]) for _ in range(48)) for _ in range(200)]
    chunk = next(decontam.chunks([pa.RecordBatch.from_pydict({"text": texts})]))
    ids, at = items.numbers(chunk)
    number = {w: i for w, i in items.vocabulary.items()}
    assert [list(ids[a:b]) for a, b in zip(at, at[1:])] == [[number.get(w, len(number)) for w in decontam.terms(t)] for t in texts]
    bits, own, unsaid = items.signatures(np.bincount(ids, minlength=len(number) + 1)[: len(number)])
    named = {i: w for w, i in number.items()}
    item, term = np.divmod(items.keys, len(number) + 1)
    passed = 0
    for a, b in zip(at[len(odd) :], at[len(odd) + 1 :]):
        seen = np.bitwise_or.reduce(bits[ids[a:b]], axis=0)
        most = np.bitwise_count(seen & own).sum(1) + unsaid
        for k in range(len(items.ids)):
            words = [None] * items.length[k]
            for t, places in zip(term[item == k], items.bits[item == k]):
                for p in range(len(words)):
                    if int(places) >> p & 1:
                        words[p] = named[t]
            assert most[k] >= subsequence(words, [named.get(i) for i in ids[a:b]])
        passed += (most >= 0.6 * items.length).sum()
    assert passed < 0.5 * 200 * len(items.ids)


def test_decontamination_basis_is_fitted_on_every_passage(spark, monkeypatch):
    monkeypatch.setattr(decontam, "OWN_PASSAGES", 100)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    items = decontam.Items([(i, " ".join(rng.choice(vocab) for _ in range(20))) for i in range(30)], 8)
    texts = [" ".join(vocab[int(rng.paretovariate(0.3)) % 400] for _ in range(rng.randint(0, 200))) for _ in range(120)] + [None, ""]
    size, length, rank = len(items.vocabulary), 32, 12
    passages = [p for t in texts for w in [decontam.terms(t)] for p in (w[k : k + length] for k in range(0, len(w), length))]
    counts = np.zeros((len(passages), size))
    for k, p in enumerate(passages):
        for w in p:
            if w in items.vocabulary:
                counts[k, items.vocabulary[w]] += 1
    rows = decontam.numbered(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), items)
    df, n = decontam.document_frequencies(rows, items, length)
    assert n == len(passages) > 200 and list(df) == list((counts > 0).sum(0))
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    own = np.zeros((len(items.ids), size))
    item, term, value = items.weights(idf)
    own[item, term] = value
    tfidf = counts * idf / np.maximum(1e-9, np.linalg.norm(counts * idf, axis=1, keepdims=True))
    gram = tfidf.T @ tfidf + decontam.OWN_WEIGHT * n / 100 * own.T @ own
    got = decontam.latent_basis(rows, items, idf, n, np.argsort(-df, kind="stable")[:64], length, rank)
    q, _ = np.linalg.qr(gram @ np.random.default_rng(7).standard_normal((size, rank + 8)))
    values, turn = np.linalg.eigh(q.T @ gram @ q)
    assert np.linalg.svd((q @ turn[:, np.argsort(-values)[:rank]]).T @ got)[1].min() > 0.999
