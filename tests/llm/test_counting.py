"""Token counts, tokenizer alignment, filter audit and shared tokenising against brute force, with nulls, odd and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from checking import assert_same
from pyspark.sql import functions as F

from hslake.llm import _tokens, alignment, chat, filter_audit, packing, token_counts
from hslake.llm._spark import scratch_folder

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, part string, piece string, digest string, mask string, row string"
BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  ", "\n a", "a <|endoftext|>b <|endoftext|>", "<|ENDOFTEXT|> x", "x  <|startoftext|>y", "it's 'tis\t\tdon't\n\n 12½ ñ", "▁a ▁", "<s> hi </s> <0x41>", "ﬁ é 中文 ends here", "a\x1cb \x85c"]


def documents(spark, rows):
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *"xxxxxx") for r in rows], DOC)


def odd_texts(seed, n, size=60):
    rng = random.Random(seed)
    signs = [32, 32, 9, 10, 65, 97, 0x301, 0xE9, 0x3C3, 0x4E2D, 0xA0, 0x2581, 0x1F600, 0x85, 0x1C, 0x2028, 39, 115, 60, 124, 62, 48]
    return ["".join(chr(rng.choice(signs)) for _ in range(rng.randint(0, size))) for _ in range(n)]


def words_text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "nation", "Éa", "ing,", "x1", "unbelievable.", "a\nb", "it's"]) for _ in range(n))


def library(path, special=False):
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: own.encode(text)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = special
    return lambda text: own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path,spaced", [(BYTES, False), (BYTES, True), (WORDS, False), (PIECES, True)])
@pytest.mark.parametrize("limits", [{}, {"SLICE": 40, "UNITS": 30, "JOINED": 7}])
def test_units_give_the_ids_of_whole_texts(monkeypatch, path, spaced, limits):
    for k, v in limits.items():
        monkeypatch.setattr(_tokens, k, v)
    texts = odd_texts(1, 400) + ODD + [words_text(k, 40) for k in range(20)] 
    texts += ["".join(f"a{chr(c)}1{chr(c)} b{chr(c)}! {chr(c)}\n" for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 2048 if path == BYTES and not limits else 16384)]
    encoder, own = _tokens.Encoder([_tokens.open_kind(path)], spaced), library(path)
    lead = " " if spaced and path == BYTES else ""
    want = [own(lead + t) for t in texts]
    assert [list(map(int, i)) for i, _ in encoder.ids(texts)] == want
    assert encoder.counts_of(texts).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("limits", [{}, {"SLICE": 40, "UNITS": 30, "JOINED": 7}])
def test_ids_by_tiles_are_those_of_whole_texts(monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(_tokens, k, v)
    rng = random.Random(5)
    texts = odd_texts(1, 400) + ODD + ["<", "|x", "é" * 3000, "a\x00b \x7f", "  <|endoftext|>", "<|endoftext|>  b\n", "’tis  “it’s”\n\n“ a", "中文 \n\n中 文", "x\u00a0  y", " \n" * 50]
    texts += ["".join(rng.choices("aZéÉÀÞßÿ×÷µ09.,<|'’中stl\n\t    ", k=60)) for _ in range(1500)] + [words_text(k, 60) for k in range(20)]
    texts += ["".join(f"a{chr(c)}1{chr(c)} B{chr(c)}! {chr(c)}\n\n{chr(c)}  {chr(c)}" for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in [*range(0, 0x3100, 64), 0xD7C0, 0xFEC0, 0x1F600]]
    body = [t.encode() for t in texts]
    for path in (BYTES, WORDS):
        encoder, own = _tokens.Encoder([_tokens.open_kind(path)]), library(path)
        want = [own(t) for t in texts]
        data, offsets = np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)])
        assert [i.tolist() for i in encoder.ids_in(data, offsets)] == want
        assert [encoder.ids_in(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tolist() for b in body] == want
    assert encoder.ids_in(data[:0], offsets[:1]) == []


def test_packing_asks_the_library_for_tiles_not_units():
    rng = random.Random(6)
    text = "".join(f"{'ab'[i % 2]}{rng.randrange(40)}{rng.choice([' ', ', ', '. ', '\n', '-'])}" for i in range(4000)).encode()
    encoder = _tokens.Encoder([_tokens.open_kind(BYTES)])
    assert encoder.ids_in(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist() == library(BYTES)(text.decode())
    assert len(encoder.known) < 60 < len(set(text.split(b" "))) / 10


@pytest.mark.parametrize("limits", [{}, {"UNITS": 30, "PIECES": 7}])
def test_counts_by_pieces_are_those_of_whole_texts(monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(_tokens, k, v)
    latin = random.Random(4)
    texts = odd_texts(1, 400) + ODD + ["<", "|x", "é" * 3000, "J\u030c j\u030c", "a\x00b \x7f"] + ["".join(latin.choices("aZéÉÀÞßÿ×÷µ09.,<|'\n ", k=40)) for _ in range(400)]
    texts += ["".join(f"a{chr(c)}1{chr(c)} B{chr(c)}! {chr(c)}\n" for c in range(a, a + 256)) for a in range(0, 0x3000, 256)]
    body = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)])
    for path in (WORDS, BYTES):
        encoder, own = _tokens.Encoder([_tokens.open_kind(path)]), library(path)
        for _ in range(2):
            assert encoder.counts_in(data, offsets).tolist() == [len(own(t)) for t in texts]
    assert encoder.counts_in(data[:0], offsets[:1]).tolist() == []


def test_words_that_differ_by_case_and_signs_are_encoded_once():
    asked = []
    kind = _tokens.open_kind(WORDS)
    ask, kind.ask_pieces = kind.ask_pieces, lambda pieces: asked.extend(pieces) or ask(pieces)
    body = "nation Nation, NATION. (nation) nation! 12 nation\u00c9 nation\u00e9".encode()
    got = _tokens.Encoder([kind]).counts_in(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    assert got.tolist() == [len(library(WORDS)(body.decode()))]
    assert sorted(asked) == sorted([b"nation", b",", b".", b"(", b")", b"!", b"1", b"2", "nation\u00e9".encode()])


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, "\t" * 1_000_000, " \n\t" * 350_000])
def test_packing_takes_long_white_space(spark, run):
    rows = [(1, run), (2, "a" + run + "b c"), (3, "short")]
    got = packing.pack(documents(spark, rows), tokenizer=BYTES, with_ids=True).orderBy("id", "piece").collect()
    own = library(BYTES)
    for i, text in rows:
        assert [x for r in got if r.id == i for x in r.ids] == [*own(text), 2]


def test_chat_takes_null_and_empty_alike(spark):
    rows = [(1, 0, None, "hi"), (2, 0, "", "hi"), (2, 1, "user", "x"), (3, 0, "user", None), (4, 0, "user", ""), (4, 1, "a", "b"), (5, 0, None, None), (6, 0, "", "")]
    got = chat.render_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.conv for r in got) == [2, 4, 5]


def test_token_counts(spark):
    texts = [*ODD, None, *odd_texts(2, 40), words_text(3, 3000), "same text here", "same  text\n here "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900 + i, "same text here") for i in range(30)] + [(None, "same text here"), (None, "lost"), (None, "lost"), (7, texts[7]), (8, "another of one id")]
    own, cache = library(WORDS), f"{scratch_folder(spark)}/cache-test"
    want = collections.Counter((i, len((t or "").encode()), len(own(t or "")), len(own(t or "")) > 100) for i, t in rows)
    for half in (rows[::2], rows, rows):
        got = token_counts.count_tokens(documents(spark, half), cache=cache, tokenizer=WORDS, limit=100)
        counted = collections.Counter(tuple(r) for r in got.collect())
    assert counted == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() and stored.select("tokenizer").distinct().count() == 1
    other = token_counts.count_tokens(documents(spark, rows), cache=cache, tokenizer=PIECES).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert collections.Counter((r.id, r.n_tokens) for r in other) == collections.Counter((i, len(library(PIECES)(t or ""))) for i, t in rows)
    assert token_counts.count_tokens(documents(spark, []), cache=cache, tokenizer=WORDS).count() == 0


@pytest.mark.parametrize("bound", [0, 4000])
def test_token_counts_beyond_the_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(token_counts, "BROADCAST_BYTES", bound)
    rows = [(i % 40, words_text(i % 25, 5 + i % 25)) for i in range(300)]
    cache, own = f"{scratch_folder(spark)}/cache-{bound}", library(WORDS)
    for some in (rows[:100], rows):
        got = token_counts.count_tokens(documents(spark, some), cache=cache, tokenizer=WORDS).collect()
        assert collections.Counter((r.id, r.n_tokens) for r in got) == collections.Counter((i, len(own(t))) for i, t in some)
    assert spark.read.parquet(cache).count() == 25


def spans(ids, tokens):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(tokens[i])))
        at += len(tokens[i])
    return out


def brute_alignment(rows):
    from tokenizers import Tokenizer

    table_a = _tokens.byte_level_tokens(Tokenizer.from_file(BYTES).get_vocab())
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table_b = [_tokens.piece_bytes(own.id_to_piece(i)) for i in range(own.get_piece_size())]
    found, of_a, of_b = [], library(BYTES, True), library(PIECES)
    for _, t in rows:
        a, b = of_a(" " + (t or "")), of_b(t or "")
        whole = (" " + (t or "")).encode()
        if not t or b"".join(table_a[i] for i in a) != whole or b"".join(table_b[i] for i in b) != whole:
            found.append(([], [], [], ""))
            continue
        sa, sb = spans(a, table_a), spans(b, table_b)
        links = [(x, y) for x, (p, q) in zip(a, sa) for y, (r, s) in zip(b, sb) if p < s and r < q]
        common = sorted({q for _, q in sa} & {s for _, s in sb})
        groups, at = [], 0
        for c in common:
            groups.append(",".join(str(x) for x, (p, q) in zip(a, sa) if at < q <= c) + "|" + ",".join(str(y) for y, (r, s) in zip(b, sb) if at < s <= c))
            at = c
        found.append((a, b, links, ";".join(groups)))
    counts = collections.Counter(p for _, _, links, _ in found for p in set(links))
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(i, len(a), len(b), g.count(";") + bool(g), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if a else "") for (i, _), (a, b, links, g) in zip(rows, found)]


@pytest.mark.parametrize("piece,hot", [(1 << 16, 1 << 18), (7, 20), (64, 0), (1, 1 << 18)])
def test_alignment(spark, piece, hot):
    texts = [*ODD, None, *odd_texts(5, 20), *(words_text(k, 30) for k in range(10)), "aaaaaaaaaa" * 20, "unbelievable " * 30, "\n\n\n  x", "中文中文"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[40]), (None, texts[40]), (None, None), (50, texts[40])]
    got = alignment.align(documents(spark, rows), path_a=BYTES, path_b=PIECES, piece=piece, hot=hot).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(brute_alignment(rows))


def test_alignment_edges(spark):
    assert alignment.align(documents(spark, []), path_a=BYTES, path_b=PIECES).count() == 0
    text = words_text(9, 200_000)
    assert len(text) > 1_000_000
    row = alignment.align(documents(spark, [(1, text)]), path_a=BYTES, path_b=PIECES).first()
    apart = alignment.align(documents(spark, [(1, text)]), path_a=BYTES, path_b=PIECES, piece=5000, hot=100).first()
    assert row == apart and (row.n_a, row.n_b) == (len(library(BYTES, True)(" " + text)), len(library(PIECES)(text)))


def test_diagonal_cuts_are_equal_work():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (np.array(sorted(rng.sample(range(1, 80), rng.randint(1, 40))), np.int64) for _ in "ab")
        i, j = alignment.diagonal_cuts(a, b, k := rng.randint(1, 9))
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b))
        for i0, i1, j0, j1 in zip(i, i[1:], j, j[1:]):
            assert 0 < i1 - i0 + j1 - j0 <= k + 1
            before, after = [*a[:i1], *b[:j1]], [*a[i1:], *b[j1:]]
            assert not before or not after or max(before) < min(after)


def test_galloping_merges():
    rng = random.Random(6)
    filter_audit.WINDOW, kept = 3, filter_audit.WINDOW
    try:
        for _ in range(300):
            lists = [np.array(sorted(rng.sample(range(60), rng.choice([0, 1, 5, 30]))), np.int32) for _ in range(4)]
            assert filter_audit.union(lists).tolist() == sorted(set().union(*map(set, lists)))
            assert filter_audit.difference(lists[0], lists[1]).tolist() == sorted(set(lists[0].tolist()) - set(lists[1].tolist()))
            assert filter_audit.common(lists[0], lists[2]) == len(set(lists[0].tolist()) & set(lists[2].tolist()))
            at, key = rng.randint(0, len(lists[3])), rng.randint(0, 60)
            assert filter_audit.gallop(lists[3], at, key) == max(at, int(np.searchsorted(lists[3], key, "right")))
    finally:
        filter_audit.WINDOW = kept


def brute_audit(rows, labels):
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)]
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((part or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = [], collections.Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in own)
                out.append([part, "".join("ABCDE"[k] for k in order), step + 1, len(left), len(gone), failing - len(gone), sum(d[1][f] and sum(d[1]) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f])
                shapley[part, f] += len(gone)
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_filter_audit(spark, monkeypatch, block):
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", 40)
    rng = random.Random(7)
    texts = [None, "", " \t", "A#", "$ few", words_text(1, 80), " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), " ".join(f"é{i}" for i in range(70)) + " |", words_text(2, 5000)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "b", "b", "b", "c"])) for _ in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(2, 1, 1), (None, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(documents(spark, rows), table, block=block).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(rows, labels)
    assert filter_audit.audit(documents(spark, []), table).count() == 0


def test_filter_audit_lists_rows_once(spark):
    rows = [(i, words_text(i, 60), "ab"[i % 3 > 0]) for i in range(100)]
    marked = filter_audit.failures(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    blocks = filter_audit.posting_lists(marked, 16).collect()
    assert sorted(i for b in blocks for i in b.ids) == list(range(100)) and all(len(b.ids) == b.n <= 16 and list(b.ids) == sorted(b.ids) for b in blocks)
    assert all(list(x) == sorted(x) for b in blocks for x in b.lists)


def test_filter_audit_sql(spark, tmp_path):
    docs = documents(spark, [(i, t, "p") for i, t in enumerate([*ODD, None, *ODD])]).select("doc_id", "text", "source")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").toPandas().to_parquet(tmp_path / "labels.parquet")
    assert_same(spark, str(tmp_path), filter_audit.op13_filter_audit, filter_audit.ORACLE)
