"""The corpus pipeline stage by stage against brute force; it needs the repository's top folder on the path."""

import math

import numpy as np
from checking import tables
from test_operators import brute_components, brute_repeats

from hslake.llm import pipeline as corpus_pipeline
from hslake.llm import decontam, packing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    after = {n: seen[m] for n, m in zip(seen, [*list(seen)[1:]])} | {"packing": docs}
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    kept = {r[0] for r in tables(SF).execute(f"select doc_id from ({quality.ORACLES['op9_quality_rules']}) q where kept").fetchall()}
    assert {i for i, _ in rows(after["quality"])} == kept

    before = rows(seen["near_duplicates"])
    _, groups = brute_components(before, 5, 4, 5)
    assert {i for i, _ in rows(after["near_duplicates"])} == {min(before[j][0] for j in g) if before[i][1] else before[i][0] for i, g in groups.items()}

    before, got = rows(seen["repeated_strings"]), dict(rows(after["repeated_strings"]))
    for (i, text), (_, n, gone, _, _) in zip(before, brute_repeats(before, 400)):
        assert got[i] == text if not gone else abs(len(got[i].encode()) - (n - gone)) <= 16
    assert len(got) == len(before)

    items = [b" ".join(decontam.terms(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, got = rows(seen["decontamination"]), dict(rows(after["decontamination"]))
    leaky = {i for i, t in before if any(x in b" ".join(decontam.terms(t)) for x in items)}
    assert not leaky & set(got) and len(got) >= len(before) - len(leaky) - 2

    out = docs.collect()
    assert {r.doc_id for r in out} == set(got) and sum(r.length for r in out) == sum(r.length for r in packing.token_pieces(seen["packing"].selectExpr("doc_id as id", "text"), tokenizer=packing.default_tokenizer(), end_id=2, capacity=1024).collect())
    assert len({r.sequence_id for r in out}) <= 1.1 * math.ceil(sum(r.length for r in out) / 1024) + 2


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_null_and_repeated_ids_are_judged_by_row(spark):
    prose = lambda seed: " ".join(f"w{seed}x{i}" for i in range(80))
    rows = [(None, prose(1)), (None, "too short"), (7, prose(2)), (7, "too short"), (8, prose(3)), (8, prose(4)), (8, prose(4)), (3, prose(4)), (9, prose(2) + " end"), (None, prose(3))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    good = corpus_pipeline.quality_stage(spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in good.collect()), key=key) == sorted((x for x in rows if x[1] != "too short"), key=key)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, good, SF).collect()), key=key)
    assert got == sorted([(None, prose(1)), (7, prose(2)), (8, prose(3)), (3, prose(4)), (None, prose(3))], key=key)


def test_decontamination_stage_fits_its_basis_on_every_passage(spark, tmp_path, monkeypatch):
    rng, size, length, rank = np.random.default_rng(5), 200, 2 * decontam.STEP, 96
    draw = lambda *shape: (rng.pareto(0.3, shape) % size).astype(int)
    write = lambda ids: " ".join(f"w{i}" for i in ids)
    spark.createDataFrame([(i, write(rng.permutation(size)[:20])) for i in range(40)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = draw(500, 100 * length)
    docs = spark.createDataFrame([(i, write(ids)) for i, ids in enumerate(words)], "doc_id long, text string").repartition(3)
    made, seen = decontam.latent_basis, []

    def fit(docs, items, idf, *rest):
        seen.append((items, idf, made(docs, items, idf, *rest)))
        return seen[-1][2]

    monkeypatch.setattr(decontam, "latent_basis", fit)
    corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()
    [(items, idf, got)] = seen
    passages = words.reshape(-1, length)
    n, terms = len(passages), [int(w[1:]) for w in items.vocabulary]
    counts = np.bincount((np.arange(n)[:, None] * size + passages).ravel(), minlength=n * size).reshape(n, size)[:, terms]
    assert n == 50_000 and np.allclose(idf, np.log((n + 1) / ((counts > 0).sum(0) + 1)) + 0.05, atol=1e-4)
    tfidf = counts * idf
    tfidf /= np.maximum(1e-9, np.linalg.norm(tfidf, axis=1, keepdims=True))
    own = np.zeros((len(items.ids), len(terms)))
    item, term, value = items.weights(idf)
    own[item, term] = value
    gram = tfidf.T @ tfidf + decontam.OWN_WEIGHT * n / 40_000 * own.T @ own
    q, _ = np.linalg.qr(gram @ np.random.default_rng(7).standard_normal((len(terms), rank + 8)).astype(np.float32))
    values, turn = np.linalg.eigh(q.T @ gram @ q)
    assert np.linalg.svd((q @ turn[:, np.argsort(-values)[:rank]]).T @ got)[1].min() > 0.999
