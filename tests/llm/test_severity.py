"""The ordinal severity model against plain forms of its likelihood and of its scoring."""

import math
import random

import numpy as np

from hslake.llm import toxicity


def objective(weights, thresholds, x, grade, ridge=0.02):
    """The penalised, balanced likelihood said row by row."""
    n, k = len(grade), max(grade) + 1
    raw = [1 / max(1, grade.count(g)) for g in grade]
    balance = [0.5 + 0.5 * r * n / sum(raw) for r in raw]
    edges = [-math.inf, *thresholds, math.inf]
    below = lambda e, s: 0.0 if e == -math.inf else 1.0 if e == math.inf else 1 / (1 + math.exp(-max(-40, min(40, e - s))))
    loss = 0.0
    for row, g, b in zip(x, grade, balance):
        s = sum(w for w, there in zip(weights, row) if there)
        loss -= b * math.log(max(1e-9, below(edges[g + 1], s) - below(edges[g], s))) / n
    assert k == len(thresholds) + 1
    return loss + ridge / max(1, len(weights)) ** 0.5 / 20 * sum(w * w for w in weights)


def test_fit_is_a_maximum_of_the_likelihood():
    rng = random.Random(3)
    x = [[rng.random() < 0.3 for _ in range(5)] for _ in range(300)]
    grade = [min(3, max(0, round(1.5 * r[0] + r[1] - r[2] + rng.gauss(0.5, 0.8)))) for r in x]
    rows, cols = np.nonzero(np.array(x))
    model = toxicity.fit(rows, cols, np.array(grade), 4, 5, rounds=3000)
    best = objective(model.weights, model.thresholds, x, grade)
    for i in range(8):
        for step in (-0.2, -0.05, 0.05, 0.2):
            w, t = list(model.weights), list(model.thresholds)
            if i < 5:
                w[i] += step
            else:
                t[i - 5] += step
            if sorted(t) == t:
                assert objective(w, t, x, grade) > best - 1e-5
    # As many rounds as are used come near it.
    used = toxicity.fit(rows, cols, np.array(grade), 4, 5)
    assert objective(used.weights, used.thresholds, x, grade) < best + 1e-3


def plain_features(text):
    """The features of one text, taken word by word."""
    out, word = set(), bytearray()
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    hashed = lambda w: int(toxicity.span_hash(toxicity.prefix_hash(np.frombuffer(bytes(w), np.uint8), toxicity.FOLDED), np.array([0]), np.array([len(w)]))[0])
    for b in (text or "").encode() + b" ":
        if toxicity._BREAKS[b]:
            if word:
                w = bytes(word).translate(fold)
                out.add(hashed(w) >> (64 - toxicity.BITS))
                for n in toxicity.PREFIXES:
                    if len(w) > n:
                        out.add(int(toxicity.mixed(np.array([(hashed(w[:n]) + n) % (1 << 64)], np.uint64))[0]) >> (64 - toxicity.BITS))
            word = bytearray()
        else:
            word.append(b)
    return out


def test_severity_scores_row_by_row(spark):
    rng = random.Random(5)
    bad, good = ["vile", "horrid", "Wretched", "odiousness", "éhonté"], [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 and rng.random() < 0.4 else good) for _ in range(rng.randint(1, 30))), "z") for i in range(400)] + [(900, None, "z"), (901, "", "z"), (902, "!!", "z"), (None, "vile words", "z"), (5, "vile " * 40000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 400, 2)] + [(0, 0), (7, None)], "doc_id long, toxic int")
    texts = docs.selectExpr("doc_id as id", "text")
    model = toxicity.train(texts, labels.selectExpr("doc_id as id", "toxic").where("toxic is not null"), 4, 4000, 4, 2.0)
    got = toxicity.severity(docs, labels, min_z=2.0).collect()
    assert len(got) == len(rows) and model.weights.any()
    for r, (i, text, _) in zip(sorted(got, key=lambda r: (r.id is None, r.id or 0, r.p_toxic)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, sum(model.weights[f] for f in plain_features(r[1]))))):
        s = sum(float(model.weights[f]) for f in plain_features(text))
        below = [0.0, *(1 / (1 + math.exp(-(t - s))) for t in model.thresholds), 1.0]
        p = [b - a for a, b in zip(below, below[1:])]
        assert r.id == i and abs(r.expected_severity - sum(k * v for k, v in enumerate(p))) < 1e-5 and abs(r.p_toxic - (1 - p[0])) < 1e-5 and r.toxic == (1 - p[0] >= 0.5)
    assert toxicity.severity(docs.where("false"), labels).count() == 0
