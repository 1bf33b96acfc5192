import math
import zlib

import numpy as np

from trajlake.llm.quality import FEATURES, THRESHOLD, AttentionModel, fit_quality, op10_quality, passages, score_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    rows = op10_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= THRESHOLD)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_edges(spark):
    text = "plain words in a row. " * 20
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "X!! " * 9000), (None, text), (1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (9, 1), (3, 7)], "doc_id long, quality int")
    docs = docs.selectExpr("*", "'c' AS label", "0.5 AS weight")
    scores = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)
    none = score_quality(docs, fit_quality(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert score_quality(docs.limit(0), fit_quality(docs.limit(0), labels)).count() == 0


def test_every_passage_is_encoded():
    import pyarrow as pa

    texts = pa.array(["w " * 130, None, " x", "a b\nc"])
    found = [(lo, row.tolist(), x) for lo, _, row, x in passages(texts)]
    assert [r for _, rows, _ in found for r in rows] == [0, 0, 0, 1, 2, 3]
    assert not found[0][2][3].any()


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    sizes = {"mean": (FEATURES,), "scale": (FEATURES,), "W": (FEATURES, 4), "b": (4,), "V": (4, 3), "bv": (3,), "U": (4, 3),
             "bu": (3,), "w": (3,), "c": (4,), "c0": (1,)}
    w = {k: rng.normal(size=n) for k, n in sizes.items()}
    w["scale"] = 1 + np.abs(w["scale"])
    row = np.array([0, 0, 0, 1, 2, 2])
    return AttentionModel(w), rng.normal(size=(6, FEATURES)), row


def test_score_equals_plain_loops():
    model, x, row = small_model()
    w, got = model.w, model.score(x, row, 3)
    for doc in range(3):
        energy, hidden = [], []
        for k in np.flatnonzero(row == doc):
            u = [(x[k, f] - w["mean"][f]) / w["scale"][f] for f in range(FEATURES)]
            h = [math.tanh(sum(u[f] * w["W"][f, j] for f in range(FEATURES)) + w["b"][j]) for j in range(4)]
            gate = lambda m, b, q, h=h: sum(h[j] * w[m][j, q] for j in range(4)) + w[b][q]
            energy.append(sum(math.tanh(gate("V", "bv", q)) / (1 + math.exp(-gate("U", "bu", q))) * w["w"][q] for q in range(3)))
            hidden.append(h)
        total = sum(math.exp(e) for e in energy)
        mean = [sum(math.exp(e) / total * h[j] for e, h in zip(energy, hidden)) for j in range(4)]
        want = 1 / (1 + math.exp(-sum(m * c for m, c in zip(mean, w["c"])) - w["c0"][0]))
        assert abs(got[doc] - want) < 1e-12


def test_gradient_equals_finite_differences():
    model, x, row = small_model(1)
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])

    def loss():
        p = model.score(x, row, 3)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    for name, slope in model.gradient(x, row, y, weight).items():
        value = model.w[name]
        for at in list(np.ndindex(value.shape))[:40]:
            keep, step = value[at], 1e-6
            value[at] = keep + step
            up = loss()
            value[at] = keep - step
            down = loss()
            value[at] = keep
            assert abs((up - down) / (2 * step) - slope[at]) < 1e-6


def test_decay_is_chosen_within_the_training_rows(spark):
    from trajlake.llm.quality import DECAY, choose_decay

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    best, losses = choose_decay(docs, labels, decays=(1e-3, 1e-2), folds=2, fit_docs=150)
    assert best == min(losses, key=losses.get) == DECAY
    # Turned labels of held-out rows change nothing.
    held = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"
    turned = labels.selectExpr("doc_id", f"CASE WHEN {held} THEN 1 - quality ELSE quality END AS quality")
    assert choose_decay(docs, turned, decays=(1e-3, 1e-2), folds=2, fit_docs=150) == (best, losses)
    assert choose_decay(docs, labels.limit(0)) == (1e-2, {})


def test_sample_ends_at_its_passages(spark):
    from trajlake.llm.quality import _sample

    docs = spark.createDataFrame([(i, "word " * (64 * 5)) for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    whole = _sample(docs, labels, "doc_id", "text", "quality", 100, 10**6)
    assert len(whole[2]) == docs.count() and np.bincount(whole[1]).tolist() == [5] * len(whole[2])
    part = _sample(docs, labels, "doc_id", "text", "quality", 100, 130)
    assert 0 < len(part[2]) < len(whole[2]) and np.bincount(part[1]).tolist() == [5] * len(part[2])
    assert _sample(docs, labels, "doc_id", "text", "quality", 100, 3) is None
