import numpy as np

import trajlake.llm.embedding_dedup as op
from trajlake.llm.embedding_dedup import near_vectors


def brute(rows):
    ok = [(k, np.array(v, float)) for k, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = unit @ unit.T >= 0.9
    comp = [k for k, _ in ok]
    changed = True
    while changed:
        new = [min(comp[j] for j in np.flatnonzero(near[i])) for i in range(len(ok))]
        changed, comp = new != comp, new
    out = {k: (0, k) for k, _ in rows}
    out.update({k: (int(near[i].sum()) - 1, comp[i]) for i, (k, _) in enumerate(ok)})
    return out


def rows():
    rng = np.random.default_rng(5)
    out = []
    centres = rng.standard_normal((8, 16))
    for i in range(260):
        c = centres[i % 8] if i % 3 else rng.standard_normal(16)
        out.append((i, (c + 0.12 * rng.standard_normal(16)).tolist()))
    out += [(300 + i, centres[0].tolist()) for i in range(25)] + [(350, (3 * centres[0]).tolist())]
    nan = float("nan")
    return out + [(400, None), (401, []), (402, [0.0] * 16), (403, [nan] * 16), (404, [None] * 16), (405, [float("inf")] * 16)]


def test_equals_brute_force_also_in_small_pieces(spark, monkeypatch):
    data = rows()
    want = brute(data)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS bucket")
    for piece in (2048, 7):
        monkeypatch.setattr(op, "PIECE", piece)
        got = near_vectors(df, bits=4, tables=40).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_repeated_null(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (5, [-0.0, 1.0]), (6, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (5, 1, 5), (6, 1, 5)]
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_defaults(spark):
    """All of a table, with the parameters that its number of rows gives."""
    one = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    data = [(r.vec_id, r.embedding) for r in one.collect()]
    unit = np.array([np.array(v, float) / np.linalg.norm(v) for _, v in data])
    want = dict(zip([k for k, _ in data], (unit @ unit.T >= 0.9).sum(axis=1) - 1, strict=True))
    got = {r.vec_id: r.n_links for r in near_vectors(one).collect()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_tables_follow_the_number_of_vectors():
    for threshold in (0.95, 0.9, 0.8, 0.5, 0.0, -1.0):
        for n in (0, 1, 10**3, 10**6, 10**9, 10**12, 10**15):
            bits, tables = op.tables_for(n, threshold)
            agree = 1 - np.arccos(threshold) / np.pi
            assert 1 - (1 - agree**bits) ** tables >= op.RECALL - 1e-9 and 1 <= tables <= op.MOST_TABLES and 0 <= bits <= op.MOST_BITS
    assert op.tables_for(10**9, 0.9)[0] == 21 and op.tables_for(10**9, 0.8)[0] == 21
    assert op.tables_for(10**9, -1.0) == (0, 1)


def test_recall_with_the_bits_of_a_billion_vectors(spark):
    """Planted pairs at the threshold, with 21 bits and as many tables as 10^9 vectors get."""
    rng = np.random.default_rng(9)
    for threshold, pairs in ((0.9, 150), (0.8, 40)):
        data = []
        for k in range(pairs):
            a, b = rng.standard_normal((2, 48))
            a /= np.linalg.norm(a)
            b -= (b @ a) * a
            b /= np.linalg.norm(b)
            c = threshold + 0.0005
            data += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
        bits, tables = op.tables_for(10**9, threshold)
        assert bits == 21
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        got = near_vectors(df, threshold=threshold, bits=bits, tables=tables).collect()
        found = {r.vec_id for r in got if r.component_id == r.vec_id - 1 and r.vec_id % 2}
        assert len(found) >= 0.93 * pairs
        unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in data])
        near = (unit @ unit.T >= threshold).sum(axis=1) - 1
        assert all(r.n_links <= near[r.vec_id] for r in got)


def test_no_bits_compare_all(spark):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = near_vectors(df, bits=0, tables=1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(data)
