"""Projection forest and whitening against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import projection_forest, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, vec string, id string, n bigint, leaves int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2, 3, "z") for i, v in rows], SCHEMA)


def brute(rows, is_query, k=10):
    """{query id: [(distance, id), ...]} by definition."""
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
          if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q in sorted({i for i, _ in ok if is_query(i)}):
        best = {}
        for _, vq in [r for r in ok if r[0] == q]:
            for i, v in ok:
                if i != q:
                    d = float(np.sqrt(((v - vq) ** 2).sum()))
                    best[i] = min(d, best.get(i, math.inf))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        found = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(found) + 1
        found.append((r["score"], r["vec_id"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-14, atol=0)


def test_forest_opens_everything_on_small_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties beyond the tenth
    df = table(spark, rows)
    got = projection_forest.nearest(df, F.col("vec_id") % 50 == 0, trees=3, leaf_size=8, cell_rows=50, query_rows=4)
    same(answers(got), brute(rows, lambda i: i % 50 == 0))


def test_forest_recall_on_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(4000)]
    found = answers(projection_forest.nearest(table(spark, rows), F.col("vec_id") % 100 == 7, search_share=0.15, search_least=0, cell_rows=700))
    want = brute(rows, lambda i: i % 100 == 7)
    recall = np.mean([len({i for _, i in want[q]} & {i for _, i in found[q]}) / 10 for q in want])
    assert recall >= 0.95 and found.keys() == want.keys()


def test_forest_hot_leaf_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    same_vector = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same_vector) for i in range(400)]  # a third of all rows in one leaf: several cells
    rows += [(1000 + i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(800)]
    rows += [(1100, rows[450][1]), (1100, rows[451][1]), (None, same_vector), (5000, None), (5100, [0.0] * 4), (5200, [1.0, None, 2.0, 3.0]),
             (5300, [float("nan"), 1.0, 1.0, 1.0]), (5400, [float("inf"), 1.0, 1.0, 1.0]), (5500, [1.0, 2.0]), (5600, [])]
    df = table(spark, rows)
    got = projection_forest.nearest(df, F.col("vec_id") % 100 == 0, cell_rows=64, leaf_size=16, query_rows=8)
    usable = [(i, v) for i, v in rows if i is None or i < 5000]
    same(answers(got), brute(usable, lambda i: i % 100 == 0))


def test_forest_few_and_no_rows(spark):
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 0.0])]
    same(answers(projection_forest.nearest(table(spark, few), F.col("vec_id") % 100 == 0)), brute(few, lambda i: i % 100 == 0))
    for none in ([], [(1, None)], [(100, [0.0, 0.0])], [(3, [1.0, 2.0])]):
        df = projection_forest.nearest(table(spark, none), F.col("vec_id") % 100 == 0)
        assert df.columns == ["query_id", "rank", "vec_id", "score"] and df.count() == 0
    alone = projection_forest.nearest(table(spark, [(100, [1.0, 2.0])]), F.col("vec_id") % 100 == 0)
    assert alone.count() == 0


def test_forest_query_recall_at_sf01(spark):
    src = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    rows = list(zip(src.vec_id.tolist(), [list(map(float, v)) for v in src.embedding]))
    want = brute(rows, lambda i: i % 100 == 0)
    got = answers(projection_forest.op12_ann_forest(spark, "/root/testdata/sf0.1"))
    assert np.mean([len({i for _, i in want[q]} & {i for _, i in got[q]}) / 10 for q in want]) >= 0.9


def test_length_is_the_most_frequent(spark):
    rows, dim = vectors.usable_vectors(table(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0, 2.0]), (4, [])]), "vec_id", "embedding")
    assert dim == 2 and {r["id"] for r in rows.collect()} == {2, 3}


def check_whitening(spark, df, rows, most=32):
    got = df.orderBy("vec_id", "component").collect()
    X = np.floor(64 * np.array([np.array(v, np.float32).astype(float) for _, v in rows])).astype(np.int64) + 1_000_000
    n, S = len(X), X.sum(axis=0)
    C = (n * X - S) / n
    e, U = np.linalg.eigh(C.T @ C / n)
    e, U = e[::-1], U[:, ::-1]
    m = min(most, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    ids = sorted(i for i, _ in rows)
    assert len(got) == n * m
    at = {i: k for k, (i, _) in enumerate(rows)}
    Y = (C @ U[:, :m] / np.sqrt(e[:m]))[[at[i] for i in ids]]
    W = np.array([r["whitened"] for r in got]).reshape(n, m)
    gaps = np.min(np.abs(e[:m, None] - e[None, :]) + np.eye(len(e))[:m] * 1e9, axis=1) / e[0]
    for j in np.flatnonzero(gaps > 1e-6):  # vectors of equal eigenvalues are free to turn
        assert min(np.abs(W[:, j] - Y[:, j]).max(), np.abs(W[:, j] + Y[:, j]).max()) < 1e-8
    assert np.abs(W.T @ W / n - np.eye(m)).max() < 1e-9
    deviation = ((n * X - S) ** 2).sum(axis=1)
    for r in got[::7]:
        assert r["n"] == n and r["deviation"] == deviation[at[r["vec_id"]]] and 0 <= r["identity_error"] < 1e-9
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-10


def test_whitening_equals_eigenvectors(spark):
    src = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    rows = list(zip(src.vec_id.tolist(), [list(map(float, v)) for v in src.embedding]))
    check_whitening(spark, whitening.op13_whitening(spark, SF), rows)


def test_whitening_of_low_rank_and_repeated_eigenvalues(spark):
    rng = np.random.default_rng(6)
    flat = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 7)) * 40
    flat = np.round(flat * 4)  # integers: scaling keeps the rank
    rows = [(i, v.tolist()) for i, v in enumerate(flat)]
    check_whitening(spark, whitening.whiten(table(spark, rows)), rows)
    cross = [(2 * j + s, [float((1 - 2 * s) * (8 if d == j else 0)) for d in range(6)]) for j in range(6) for s in range(2)]
    check_whitening(spark, whitening.whiten(table(spark, cross)), cross)  # all six eigenvalues equal
    check_whitening(spark, whitening.whiten(table(spark, rows), components=2), rows, most=2)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(50)] + [(None, [0.0] * 5)]
    odd = [(60, None), (61, [1.0, None, 1.0, 1.0, 1.0]), (62, [float("nan")] * 5), (63, [float("-inf")] * 5), (64, [1.0]), (65, [])]
    got = whitening.whiten(table(spark, good + odd))
    assert got.count() == 51 * 5 and {r["n"] for r in got.select("n").distinct().collect()} == {51}
    assert got.where("vec_id is null").count() == 5
    for rows in ([], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(20)], odd[:1]):
        none = whitening.whiten(table(spark, rows))
        assert none.count() == 0 and none.columns[:3] == ["vec_id", "component", "n"]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(table(spark, [(1, [1e18, 1.0]), (2, [1.0, 2.0])])).count()


def test_bidiagonal_recurrence(spark):
    """X V = U B with orthonormal columns on both sides."""
    rng = np.random.default_rng(8)
    X = rng.normal(size=(40, 6))
    frame = spark.createDataFrame([(X[i:i + 10].astype("<f8").tobytes(),) for i in range(0, 40, 10)], "x binary")
    run = whitening.Bidiagonalisation(frame, 6)
    V, sigma = run.run(6)
    U = X @ run.W
    B = np.diag(run.alpha) + np.diag(run.beta[:5], 1)
    assert np.abs(U.T @ U - np.eye(6)).max() < 1e-13 and np.abs(run.V.T @ run.V - np.eye(6)).max() < 1e-13
    assert np.abs(X @ run.V - U @ B).max() < 1e-12
    assert np.allclose(sigma, np.linalg.svd(X)[1], rtol=1e-13)
