"""The operators on vectors, next to brute force and on odd input."""

import numpy as np
import pytest

from rollcall.llm import embedding_dedup, exact_topk

SCHEMA = "vec_id long, embedding array<float>, key string, rep int, cell int"


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(4)
    x = draw.standard_normal((400, 16))
    x[200:300] = x[0] + 0.1 * draw.standard_normal((100, 16))
    x[300:320] = x[7]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, [float(np.float32(v)) for v in r], "k", 1, 2) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA), np.float32(x).astype(np.float64)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
        (6, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (9, [1e30, 2e30]), (None, [3.0, -1.0]), (20, [-1.0, 0.5]),
    ]
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


@pytest.mark.parametrize("cell", [768, 16])
def test_links_equal_brute_force(vectors, cell):
    df, x = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(df, cell=cell).collect()}
    links = np.array([got[k].n_links for k in range(len(x))])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.99 * close.sum()
    assert {got[k].component_id for k in range(300, 320)} == {7}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("common", [0.8, 0.97])
def test_links_around_a_large_mean(spark, common):
    draw = np.random.default_rng(6)
    mean = np.zeros(32)
    mean[0] = np.sqrt(common)

    def at(direction):
        direction[:, 0] = 0
        return mean + np.sqrt(1 - common) * direction / np.linalg.norm(direction, axis=1, keepdims=True)

    a = draw.standard_normal((2500, 32))
    a[:, 0] = 0
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    cosine = 1 - (1 - 0.953) / (1 - common)  # within the rest, for 0.953 as a whole
    v = draw.standard_normal((2500, 32))
    v[:, 0] = 0
    v -= (v * a).sum(1, keepdims=True) * a
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    x = np.float32(np.concatenate([at(a), at(cosine * a + np.sqrt(1 - cosine**2) * v)])).astype(np.float64)
    if common > 0.9:
        x = x[:1000]  # nearly all of them are links
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    links = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(df).collect()}
    assert all(links[k] <= n for k, n in enumerate(close.sum(1)))
    assert sum(links.values()) >= 0.985 * close.sum() > 0


def test_links_odd(odd, spark):
    rows = embedding_dedup.link_vectors(odd).collect()
    assert len(rows) == odd.count()
    of = {r.vec_id: r for r in rows}
    assert all(of[k].n_links == 0 and of[k].kept for k in (0, 1, 2, 3, 4, 5, 8, 20))
    assert of[7].component_id == 6 and of[9].component_id == 6 and of[6].n_links == 3
    assert embedding_dedup.link_vectors(odd.limit(0)).count() == 0


def brute_top(ids, x, queries, k):
    out = set()
    for q in queries:
        i = ids.index(q)
        scores = sorted((-int(x[i] @ x[j]), ids[j]) for j in range(len(ids)) if ids[j] != q)
        out |= {(q, rank, vec, -s) for rank, (s, vec) in enumerate(scores[:k], start=1)}
    return out


@pytest.mark.parametrize("block", [4096, 37])
def test_top_scores_equal_brute_force(vectors, block):
    df, x = vectors
    got = exact_topk.top_scores(df, lambda v: v % 20 == 0, vectors=block, queries=7)
    whole = np.floor(64 * x).astype(np.int64)
    want = brute_top(list(range(len(x))), whole, range(0, len(x), 20), 20)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == want


def test_top_scores_odd(odd, spark):
    got = exact_topk.top_scores(odd.where("vec_id <> 9"), lambda v: v % 20 == 0, k=5).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 20] == [(20, 1, 2), (20, 2, 6), (20, 3, 7), (20, 4, 7)]
    assert exact_topk.top_scores(odd.limit(0), lambda v: v % 20 == 0).count() == 0
