"""Approximate neighbours: recall, order and scores against brute force."""

import numpy as np
import pytest

from quarry.llm import neighbours as nb
from tests.conftest import SF01

SCHEMA = "vec_id long, embedding array<float>"


def _exact(ids, x, query, k):
    s = nb.exact_scores(x, x[query])
    order = np.lexsort((ids, -s))
    order = order[ids[order] != ids[query]][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def _table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], SCHEMA)


def _results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def _recall(got, ids, x, queries, k):
    hit = total = 0
    for q in queries:
        true = _exact(ids, x, q, k)
        mine = got.get(int(ids[q]), [])
        assert mine == sorted(mine, key=lambda p: (-p[1], p[0])) and len({i for i, _ in mine}) == len(mine) == len(true)
        s = dict(zip(ids.tolist(), nb.exact_scores(x, x[q]).tolist()))
        assert all(s[i] == v for i, v in mine)
        hit += len({i for i, _ in true} & {i for i, _ in mine})
        total += len(true)
    return hit / total


def test_recall_on_the_given_vectors(spark):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = v.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = _results(nb.nearest(v, v.where("vec_id % 20 = 0")))
    assert _recall(got, ids, x, np.flatnonzero(ids % 20 == 0), 20) >= 0.9


@pytest.mark.parametrize("norms", ["one", "many"])
def test_recall_on_clustered_vectors_of_any_norm(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 24))[rng.integers(0, 40, 4000)] + 0.25 * rng.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "many":
        x *= rng.lognormal(0, 0.4, (4000, 1))
    x, ids = x.astype(np.float32).astype(np.float64), np.arange(4000)
    df = _table(spark, ids, x)
    got = _results(nb.nearest(df, df.where("vec_id % 20 = 0"), 20))
    assert _recall(got, ids, x, np.flatnonzero(ids % 20 == 0), 20) >= 0.9


def test_copies_ties_and_split_buckets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 8)).astype(np.float32).astype(np.float64)
    x[100:500] = x[100]                                            # a hot vector
    x[500:600] = x[100] + 1e-3 * rng.standard_normal((100, 8)).astype(np.float32)
    x, ids = x.astype(np.float32).astype(np.float64), rng.permutation(2000)[:900]
    df = _table(spark, ids, x)
    monkeypatch.setattr(nb, "GROUP_BYTES", 8 * 8 * 64)
    got = _results(nb.nearest(df, df.where("vec_id % 20 = 0"), 20))
    queries = np.flatnonzero(ids % 20 == 0)
    assert _recall(got, ids, x, queries, 20) >= 0.9
    hot = next(q for q in queries if 100 <= q < 500)
    assert got[int(ids[hot])] == _exact(ids, x, hot, 20)           # equal scores: the smallest ids


def test_few_candidates_and_probes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, ids = rng.standard_normal((300, 6)).astype(np.float32).astype(np.float64), np.arange(300)
    df = _table(spark, ids, x)
    monkeypatch.setattr(nb, "fit_probes", lambda plan, sample, k: nb.probing_sequence(plan.k, 1))
    got = _results(nb.nearest(df, df.where("vec_id % 20 = 0"), 250))
    for q in range(0, 300, 20):                                    # one probe finds too few: all buckets are visited
        assert got[q] == _exact(ids, x, q, 250)
    monkeypatch.setattr(nb, "fit_probes", lambda plan, sample, k: None)
    got = _results(nb.nearest(df, df.where("vec_id % 20 = 0"), 400))
    assert got[20] == _exact(ids, x, 20, 400) and len(got[20]) == 299


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (20, [1.0, 0.0, 0.0]), (21, [2.0, 0.0, 0.0]), (1, [0.5, 0.5]), (8, [-1.0, 0.0]), (40, [3.0, 4.0, 5.0, 6.0]), (60, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {0: [(1, 0.5), (8, -1.0)], 20: [(21, 2.0)]}
    assert _results(nb.nearest(df, df.where("vec_id % 20 = 0"))) == want
    extra = df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("score", "rank", "key", "kind", "part", "query_id", "h1")])
    assert _results(nb.nearest(extra, extra.where("vec_id % 20 = 0"))) == want
    empty = spark.createDataFrame([], SCHEMA)
    out = nb.nearest(empty, empty)
    assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]


def test_probes_follow_the_boundaries():
    sequence = nb.probing_sequence(6, 500)
    sets = [tuple(i for i in row if i < 12) for row in sequence]
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == len(sets) and all(len({min(i, 11 - i) for i in s}) == len(s) for s in sets)
    hashing = nb.Hashing(5, 6, 1.0)
    q = np.random.default_rng(1).standard_normal(5)
    q /= np.linalg.norm(q)
    codes = hashing.probes(q, sequence)
    assert (codes[:, 0] == hashing.rows(q[None])[0]).all()         # a unit vector's own bucket comes first
    assert all(len(set(row.tolist())) == len(row) for row in codes)
