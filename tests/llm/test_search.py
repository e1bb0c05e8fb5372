"""Operators 1 and 4 against brute force."""

import numpy as np
import pytest

from spanlake.llm import pivots, projections, search


def table(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v], 3.5) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def brute(x, ids, q, k, scores):
    out = {}
    for a in q:
        order = sorted((-s, b) for b, s in zip(ids, scores(a), strict=True) if b != ids[a])[:k]
        out[int(ids[a])] = [(int(b), -s) for s, b in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.fixture(scope="module")
def points():
    g = np.random.default_rng(7)
    centre = g.standard_normal((12, 16))
    x = centre[g.integers(0, 12, 1500)] + 0.7 * g.standard_normal((1500, 16))
    x[200:700] = x[3]     # a third of the rows are one vector
    x[900:910] *= 3
    return x.astype(np.float32).astype(np.float64)


def test_projections_reach_recall(spark, points):
    ids = np.arange(len(points))[::-1] * 2
    df = table(spark, points, ids)
    got = found(projections.nearest(df, df.where("vec_id % 50 = 0")))
    q = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    want = brute(points, ids, q, 20, lambda a: projections.inner(points[a:a + 1], points)[0])
    hits = [len({b for b, _ in got[i]} & {b for b, _ in want[i]}) / 20 for i in want]
    assert set(got) == set(want) and np.mean(hits) >= 0.9
    pos = {int(v): i for i, v in enumerate(ids)}
    for i, rows in got.items():
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(s == projections.inner(points[pos[i]][None], points[pos[b]][None])[0, 0] for b, s in rows)


def test_pivots_are_exact(spark, points):
    ids = np.arange(len(points)) * 3
    df = table(spark, points, ids)
    w = np.floor(64 * points)
    q = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    assert found(pivots.top_products(df, df.where("vec_id % 50 = 0"))) == brute(w, ids, q, 20, lambda a: (w @ w[a]).astype(int))


def test_large_components_stay_exact(spark):
    g = np.random.default_rng(2)
    x = g.integers(-2**21, 2**21, (60, 8)).astype(float)
    df = table(spark, x)
    w = (x * 64).astype(np.int64)
    assert found(pivots.top_products(df, df, k=5)) == brute(w, np.arange(60), range(60), 5, lambda a: w @ w[a])


@pytest.mark.parametrize("run,zero", [(projections.nearest, False), (pivots.top_products, True)])
def test_edges(spark, run, zero):
    v = [[1, 0], [0.5, 0.5], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [], [1, 2, 3][:2], [1, 0]]
    df = table(spark, v)
    got = found(run(df, df))
    taking = {0, 1, 8, 9} | ({3} if zero else set())
    assert set(got) == taking and all({b for b, _ in rows} == taking - {i} for i, rows in got.items())
    assert [b for b, _ in got[8]][:2] == [1, 0]      # 1.5, then 1 and 1: the smaller id first
    again = found(run(df.unionByName(df), df))
    assert again == got                              # repeated rows count once
    assert run(df.limit(0), df.limit(0)).count() == 0
    assert run(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    assert run(df, df).columns == ["query_id", "rank", "vec_id", "score"]


def test_chi_square_law():
    x = np.random.default_rng(1).chisquare(projections.DIMS, 200_000)
    assert abs((x <= projections.reach()).mean() - projections.CONFIDENCE) < 0.002
    assert search.rows_per_block(10) == 512 and search.rows_per_block(10**9) == 8192


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e15])
def test_closest_is_exact_where_all_is_admitted(scale):
    """Rounding in single precision leaves out no pair, however many products tie or differ by little; large blocks are met in few steps."""
    g = np.random.default_rng(4)
    x = g.standard_normal((5000, 16))
    x[1000:2500] = x[7]                                                    # more copies than anyone asks for
    x[3000:3400] = x[8] * (1 + 1e-12 * g.standard_normal((400, 1)))        # products that single precision cannot tell apart
    x *= scale
    ids = g.permutation(5000) // 2                                         # every id twice
    rows = np.r_[0:40, 1000:1010, 3000:3010]
    qx, qid = x[rows], ids[rows]
    kept = projections.first_copies(x, ids, 20)
    assert len(kept) < 3600
    row, found, score = projections.closest(qx, qid, x[kept], ids[kept], np.zeros(len(kept), int), lambda part: np.ones((len(qx[part]), 1), bool), np.full(len(qx), -np.inf), 20)
    every = projections.inner(qx, x)
    for i in range(len(qx)):
        order = np.lexsort((ids, -every[i]))
        want = [(ids[j], every[i, j]) for j in order if ids[j] != qid[i]][:20]
        assert list(zip(found[row == i].tolist(), score[row == i].tolist())) == want


def test_vectors_travel_in_few_copies(spark, points):
    """Whatever the number of queries up to a block, a cell's vectors are sent to one task, as they are stored."""
    sent = []
    plain = search.blocked_search

    def seen(data, queries, counts, asked, block, *more, **kw):
        sent.append((data.schema["vec"].dataType.simpleString(), sum(-(-asked[c] // more[2]) for c in asked if c in counts) / len(asked)))
        return plain(data, queries, counts, asked, block, *more, **kw)

    df = table(spark, points)
    search.blocked_search = seen
    try:
        assert projections.nearest(df, df).count() == 20 * len(points)
    finally:
        search.blocked_search = plain
    assert sent == [("array<float>", 1.0)] * 2
