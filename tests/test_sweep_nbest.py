"""Sweeps and answer lists that choose inside a window's row give what all its pairs would give."""

import pytest
from pyspark.sql import functions as F

from spanlake.config import WindowConfig
from spanlake.operators import decode as D
from spanlake.operators.scoring import lexical_logits

CFG = WindowConfig(24, 6, 3)


@pytest.fixture(scope="module")
def rows(spark):
    text = " ".join(f"w{i % 7} x{i}" for i in range(40))
    data = [(1, text, "w1 W2 x3"), (2, "  a  b a b ", "a b"), (3, None, "q"), (4, "", "q r"), (5, "lone", None), (6, " ".join(["z"] * 30), "z"),
            (7, text, "w1"), (7, text, "w1"), (7, "other text of id seven", "text"), (-8, text + " İstanbul ΣΣ", "σς x9"), (None, text, "w3")]
    return spark.createDataFrame(data, "id long, context string, question string")


def test_sweep_equals_one_point_at_a_time(rows):
    grid = [(2, 5), (20, 1), (20, 5), (5, 30), (20, 30)]
    swept = {(r["n_best"], r["max_len"], r["id"]): (r["score"], r["prediction"]) for r in D.sweep_best(D.window_topk(lexical_logits(rows, CFG), 20), grid).collect()}
    one = {}
    for n, m in grid:
        best = D.best_spans(D.window_best(D.window_topk(lexical_logits(rows, CFG), n), m))
        one |= {(n, m, r["id"]): (None if r["score"] is None else float(r["score"]), r["text"]) for r in best.collect()}
    assert swept == one and len(one) > 20


def test_scores_of_any_kind_pair_by_rank(spark):
    inf = float("inf")
    lg = spark.createDataFrame([(1, 0, p, s, e, True, p, p + 1, "t", "t") for p, (s, e) in enumerate([(-inf, 0.5), (-inf, -inf), (-inf, 0.25)])],
                               "id long, feature_idx int, pos int, start_logit double, end_logit double, is_context boolean, ts int, te int, tok string, piece string")
    tk = D.window_topk(lg, 3)
    one = D.best_spans(D.window_best(tk, 2)).first()
    r = D.sweep_best(tk, [(3, 2)]).first()
    assert (r["score"], r["prediction"]) == (one["score"], one["text"]) == (-inf, "t")


def test_a_window_gives_as_many_texts_as_a_list_holds(rows):
    tk = D.window_topk(lexical_logits(rows, CFG), 20)
    every, cut = D.span_candidates(tk, 10), D.span_candidates(tk, 10, n_texts=3)
    assert cut.groupBy("id", "feature_idx").count().agg(F.max("count")).first()[0] == 3
    assert every.count() > 5 * cut.count()
    a, b = (sorted(map(str, D.nbest_list(c, 3).collect())) for c in (every, cut))
    assert a == b and a
