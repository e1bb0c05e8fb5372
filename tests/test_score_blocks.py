"""Stored scores, answer lists and sweeps in blocks of ids give what one row a position gives."""

import pytest
from pyspark.sql import functions as F

from spanlake.config import DecodeConfig, WindowConfig
from spanlake.operators import decode as D
from spanlake.operators import scoring as S
from spanlake.operators.windows import windowed_tokens
from spanlake.plans.composite import lexical_sweep_for
from tests.conftest import SF_SMALL

CFG = WindowConfig(24, 6, 3)


@pytest.fixture(scope="module")
def rows(spark):
    text = " ".join(f"w{i % 7} x{i}" for i in range(40))
    odd = "a b\x1c c  \U0001f600d\u0085e " + text + " İstanbul ΣΑΣ\n"
    data = [(1, text, "w1 W2 x3"), (2, "  a  b a b ", "a b"), (3, None, "q"), (4, "", "q r"), (5, "lone", None), (6, " ".join(["z"] * 30), "z"), (11, text, ""),
            (7, text, "w1"), (7, text, "w1"), (7, "other text of id seven", "text"), (-8, odd, "σας x9 c"), (9, text, " ".join(["x1"] * 17)), (None, text, "w3")]
    return spark.createDataFrame(data + [(100 + i, text, f"w{i % 9} x{i}") for i in range(300)], "id long, context string, question string")


def _same(a, b):
    x, y = (sorted(map(str, d.collect())) for d in (a, b))
    assert x == y and x


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _queries():
    from __spark_entry__ import queries
    return queries()


@pytest.mark.parametrize("logit", ["start_logit", "if(pos % 5 = 0, null, start_logit)",
                                   "case pos % 6 when 0 then double('NaN') when 1 then double('inf') when 2 then -0.0d when 3 then 0.0d when 4 then null else -start_logit / 8 end"])
@pytest.mark.parametrize("masked", [False, True])
def test_stored_scores_meet_tokens_by_key(rows, logit, masked):
    scores = S.lexical_logits(rows, CFG).select("id", "feature_idx", "pos", F.expr(logit).alias("start_logit"), F.expr(f"{logit} + pos").alias("end_logit"))
    scores = scores.where("id is not null and pos % 11 <> 9").repartition(5, "pos")   # not all positions, and no id in one piece
    want = D.window_topk(S.attach_offsets(scores, windowed_tokens(rows, CFG)), 5, masked)
    got = S.aligned_windows(scores, rows, CFG, DecodeConfig(5, 4, masked)).select("id", F.inline("windows"))
    assert got.dtypes == want.dtypes
    _same(got, want)


def test_stored_scores_decode_as_rows(rows):
    scores = S.lexical_logits(rows, CFG).select("id", "feature_idx", "pos", "start_logit", "end_logit").where("id is not null")
    cfg = DecodeConfig(6, 4)
    _same(D.decode_windows(S.aligned_windows(scores, rows, CFG, cfg, "best")), D.decode_spans(S.attach_offsets(scores, windowed_tokens(rows, CFG)), cfg))


def test_no_scored_position_is_shuffled(spark):
    """Scores and texts meet by id; before, every position was shuffled by (id, feature_idx, pos) on both sides."""
    p = _plan(_queries()["model_scorer"](spark, SF_SMALL))
    assert "posexplode" not in p
    assert not [x for x in p.split("\n") if "Exchange" in x and "feature_idx" in x]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_answers_equal_those_of_candidate_rows(rows, k):
    want = D.nbest_list(D.span_candidates(D.window_topk(S.lexical_logits(rows, CFG), 20), 10), k)
    got = S.lexical_answers(rows, CFG, DecodeConfig(20, 10), k).select("id", F.inline("answers"))
    assert got.dtypes == want.dtypes
    _same(got, want)


def test_answers_look_on_until_enough_texts_differ(spark):
    """Most pairs of a window have one of two texts, so the first pairs hold fewer than ``k`` distinct ones."""
    rows = spark.createDataFrame([(1, "z " * 200 + "y", "z"), (2, "z z", "z")], "id long, context string, question string")
    want = D.nbest_list(D.span_candidates(D.window_topk(S.lexical_logits(rows, CFG), 20), 3), 5)
    got = S.lexical_answers(rows, CFG, DecodeConfig(20, 3), 5).select("id", F.inline("answers"))
    _same(got, want)


GRID = [(2, 5), (20, 1), (20, 5), (5, 30), (20, 30), (20, 5)]


def test_a_sweep_in_rows_equals_that_of_windows(rows):
    want = D.sweep_best(D.window_topk(S.lexical_logits(rows, CFG), 20), GRID)
    got = S.lexical_sweep(rows, CFG, DecodeConfig(20, 30), GRID).select("id", F.inline("swept")).where("prediction is not null")
    _same(got.select(want.columns), want)
    assert S.lexical_sweep(rows, CFG, DecodeConfig(20, 30), GRID).select(F.size("swept").alias("n")).distinct().collect() == [(len(set(GRID)),)]


@pytest.mark.parametrize("masked", [False, True])
def test_texts_that_share_an_id_are_swept_together(rows, masked):
    want = D.sweep_best(D.window_topk(S.lexical_logits(rows, CFG, include_special=not masked), 20, masked), GRID).where("id is not null")
    got = lexical_sweep_for(rows, CFG, DecodeConfig(20, 30, masked), GRID).select("id", F.inline("swept")).where("prediction is not null and id is not null")
    _same(got.select(want.columns), want)


def test_answers_and_sweeps_rank_windows_in_blocks(spark):
    assert "posexplode" not in _plan(_queries()["nbest_list"](spark, SF_SMALL))
    p = _plan(_queries()["decode_sweep"](spark, SF_SMALL))
    assert "MapInArrow" in p and p.count("posexplode") == 1   # ids of one text in blocks, ids that texts share by positions
