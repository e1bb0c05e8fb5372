"""Scoring and ranking in blocks of ids gives what one row a token gives, and no token becomes a row."""

import pytest
from pyspark.sql import functions as F

from spanlake.config import DecodeConfig, WindowConfig
from spanlake.operators import decode as D
from spanlake.operators import ensemble as E
from spanlake.operators import scoring as S
from spanlake.plans import queries_eval as Q
from tests.conftest import SF_SMALL

CFG = WindowConfig(24, 6, 3)


@pytest.fixture(scope="module")
def rows(spark):
    text = " ".join(f"w{i % 7} x{i}" for i in range(40))
    odd = "a b\x1c c  \U0001f600d\u0085e " + text + " İstanbul ΣΑΣ\n"
    data = [(1, text, "w1 W2 x3"), (2, "  a  b a b ", "a b"), (3, None, "q"), (4, "", "q r"), (5, "lone", None), (6, " ".join(["z"] * 30), "z"), (11, text, ""),
            (7, text, "w1"), (7, text, "w1"), (7, "other text of id seven", "text"), (-8, odd, "σας x9 c"), (9, text, " ".join(["x1"] * 17)), (None, text, "w3")]
    return spark.createDataFrame(data + [(100 + i, text, f"w{i % 9} x{i}") for i in range(300)], "id long, context string, question string")


def _same(a, b):
    x, y = (sorted(map(str, d.collect())) for d in (a, b))
    assert x == y and x


@pytest.mark.parametrize("masked", [False, True])
def test_ranked_windows_equal_those_of_token_rows(rows, masked):
    want = D.window_topk(S.lexical_logits(rows, CFG, include_special=not masked), 5, masked)
    got = S.lexical_windows(rows, CFG, DecodeConfig(5, 4, masked)).select("id", F.inline("windows"))
    assert got.dtypes == want.dtypes
    _same(got, want)


def test_pairs_equal_those_of_token_rows(rows):
    want = D.span_candidates(D.window_topk(S.lexical_logits(rows, CFG), 6), 4)
    got = D.span_candidates(S.lexical_windows(rows, CFG, DecodeConfig(6, 4), "every").select("id", F.inline("windows")), 4)
    assert got.dtypes == want.dtypes
    _same(got, want)


def test_spans_equal_those_of_token_rows(rows):
    cfg = DecodeConfig(6, 4)
    _same(D.decode_windows(S.lexical_windows(rows, CFG, cfg, "best")), D.decode_spans(S.lexical_logits(rows, CFG), cfg))


def test_ids_that_are_no_numbers(rows):
    named = rows.withColumn("id", F.concat(F.lit("n"), F.col("id").cast("string")))
    _same(D.decode_windows(S.lexical_windows(named, CFG, DecodeConfig(6), "best")), D.decode_spans(S.lexical_logits(named, CFG), DecodeConfig(6)))


def test_members_average_in_blocks_as_in_rows(rows):
    m = S.lexical_logits(rows, CFG).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(Q.N_AVG - 1).cast("bigint"))).alias("member"))
    m = m.withColumns({"start_logit": F.expr("start_logit + ((pos * (member + 3) + feature_idx * 7 + member) % 11) * 100"),
                       "end_logit": F.expr("end_logit + ((pos * (member + 5) + feature_idx * 11 + member) % 13) * 100")})
    got = S.lexical_windows(rows, CFG, DecodeConfig(5), through=(Q._member_logits, E.logit_average))
    _same(got.select("id", F.inline("windows")), D.window_topk(E.logit_average(m), 5))


@pytest.mark.parametrize("name", ["best_span", "span_candidates", "top_positions", "logit_average", "two_level_vote", "valid_fold_eval"])
def test_no_token_becomes_a_row(spark, name):
    from __spark_entry__ import queries
    plan = queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan
