"""Steps that must stay linear in a row's text, and streams over a table that is a folder of files."""

import pytest
from pyspark.sql import functions as F

from spanlake.config import WindowConfig
from spanlake.functions.text import TOKEN_PIECE
from spanlake.operators import augment as AU
from spanlake.operators import windows as WI
from spanlake.plans import fixtures as X
from tests.conftest import SF_SMALL


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pushed_filters_do_not_cut_texts_again(spark):
    """A pushed filter asks for an example's answer once; windows cut a text once for the example and once to count its tokens."""
    qa = X.qa(spark, SF_SMALL)
    assert _optimized(qa.where("contains(context, answer_text)").select("id")).count(TOKEN_PIECE) <= 2
    assert _optimized(WI.window_spans(qa, WindowConfig(64, 16))).count("regexp_extract_all(text#") <= 2


def test_sequences_cut_a_text_once_not_once_a_window(spark):
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500)), "w1 w2"), (2, None, "q"), (3, "", "")], "id long, context string, question string")
    out = WI.sequence_arrays(rows, WindowConfig(64, 16))
    plan = _optimized(out)
    above = plan[:plan.index("Generate")]
    assert "regexp_extract_all(context" not in above
    got = {(r["id"], r["feature_idx"]): r for r in out.collect()}
    assert got[1, 1]["tokens"][4:6] == ["w43", "w44"] and len(got[1, 1]["tokens"]) == 64
    assert got[2, 0]["tokens"] is None and got[3, 0]["tokens"][:3] == ["<s>", "</s>", "</s>"]


@pytest.mark.parametrize("name", ["stream_align", "stream_decode", "stream_meter", "stream_meter_windows"])
def test_streams_read_a_folder_of_files(spark, tmp_path, name):
    from __spark_entry__ import queries
    for table in ("documents", "events"):
        spark.read.parquet(f"{SF_SMALL}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    one, many = (sorted(map(str, queries()[name](spark, d).collect())) for d in (SF_SMALL, str(tmp_path)))
    assert one == many and one


def test_log_sum_exp_takes_its_maximum_once(spark):
    from spanlake.operators.losses import softmax, window_score_stats
    rows = spark.createDataFrame([(1, 0, p, 1000.0 * p, -1000.0 * p, True, p, p + 1) for p in range(5)],
                                 "id long, feature_idx int, pos int, start_logit double, end_logit double, is_context boolean, ts int, te int")
    stats = window_score_stats(rows)
    assert _optimized(stats).count("array_max(transform(_a") <= 4
    r = stats.first()
    assert abs(r["lse_s"] - 4.451914) < 1e-6 and (r["arg_s"], r["arg_e"]) == (4, 0)
    p = spark.range(1).select(softmax(F.array(F.lit(0.0), F.lit(1.0))).alias("p")).first()["p"]
    assert abs(sum(p) - 1) < 1e-12 and abs(p[1] - 0.7310585786) < 1e-9


def test_synonyms_are_put_in_inside_the_row(spark):
    """Words leave their text's row only as distinct candidates; rows that repeat an id share their words, a null id has none."""
    syn = spark.createDataFrame([("a", "x"), ("c", "p q"), ("the", "no")], "word string, synonym string")
    stop = spark.createDataFrame([("the",)], "word string")
    rows = [(1, " A b\ta  the c"), (2, None), (2, ""), (3, "c d"), (3, "b"), (None, "a")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3, "id")
    out = AU.synonym_replacement(docs, syn, stop, 3, 7)
    assert "posexplode" not in _optimized(out)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(1, "x b x the p q", 3), (2, "", 0), (2, "", 0), (3, "b p q d", 1), (3, "b p q d", 1), (None, "", 0)], key=repr)
