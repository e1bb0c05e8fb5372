"""Layers 2 and 3: properties and defect regressions on hand-written rows (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from spanlake.config import DecodeConfig, WindowConfig
from spanlake.functions.text import jaccard
from spanlake.operators import align as A
from spanlake.operators import augment as AU
from spanlake.operators import decode as D
from spanlake.operators import ensemble as E
from spanlake.operators import folds as FO
from spanlake.operators import losses as L
from spanlake.operators import metrics as M
from spanlake.operators import runs as R
from spanlake.operators.scoring import lexical_logits
from spanlake.operators.tokens import longest_first, tokenize
from spanlake.operators.windows import label_windows, sequence_arrays, window_labels, window_spans, windowed_tokens
from spanlake.plans import fixtures as X


def _jac(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    return df.select(jaccard("a", "b").alias("j")).first()["j"]


def test_jaccard_edges(spark):
    assert _jac(spark, "", " ") is None          # blank vs blank: 0/0 -> NULL
    assert _jac(spark, "", "a") == 0.0
    assert _jac(spark, "A b", "a B") == 1.0      # case-insensitive
    assert _jac(spark, "a b", "b c") == 1 / 3
    assert _jac(spark, "a\u00a0b", "a b") == 1.0  # NBSP separates words like str.split()


def test_jaccard_symmetric_and_bounded(spark):
    pairs = [("x y z", "y"), ("one two", "two three four"), ("a a a", "a")]
    for a, b in pairs:
        j1, j2 = _jac(spark, a, b), _jac(spark, b, a)
        assert j1 == j2 and 0.0 <= j1 <= 1.0
    assert _jac(spark, "q w e", "q w e") == 1.0


def test_occurrences(spark):
    df = spark.createDataFrame([(1, "ab.ab.x ab", "ab"), (2, "aaa", "aa"), (3, "abc", ""), (4, "abc", "z")],
                               "id long, context string, answer_text string")
    out = {r["id"]: r["answer_start_list"] for r in A.all_occurrences(df).collect()}
    assert out == {1: [0, 3, 8], 2: [0], 3: [], 4: []}


def test_repair_guards_negative_slices(spark):
    df = spark.createDataFrame([(1, "xab", "ab", 1), (2, "ab", "ab", 1), (3, "ab", "ab", 0), (4, "ba", "ab", 0)],
                               "id long, context string, answer_text string, claimed_start long")
    out = {r["id"]: (r["answer_start"], r["repair"]) for r in A.repair_answer_offsets(df).collect()}
    assert out == {1: (1, "exact"), 2: (0, "off_by_1"), 3: (0, "exact"), 4: (None, "unmatched")}


def test_token_offsets_code_points(spark):
    df = spark.createDataFrame([(1, "a\U0001F600b  cd\te")], "id long, context string")
    rows = sorted((r["pos"], r["tok"], r["ts"], r["te"]) for r in tokenize(df).collect())
    assert rows == [(0, "a\U0001F600b", 0, 3), (1, "cd", 5, 7), (2, "e", 8, 9)]
    text = "a\U0001F600b  cd\te"
    assert all(text[ts:te] == tok for _, tok, ts, te in rows)


def test_window_geometry(spark):
    # capacity = 16 - 3 - 1 = 12, step = 12 - 4 = 8 -> windows at 0, 8, 16 for 25 tokens
    ctx = " ".join(f"w{i}" for i in range(25))
    ex = spark.createDataFrame([(1, ctx, "q")], "id long, context string, question string")
    spans = sorted((r["feature_idx"], r["first_pos"], r["last_pos"])
                   for r in window_spans(ex, WindowConfig(16, 4, 3)).collect())
    assert spans == [(0, 0, 11), (1, 8, 19), (2, 16, 24)]
    # consecutive windows share exactly `stride` tokens, every token is covered
    assert spans[0][2] - spans[1][1] + 1 == 4


def test_label_at_last_context_token(spark):
    """An answer starting at the last context token labels that token, not padding."""
    ex = spark.createDataFrame([(1, "a b c", "q", 4, 5)],
                               "id long, context string, question string, start_char long, end_char long")
    wt = windowed_tokens(ex, WindowConfig(16, 4, 3), keep=("start_char", "end_char"))
    lab = window_labels(wt).first()
    # sequence: CLS q SEP a b c -> c is at position 5
    assert (lab["start_position"], lab["end_position"]) == (5, 5)


def test_label_outside_window_is_cls(spark):
    ctx = " ".join(f"w{i}" for i in range(30))
    start = ctx.index("w25")
    ex = spark.createDataFrame([(1, ctx, "q", start, start + 3)],
                               "id long, context string, question string, start_char long, end_char long")
    wt = windowed_tokens(ex, WindowConfig(16, 4, 3), keep=("start_char", "end_char"))
    labels = {r["feature_idx"]: (r["start_position"], r["end_position"]) for r in window_labels(wt).collect()}
    assert labels[0] == (0, 0)
    assert any(v != (0, 0) for v in labels.values())


def test_no_valid_candidate_gives_empty_prediction(spark):
    # one context token, max answer length 0 -> no candidate -> '' and 0.0
    ex = spark.createDataFrame([(7, "alpha", "beta")], "id long, context string, question string")
    lg = lexical_logits(ex, WindowConfig(16, 4, 3))
    preds = D.decode_spans(lg, DecodeConfig(n_best=5, max_answer_len=0))
    out = D.with_predictions(ex, preds).first()
    assert (out["prediction"], out["score"]) == ("", 0.0)


def test_decode_prediction_is_substring_and_bounded(spark):
    ctx = "the quick brown fox jumps over the lazy dog near the river bank today"
    ex = spark.createDataFrame([(3, ctx, "fox jumps over")], "id long, context string, question string")
    lg = lexical_logits(ex, WindowConfig(32, 8, 3))
    small = D.with_predictions(ex, D.decode_spans(lg, DecodeConfig(n_best=5, max_answer_len=4))).first()
    large = D.with_predictions(ex, D.decode_spans(lg, DecodeConfig(n_best=20, max_answer_len=4))).first()
    assert small["prediction"] in ctx and len(small["prediction"].split()) <= 4
    assert large["score"] >= small["score"]


def test_meter_seeded_bounds(spark):
    df = spark.createDataFrame([("k", 1, -1.0, 1), ("k", 2, -2.0, 1)], "key string, seq long, val double, n long")
    r = M.meter(df, "key", "seq").first()
    assert (r["max"], r["min"], r["last"], r["avg"]) == (0.0, -2.0, -2.0, -1.5)


def test_running_meter_last_row_equals_batch(spark):
    rows = [("k", i, float(i % 7) - 2.5, 1 + i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, seq long, val double, n long")
    run = M.running_meter(df, "key", "seq", bucket_width=8).orderBy(F.desc("seq")).first()
    bat = M.meter(df, "key", "seq").first()
    assert (run["avg"], run["max"], run["min"]) == (bat["avg"], bat["max"], bat["min"])


def test_early_stop_first_epoch_zero(spark):
    """0.0, 0.0, 0.0 with patience 2 stops at the second non-improving epoch."""
    h = spark.createDataFrame([("r", 0, 0.0), ("r", 1, 0.0), ("r", 2, 0.0)], "run string, epoch int, jaccard double")
    r = R.early_stop(h, 2).first()
    assert (r["stop_epoch"], r["best_epoch"]) == (1, None)


def test_votes(spark):
    unanimous = spark.createDataFrame([(1, m, "x") for m in range(5)], "id long, member int, text string")
    assert [tuple(r) for r in E.hard_vote(unanimous).collect()] == [(1, "x", 5)]
    tie = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "id long, member int, text string")
    assert E.hard_vote(tie).first()["text"] == "b"  # tie -> the earliest member's answer
    perm = spark.createDataFrame([(1, 4, "a"), (1, 0, "a"), (1, 2, "a"), (1, 1, "b")], "id long, member int, text string")
    assert E.hard_vote(perm).first()["text"] == "a"


def test_folds_balanced_and_stable(spark):
    rows = [(i, "hi" if i % 3 else "ta") for i in range(203)]
    df = spark.createDataFrame(rows, "id long, language string")
    f1 = FO.stratified_kfold(df, 5)
    sizes = f1.groupBy("language", "kfold").count().collect()
    for lang in ("hi", "ta"):
        c = [r["count"] for r in sizes if r["language"] == lang]
        assert max(c) - min(c) <= 1
    f2 = FO.stratified_kfold(df.repartition(7), 5)
    assert sorted(map(tuple, f1.collect())) == sorted(map(tuple, f2.collect()))


def test_global_rank_matches_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 3000).withColumn("g", (F.col("id") % 3).cast("string")).withColumn("k", F.md5(F.col("id").cast("string")))
    r = FO.global_rank(df, [F.col("k"), F.col("id")], ["g"], out="rk", bucket_digits=2)
    ref = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    bad = r.join(ref, ["id", "g", "k"]).where(F.col("rk") != F.col("rk2")).count()
    assert bad == 0


def test_hard_negatives_keep_exactly_the_right_rows(spark):
    n = 300_000
    df = (spark.range(0, n, numPartitions=7).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
          .withColumn("s", F.floor(F.col("id") * 7919 % 5003 / 3).cast("double")).withColumn("other", F.md5(F.col("id").cast("string"))))
    out = L.hard_negatives(df, F.col("y") == 1, "s", 2.5, "id")
    assert out.where("kept and y = 0").count() == 75_000 and out.where("y = 1 and not kept").count() == 0
    worst = out.where("kept and y = 0").agg(F.min("s")).first()[0]
    assert out.where((F.col("y") == 0) & ~F.col("kept") & (F.col("s") > worst)).count() == 0
    tie = out.where((F.col("y") == 0) & (F.col("s") == worst))
    assert tie.where("kept").agg(F.max("id")).first()[0] < tie.where("not kept").agg(F.min("id")).first()[0]


def test_hard_negatives_few_rows(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.1), (3, 0, 0.1), (4, 0, None), (5, None, 0.9)], "id long, y int, s double")
    out = {r["id"]: r["kept"] for r in L.hard_negatives(df, F.col("y") == 1, "s", 2.0, "id").collect()}
    assert out == {1: True, 2: True, 3: False, 4: False, 5: True}
    by = L.hard_negatives_by_class(spark.createDataFrame([(1, 0, [2.0, 0.0]), (2, 1, [3.0, 0.0]), (3, 1, [1.0, 0.0]), (4, 1, [0.0, 1.0])],
                                                         "id long, label int, x array<double>"), "x", "label", 2, 2.0, "id")
    assert {r["id"]: (r["kept_0"], r["kept_1"]) for r in by.collect()} == {1: (True, False), 2: (True, True), 3: (False, True), 4: (False, True)}


def test_dice_multiclass_keeps_equal_rows(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0), ([1.0, 0.0], 0), ([0.0, 2.0], 1)], "x array<double>, y int")
    out = [r["loss"] for r in L.dice_multiclass(df, "x", "y", 2).orderBy("y").collect()]
    assert len(out) == 3 and out[0] == out[1]
    masked = L.dice_multiclass(df.withColumn("m", F.col("y") * 0), "x", "y", 2, alpha=1.0, square=True, mask="m").collect()
    assert all(abs(r["loss"]) < 1e-9 for r in masked)


def test_null_strata_and_keys_stay(spark):
    df = spark.range(0, 20).select(F.col("id"), F.when(F.col("id") % 4 != 0, F.lit("x")).alias("language"))
    assert FO.stratified_kfold(df, 5).count() == 20
    m = spark.createDataFrame([("a", 1, 2.0, 1), (None, 2, 3.0, 1)], "k string, seq long, val double, n int")
    assert M.running_meter(m, "k", "seq").count() == 2


def test_no_window_when_the_question_leaves_no_room(spark):
    ex = spark.createDataFrame([(1, " ".join(["q"] * 60), "a b c")], "id long, question string, context string")
    cfg = WindowConfig(max_len=64, stride=16)
    assert window_spans(ex, cfg).count() == 0 and sequence_arrays(ex, cfg).count() == 0


def test_occurrences_take_any_character_literally(spark):
    df = spark.createDataFrame([(1, "x\u0001ab y", "ab"), (2, "a\\Eb a\\Eb", "a\\Eb"), (3, "a.b axb", "a.b"), (1, "ab", "ab")],
                               "id long, context string, answer_text string")
    out = sorted((r["id"], r["answer_start_list"]) for r in A.all_occurrences(df).collect())
    assert out == [(1, [0]), (1, [2]), (2, [0, 5]), (3, [0])]


def test_back_translation_chooses_one_language(spark):
    ex = spark.createDataFrame([(1, "c", "q", "a")], "id long, context string, question string, answer_text string")
    mem = spark.createDataFrame([(1, f, v, f + v) for f in ("context", "question", "answer") for v in ("de", "fr")],
                                "id long, field string, via_lang string, back_text string")
    out = AU.back_translate(ex, mem, 100, 1).collect()
    assert len(out) == 1 and {out[0][c][-2:] for c in ("context", "question", "answer_text")} == {out[0]["via_lang"]}


def test_null_score_of_an_empty_context(spark):
    ex = spark.createDataFrame([(1, "a b", ""), (2, "a", "x a")], "id long, question string, context string")
    out = D.null_score(lexical_logits(ex, WindowConfig(max_len=64, stride=16))).collect()
    assert {r["id"] for r in out} == {1, 2}


def test_repeated_ids_keep_their_own_offsets(spark):
    rows = tokenize(spark.createDataFrame([(1, "aa b"), (1, "c dd")], "id long, context string")).collect()
    assert sorted((r["tok"], r["ts"], r["te"]) for r in rows) == [("aa", 0, 2), ("b", 3, 4), ("c", 0, 1), ("dd", 2, 4)]


def test_contains_join_matches_brute_force(spark):
    docs = [(1, "the red fox ran far"), (2, "red fox"), (3, "a fox"), (4, None), (5, "")]
    pas = [(1, "the red fox"), (2, "fox"), (3, "re"), (4, "red fox"), (5, "x"), (6, "no such text here"), (7, "")]
    out = X.contains_join(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(pas, "item_id long, btext string"))
    want = sorted((d, p) for d, t in docs for p, b in pas if t is not None and b in t)
    assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == want


def test_longest_first_ties(spark):
    df = spark.createDataFrame([(1, "a b c d e", "v w x y z"), (2, "a b", "v w x y z q r s t")],
                               "id long, context string, question string")
    out = {r["id"]: (r["a_kept"], r["b_kept"]) for r in longest_first(df, 9, n_special=3).collect()}
    assert out == {1: (3, 3), 2: (2, 4)}


def test_question_trim_unicode(spark):
    df = spark.createDataFrame([(1, "\t  q x")], "id long, question string")
    assert A.trim_question(df).first()["question"] == "q x"


def test_contains_join_on_tables_matches_brute_force(spark):
    from spanlake.plans.fixtures import contains_join
    from spanlake.sources.tables import table
    from tests.conftest import SF_SMALL
    d = table(spark, SF_SMALL, "documents").select("doc_id", "lang", "text")
    b = table(spark, SF_SMALL, "benchmark").select("item_id", F.col("text").alias("btext"))
    extra = spark.createDataFrame([(900001, "a"), (900002, "the the")], "item_id long, btext string")
    b = b.unionByName(extra)
    fast = {(r["doc_id"], r["item_id"]) for r in contains_join(d, b).select("doc_id", "item_id").collect()}
    texts, passages = d.select("doc_id", "text").collect(), b.collect()
    exact = {(r["doc_id"], p["item_id"]) for r in texts for p in passages if p["btext"] in r["text"]}
    assert fast == exact and len(fast) > 0


def test_answer_straddling_two_windows_is_cls_in_both(spark):
    # capacity 12, stride 4 -> windows [0,12) and [8,20); an answer over tokens 6..13 fits neither
    ctx = " ".join(f"w{i:02d}" for i in range(20))
    start, end = ctx.index("w06"), ctx.index("w13") + 3
    ex = spark.createDataFrame([(1, ctx, "q", start, end)],
                               "id long, context string, question string, start_char long, end_char long")
    wt = windowed_tokens(ex, WindowConfig(16, 4, 3), keep=("start_char", "end_char"))
    labels = {r["feature_idx"]: (r["start_position"], r["end_position"]) for r in window_labels(wt).collect()}
    assert labels == {0: (0, 0), 1: (0, 0)}


def test_short_answers_are_covered_and_labelled_spans_contain_them(spark):
    """Every answer of at most `stride` tokens is covered by some window, and the
    labelled token span's text contains the answer."""
    from tests.conftest import SF_SMALL
    from spanlake.plans import fixtures as X
    cfg = WindowConfig(64, 16, 3)
    ex = X.qa(spark, SF_SMALL).select("id", "context", "question", F.col("answer_start").alias("start_char"),
                                      F.col("answer_end").alias("end_char"), "answer_text")
    wt = windowed_tokens(ex.drop("answer_text"), cfg, keep=("start_char", "end_char"))
    lab = window_labels(wt).where(F.col("start_position") != 0)
    answered = ex.where("start_char is not null")
    assert lab.select("id").distinct().count() == answered.count()
    none = window_labels(wt).join(ex.where("start_char is null"), "id", "left_semi")
    assert none.where("start_position <> 0 or end_position <> 0").count() == 0 and none.count() > 0
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(label_windows(ex, cfg)) == rows(window_labels(wt).select("id", "feature_idx", "start_position", "end_position"))
    toks = wt.select("id", "feature_idx", "pos", "ts", "te")
    spans = (lab.join(toks.withColumnRenamed("pos", "start_position").withColumnRenamed("te", "_te"),
                      ["id", "feature_idx", "start_position"])
             .join(toks.withColumnRenamed("pos", "end_position").withColumnRenamed("ts", "_ts"),
                   ["id", "feature_idx", "end_position"])
             .join(ex.select("id", "context", "answer_text"), "id"))
    bad = spans.where(~F.substr("context", F.col("ts") + 1, F.col("te") - F.col("ts")).contains(F.col("answer_text")))
    assert bad.count() == 0


def test_stream_meter_equals_batch(spark):
    from tests.conftest import SF_SMALL
    from spanlake.sources.tables import table
    from spanlake.streaming import meter as ST
    streamed = ST.run_complete_to_table(ST.stream_meter(ST.file_stream(spark, SF_SMALL, "events")), spark, "t-meter")
    batch = ST.stream_meter(table(spark, SF_SMALL, "events"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_window_meter_over_several_batches(spark, tmp_path):
    """A row behind the watermark is left out, one within it counts; a second run goes on from the first one's progress."""
    from spanlake.streaming import meter as ST
    schema = "event_type string, ts timestamp, event_id long, val double, n long"
    parts = [[("a", "2024-01-01 10:00:00", 1, 2.0, 1), ("b", "2024-01-01 11:00:00", 2, 5.0, 2), (None, "2024-01-01 12:00:00", 3, 1.0, 1)],
             [("a", "2024-01-01 01:00:00", 4, -3.0, 3), ("a", "2024-01-09 10:00:00", 5, 7.0, 1), ("a", None, 6, 9.0, 1)],
             [("a", "2024-01-01 23:00:00", 7, 100.0, 1), ("b", "2024-01-09 02:00:00", 8, 4.0, 1)]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        return ST.latest_rows(ST.run_each_batch(ST.stream_window_meter(stream), spark, out, mode="update"), ["window", "event_type"])

    arrive(parts[0])
    assert run().count() == 3
    arrive(parts[1])
    run()
    arrive(parts[2])
    got = run()
    in_time = spark.createDataFrame([r for p in parts for r in p if r[2] != 7], schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    want = ST.stream_window_meter(in_time)
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert got.where("event_type = 'a' and last = -3.0 and count = 4").count() == 1


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    import shutil
    from spanlake.plans.composite import lexical_predictions
    from spanlake.streaming import meter as ST
    from tests.conftest import SF_SMALL
    out, other = str(tmp_path / "out"), str(tmp_path / "other")
    decode = lambda batch: lexical_predictions(X.qa_from_documents(batch.where("doc_id < 20")), WindowConfig(), DecodeConfig())
    docs = ST.file_stream(spark, SF_SMALL, "documents")
    first = sorted(map(tuple, ST.run_each_batch(docs, spark, out, decode).collect()))
    # as if the session had ended after the write and before the commit
    shutil.copytree(out, other, ignore=shutil.ignore_patterns("commits"))
    again = sorted(map(tuple, ST.run_each_batch(docs, spark, other, decode).collect()))
    batch = sorted(map(tuple, decode(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()))
    assert first == again and [r[:-1] for r in first] == batch and len(batch) == 20


def test_unique_ids_are_required_or_made(spark):
    import pytest
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "id long, v long")
    assert sorted((r["id"], r["v"]) for r in FO.first_by_id(df, ["v"]).collect()) == [(1, 1), (2, 5)]
    assert FO.require_unique_ids(df.where("v <> 2")).count() == 2
    with pytest.raises(Exception, match="repeated id: 1"):
        FO.require_unique_ids(df).collect()


def test_path_fold_and_progress_line(spark):
    from spanlake.functions.text import fold_of_path, progress_line
    df = spark.createDataFrame([("m/fold12", 1, 50, 1000, 0.25), ("m/", 11, 1000, 1000, 1.5)], "p string, e int, s int, t int, l double")
    out = df.select(fold_of_path("p").alias("f"), progress_line("e", "s", "t", "l").alias("x")).collect()
    assert [r["f"] for r in out] == [12, None]
    assert out[0]["x"] == "Epoch: 01 [  50/1000 (  5%)], Train Loss: 0.25000"


def test_dice_with_logits_and_ignored_labels(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 0)], "p double, y int")
    assert abs(L.dice_binary(df, "p", "y", with_logits=True).first()["loss"] - (1 - 1.0001 / 2.0001)) < 1e-9
    st = spark.createDataFrame([(1, 0, [(0, 1.0, 2.0)], 1.5, 2.5, 0, 0), (2, 0, [(0, 1.0, 2.0)], 1.5, 2.5, 7, 0)],
                               "id long, feature_idx int, _a array<struct<pos:int,xs:double,xe:double>>, lse_s double, lse_e double, start_position int, end_position int")
    out = {r["id"]: (r["ce_s"], r["ce_e"]) for r in L.span_cross_entropy(st).collect()}
    assert out == {1: (0.5, 0.5), 2: (None, 0.5)}
    assert L.span_cross_entropy(st, ignore_index=0).where("ce_e is not null").count() == 0


# --- row-local pass, exact selection, occurrences ----------------------------------

def test_repeated_ids_are_scored_by_themselves(spark):
    rows = [(1, "alpha beta gamma", "beta"), (1, "delta epsilon zeta", "zeta")]
    ex = spark.createDataFrame(rows, "id long, context string, question string")
    lg = lexical_logits(ex, WindowConfig(32, 8, 3)).where("is_context").collect()
    assert len(lg) == 6 and {r["te"] for r in lg} <= {5, 10, 16, 13, 18}
    hits = {r["tok"]: r["start_logit"] // 1000 for r in lg}
    # a word's score counts the question's words in it and behind it, of its own row only
    assert hits == {"alpha": 1, "beta": 1, "gamma": 0, "delta": 1, "epsilon": 1, "zeta": 1}


def test_token_arrays_of_long_and_odd_texts(spark):
    import re
    from spanlake.functions.arrays import SUM_BLOCK
    from spanlake.operators.tokens import with_tokens
    texts = ["", None, "  a\u2003b\n c ", "x " * (3 * SUM_BLOCK + 5), "\u00e9t\u00e9 \U0001f600 z"] + ["w" * (i % 5 + 1) + " y" * i for i in (SUM_BLOCK - 1, SUM_BLOCK, SUM_BLOCK + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, context string")
    want = [(i, k, m[0], m.start(), m.end()) for i, t in enumerate(texts) for k, m in enumerate(re.finditer(r"\S+", t or ""))]
    assert sorted((r["id"], r["pos"], r["tok"], r["ts"], r["te"]) for r in tokenize(df).collect()) == want
    rows = with_tokens(df).orderBy("id").collect()
    assert [(r["id"], k, *x) for r in rows for k, x in enumerate(zip(r["toks"] or [], r["ts"] or [], r["te"] or []))] == want


def test_char_to_token_searches_the_row(spark):
    from spanlake.operators.tokens import char_to_token
    text = "ab  cde f"
    df = spark.createDataFrame([(c, text) for c in [*range(-1, 11), None]] + [(0, ""), (0, None)], "c int, context string").withColumn("n", F.lit(2))
    got = [r["c_token"] for r in char_to_token(df, ["c"], 99).collect()]
    assert got == [99, 0, 0, 99, 99, 1, 1, 1, 99, 2, 99, 99, 99, 99, 99]
    assert [r["c_token"] for r in char_to_token(df, ["c"], 99, kept="n").collect()].count(2) == 0
    assert char_to_token(df, ["c"], 99).columns == ["c", "context", "n", "c_token"]


@pytest.mark.parametrize("kind", ["long", "double", "decimal(20,2)"])
def test_nth_value_is_exact(spark, kind):
    import random
    from decimal import Decimal
    r = random.Random(5)
    inf = float("inf")
    values = {"long": [2**60 + i for i in range(9)] + [-2**63, 2**63 - 1, 0, 0, -1] + [r.randint(-10**18, 10**18) for _ in range(200)],
              "double": [1.0, 2.0, 3.0, 4.0, inf, inf, -inf, 1e308, -1.7e308, 5e-324, 0.0, 1.0000000000000002, 1.0] + [r.gauss(0, 1) for _ in range(200)],
              "decimal(20,2)": [Decimal("123456789012345678.25"), Decimal("123456789012345678.26"), Decimal("-0.01"), Decimal("0.00")] * 3}[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"x {kind}")
    for down in (False, True):
        ranked = sorted(values, reverse=down)
        for n in [1, 2, 3, 5, 9, len(values) // 2, len(values) - 1, len(values)]:
            want = ranked[n - 1]
            assert FO.nth_value(df, "x", n, down) == (want, sum(v > want if down else v < want for v in values))
        assert FO.nth_value(df, "x", len(values) + 1, down) is None and FO.nth_value(df, "x", 0, down) is None
    assert FO.nth_value(df.where("x is null"), "x", 1) is None


def test_hard_negatives_with_snowflake_keys_and_infinite_scores(spark):
    rows = [(2**60 + i, 0, 1.0) for i in range(9)] + [(2**60 + 20 + i, 1, 0.0) for i in range(4)] + [(5, 0, float("-inf")), (6, 0, None)]
    df = spark.createDataFrame(rows, "k long, y int, s double")
    kept = {r["k"] for r in L.hard_negatives(df, F.col("y") == 1, "s", 1.0, "k").where("kept").collect()}
    assert kept == {2**60 + i for i in range(4)} | {2**60 + 20 + i for i in range(4)}
    up = df.withColumn("s", F.when(F.col("k") == 5, float("inf")).otherwise(F.col("s")))
    kept = {r["k"] for r in L.hard_negatives(up, F.col("y") == 1, "s", 0.5, "k").where("kept and y = 0").collect()}
    assert kept == {5, 2**60}


def test_many_occurrences_in_one_text(spark):
    df = spark.createDataFrame([(1, "ab." * 20000, "ab"), (2, "aaaaa", "aa"), (3, "\\E.*\\Q", "\\E"), (4, "x", ""), (5, None, "x")], "id long, context string, answer_text string")
    got = {r["id"]: r["answer_start_list"] for r in A.all_occurrences(df).collect()}
    assert got == {1: list(range(0, 60000, 3)), 2: [0, 2], 3: [0], 4: [], 5: []}
