"""Sinks and the pluggable scorer: S4, S5, S6, M1, J2, J3, F3, F9, J10, P2."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.config import TEST_DECODE, TEST_WINDOW
from spanlake.functions.text import TOKEN
from spanlake.operators import decode as D
from spanlake.operators import folds as FO
from spanlake.operators.metrics import mean_by_language, with_jaccard
from spanlake.operators.scoring import (END_POS_MULT, ID_MULT, MATCH_WEIGHT, NEIGHBOURS, NOISE_MOD, START_POS_MULT,
                                        WINDOW_MULT, aligned_windows, model_logits)
from spanlake.operators.windows import sequence_arrays
from spanlake.plans import fixtures as X
from spanlake.plans import oracle as O
from spanlake.plans.catalog import register
from spanlake.plans.composite import lexical_predictions, partition_examples
from spanlake.plans.queries_prep import FOLDS_SQL, VALID_FOLD
from spanlake.session import scratch_dir
from spanlake.sources import files as S

W, DC = TEST_WINDOW, TEST_DECODE
QA_BASE = [O.TOK, O.QA]


# --- S4 / S5 ----------------------------------------------------------------------------

@register("run_history_json", O.with_ctes([O.HISTORY], """
SELECT run, epoch, jaccard, val_loss, CAST(NULL AS DOUBLE) AS best_val_loss FROM history"""))
def q_run_history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run history -> JSON (non-finite ``best_val_loss`` stored as NULL) -> read back."""
    h = X.history(spark, sf_dir).select("run", "epoch", "jaccard", "val_loss",
                                        F.lit(float("inf")).alias("best_val_loss"))
    path = scratch_dir(spark, "history")
    S.write_run_history(h, path)
    return spark.read.schema(h.schema).json(path)


@register("partitioned_output", O.with_ctes(QA_BASE + [O.PREDS], """
SELECT member, count(*) AS n_rows, count(DISTINCT text) AS n_texts FROM preds GROUP BY member"""))
def q_partitioned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions laid out by run key (``member=<k>/`` folders) and read back by partition discovery."""
    path = scratch_dir(spark, "preds")
    S.write_examples(X.preds(spark, sf_dir).select("id", "member", "text"), path, partition_by=["member"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("member").cast("int").alias("member")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("text").alias("n_texts"))


# --- F3 / F9 ----------------------------------------------------------------------------

@register("sequence_layout", O.with_ctes(QA_BASE + O.logits_ctes("qa", W, False)[:2], f"""
SELECT w.id, CAST(w.fid AS INTEGER) AS feature_idx, {W.max_len} AS n_tokens,
       CAST(g.q_len + (least(w.fid * g.step + g.cap, g.n_ctx) - w.fid * g.step) + {W.n_special} AS INTEGER) AS n_mask,
       CAST(least(w.fid * g.step + g.cap, g.n_ctx) - w.fid * g.step AS INTEGER) AS n_ctx,
       CAST(g.q_len + 2 AS INTEGER) AS first_ctx_pos
FROM wins w JOIN geo g ON w.id = g.id"""))
def q_sequence_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 + F9: assembled, padded sequences; lengths of the mask and the context segment."""
    s = sequence_arrays(X.qa(spark, sf_dir), W)
    return s.select(
        "id", "feature_idx", F.size("tokens").alias("n_tokens"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_mask"),
        F.aggregate("sequence_ids", F.lit(0), lambda a, x: a + x).alias("n_ctx"),
        (F.array_position("sequence_ids", 1) - 1).cast("int").alias("first_ctx_pos"))


# --- M1 + S6 + J3: a user batch scorer ----------------------------------------------------

def lexical_model(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in "model" in the shape M1 expects: token arrays in, two scores per position out.

    It recomputes the built-in lexical scores from the assembled sequence
    (question segment = positions ``1..q_len``, context = ``sequence_ids == 1``),
    so decoding its output must give exactly the built-in predictions.
    """
    n, q_len = len(batch), batch["q_len"].to_numpy(np.int64)
    if not n:
        return pd.DataFrame({"id": [], "feature_idx": [], "pos": [], "start_logit": [], "end_logit": []})
    size = np.array([len(t) for t in batch["tokens"]], np.int64)
    begin = np.cumsum(size) - size
    words = pa.array(np.concatenate(batch["tokens"].to_list()), pa.string()).dictionary_encode()
    lower = pa.array([w.lower() for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    code = lower.indices.to_numpy()[words.indices.to_numpy()].astype(np.int64)

    def rows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(n), counts)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)

    every, place = rows(size)
    question = (place > 0) & (place <= q_len[every])
    asked = np.unique(every[question] << 32 | code[question])
    context = np.concatenate(batch["sequence_ids"].to_list()) == 1
    w, p = every[context], place[context]
    key = w << 32 | code[context]
    hit = asked[np.minimum(np.searchsorted(asked, key), len(asked) - 1)] == key if len(asked) else np.zeros(len(key), bool)
    c = np.concatenate(([0], np.cumsum(hit)))
    last = np.cumsum(np.bincount(w, minlength=n))
    first, i = (last - np.bincount(w, minlength=n))[w], np.arange(len(w))
    fwd, bwd = c[np.minimum(i + NEIGHBOURS + 1, last[w])] - c[i], c[i + 1] - c[np.maximum(i - NEIGHBOURS, first)]
    # CLS and the question, whose words are all in it
    sw, k = rows(q_len + 1)
    near = np.where(k == 0, 0, np.minimum(q_len[sw], k + NEIGHBOURS) - k + 1), np.where(k == 0, 0, k - np.maximum(1, k - NEIGHBOURS) + 1)
    owner = np.concatenate((sw, w))
    order = np.argsort(owner, kind="stable")
    owner, pos, fwd, bwd = (np.concatenate(x)[order] for x in ((sw, w), (k, p), (near[0], fwd), (near[1], bwd)))
    ids, fids = batch["id"].to_numpy(np.int64)[owner], batch["feature_idx"].to_numpy(np.int64)[owner]
    base = ids * ID_MULT + fids * WINDOW_MULT
    return pd.DataFrame({"id": ids, "feature_idx": fids.astype(np.int32), "pos": pos.astype(np.int32),
                         "start_logit": fwd * MATCH_WEIGHT + (base + pos * START_POS_MULT) % NOISE_MOD,
                         "end_logit": bwd * MATCH_WEIGHT + (base + pos * END_POS_MULT) % NOISE_MOD})


@register("model_scorer", O.with_ctes(QA_BASE + O.decode_ctes("qa", W, DC), "SELECT id, prediction, score FROM pred"))
def q_model_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 -> S6 -> J3 -> M3: score assembled windows with a pandas batch scorer
    (``mapInPandas``), store the logits, read them back, align them to the
    window tokens by key and decode."""
    ex = X.qa(spark, sf_dir)
    part = partition_examples(ex)
    # rows that repeat an id share their questions' lengths, so these meet in the id's row and no sequence is joined
    per_id = part.where(F.col("id").isNotNull()).groupBy("id").agg(F.collect_list(F.struct("context", "question")).alias("t"))
    q_lens = F.transform("t.question", lambda q: F.size(F.regexp_extract_all(q, F.lit(TOKEN), 0)))
    texts = per_id.select("id", "t", F.explode(q_lens).alias("_q")).select("id", "_q", F.inline("t"))
    feats = sequence_arrays(texts, W, keep=("_q",))
    scores = model_logits(feats.select("id", "feature_idx", "tokens", "sequence_ids", F.col("_q").alias("q_len")), lexical_model,
                          "id bigint, feature_idx int, pos int, start_logit bigint, end_logit bigint")
    path = scratch_dir(spark, "logits")
    S.write_logits(scores, path)
    stored = S.read_logits(spark, path)
    return D.with_predictions(ex, D.decode_windows(aligned_windows(stored, part, W, DC, "best")))


# --- J10 / P2 / M4 ----------------------------------------------------------------------

@register("valid_fold_eval", O.with_ctes(
    QA_BASE + [FOLDS_SQL] + O.decode_ctes("qa", W, DC, keep=("language", "answer_text")),
    f"""SELECT p.language, grouping(p.language) = 1 AS is_total,
          round(avg({O.jaccard_sql('p.answer_text', 'p.prediction')}), 6) AS mean_jaccard, count(*) AS n
   FROM pred p WHERE p.id IN (SELECT id FROM folded WHERE kfold = {VALID_FOLD})
   GROUP BY GROUPING SETS ((p.language), ())"""))
def q_valid_fold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 + P1 + M4: examples semi-joined to the held-out fold, decoded, then per-language means."""
    ex = X.qa(spark, sf_dir)
    _, valid = FO.split_by_fold(FO.stratified_kfold(ex, 5), VALID_FOLD)
    held = ex.join(valid.select("id"), "id", "left_semi")  # the fold first: only its examples are decoded
    return mean_by_language(with_jaccard(lexical_predictions(held, W, DC, keep=("language", "answer_text"))))


@register("eval_one_language", O.with_ctes(
    QA_BASE + O.decode_ctes("qa", W, DC, keep=("language", "answer_text")),
    f"""SELECT id, round({O.jaccard_sql('answer_text', 'prediction')}, 6) AS jaccard FROM pred WHERE language = 'de'"""))
def q_eval_one_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row Jaccard of one language (the filter is pushed to the example scan)."""
    ex = X.qa(spark, sf_dir).where(F.col("language") == "de")
    preds = lexical_predictions(ex, W, DC, keep=("answer_text",))
    return with_jaccard(preds).select("id", F.round("jaccard", 6).alias("jaccard"))
