"""Featurisation, scoring and decoding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.config import TEST_DECODE, TEST_WINDOW
from spanlake.functions.text import jaccard, pieces
from spanlake.operators import decode as D
from spanlake.operators.tokens import char_to_token, longest_first, tokenize
from spanlake.operators.windows import assembled_lengths, label_windows, window_spans
from spanlake.plans import fixtures as X
from spanlake.plans import oracle as O
from spanlake.plans.catalog import register
from spanlake.plans.composite import eval_by_language, lexical_answers_for, lexical_logits_for, lexical_predictions, lexical_topk_for
from spanlake.session import shuffle_partitions
from spanlake.sources.tables import table

W, DC = TEST_WINDOW, TEST_DECODE
QA_BASE = [O.TOK, O.QA]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"),
                                                 F.col("text").alias("context"))
    return d.repartition(shuffle_partitions(d), "id")


# --- flagship -----------------------------------------------------------------

@register("eval_by_language", O.with_ctes(
    QA_BASE + O.decode_ctes("qa", W, DC, keep=("language", "answer_text")),
    f"""SELECT language, grouping(language) = 1 AS is_total, round(avg(jaccard), 6) AS mean_jaccard,
          count(*) AS n
   FROM (SELECT language, {O.jaccard_sql('answer_text', 'prediction')} AS jaccard FROM pred) j
   GROUP BY GROUPING SETS ((language), ())"""))
def q_eval_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_by_language(X.qa(spark, sf_dir), W, DC)


@register("best_span", O.with_ctes(QA_BASE + O.decode_ctes("qa", W, DC), "SELECT id, prediction, score FROM pred"))
def q_best_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_predictions(X.qa(spark, sf_dir), W, DC)


@register("best_span_conv", O.with_ctes([O.QA_CONV] + O.decode_ctes("qa_conv", W, DC),
                                        "SELECT id, prediction, score FROM pred"))
def q_best_span_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode over conversation pairs: long, variable-length questions (capacity varies per row)."""
    return lexical_predictions(X.qa_conv(spark, sf_dir), W, DC)


@register("jaccard_pairs", O.with_ctes(
    [O.QA_CONV], f"SELECT id, round({O.jaccard_sql('question', 'context')}, 6) AS jaccard FROM qa_conv"))
def q_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.qa_conv(spark, sf_dir)
    return c.select("id", F.round(jaccard("question", "context"), 6).alias("jaccard"))


# --- tokens and windows -------------------------------------------------------

@register("token_offsets", O.with_ctes([O.TOK], """
SELECT doc_id AS id, count(*) AS n_tok, CAST(sum(ts) AS BIGINT) AS sum_ts, CAST(sum(te) AS BIGINT) AS sum_te,
       max(te) AS max_te
FROM tok GROUP BY doc_id"""))
def q_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenize(_docs(spark, sf_dir), "id", "context")
    return t.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_tok"), F.sum("ts").cast("bigint").alias("sum_ts"),
        F.sum("te").cast("bigint").alias("sum_te"), F.max("te").cast("bigint").alias("max_te"))


@register("token_stats", O.with_ctes([O.TOK], """
SELECT lang AS language, count(*) AS n_tokens, count(DISTINCT lower(tok)) AS n_distinct FROM tok GROUP BY lang"""))
def q_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenize(_docs(spark, sf_dir), "id", "context", keep=("language",))
    return t.groupBy("language").agg(F.count(F.lit(1)).alias("n_tokens"),
                                     F.countDistinct(F.lower("tok")).alias("n_distinct"))


@register("window_spans", O.with_ctes(QA_BASE + O.logits_ctes("qa", W, False)[:2], """
SELECT w.id, CAST(w.fid AS INTEGER) AS feature_idx, CAST(w.fid * g.step AS INTEGER) AS first_pos,
       CAST(least(w.fid * g.step + g.cap, g.n_ctx) - 1 AS INTEGER) AS last_pos
FROM wins w JOIN geo g ON w.id = g.id"""))
def q_window_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = window_spans(X.qa(spark, sf_dir), W)
    return s.select("id", "feature_idx", F.col("first_pos").cast("int"), F.col("last_pos").cast("int"))


@register("assembled_lengths", O.with_ctes(QA_BASE + O.logits_ctes("qa", W, False)[:2], f"""
SELECT w.id, CAST(w.fid AS INTEGER) AS feature_idx, CAST(g.q_len AS INTEGER) AS q_len,
       CAST(least(w.fid * g.step + g.cap, g.n_ctx) - w.fid * g.step AS INTEGER) AS ctx_len,
       CAST({W.max_len - W.n_special} - g.q_len - (least(w.fid * g.step + g.cap, g.n_ctx) - w.fid * g.step)
            AS INTEGER) AS pad_len
FROM wins w JOIN geo g ON w.id = g.id"""))
def q_assembled_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled_lengths(X.qa(spark, sf_dir), W).select(
        "id", "feature_idx", *[F.col(c).cast("int").alias(c) for c in ("q_len", "ctx_len", "pad_len")])


LABEL_SQL = O.with_ctes(QA_BASE + O.logits_ctes("qa", W, False)[:4], """
SELECT w.id, CAST(w.fid AS INTEGER) AS feature_idx,
       CAST(CASE WHEN min(w.ts) <= q.answer_start AND max(w.te) >= q.answer_end
            THEN max(CASE WHEN w.ts <= q.answer_start THEN w.pos END) ELSE 0 END AS INTEGER) AS start_position,
       CAST(CASE WHEN min(w.ts) <= q.answer_start AND max(w.te) >= q.answer_end
            THEN min(CASE WHEN w.te >= q.answer_end THEN w.pos END) ELSE 0 END AS INTEGER) AS end_position
FROM wtok w JOIN qa q ON w.id = q.id
GROUP BY w.id, w.fid, q.answer_start, q.answer_end""")


@register("window_labels", LABEL_SQL)
def q_window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = X.qa(spark, sf_dir).select("id", "context", "question", F.col("answer_start").alias("start_char"), F.col("answer_end").alias("end_char"))
    return label_windows(ex, W)


@register("longest_first", O.with_ctes([O.QA_CONV], r"""
SELECT id,
  CAST(CASE WHEN la + lb <= 125 THEN la
            WHEN la > lb THEN (CASE WHEN 2 * lb <= 125 THEN 125 - lb ELSE 63 END)
            ELSE (CASE WHEN 2 * la <= 125 THEN la ELSE 62 END) END AS INTEGER) AS ctx_kept,
  CAST(CASE WHEN la + lb <= 125 THEN lb
            WHEN la > lb THEN (CASE WHEN 2 * lb <= 125 THEN lb ELSE 62 END)
            ELSE (CASE WHEN 2 * la <= 125 THEN 125 - la ELSE 63 END) END AS INTEGER) AS q_kept
FROM (SELECT id, len(regexp_extract_all(context, '\S+')) AS la, len(regexp_extract_all(question, '\S+')) AS lb
      FROM qa_conv) t"""))
def q_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 on (context, question) pairs with a 128-token budget (125 after 3 specials)."""
    lf = longest_first(X.qa_conv(spark, sf_dir), 128, "context", "question", n_special=3)
    return lf.select("id", F.col("a_kept").alias("ctx_kept"), F.col("b_kept").alias("q_kept"))


C2T_BUDGET = 512


@register("char_to_token", O.with_ctes(QA_BASE + [r"""
kept AS (
  SELECT id, CASE WHEN la + lb <= 509 THEN la
                  WHEN la > lb THEN (CASE WHEN 2 * lb <= 509 THEN 509 - lb ELSE 255 END)
                  ELSE (CASE WHEN 2 * la <= 509 THEN la ELSE 254 END) END AS ctx_kept
  FROM (SELECT id, len(regexp_extract_all(context, '\S+')) AS la, len(regexp_extract_all(question, '\S+')) AS lb
        FROM qa) t
)"""], """
SELECT q.id,
  CAST(coalesce(min(CASE WHEN t.ts <= q.answer_start AND q.answer_start < t.te AND t.pos < k.ctx_kept
                         THEN t.pos + 1 END), 512) AS INTEGER) AS start_token,
  CAST(coalesce(min(CASE WHEN t.ts <= q.answer_end - 1 AND q.answer_end - 1 < t.te AND t.pos < k.ctx_kept
                         THEN t.pos + 1 END), 512) AS INTEGER) AS end_token
FROM qa q JOIN kept k ON q.id = k.id JOIN tok t ON t.doc_id = q.id
GROUP BY q.id"""))
def q_char_to_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer characters -> sequence positions of a ``[CLS] context [SEP] question [SEP]``
    encoding truncated longest-first to 512; positions cut off map to the sentinel 512."""
    ex = longest_first(X.qa(spark, sf_dir), C2T_BUDGET, "context", "question")
    ex = ex.where(F.size(pieces("context")) > 0).withColumn("answer_last", F.col("answer_end") - 1)
    t = char_to_token(ex, ["answer_start", "answer_last"], C2T_BUDGET - 1, kept="a_kept")
    return t.select("id", (F.col("answer_start_token") + 1).cast("int").alias("start_token"), (F.col("answer_last_token") + 1).cast("int").alias("end_token"))


# --- scores, top-n, candidates --------------------------------------------------

@register("lexical_logits", O.with_ctes(QA_BASE + O.logits_ctes("qa", W, True), """
SELECT id, CAST(fid AS INTEGER) AS feature_idx, count(*) AS n, CAST(sum(sl) AS BIGINT) AS sum_start,
       CAST(sum(el) AS BIGINT) AS sum_end, max(sl) AS max_start, max(el) AS max_end
FROM alllog GROUP BY id, fid"""))
def q_lexical_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lg = lexical_logits_for(X.qa(spark, sf_dir), W, DC)
    return lg.groupBy("id", "feature_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start_logit").cast("bigint").alias("sum_start"),
        F.sum("end_logit").cast("bigint").alias("sum_end"), F.max("start_logit").alias("max_start"),
        F.max("end_logit").alias("max_end"))


TOP_K = DC.n_best


@register("top_positions", O.with_ctes(QA_BASE + O.logits_ctes("qa", W, True) + O.candidate_ctes(DC)[:2], f"""
SELECT id, CAST(fid AS INTEGER) AS feature_idx, 'start' AS side, CAST(pos AS INTEGER) AS pos, CAST(srank AS INTEGER) AS rk
FROM rs WHERE srank <= {TOP_K} AND is_ctx
UNION ALL
SELECT id, CAST(fid AS INTEGER) AS feature_idx, 'end' AS side, CAST(pos AS INTEGER) AS pos, CAST(erank AS INTEGER) AS rk
FROM re WHERE erank <= {TOP_K} AND is_ctx"""))
def q_top_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tk = lexical_topk_for(X.qa(spark, sf_dir), W, DC)
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.arrays_zip(F.col(f"{side}s.pos").alias("pos"), F.col(f"{side}s.rk").alias("rk")).alias("a"))
                      for side in ("start", "end")])
    x = tk.select("id", "feature_idx", F.inline(sides)).select("id", "feature_idx", "side", F.explode("a").alias("e"))
    return x.select("id", "feature_idx", "side", F.col("e.pos").cast("int").alias("pos"), F.col("e.rk").cast("int").alias("rk"))


@register("span_candidates", O.with_ctes(QA_BASE + O.logits_ctes("qa", W, True) + O.candidate_ctes(DC)[:3], """
SELECT id, CAST(fid AS INTEGER) AS feature_idx, count(*) AS n_cand, CAST(sum(score) AS BIGINT) AS sum_score,
       max(score) AS max_score
FROM cand GROUP BY id, fid"""))
def q_span_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tk = lexical_topk_for(X.qa(spark, sf_dir), W, DC, "every")
    c = D.span_candidates(tk, DC.max_answer_len)
    return c.groupBy("id", "feature_idx").agg(
        F.count(F.lit(1)).alias("n_cand"), F.sum("score").cast("bigint").alias("sum_score"),
        F.max("score").alias("max_score"))


@register("null_score", O.with_ctes(QA_BASE + O.logits_ctes("qa", W, True), """
SELECT id, max(sl + el) AS null_score FROM alllog WHERE pos = 0 GROUP BY id"""))
def q_null_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.null_score(lexical_logits_for(X.qa(spark, sf_dir), W, DC))


NBEST_K = DC.n_best


@register("nbest_list", O.with_ctes(QA_BASE + O.logits_ctes("qa", W, True) + O.candidate_ctes(DC)[:3], f"""
SELECT id, CAST(rk AS INTEGER) AS rk, text, CAST(score AS DOUBLE) AS score FROM (
  SELECT id, text, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, fid, srank, erank) AS rk FROM (
    SELECT *, row_number() OVER (PARTITION BY id, text ORDER BY score DESC, fid, srank, erank) AS tr FROM (
      SELECT c.*, substr(q.context, CAST(c.s_char + 1 AS INTEGER), CAST(c.e_char - c.s_char AS INTEGER)) AS text
      FROM cand c JOIN qa q ON c.id = q.id) c1) c2
  WHERE tr = 1) c3
WHERE rk <= {NBEST_K}"""))
def q_nbest_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_answers_for(X.qa(spark, sf_dir), W, DC, NBEST_K).select("id", "rk", "text", "score")
