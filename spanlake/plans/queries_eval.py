"""Evaluation, ensemble, loss, run-history and augmentation queries
(G3, G6-G18, W3, W4, W7, X1-X5, J6-J8, U4, U5)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.config import TEST_DECODE, TEST_WINDOW, DecodeConfig
from spanlake.functions.text import jaccard, pieces
from spanlake.operators import augment as AU
from spanlake.operators import decode as D
from spanlake.operators import ensemble as E
from spanlake.operators import losses as L
from spanlake.operators import metrics as M
from spanlake.operators import runs as R
from spanlake.operators.align import keep_if_answer_in_context, relocate_answer
from spanlake.operators.folds import MAIN_FOLD_SEED, stratified_kfold
from spanlake.plans import fixtures as X
from spanlake.plans import oracle as O
from spanlake.plans.catalog import register
from spanlake.operators.scoring import lexical_logits
from spanlake.plans.composite import lexical_logits_for, lexical_predictions, lexical_sweep_for, lexical_windows_for
from spanlake.session import scratch_dir, shuffle_partitions
from spanlake.sources.tables import table

W, DC = TEST_WINDOW, TEST_DECODE
QA_BASE = [O.TOK, O.QA]
SEED = MAIN_FOLD_SEED

# --- G6 / J8: decode sweep ----------------------------------------------------------

# The twelve sweep calls of the reference's evaluation (one point appears twice).
SWEEP_GRID = [(20, 35), (20, 40), (20, 45), (20, 50), (5, 30), (10, 30), (15, 30), (25, 30), (30, 50), (40, 50),
              (50, 50), (20, 50)]
GRID_MAX = DecodeConfig(n_best=max(n for n, _ in SWEEP_GRID), max_answer_len=max(m for _, m in SWEEP_GRID))
_GRID_VALUES = ", ".join(f"({n}, {m})" for n, m in sorted(set(SWEEP_GRID)))


@register("decode_sweep", O.with_ctes(
    QA_BASE + O.logits_ctes("qa", W, True) + O.candidate_ctes(GRID_MAX)[:3] + [f"""
grid AS (SELECT * FROM (VALUES {_GRID_VALUES}) t(n_best, max_len)),
gbest AS (
  SELECT * FROM (
    SELECT g.n_best, g.max_len, c.*,
           row_number() OVER (PARTITION BY g.n_best, g.max_len, c.id ORDER BY c.score DESC, c.fid, c.srank, c.erank) AS r
    FROM cand c JOIN grid g ON c.srank <= g.n_best AND c.erank <= g.n_best AND c.e_pos - c.s_pos + 1 <= g.max_len) x
  WHERE r = 1
),
gpred AS (
  SELECT g.n_best, g.max_len, q.id, q.language, q.answer_text,
         coalesce(substr(q.context, CAST(b.s_char + 1 AS INTEGER), CAST(b.e_char - b.s_char AS INTEGER)), '') AS prediction
  FROM qa q JOIN grid g ON TRUE
  LEFT JOIN gbest b ON b.id = q.id AND b.n_best = g.n_best AND b.max_len = g.max_len
)"""], f"""
SELECT n_best, max_len, language, round(avg({O.jaccard_sql('answer_text', 'prediction')}), 6) AS mean_jaccard
FROM gpred GROUP BY GROUPING SETS ((n_best, max_len, language), (n_best, max_len))"""))
def q_decode_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All grid points from one candidate frame ranked at the grid maxima."""
    ex = X.qa(spark, sf_dir)
    swept = lexical_sweep_for(ex, W, GRID_MAX, SWEEP_GRID)
    # a point without a span is left out or NULL
    none = F.array().cast("array<struct<n_best:int,max_len:int,score:double,prediction:string>>")
    grid = F.array(*[F.struct(F.lit(n).alias("n_best"), F.lit(m).alias("max_len")) for n, m in sorted(set(SWEEP_GRID))])

    def predicted(g: Column) -> Column:
        own = F.filter("swept", lambda x: (x["n_best"] == g["n_best"]) & (x["max_len"] == g["max_len"]))
        return F.struct(g["n_best"].alias("n_best"), g["max_len"].alias("max_len"), F.coalesce(F.try_element_at(own, F.lit(1))["prediction"], F.lit("")).alias("prediction"))

    per = ex.select("id", "language", "answer_text").join(swept, "id", "left").withColumn("swept", F.coalesce("swept", none))
    j = per.select("language", "answer_text", F.inline(F.transform(grid, predicted)))
    g = j.withColumn("jaccard", jaccard("answer_text", "prediction")).groupingSets(
        [["n_best", "max_len", "language"], ["n_best", "max_len"]], "n_best", "max_len", "language")
    return g.agg(F.round(F.avg("jaccard"), 6).alias("mean_jaccard")).select("n_best", "max_len", "language",
                                                                            "mean_jaccard")


# --- G7-G11: ensembles ----------------------------------------------------------------

@register("hard_vote", O.with_ctes(QA_BASE + [O.PREDS], """
SELECT id, text, votes FROM (
  SELECT id, text, votes, row_number() OVER (PARTITION BY id ORDER BY votes DESC, first_member) AS r FROM (
    SELECT id, text, count(*) AS votes, min(member) AS first_member FROM preds GROUP BY id, text) g) x
WHERE r = 1"""))
def q_hard_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hard_vote(X.preds(spark, sf_dir))


@register("score_vote", O.with_ctes(QA_BASE + [O.PREDS], """
SELECT id, text, CAST(score AS DOUBLE) AS score FROM (
  SELECT id, text, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, first_member) AS r FROM (
    SELECT id, text, sum(score) AS score, min(member) AS first_member FROM preds GROUP BY id, text) g) x
WHERE r = 1"""))
def q_score_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_vote(X.preds(spark, sf_dir))


@register("start_end_vote", O.with_ctes(QA_BASE + [O.PREDS, """
sv AS (SELECT id, start_tok AS s FROM (
  SELECT id, start_tok, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(member)) AS r
  FROM preds GROUP BY id, start_tok) x WHERE r = 1),
ev AS (SELECT id, end_tok AS e FROM (
  SELECT id, end_tok, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(member)) AS r
  FROM preds GROUP BY id, end_tok) x WHERE r = 1)"""], """
SELECT sv.id, sv.s, ev.e,
  CASE WHEN sv.s <= ev.e THEN substr(q.context, CAST(a.ts + 1 AS INTEGER), CAST(b.te - a.ts AS INTEGER)) ELSE '' END AS text
FROM sv JOIN ev ON sv.id = ev.id JOIN qa q ON q.id = sv.id
JOIN ktok a ON a.doc_id = sv.id AND a.pos = sv.s JOIN ktok b ON b.doc_id = sv.id AND b.pos = ev.e"""))
def q_start_end_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separate start and end votes; a start after the end gives ''."""
    p = X.preds(spark, sf_dir)
    se = E.start_end_vote(p)
    ctx = p.where(F.col("member") == 0).select("id", "context")
    j = se.join(ctx, "id").withColumn("_p", pieces("context"))
    te = F.length(F.array_join(F.slice("_p", 1, F.col("e").cast("int") + 1), ""))
    te_s = F.length(F.array_join(F.slice("_p", 1, F.col("s").cast("int") + 1), ""))
    ts = te_s - F.length(F.regexp_extract(F.element_at("_p", F.col("s").cast("int") + 1), r"(?U)\S+", 0))
    text = F.when(F.col("s") <= F.col("e"), F.substr("context", ts + 1, te - ts)).otherwise(F.lit(""))
    return j.select("id", "s", "e", text.alias("text"))


N_AVG = 3


def _member_logits(scored: pa.Table) -> pa.Table:
    """Three members sharing a tokenizer: the lexical scores plus a member-specific integer perturbation."""
    pos, fid = (scored[c].to_numpy().astype("int64") for c in ("pos", "feature_idx"))

    def member(mb: int) -> pa.Table:
        s, e = ((pos * (mb + 3) + fid * 7 + mb) % 11) * 100, ((pos * (mb + 5) + fid * 11 + mb) % 13) * 100
        names = scored.column_names
        return (scored.set_column(names.index("start_logit"), "start_logit", pc.add(scored["start_logit"], pa.array(s)))
                .set_column(names.index("end_logit"), "end_logit", pc.add(scored["end_logit"], pa.array(e))))

    return pa.concat_tables([member(mb) for mb in range(N_AVG)])


AVG_SQL = [f"""
mlog AS (
  SELECT a.*, m.member FROM alllog a CROSS JOIN (SELECT * FROM range(0, {N_AVG}) t(member)) m
),
avglog AS (
  SELECT id, fid, pos, is_ctx, ts, te,
         sum(sl + ((pos * (member + 3) + fid * 7 + member) % 11) * 100) AS sl,
         sum(el + ((pos * (member + 5) + fid * 11 + member) % 13) * 100) AS el
  FROM mlog GROUP BY id, fid, pos, is_ctx, ts, te
)"""]


def _avg_decode_ctes() -> list[str]:
    return (QA_BASE + O.logits_ctes("qa", W, True) + AVG_SQL + O.candidate_ctes(DC, "avglog") + ["""
apred AS (
  SELECT q.id, coalesce(substr(q.context, CAST(b.s_char + 1 AS INTEGER), CAST(b.e_char - b.s_char AS INTEGER)), '')
         AS prediction, round(coalesce(CAST(b.score AS DOUBLE), 0.0) / 3, 6) AS score
  FROM qa q LEFT JOIN best b ON q.id = b.id
)"""])


def _logit_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = X.qa(spark, sf_dir)
    avg = lexical_windows_for(ex, W, DC, "best", through=(_member_logits, E.logit_average))
    preds = D.decode_windows(avg)
    out = D.with_predictions(ex, preds)
    return out.select("id", "prediction", F.round(F.col("score") / N_AVG, 6).alias("score"))


@register("logit_average", O.with_ctes(_avg_decode_ctes(), "SELECT id, prediction, score FROM apred"))
def q_logit_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average three members' logits per position, then decode once."""
    return _logit_average(spark, sf_dir)


@register("two_level_vote", O.with_ctes(_avg_decode_ctes() + [O.PREDS, """
members AS (SELECT id, member, text FROM preds UNION ALL SELECT id, 5 AS member, prediction AS text FROM apred)"""], """
SELECT id, text, votes FROM (
  SELECT id, text, votes, row_number() OVER (PARTITION BY id ORDER BY votes DESC, first_member) AS r FROM (
    SELECT id, text, count(*) AS votes, min(member) AS first_member FROM members GROUP BY id, text) g) x
WHERE r = 1"""))
def q_two_level_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five raw members plus one logit-averaged member (itself an ensemble), then a hard vote."""
    raw = X.preds(spark, sf_dir).select("id", "member", "text")
    avg = _logit_average(spark, sf_dir).select("id", F.lit(5).alias("member"), F.col("prediction").alias("text"))
    return E.two_level_vote(raw, avg)


# --- G3, W4, W7: meters -----------------------------------------------------------------

def _meter_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_type", "event_id", F.col("value").alias("val"),
                    (F.lit(1) + F.col("event_id") % 4).cast("bigint").alias("n"))


@register("meter_batch", """
SELECT event_type, round(arg_max(value, event_id), 6) AS last,
       round(sum(value * (1 + event_id % 4)) / sum(1 + event_id % 4), 6) AS avg,
       round(sum(value * (1 + event_id % 4)), 6) AS sum, CAST(sum(1 + event_id % 4) AS BIGINT) AS count,
       round(greatest(max(value), 0.0), 6) AS max, round(least(min(value), 100000.0), 6) AS min
FROM events GROUP BY event_type""")
def q_meter_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.meter(_meter_input(spark, sf_dir), "event_type", "event_id")


RUNNING_SQL = """
running AS (
  SELECT event_type, event_id,
    row_number() OVER w AS n_rows,
    floor((CAST(sum(CAST(round(value * 10000) AS BIGINT) * (1 + event_id % 4)) OVER w AS BIGINT) * 100 * 2
           + sum(1 + event_id % 4) OVER w) / (2 * sum(1 + event_id % 4) OVER w)) / 1000000.0 AS avg,
    round(greatest(max(value) OVER w, 0.0), 6) AS max, round(least(min(value) OVER w, 100000.0), 6) AS min
  FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


@register("meter_running", O.with_ctes([RUNNING_SQL], "SELECT event_id, avg, max, min FROM running"))
def q_meter_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.running_meter(_meter_input(spark, sf_dir), "event_type", "event_id", bucket_width=512, exact_scale=4)
    return r.select("event_id", "avg", "max", "min")


LOG_EVERY = 50


@register("log_every", O.with_ctes([RUNNING_SQL], f"""
SELECT event_type, CAST(n_rows - 1 AS BIGINT) AS seq, avg AS running_avg FROM running r
WHERE (n_rows - 1) % {LOG_EVERY} = 0
   OR n_rows = (SELECT count(*) FROM events e WHERE e.event_type = r.event_type)"""))
def q_log_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.running_meter(_meter_input(spark, sf_dir), "event_type", "event_id", bucket_width=512, exact_scale=4)
    r = r.select("event_type", (F.col("n_rows") - 1).cast("bigint").alias("seq"), F.col("avg").alias("running_avg"))
    return M.log_every(r, "seq", LOG_EVERY, keys=("event_type",))


# --- G12-G16: losses ---------------------------------------------------------------------

def _window_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = X.qa(spark, sf_dir)
    part = ex.select("id", "context", "question", F.col("answer_start").alias("start_char"),
                     F.col("answer_end").alias("end_char")).repartition(shuffle_partitions(ex), "id")
    lg = lexical_logits(part, W, include_special=True, keep=("start_char", "end_char"))
    ce = L.span_cross_entropy(L.window_score_stats(lg, with_labels=True))
    return L.distance_weighted(ce).join(ex.select("id", "language"), "id")


LOSS_SQL = QA_BASE + O.logits_ctes("qa", W, True) + [
    """lab AS (
  SELECT w.id, w.fid,
    CASE WHEN min(w.ts) <= q.answer_start AND max(w.te) >= q.answer_end
         THEN max(CASE WHEN w.ts <= q.answer_start THEN w.pos END) ELSE 0 END AS sp,
    CASE WHEN min(w.ts) <= q.answer_start AND max(w.te) >= q.answer_end
         THEN min(CASE WHEN w.te >= q.answer_end THEN w.pos END) ELSE 0 END AS ep
  FROM wtok w JOIN qa q ON w.id = q.id GROUP BY w.id, w.fid, q.answer_start, q.answer_end
)""",
    """xs AS (SELECT id, fid, pos, CAST(sl AS DOUBLE) / 1000 AS xs, CAST(el AS DOUBLE) / 1000 AS xe FROM alllog)""",
    """wst AS (
  SELECT id, fid, max(xs) AS ms, max(xe) AS me,
         arg_max(pos, xs * 1000000 - pos) AS arg_s, arg_max(pos, xe * 1000000 - pos) AS arg_e
  FROM xs GROUP BY id, fid
)""",
    """ce AS (
  SELECT x.id, x.fid,
    w.ms + ln(sum(exp(x.xs - w.ms))) - max(CASE WHEN x.pos = l.sp THEN x.xs END) AS ce_s,
    w.me + ln(sum(exp(x.xe - w.me))) - max(CASE WHEN x.pos = l.ep THEN x.xe END) AS ce_e,
    max(w.arg_s) - max(l.sp) AS gap_s, max(w.arg_e) - max(l.ep) AS gap_e
  FROM xs x JOIN wst w ON x.id = w.id AND x.fid = w.fid JOIN lab l ON x.id = l.id AND x.fid = l.fid
  GROUP BY x.id, x.fid, w.ms, w.me
)""",
]


@register("span_cross_entropy", O.with_ctes(LOSS_SQL, """
SELECT q.language, round(avg(0.5 * ce_s + 0.5 * ce_e), 6) AS loss FROM ce JOIN qa q ON ce.id = q.id GROUP BY q.language"""))
def q_span_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over windows of 0.5 * CE(start) + 0.5 * CE(end), scores / 1000, per language."""
    return _window_losses(spark, sf_dir).groupBy("language").agg(F.round(F.avg("loss"), 6).alias("loss"))


@register("distance_weighted_loss", O.with_ctes(LOSS_SQL, """
SELECT q.language, round(avg(ce_s * abs(gap_s)) + avg(ce_e * abs(gap_e)), 6) AS loss
FROM ce JOIN qa q ON ce.id = q.id GROUP BY q.language"""))
def q_distance_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-window CE times the distance of the argmax from the label (both weights 1)."""
    return _window_losses(spark, sf_dir).groupBy("language").agg(
        F.round(F.avg("ws") + F.avg("we"), 6).alias("loss"))


ALPHAS = (0.0, 0.5, 1.0)
_ALPHA_VALUES = ", ".join(f"({a})" for a in ALPHAS)


def _dice_sql(square: bool) -> str:
    den = "sum(pp * pp) + sum(y * y)" if square else "sum(pp) + sum(y)"
    return f"""
SELECT alpha, round(1 - (2 * sum(pp * y) + 0.0001) / ({den} + 0.0001), 6) AS loss FROM (
  SELECT a.alpha, pow(1 - pm, a.alpha) * pm AS pp, y FROM (
    SELECT ((doc_id * 7919) % 1000) / CAST(1000 AS DOUBLE) * quality AS pm, CAST(toxic * quality AS DOUBLE) AS y
    FROM labels) l
  CROSS JOIN (SELECT CAST(alpha AS DOUBLE) AS alpha FROM (VALUES {_ALPHA_VALUES}) t(alpha)) a) x
GROUP BY alpha"""


def _dice(spark: SparkSession, sf_dir: str, square: bool) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    x = lab.select(((F.col("doc_id") * 7919) % 1000 / F.lit(1000.0).cast("double")).alias("p"), "toxic", "quality",
                   F.explode(F.array(*[F.lit(a) for a in ALPHAS])).alias("alpha"))
    d = L.dice_binary(x, "p", "toxic", "quality", alpha=F.col("alpha"), square=square, group=["alpha"])
    return d.select("alpha", F.round("loss", 6).alias("loss"))


@register("dice_binary", _dice_sql(False))
def q_dice_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary Dice of p against toxic, masked by quality, for three alphas."""
    return _dice(spark, sf_dir, False)


@register("dice_squared", _dice_sql(True))
def q_dice_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dice(spark, sf_dir, True)


N_CLASSES = 10


@register("dice_multiclass", f"""
WITH x AS (
  SELECT vec_id, label, c, exp(v - m) / z AS p, CASE WHEN label = c THEN 1.0 ELSE 0.0 END AS y FROM (
    SELECT vec_id, label, c, v, m, sum(exp(v - m)) OVER (PARTITION BY vec_id) AS z FROM (
      SELECT vec_id, label, c, v, max(v) OVER (PARTITION BY vec_id) AS m FROM (
        SELECT vec_id, label, CAST(unnest(range(0, {N_CLASSES})) AS INTEGER) AS c,
               unnest([list_sum([CAST(embedding[j + 1] AS DOUBLE) for j in range(0, len(embedding)) if j % {N_CLASSES} = i])
                       for i in range(0, {N_CLASSES})]) AS v FROM embeddings) e0) e1) e2
),
tot AS (SELECT c, sum(p) AS tot_p, sum(y) AS tot_y FROM x GROUP BY c),
per AS (SELECT vec_id, sum(1 - (2 * p * y + 0.0001) / (tot_p + tot_y + 0.0001)) AS loss FROM x JOIN tot USING (c) GROUP BY vec_id)
SELECT 'mean' AS reduction, round(avg(loss), 6) AS loss FROM per
UNION ALL SELECT 'sum', round(sum(loss), 6) FROM per""")
def q_dice_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over the embedding folded into ten class scores vs the label, per-label Dice, mean and sum."""
    x = _class_scores(table(spark, sf_dir, "embeddings"))
    per = L.dice_multiclass(x, "logits", "label", N_CLASSES)
    both = per.agg(F.avg("loss").alias("mean"), F.sum("loss").alias("sum"))
    return both.select(F.explode(F.create_map(F.lit("mean"), F.round("mean", 6), F.lit("sum"), F.round("sum", 6))).alias("reduction", "loss"))


def _class_scores(emb: DataFrame) -> DataFrame:
    """``vec_id, label, logits``: class ``c`` scores the sum of all embedding values at places ``c`` modulo the classes."""
    v = F.col("embedding").cast("array<double>")
    fold = F.transform(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)), lambda c: F.aggregate(
        F.filter(v, lambda x, j: j % N_CLASSES == c), F.lit(0.0), lambda a, x: a + x))
    return emb.select("vec_id", "label", fold.alias("logits"))


OHEM_RATIO = 3.0


@register("hard_negatives", f"""
WITH s AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS score FROM embeddings),
k AS (SELECT CAST(floor(count(*) * {OHEM_RATIO}) AS BIGINT) AS k FROM s WHERE label = 0)
SELECT vec_id, label, label = 0 OR rk <= (SELECT k FROM k) AS kept FROM (
  SELECT *, CASE WHEN label = 0 THEN NULL ELSE row_number() OVER (PARTITION BY label = 0 ORDER BY score DESC, vec_id) END
         AS rk FROM s) r""")
def q_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16 + T3: all positives (label 0) and the 3x as many highest-scoring negatives (score over the whole vector)."""
    emb = table(spark, sf_dir, "embeddings")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0).cast("bigint"), lambda a, x: a + F.floor(x * 64))
    s = emb.select("vec_id", "label", total.alias("score"))
    return L.hard_negatives(s, F.col("label") == 0, "score", OHEM_RATIO, "vec_id").select("vec_id", "label", "kept")


# --- G17, G18, W3: run history -----------------------------------------------------------

@register("best_epoch", O.with_ctes([O.HISTORY], """
SELECT run, epoch, jaccard, val_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY jaccard DESC, epoch) AS r FROM history) h WHERE r = 1"""))
def q_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_epoch(X.history(spark, sf_dir))


PATIENCE = 2


@register("early_stop", O.with_ctes([O.HISTORY, """
h1 AS (SELECT *, jaccard > greatest(coalesce(max(jaccard) OVER (PARTITION BY run ORDER BY epoch
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS improved FROM history),
h2 AS (SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS counter FROM h1),
st AS (SELECT run, min(CASE WHEN counter = 2 THEN epoch END) AS stop_epoch FROM h2 GROUP BY run)"""], """
SELECT st.run, CAST(st.stop_epoch AS INTEGER) AS stop_epoch,
       CAST(max(CASE WHEN h2.improved AND (st.stop_epoch IS NULL OR h2.epoch <= st.stop_epoch) THEN h2.epoch END)
            AS INTEGER) AS best_epoch
FROM st JOIN h2 ON st.run = h2.run GROUP BY st.run, st.stop_epoch"""))
def q_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.early_stop(X.history(spark, sf_dir), PATIENCE)


@register("epoch_times", O.with_ctes([O.HISTORY], """
SELECT run, CAST(sum(seconds) AS BIGINT) AS total, round(avg(seconds), 6) AS mean FROM history GROUP BY run"""))
def q_epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.epoch_times(X.history(spark, sf_dir))


# --- X1-X5: augmentation ------------------------------------------------------------------

@register("synonym_normalize", O.with_ctes([O.LEXICON], "SELECT word, synonym FROM syn"))
def q_synonym_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.normalize_synonyms(X.lexicon(spark, sf_dir))


N_REPLACE = 3


@register("synonym_replace", O.with_ctes([O.STOP, O.LEXICON, r"""
dw AS (
  SELECT doc_id AS id, pos, w FROM (
    SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS pos
    FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS x FROM documents) d) t
  WHERE w <> ''
),
cand AS (SELECT DISTINCT id, w FROM dw WHERE lower(w) NOT IN (SELECT word FROM stop)),
pick AS (
  SELECT id, w, arg_min(synonym, md5(synonym || ':' || w || ':' || CAST(id AS VARCHAR) || ':9353')) AS syn
  FROM cand JOIN syn ON lower(cand.w) = syn.word GROUP BY id, w
),
chosen AS (
  SELECT id, w, syn FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(w || ':' || CAST(id AS VARCHAR) || ':9353'), w) AS rk
    FROM pick) p WHERE rk <= 3
),
newtext AS (
  SELECT dw.id, string_agg(coalesce(c.syn, dw.w), ' ' ORDER BY dw.pos) AS text
  FROM dw LEFT JOIN chosen c ON dw.id = c.id AND dw.w = c.w GROUP BY dw.id
)"""], """
SELECT d.doc_id AS id, md5(coalesce(n.text, '')) AS text_md5,
       CAST((SELECT count(*) FROM chosen c WHERE c.id = d.doc_id) AS BIGINT) AS n_replaced
FROM documents d LEFT JOIN newtext n ON n.id = d.doc_id"""))
def q_synonym_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 + J6 + J7 + U5 + T4 on every document, three words each."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    d = d.repartition(shuffle_partitions(d), "id")
    syn = AU.normalize_synonyms(X.lexicon(spark, sf_dir))
    out = AU.synonym_replacement(d, syn, None, N_REPLACE, SEED, stop_k=X.STOP_N)
    return out.select("id", F.md5("text").alias("text_md5"), "n_replaced")


@register("stopword_removal", O.with_ctes([O.STOP, r"""
dw AS (SELECT doc_id AS id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) t
       WHERE w <> '')"""], """
SELECT d.doc_id AS id, count(dw.w) AS n_before,
       count(dw.w) FILTER (WHERE lower(dw.w) NOT IN (SELECT word FROM stop)) AS n_after
FROM documents d LEFT JOIN dw ON dw.id = d.doc_id GROUP BY d.doc_id"""))
def q_stopword_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts before and after removing stop words."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    d = d.repartition(shuffle_partitions(d), "id")
    words = AU.word_rows(d)
    kept = AU.remove_stop_words(words, AU.top_words(words, X.STOP_N))
    nb = words.groupBy("id").agg(F.count(F.lit(1)).alias("n_before"))
    na = kept.groupBy("id").agg(F.count(F.lit(1)).alias("n_after"))
    out = d.select("id").join(nb, "id", "left").join(na, "id", "left")
    return out.select("id", F.coalesce("n_before", F.lit(0)).alias("n_before"),
                      F.coalesce("n_after", F.lit(0)).alias("n_after"))


BT_PROB = 50


def _bt_apply(field: str) -> str:
    return (f"(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':{field}:{SEED}'), 1, 8)) AS BIGINT) % 100) "
            f"< {BT_PROB}")


@register("back_translate_filter", O.with_ctes(QA_BASE + [f"""
folded AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY language ORDER BY md5(CAST(id AS VARCHAR) || ':{SEED}'), id) - 1)
                 % 5 AS INTEGER) AS kfold
  FROM qa
),
aug AS (
  SELECT id, kfold, language,
    list_filter(['de', 'en', 'es', 'fr'], lambda x: x <> language)[CAST(id % 3 + 1 AS INTEGER)] AS via_lang,
    context,
    CASE WHEN {_bt_apply('answer')} AND id % 5 = 0 THEN answer_text || ' x' ELSE answer_text END AS answer_text
  FROM folded
)"""], """
SELECT id, via_lang, coalesce(contains(context, answer_text), FALSE) AS kept,
       CASE WHEN contains(context, answer_text) THEN CAST(instr(context, answer_text) - 1 AS BIGINT) END AS answer_start,
       kfold
FROM aug"""))
def q_back_translate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 + X5 + P3 + A3: back-translation through a translation memory, then keep
    rows whose answer still occurs and re-locate it; augmented rows keep their fold."""
    f = stratified_kfold(X.qa(spark, sf_dir), 5, "language", SEED)
    mem = X.memory(f)
    aug = AU.back_translate(f, mem, BT_PROB, SEED)
    kept, rejected = keep_if_answer_in_context(aug)
    kept = relocate_answer(kept).withColumn("kept", F.lit(True))
    rejected = rejected.withColumn("answer_start", F.lit(None).cast("bigint")).withColumn("kept", F.lit(False))
    return kept.unionByName(rejected).select("id", "via_lang", "kept", "answer_start", "kfold")


# --- ST1, ST2: streaming ------------------------------------------------------------------

from spanlake.streaming import meter as ST  # noqa: E402


@register("stream_meter", """
SELECT event_type, round(avg(value), 6) AS avg, count(*) AS count, round(max(value), 6) AS max,
       round(min(value), 6) AS min FROM events GROUP BY event_type""")
def q_stream_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the events table as a file stream, per-type meter in complete mode."""
    return ST.run_complete_to_table(ST.stream_meter(ST.file_stream(spark, sf_dir, "events")), spark, "stream-meter")


@register("stream_align", O.with_ctes(QA_BASE + [
    "repaired AS (SELECT id, CASE WHEN claimed_start >= 0 AND substr(context, CAST(claimed_start + 1 AS INTEGER), "
    "CAST(length(answer_text) AS INTEGER)) = answer_text THEN 'exact' "
    "WHEN claimed_start >= 1 AND substr(context, CAST(claimed_start AS INTEGER), "
    "CAST(length(answer_text) AS INTEGER)) = answer_text THEN 'off_by_1' "
    "WHEN claimed_start >= 2 AND substr(context, CAST(claimed_start - 1 AS INTEGER), "
    "CAST(length(answer_text) AS INTEGER)) = answer_text THEN 'off_by_2' ELSE 'unmatched' END AS repair FROM qa)"],
    "SELECT id, repair FROM repaired"))
def q_stream_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: documents as a file stream -> qa examples -> offset repair, parquet sink."""
    return ST.run_append_to_table(ST.stream_align(ST.file_stream(spark, sf_dir, "documents")), spark, "stream-align")


@register("stream_meter_windows", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(arg_max(value, event_id), 6) AS last,
       round(sum(value * (1 + event_id % 4)) / sum(1 + event_id % 4), 6) AS avg,
       round(sum(value * (1 + event_id % 4)), 6) AS sum, CAST(sum(1 + event_id % 4) AS BIGINT) AS count,
       round(greatest(max(value), 0.0), 6) AS max, round(least(min(value), 100000.0), 6) AS min
FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def q_stream_meter_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 in event time: weighted meter per day and type, update mode, state dropped behind the watermark."""
    e = ST.file_stream(spark, sf_dir, "events").withColumn("val", F.col("value")).withColumn("n", (F.lit(1) + F.col("event_id") % 4).cast("bigint"))
    rows = ST.run_each_batch(ST.stream_window_meter(e), spark, scratch_dir(spark, "stream-windows"), mode="update")
    rows = ST.latest_rows(rows, ["window", "event_type"])
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86400).cast("int")).cast("string")
    return rows.select(day.alias("day"), *[c for c in rows.columns if c != "window"])


@register("stream_decode", O.with_ctes(QA_BASE + O.decode_ctes("qa", W, DC), "SELECT id, prediction, score FROM pred"))
def q_stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 and J1 on a stream: each micro-batch of documents is featurised, scored and decoded."""
    decoded = ST.run_each_batch(ST.file_stream(spark, sf_dir, "documents"), spark, scratch_dir(spark, "stream-decode"),
                                lambda batch: lexical_predictions(X.qa_from_documents(batch), W, DC))
    return decoded.drop("batch")
