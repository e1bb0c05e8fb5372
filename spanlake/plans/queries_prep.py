"""Data-preparation queries: sources (S1-S3), alignment (A1-A5, P3, P8, P9, P11, P12),
folds / unions / ranks (W2, W5, P1, P7, U1, U6, F8, F10, P10, G2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.config import TEST_WINDOW
from spanlake.operators import align as A
from spanlake.operators import folds as FO
from spanlake.operators.features import feature_table, project_features
from spanlake.operators.windows import window_spans
from spanlake.plans import fixtures as X
from spanlake.plans import oracle as O
from spanlake.plans.catalog import register
from spanlake.session import scratch_dir
from spanlake.sources import files as S
from spanlake.sources.tables import table

W = TEST_WINDOW
QA_BASE = [O.TOK, O.QA]
SEED = FO.MAIN_FOLD_SEED
K = 5
VALID_FOLD = 0

# --- sources --------------------------------------------------------------------

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@register("scan_csv_roundtrip", "SELECT doc_id, n_chars, md5(text) AS text_md5 FROM documents")
def q_scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents -> quoted multi-line CSV -> read back with a declared schema."""
    path = scratch_dir(spark, "csv")
    S.write_csv(table(spark, sf_dir, "documents"), path)
    back = S.read_qa_csv(spark, path, DOC_SCHEMA)
    return back.select("doc_id", "n_chars", F.md5("text").alias("text_md5"))


@register("squad_flatten", O.with_ctes(QA_BASE, """
SELECT CAST(id AS VARCHAR) AS id, question, answer_text, answer_start FROM qa"""))
def q_squad_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples -> nested QA JSON (with unanswerable questions) -> flattened answers."""
    path = scratch_dir(spark, "squad")
    S.write_squad_json(X.qa(spark, sf_dir), path)
    return S.read_squad_json(spark, path).select("id", "question", "answer_text", "answer_start")


# --- alignment ------------------------------------------------------------------

def _shift_ok(shift: int) -> str:
    return (f"(claimed_start - {shift} >= 0 AND substr(context, CAST(claimed_start - {shift} + 1 AS INTEGER), "
            f"CAST(length(answer_text) AS INTEGER)) = answer_text)")


REPAIR_SQL = f"""
repaired AS (
  SELECT id,
    CASE WHEN {_shift_ok(0)} THEN claimed_start WHEN {_shift_ok(1)} THEN claimed_start - 1
         WHEN {_shift_ok(2)} THEN claimed_start - 2 END AS answer_start,
    CASE WHEN {_shift_ok(0)} THEN 'exact' WHEN {_shift_ok(1)} THEN 'off_by_1'
         WHEN {_shift_ok(2)} THEN 'off_by_2' ELSE 'unmatched' END AS repair,
    length(answer_text) AS alen
  FROM qa
)"""


@register("align_repair", O.with_ctes(QA_BASE + [REPAIR_SQL], """
SELECT id, answer_start, answer_start + alen AS answer_end, repair FROM repaired"""))
def q_align_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = X.qa(spark, sf_dir).select("id", "context", "answer_text", "claimed_start")
    return A.repair_answer_offsets(qa).select("id", "answer_start", "answer_end", "repair")


@register("align_audit", O.with_ctes(QA_BASE + [REPAIR_SQL], "SELECT repair, count(*) AS n FROM repaired GROUP BY repair"))
def q_align_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = X.qa(spark, sf_dir).select("id", "context", "answer_text", "claimed_start")
    return A.alignment_audit(A.repair_answer_offsets(qa))


@register("relocate_first", O.with_ctes(QA_BASE, """
SELECT id, CAST(instr(context, answer_text) - 1 AS BIGINT) AS answer_start,
       CAST(instr(context, answer_text) - 1 AS BIGINT) <> answer_start AS moved FROM qa"""))
def q_relocate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = X.qa(spark, sf_dir).select("id", "context", "answer_text", F.col("answer_start").alias("given"))
    r = A.relocate_answer(qa)
    return r.select("id", "answer_start", (F.col("answer_start") != F.col("given")).alias("moved"))


@register("relocate_bench", O.with_ctes([O.QA_BENCH], "SELECT id, answer_start FROM qa_bench"))
def q_relocate_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 / J9 on the containment join of documents and benchmark passages."""
    return A.relocate_answer(X.qa_bench(spark, sf_dir).drop("answer_start")).select("id", "answer_start")


def _altered(qa: DataFrame) -> DataFrame:
    # every fifth answer is changed so that it usually no longer occurs in the context
    return qa.withColumn("answer_text", F.when(F.col("id") % 5 == 0, F.concat("answer_text", F.lit(" x")))
                         .otherwise(F.col("answer_text")))


@register("answer_containment", O.with_ctes(QA_BASE, """
SELECT id, coalesce(contains(context, CASE WHEN id % 5 = 0 THEN answer_text || ' x' ELSE answer_text END), FALSE) AS kept FROM qa"""))
def q_answer_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = _altered(X.qa(spark, sf_dir))
    kept, rejected = A.keep_if_answer_in_context(qa)
    return kept.select("id", F.lit(True).alias("kept")).unionByName(rejected.select("id", F.lit(False).alias("kept")))


@register("occurrence_lists", O.with_ctes(QA_BASE + [r"""
occ AS (
  SELECT id, needle, CASE WHEN needle = '' THEN [context] ELSE string_split(context, needle) END AS parts FROM (
    SELECT id, context, coalesce(answer_text, '') AS needle FROM qa
    UNION ALL SELECT -1 - id, context, regexp_extract(coalesce(answer_text, ''), '\S+') FROM qa) q
)"""], """
SELECT id, CAST(len(parts) - 1 AS INTEGER) AS n_occ,
  array_to_string(list_transform(range(1, len(parts)),
     lambda i: CAST(list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(needle) AS VARCHAR)), ',')
  AS positions
FROM occ"""))
def q_occurrence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the answer in its context, and (ids ``-1 - id``) its first word, which may occur many times."""
    first = F.regexp_extract("answer_text", r"(?U)\S+", 0)
    each = F.explode(F.array(F.struct(F.col("id").alias("id"), F.col("answer_text").alias("needle")), F.struct((-1 - F.col("id")).alias("id"), first.alias("needle"))))
    qa = X.qa(spark, sf_dir).select("context", each.alias("x")).select("x.*", "context")
    occ = A.all_occurrences(qa, text_col="needle")
    return occ.select("id", F.size("answer_start_list").alias("n_occ"),
                      F.array_join(F.col("answer_start_list").cast("array<string>"), ",").alias("positions"))


@register("answers_struct", O.with_ctes(QA_BASE + [O.QA_CONV], """
SELECT 'd' || CAST(id AS VARCHAR) AS id, CASE WHEN answer_start IS NULL THEN 0 ELSE 1 END AS n_answers, CAST(answer_start AS INTEGER) AS first_start,
       answer_text AS first_text FROM qa
UNION ALL
SELECT 'c' || CAST(id AS VARCHAR) AS id, 0 AS n_answers, CAST(NULL AS INTEGER) AS first_start,
       CAST(NULL AS VARCHAR) AS first_text FROM qa_conv"""))
def q_answers_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 + P12: answer structs; conversation pairs have no answer (empty arrays)."""
    a = X.qa(spark, sf_dir).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"),
                                   "answer_start", "answer_text")
    c = X.qa_conv(spark, sf_dir).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"))
    s = A.to_answers_struct(FO.union_examples(a, c))
    return s.select(
        "id", F.size("answers.answer_start").alias("n_answers"),
        F.try_element_at(F.col("answers.answer_start"), F.lit(1)).alias("first_start"),
        F.try_element_at(F.col("answers.text"), F.lit(1)).alias("first_text"))


@register("question_trim", O.with_ctes(QA_BASE, r"""
SELECT id, regexp_replace(CASE WHEN id % 2 = 0 THEN chr(9) || '  ' || question ELSE question END, '^\s+', '')
       AS question FROM qa"""))
def q_question_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = X.qa(spark, sf_dir)
    padded = qa.withColumn("question", F.when(F.col("id") % 2 == 0, F.concat(F.lit("\t  "), "question"))
                           .otherwise(F.col("question")))
    return A.trim_question(padded).select("id", "question")


@register("language_code", O.with_ctes(QA_BASE, """
SELECT CASE WHEN language IS NOT DISTINCT FROM 'en' THEN 0 ELSE 1 END AS code, count(*) AS n FROM qa GROUP BY 1"""))
def q_language_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 + G2: primary language vs everything else."""
    e = A.encode_language(X.qa(spark, sf_dir), "en")
    return e.groupBy(F.col("lang_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


# --- folds, unions, ranks ---------------------------------------------------------

FOLDS_SQL = f"""
folded AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY language ORDER BY md5(CAST(id AS VARCHAR) || ':{SEED}'), id) - 1)
                 % {K} AS INTEGER) AS kfold
  FROM qa
)"""

EXT_SQL = """
ext AS (
  SELECT 'ext-' || CAST(row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS VARCHAR) AS id,
         language, context, CAST(NULL AS VARCHAR) AS question, answer_text, answer_start, -1 AS kfold,
         'external' AS source
  FROM qa_bench
),
combined AS (
  SELECT CAST(id AS VARCHAR) AS id, language, context, question, answer_text, answer_start, kfold, 'main' AS source
  FROM folded
  UNION ALL SELECT * FROM ext
)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.stratified_kfold(X.qa(spark, sf_dir), K, "language", SEED)


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = _folded(spark, sf_dir).withColumn("id", F.col("id").cast("string")).withColumn("source", F.lit("main"))
    ext = FO.assign_ids(X.qa_bench(spark, sf_dir), ["id"])
    ext = FO.with_constant_fold(ext).withColumn("source", F.lit("external"))
    return FO.union_examples(main, ext)


@register("stratified_folds", O.with_ctes(QA_BASE + [FOLDS_SQL], "SELECT id, language, kfold FROM folded"))
def q_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("id", "language", "kfold")


@register("fold_sizes", O.with_ctes(QA_BASE + [FOLDS_SQL],
                                    "SELECT language, kfold, count(*) AS n FROM folded GROUP BY language, kfold"))
def q_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).groupBy("language", "kfold").agg(F.count(F.lit(1)).alias("n"))


@register("external_union", O.with_ctes(QA_BASE + [O.QA_BENCH, FOLDS_SQL, EXT_SQL],
                                        "SELECT id, language, kfold, source FROM combined"))
def q_external_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir).select("id", "language", "kfold", "source")


@register("train_valid_split", O.with_ctes(QA_BASE + [O.QA_BENCH, FOLDS_SQL, EXT_SQL], f"""
SELECT CASE WHEN coalesce(kfold, -1) = {VALID_FOLD} THEN 'valid' ELSE 'train' END AS split, count(*) AS n
FROM combined GROUP BY 1"""))
def q_train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.coalesce("kfold", F.lit(FO.EXTERNAL_FOLD)) == VALID_FOLD, "valid").otherwise("train")
    return _combined(spark, sf_dir).groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@register("unique_ids", O.with_ctes(QA_BASE + [O.QA_BENCH, FOLDS_SQL, EXT_SQL],
                                    "SELECT count(*) AS n, count(DISTINCT id) AS n_distinct FROM combined"))
def q_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.id_uniqueness(_combined(spark, sf_dir))


WIN_SQL = O.logits_ctes("folded", W, False)[:2]


@register("window_counts_by_split", O.with_ctes(QA_BASE + [FOLDS_SQL] + WIN_SQL, f"""
SELECT CASE WHEN f.kfold = {VALID_FOLD} THEN 'valid' ELSE 'train' END AS split, count(*) AS n_windows
FROM wins w JOIN folded f ON w.id = f.id GROUP BY 1"""))
def q_window_counts_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: windows per split (fold 0 held out)."""
    f = _folded(spark, sf_dir)
    spans = window_spans(f, W).join(f.select("id", "kfold"), "id")
    split = F.when(F.col("kfold") == VALID_FOLD, "valid").otherwise("train")
    return spans.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n_windows"))


FEATURE_SQL = O.with_ctes(QA_BASE + [FOLDS_SQL] + O.logits_ctes("folded", W, False)[:4] + [f"""
lab AS (
  SELECT w.id, w.fid, f.kfold,
         CASE WHEN min(w.ts) <= f.answer_start AND max(w.te) >= f.answer_end
              THEN max(CASE WHEN w.ts <= f.answer_start THEN w.pos END) ELSE 0 END AS start_position
  FROM wtok w JOIN folded f ON w.id = f.id
  GROUP BY w.id, w.fid, f.kfold, f.answer_start, f.answer_end
)"""], f"""
SELECT 'train' AS split, 'train' AS mode, count(*) AS n_rows, count(*) FILTER (WHERE start_position <> 0) AS n_labelled
FROM lab WHERE kfold <> {VALID_FOLD}
UNION ALL
SELECT 'valid', 'valid', count(*), count(*) FILTER (WHERE start_position <> 0) FROM lab WHERE kfold = {VALID_FOLD}
UNION ALL
SELECT 'valid', 'test', count(*), CAST(NULL AS BIGINT) FROM lab WHERE kfold = {VALID_FOLD}""")


@register("feature_projection", FEATURE_SQL)
def q_feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 + F11: the feature table per split in the three projection modes.

    ``train`` keeps ids/mask/offsets/labels, ``valid`` adds sequence ids and the
    example key, ``test`` drops the labels; counted here as rows and labelled rows.
    """
    f = _folded(spark, sf_dir)
    feats = feature_table(_with_chars(f), W, keep=("kfold",)).where(F.array_contains("sequence_ids", 1))
    split = F.when(F.col("kfold") == VALID_FOLD, "valid").otherwise("train")
    counts = feats.groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("start_position") != 0, 1)).alias("n_labelled"))
    read_by = F.when(F.col("split") == "valid", F.array(F.lit("valid"), F.lit("test"))).otherwise(F.array(F.lit("train")))
    modes = counts.select("split", "n_rows", "n_labelled", F.explode(read_by).alias("mode"))
    return modes.select("split", "mode", "n_rows", F.when(F.col("mode") != "test", F.col("n_labelled")).alias("n_labelled"))


def _with_chars(examples: DataFrame) -> DataFrame:
    return examples.withColumn("start_char", F.col("answer_start")).withColumn("end_char", F.col("answer_end"))


FEATURE_TABLE_SQL = O.with_ctes(QA_BASE + O.logits_ctes("qa", W, False)[:4] + [r"""
qtok AS (
  SELECT id, list(tok ORDER BY pos) AS qt, list((te - length(tok)) || ':' || te ORDER BY pos) AS qo FROM (
    SELECT id, pos, regexp_extract(piece, '\S+') AS tok,
           CAST(sum(length(piece)) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS te
    FROM (SELECT id, unnest(x) AS piece, generate_subscripts(x, 1) - 1 AS pos
          FROM (SELECT id, regexp_extract_all(question, '\s*\S+') AS x FROM qa) q0) q1) q2 GROUP BY id
)""", """
feat AS (
  SELECT w.id, w.fid, count(c.p) AS n, coalesce(list(c.tok ORDER BY c.p) FILTER (WHERE c.p IS NOT NULL), []) AS ct,
         coalesce(list(c.ts || ':' || c.te ORDER BY c.p) FILTER (WHERE c.p IS NOT NULL), []) AS co,
         CASE WHEN min(c.ts) <= min(f.answer_start) AND max(c.te) >= min(f.answer_end)
              THEN max(CASE WHEN c.ts <= f.answer_start THEN c.pos END) ELSE 0 END AS start_position,
         CASE WHEN min(c.ts) <= min(f.answer_start) AND max(c.te) >= min(f.answer_end)
              THEN min(CASE WHEN c.te >= f.answer_end THEN c.pos END) ELSE 0 END AS end_position
  FROM wins w JOIN qa f ON w.id = f.id LEFT JOIN wtok c ON c.id = w.id AND c.fid = w.fid GROUP BY w.id, w.fid
)"""], f"""
SELECT w.id AS example_id, CAST(w.fid AS INTEGER) AS feature_idx,
  md5(array_to_string(list_concat(list_concat(['<s>'], coalesce(q.qt, [])), list_concat(list_concat(['</s>'], w.ct), ['</s>']),
      list_transform(range({W.max_len - W.n_special} - g.q_len - w.n), lambda i: '<pad>')), ' ')) AS tokens_md5,
  md5(repeat('1', CAST(g.q_len + w.n + {W.n_special} AS INTEGER)) || repeat('0', CAST({W.max_len - W.n_special} - g.q_len - w.n AS INTEGER))) AS mask_md5,
  md5(array_to_string(list_concat(list_concat(['0:0'], coalesce(q.qo, [])), list_concat(list_concat(['0:0'], w.co), ['0:0']),
      list_transform(range({W.max_len - W.n_special} - g.q_len - w.n), lambda i: '0:0')), ' ')) AS offsets_md5,
  md5(repeat('0', CAST(g.q_len + 2 AS INTEGER)) || repeat('1', CAST(w.n AS INTEGER))
      || repeat('0', CAST({W.max_len - W.n_special + 1} - g.q_len - w.n AS INTEGER))) AS sequence_md5,
  CAST(start_position AS INTEGER) AS start_position, CAST(end_position AS INTEGER) AS end_position,
  md5(f.context) AS context_md5, md5(f.question) AS question_md5
FROM feat w JOIN geo g ON g.id = w.id JOIN qa f ON f.id = w.id LEFT JOIN qtok q ON q.id = w.id""")


@register("feature_table", FEATURE_TABLE_SQL)
def q_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 + F3 + F9 + P10: the ``valid`` projection of the feature table, every column by content."""
    feats = project_features(feature_table(_with_chars(X.qa(spark, sf_dir)), W), "valid", keep=("feature_idx",))
    offsets = F.transform("offset_mapping", lambda o: F.concat_ws(":", o["start"].cast("string"), o["end"].cast("string")))
    return feats.select(
        "example_id", "feature_idx", F.md5(F.concat_ws(" ", "tokens")).alias("tokens_md5"),
        F.md5(F.concat_ws("", F.col("attention_mask").cast("array<string>"))).alias("mask_md5"),
        F.md5(F.concat_ws(" ", offsets)).alias("offsets_md5"),
        F.md5(F.concat_ws("", F.col("sequence_ids").cast("array<string>"))).alias("sequence_md5"),
        "start_position", "end_position", F.md5("context").alias("context_md5"), F.md5("question").alias("question_md5"))


BATCH = 16


@register("epoch_batches", O.with_ctes(QA_BASE + WIN_SQL[:0] + O.logits_ctes("qa", W, False)[:2], f"""
SELECT id, CAST(fid AS INTEGER) AS feature_idx, CAST(epoch AS INTEGER) AS epoch,
       CAST(floor((row_number() OVER (PARTITION BY epoch ORDER BY
             md5(CAST(id AS VARCHAR) || ':' || CAST(fid AS VARCHAR) || ':' || CAST(epoch AS VARCHAR) || ':{SEED}'),
             id, fid) - 1) / {BATCH}) AS INTEGER) AS batch
FROM wins CROSS JOIN (SELECT * FROM (VALUES (0), (1)) t(epoch)) e"""))
def q_epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 + W6: two epochs of shuffled batches of 16 windows."""
    spans = window_spans(X.qa(spark, sf_dir), W).select("id", "feature_idx")
    e0 = FO.epoch_batches(spans, 0, SEED, BATCH, ["id", "feature_idx"])
    e1 = FO.epoch_batches(spans, 1, SEED, BATCH, ["id", "feature_idx"])
    return e0.unionByName(e1)
