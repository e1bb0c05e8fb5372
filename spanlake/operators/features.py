"""The feature table, one nested row per window, built inside the example's row.

Tokens, offsets and labels of all windows come from the token arrays of one
pass over the texts; a window carries slices of them, so an example's work is
the length of its windows, nothing is exploded to tokens, shuffled or joined,
and rows that repeat an id stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.config import WindowConfig
from spanlake.functions.arrays import first_above, span
from spanlake.functions.text import lstrip
from spanlake.operators.tokens import with_tokens
from spanlake.operators.windows import with_geometry

MODES = {
    "train": ["tokens", "attention_mask", "offset_mapping", "start_position", "end_position"],
    "valid": ["tokens", "attention_mask", "offset_mapping", "sequence_ids", "start_position", "end_position",
              "example_id", "context", "question"],
    "test": ["tokens", "attention_mask", "offset_mapping", "sequence_ids", "id", "context", "question"],
}


def _offsets(starts: Column, ends: Column) -> Column:
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def feature_table(examples: DataFrame, cfg: WindowConfig, keep: tuple[str, ...] = (), cls: str = "<s>",
                  sep: str = "</s>", pad: str = "<pad>") -> DataFrame:
    """``examples (id, context, question, start_char, end_char)`` -> one row per window.

    Columns: ``example_id, feature_idx, context, question`` (left-stripped, P11),
    the arrays ``tokens``, ``attention_mask``, ``offset_mapping`` (structs
    ``start, end`` in the question or the context; 0, 0 for CLS, SEP and padding)
    and ``sequence_ids`` (1 for the context, else 0), each ``max_len`` long, the
    labels ``start_position, end_position`` (0 where the window does not cover
    the answer, or there is none: NULL ``start_char``), and ``keep``.

    A blank context gives one window without context tokens; a NULL context or
    question counts as blank for tokens and stays NULL in its column; a question
    that leaves no room for the stride gives no window.
    """
    x = examples.select(
        F.col("id").alias("example_id"), F.col("context"), lstrip("question").alias("question"), "start_char", "end_char",
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("_keep"),
        F.coalesce("context", F.lit("")).alias("_c"), F.coalesce(lstrip("question"), F.lit("")).alias("_q"))
    names = ["example_id", "start_char", "end_char", "_keep", "context", "question"]
    q = with_tokens(x, "_q").select(*names, "_c", "_q", F.col("ts").alias("q_ts"), F.col("te").alias("q_te"))
    g = with_geometry(q.withColumns({"_context": F.col("context"), "_question": F.col("question"), "context": F.col("_c"), "question": F.col("_q")}), cfg)
    g = with_tokens(g, "context").withColumns({
        "_s": first_above(F.col("ts"), F.col("start_char")) - 1,
        "_e": first_above(F.col("te"), F.col("end_char") - 1),
    })

    def window(i: Column) -> Column:
        ws = i * F.col("step")
        n = F.least(ws + F.col("capacity"), F.col("n_ctx")) - ws
        part = lambda c: F.slice(c, ws + 1, n)
        return F.struct(i.alias("feature_idx"), ws.alias("ws"), n.alias("n"), part("toks").alias("toks"),
                        part("ts").alias("ts"), part("te").alias("te"))

    w = g.select("example_id", "start_char", "end_char", "_keep", F.col("_context").alias("context"), F.col("_question").alias("question"),
                 "q_toks", "q_ts", "q_te", "q_len", "_s", "_e",
                 # outer: a filter that Spark infers from a plain explode would be computed again below, from the raw texts
                 F.explode_outer(F.transform(span(F.lit(0), F.col("n_windows")), window)).alias("w")).where("w is not null")
    n = F.col("w.n")
    n_pad = F.greatest(F.lit(cfg.max_len - cfg.n_special) - F.col("q_len") - n, F.lit(0))
    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    covered = F.col("start_char").isNotNull() & (F.get("w.ts", F.lit(0)) <= F.col("start_char")) & (F.get("w.te", n - 1) >= F.col("end_char"))
    at = lambda i: F.when(covered, F.col("q_len") + 2 + i - F.col("w.ws")).otherwise(F.lit(0)).cast("int")
    return w.select(
        "example_id",
        F.col("w.feature_idx").alias("feature_idx"),
        "context",
        "question",
        F.concat(F.array(F.lit(cls)), F.col("q_toks"), F.array(F.lit(sep)), F.col("w.toks"), F.array(F.lit(sep)),
                 F.array_repeat(F.lit(pad), n_pad)).alias("tokens"),
        F.concat(F.array_repeat(F.lit(1), F.col("q_len") + n + F.lit(cfg.n_special)), F.array_repeat(F.lit(0), n_pad)).alias("attention_mask"),
        F.concat(F.array(none), _offsets(F.col("q_ts"), F.col("q_te")), F.array(none), _offsets(F.col("w.ts"), F.col("w.te")),
                 F.array_repeat(none, n_pad + 1)).alias("offset_mapping"),
        F.concat(F.array_repeat(F.lit(0), F.col("q_len") + 2), F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), n_pad + 1)).alias("sequence_ids"),
        at(F.least("_s", F.col("w.ws") + n - 1)).alias("start_position"),
        at(F.greatest("_e", F.col("w.ws"))).alias("end_position"),
        *[F.col("_keep")[c].alias(c) for c in keep],
    )


def project_features(features: DataFrame, mode: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """P10: the columns that ``train``, ``valid`` or ``test`` reads (+ ``keep``).

    ``valid`` adds sequence ids, the example's key and its texts to ``train``;
    ``test`` has them without labels, the key named ``id``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return features.withColumn("id", F.col("example_id")).select(*MODES[mode], *[c for c in keep if c not in MODES[mode]])
