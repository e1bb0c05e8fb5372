"""Overlapping windows, sequence layout, span labels.

Sequence layout of one window (one CLS, two SEP, ``n_special = 3``)::

    pos 0         CLS
    pos 1..Q      question tokens
    pos Q+1       SEP
    pos Q+2..     context tokens p = win_start .. win_end-1  (pos = Q + 2 + p - win_start)
    then          SEP, then padding up to max_len

Only the context is cut (``only_second``): ``capacity = max_len - Q - n_special``
context tokens per window, consecutive windows overlap by ``stride`` tokens
(``step = capacity - stride``) and there are ``1 + ceil(max(0, n - capacity) / step)``
windows.  Window membership of a token is arithmetic (no range join): token
``p`` is in windows ``floor((p - capacity) / step) + 1 .. floor(p / step)``
clipped to ``[0, n_windows - 1]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.config import WindowConfig
from spanlake.functions.arrays import evaluated, first_above, span
from spanlake.functions.text import TOKEN, lstrip
from spanlake.operators.tokens import tokenize, with_tokens


def _ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - F.lit(1)) / b).cast("int")


def with_geometry(examples: DataFrame, cfg: WindowConfig, with_context: bool = False) -> DataFrame:
    """Adds ``q_toks, q_len, n_ctx, capacity, step, n_windows`` per example (and ``ctx_toks``, counted instead of the text).

    The question is left-stripped first (P11).  Examples whose question leaves
    no room for ``stride`` (``step <= 0``) get ``n_windows = 0``.
    """
    q_toks = F.regexp_extract_all(lstrip(F.col("question")), F.lit(TOKEN), 0)
    if with_context:
        out = evaluated(examples, q_toks=q_toks, ctx_toks=F.regexp_extract_all(F.col("context"), F.lit(TOKEN), 0))
        out = out.withColumn("n_ctx", F.when(F.col("ctx_toks").isNotNull(), F.size("ctx_toks")))
    else:
        out = evaluated(examples, q_toks=q_toks, n_ctx=F.regexp_count(F.col("context"), F.lit(TOKEN)))
    out = (
        out.withColumn("q_len", F.size("q_toks"))
        .withColumn("capacity", F.lit(cfg.max_len - cfg.n_special) - F.col("q_len"))
        .withColumn("step", F.col("capacity") - F.lit(cfg.stride))
    )
    n_win = F.when(
        F.col("step") > 0,
        F.lit(1) + _ceil_div(F.greatest(F.col("n_ctx") - F.col("capacity"), F.lit(0)), F.col("step")),
    ).otherwise(F.lit(0))
    return out.withColumn("n_windows", n_win)


def window_spans(examples: DataFrame, cfg: WindowConfig) -> DataFrame:
    """``id, feature_idx, first_pos, last_pos`` (context token indices, inclusive).

    A window over an empty context has ``last_pos = first_pos - 1``.
    """
    g = with_geometry(examples, cfg)
    return (
        g.where(F.col("n_windows") > 0)
        .select("id", "n_ctx", "capacity", "step",
                F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)).alias("feature_idx"))
        .select(
            "id",
            "feature_idx",
            (F.col("feature_idx") * F.col("step")).alias("first_pos"),
            (F.least(F.col("feature_idx") * F.col("step") + F.col("capacity"), F.col("n_ctx")) - 1).alias("last_pos"),
        )
    )


def explode_windows(toks: DataFrame) -> DataFrame:
    """Token rows (with geometry columns) -> one row per (window, token).

    Adds ``feature_idx, p`` (context token index), ``win_start, win_end``
    (exclusive) and ``pos`` (position in the assembled sequence).
    """
    lo = F.greatest(F.floor((F.col("pos") - F.col("capacity")) / F.col("step")).cast("int") + 1, F.lit(0))
    hi = F.least(F.floor(F.col("pos") / F.col("step")).cast("int"), F.col("n_windows") - 1)
    return (
        toks.select("*", F.explode(F.sequence(lo, hi)).alias("feature_idx"))
        .withColumnRenamed("pos", "p")
        .withColumn("win_start", F.col("feature_idx") * F.col("step"))
        .withColumn("win_end", F.least(F.col("win_start") + F.col("capacity"), F.col("n_ctx")))
        .withColumn("pos", F.col("q_len") + F.lit(2) + F.col("p") - F.col("win_start"))
    )


def windowed_tokens(examples: DataFrame, cfg: WindowConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """F1 + F2: one row per (window, context token).

    Columns: ``id, feature_idx, p, pos, tok, ts, te, win_start, win_end, q_len``
    (+ ``keep``); ``pos`` is the position in the assembled sequence (F3).
    ``examples`` should already be partitioned by ``id``.
    """
    g = with_geometry(examples, cfg)
    toks = tokenize(g, "id", "context", keep=("q_len", "n_ctx", "capacity", "step", "n_windows", *keep),
                    with_piece=True)
    return explode_windows(toks.where(F.col("n_windows") > 0))


def assembled_lengths(examples: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Per window ``q_len, ctx_len, pad_len`` and the attention-mask length.

    ``real_len = q_len + ctx_len + n_special`` tokens carry mask 1, the remaining
    ``pad_len = max_len - real_len`` carry 0 (``padding='max_length'``).
    """
    spans = window_spans(examples, cfg)
    g = with_geometry(examples, cfg).select("id", "q_len")
    return (
        spans.join(g, "id")
        .withColumn("ctx_len", F.col("last_pos") - F.col("first_pos") + 1)
        .withColumn("pad_len", F.lit(cfg.max_len - cfg.n_special) - F.col("q_len") - F.col("ctx_len"))
        .select("id", "feature_idx", "q_len", "ctx_len", "pad_len")
    )


def sequence_arrays(examples: DataFrame, cfg: WindowConfig, cls: str = "<s>", sep: str = "</s>",
                    pad: str = "<pad>", keep: tuple[str, ...] = ()) -> DataFrame:
    """the assembled token sequence per window as arrays.

    ``tokens``, ``attention_mask`` and ``sequence_ids`` (0 for CLS/question/SEP/pad,
    1 for context); ``keep`` carries example-level columns onto every window.
    """
    # a text is cut once, not once a window, and a window takes only its own tokens along
    g = with_geometry(examples, cfg, with_context=True)
    g = g.where(F.col("n_windows") > 0).select("id", *keep, "q_toks", "q_len", "n_ctx", "capacity", "step", "n_windows", "ctx_toks")

    def window(i: Column) -> Column:
        ws = i * F.col("step")
        n = F.least(ws + F.col("capacity"), F.col("n_ctx")) - ws
        return F.struct(i.alias("feature_idx"), n.alias("ctx_len"), F.slice(F.col("ctx_toks"), ws + 1, n).alias("ctx"))

    w = g.select("id", *keep, "q_toks", "q_len", F.inline_outer(F.transform(F.sequence(F.lit(0), F.col("n_windows") - 1), window)))
    ctx = F.col("ctx")
    real = F.col("q_len") + F.col("ctx_len") + F.lit(cfg.n_special)
    n_pad = F.greatest(F.lit(cfg.max_len) - real, F.lit(0))
    seq = F.concat(F.array(F.lit(cls)), F.col("q_toks"), F.array(F.lit(sep)), ctx, F.array(F.lit(sep)),
                   F.array_repeat(F.lit(pad), n_pad))
    seq_ids = F.concat(
        F.array_repeat(F.lit(0), F.col("q_len") + 2),
        F.array_repeat(F.lit(1), F.col("ctx_len")),
        F.array_repeat(F.lit(0), n_pad + 1),
    )
    mask = F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), n_pad))
    return w.select("id", "feature_idx", seq.alias("tokens"), mask.alias("attention_mask"),
                    seq_ids.alias("sequence_ids"), *keep)


def window_labels(wtoks: DataFrame) -> DataFrame:
    """``start_position, end_position`` per window; CLS (0) when not fully covered.

    ``wtoks`` are window tokens carrying the example's answer as ``start_char``
    and ``end_char`` (NULL start = no answer, P12).  The window covers the
    answer iff its first context token starts at or before ``start_char`` and
    its last ends at or after ``end_char``; then start = last context token
    with ``ts <= start_char`` and end = first context token with
    ``te >= end_char``.  (The reference's start scan can run past the context
    into padding when the answer starts at the last context token; here it
    stays inside the context.)  One aggregate keyed by ``(id, feature_idx)``,
    which the ``id`` partitioning already satisfies.
    """
    agg = wtoks.groupBy("id", "feature_idx", "start_char", "end_char").agg(
        F.min("ts").alias("_cmin"),
        F.max("te").alias("_cmax"),
        F.max(F.when(F.col("ts") <= F.col("start_char"), F.col("pos"))).alias("_s"),
        F.min(F.when(F.col("te") >= F.col("end_char"), F.col("pos"))).alias("_e"),
    )
    covered = (F.col("start_char").isNotNull() & (F.col("_cmin") <= F.col("start_char"))
               & (F.col("_cmax") >= F.col("end_char")))
    return agg.select(
        "id",
        "feature_idx",
        F.when(covered, F.col("_s")).otherwise(F.lit(0)).cast("int").alias("start_position"),
        F.when(covered, F.col("_e")).otherwise(F.lit(0)).cast("int").alias("end_position"),
    )


def label_windows(examples: DataFrame, cfg: WindowConfig) -> DataFrame:
    """F2 + F5 inside the row: ``id, feature_idx, start_position, end_position`` of every window with context tokens.

    Same rule as ``window_labels``; ``examples`` has ``id, context, question,
    start_char, end_char``.  The answer's first and last token are found once per
    example by binary search, a window only shifts and clips them, so nothing is
    exploded to tokens, shuffled or grouped, and rows that repeat an id stay apart.
    """
    g = with_tokens(with_geometry(examples, cfg))
    g = g.withColumns({"_s": first_above(F.col("ts"), F.col("start_char")) - 1, "_e": first_above(F.col("te"), F.col("end_char") - 1)})
    w = g.select("id", "start_char", "end_char", "q_len", "n_ctx", "capacity", "step", "ts", "te", "_s", "_e",
                 # outer: a filter that Spark infers from a plain explode would be computed again below, from the raw texts
                 F.explode_outer(span(F.lit(0), F.col("n_windows"))).alias("feature_idx"))
    w = w.withColumn("ws", F.col("feature_idx") * F.col("step")).withColumn("we", F.least(F.col("ws") + F.col("capacity"), F.col("n_ctx"))).where("we > ws")
    covered = (F.col("start_char").isNotNull() & (F.get("ts", F.col("ws")) <= F.col("start_char")) & (F.get("te", F.col("we") - 1) >= F.col("end_char")))
    at = lambda i: F.when(covered, F.col("q_len") + 2 + i - F.col("ws")).otherwise(F.lit(0)).cast("int")
    return w.select("id", "feature_idx", at(F.least("_s", F.col("we") - 1)).alias("start_position"), at(F.greatest("_e", F.col("ws"))).alias("end_position"))
