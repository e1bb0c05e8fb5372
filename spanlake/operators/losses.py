"""Losses as evaluation aggregates (no autograd), and their scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import let
from spanlake.operators.folds import nth_value

SMOOTH = 1e-4


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(arr: Column) -> Column:
    """Max-shifted softmax of a numeric array."""
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v), lambda z: F.transform(e, lambda v: v / z))

    return let(arr, lambda a: let(F.array_max(a), lambda m: let(F.transform(a, lambda v: F.exp(v - m)), shares)))


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("double"))


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum."""
    return F.array_position(arr, F.array_max(arr)) - 1


def window_score_stats(logits: DataFrame, scale: float = 1000.0, with_labels: bool = False) -> DataFrame:
    """Per window: positions with ``xs, xe`` scaled scores and their log-sum-exp and argmax.

    With ``with_labels`` the rows carry the example's ``start_char, end_char``
    and the F5 span labels (``start_position, end_position``; 0 = CLS when the
    window does not cover the answer) come out of the same aggregate.
    """
    keys = ["id", "feature_idx"] + (["start_char", "end_char"] if with_labels else [])
    aggs = [F.collect_list(F.struct(
        "pos", (F.col("start_logit") / scale).alias("xs"), (F.col("end_logit") / scale).alias("xe"))).alias("_a")]
    if with_labels:
        ctx = F.col("is_context")
        aggs += [F.min(F.when(ctx, F.col("ts"))).alias("_cmin"), F.max(F.when(ctx, F.col("te"))).alias("_cmax"),
                 F.max(F.when(ctx & (F.col("ts") <= F.col("start_char")), F.col("pos"))).alias("_sp"),
                 F.min(F.when(ctx & (F.col("te") >= F.col("end_char")), F.col("pos"))).alias("_ep")]
    g = logits.groupBy(*keys).agg(*aggs)
    if with_labels:
        covered = (F.col("start_char").isNotNull() & (F.col("_cmin") <= F.col("start_char"))
                   & (F.col("_cmax") >= F.col("end_char")))
        g = (g.withColumn("start_position", F.when(covered, F.col("_sp")).otherwise(F.lit(0)).cast("int"))
             .withColumn("end_position", F.when(covered, F.col("_ep")).otherwise(F.lit(0)).cast("int"))
             .drop("_cmin", "_cmax", "_sp", "_ep", "start_char", "end_char"))

    def lse(side: str) -> Column:
        # the maximum is taken once a window, not once a position
        return let(F.array_max(F.transform("_a", lambda x: x[side])),
                   lambda m: m + F.log(F.aggregate("_a", F.lit(0.0), lambda acc, x: acc + F.exp(x[side] - m))))

    def first_argmax(side: str) -> Column:
        # highest score, lowest position first
        best = F.array_max(F.transform("_a", lambda x: F.struct(x[side].alias("v"), (-x["pos"]).alias("np"))))
        return -best["np"]

    extra = ["start_position", "end_position"] if with_labels else []
    return g.select("id", "feature_idx", "_a", lse("xs").alias("lse_s"), lse("xe").alias("lse_e"),
                    first_argmax("xs").alias("arg_s"), first_argmax("xe").alias("arg_e"), *extra)


def _at(arr: str, pos: Column, side: str) -> Column:
    """Score at a position; NULL where the window has no such position."""
    return F.get(F.filter(arr, lambda x: x["pos"] == pos), F.lit(0))[side]


def span_cross_entropy(stats: DataFrame, labels: DataFrame | None = None, ignore_index: int | None = None) -> DataFrame:
    """G12 per window: ``ce = 0.5 * CE(start) + 0.5 * CE(end)``, ``CE = lse(x) - x[label]``.

    Labels come from ``stats`` (``with_labels``) or a separate label table
    joined on ``(id, feature_idx)``.  Adds ``ce_s, ce_e, loss``; average
    ``loss`` over rows for the batch mean.  A label equal to ``ignore_index``, or
    at no position of the window, gives NULL, which averages leave out.
    """
    j = stats if labels is None else stats.join(labels, ["id", "feature_idx"])
    ce_s = F.col("lse_s") - _at("_a", F.col("start_position"), "xs")
    ce_e = F.col("lse_e") - _at("_a", F.col("end_position"), "xe")
    if ignore_index is not None:
        ce_s = F.when(F.col("start_position") != ignore_index, ce_s)
        ce_e = F.when(F.col("end_position") != ignore_index, ce_e)
    return j.withColumn("ce_s", ce_s).withColumn("ce_e", ce_e).withColumn("loss", 0.5 * F.col("ce_s") + 0.5 * F.col("ce_e"))


def distance_weights(pred_pos: Column, label: Column, neg_weight: float = 1.0, pos_weight: float = 1.0) -> Column:
    """G13 weight: ``-neg_w * gap`` when the prediction is before the label, else ``pos_w * gap``."""
    gap = (pred_pos - label).cast("double")
    return F.when(gap < 0, -neg_weight * gap).otherwise(pos_weight * gap)


def distance_weighted(ce: DataFrame, neg_weight: float = 1.0, pos_weight: float = 1.0) -> DataFrame:
    """G13 per window: ``ws = CE(start) * w(start gap)``, ``we`` likewise (mean each, then add)."""
    return (ce.withColumn("ws", F.col("ce_s") * distance_weights(F.col("arg_s"), F.col("start_position"), neg_weight,
                                                                pos_weight))
            .withColumn("we", F.col("ce_e") * distance_weights(F.col("arg_e"), F.col("end_position"), neg_weight,
                                                               pos_weight)))


def dice_binary(df: DataFrame, p: str, y: str, mask: str | None = None, alpha: Column | float = 0.0,
                square: bool = False, smooth: float = SMOOTH, group: list[str] | None = None, with_logits: bool = False) -> DataFrame:
    """``1 - (2 sum(p'y) + s) / (sum(p') + sum(y) + s)`` with ``p' = (1-p)^alpha * p``.

    ``mask`` multiplies both inputs first; ``square`` uses sums of squares in
    the denominator; ``with_logits`` applies the sigmoid to ``p`` first.  One
    aggregate (per ``group``).
    """
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    pm = (sigmoid(F.col(p).cast("double")) if with_logits else F.col(p).cast("double")) * m
    ym = F.col(y).cast("double") * m
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    pp = F.pow(F.lit(1.0) - pm, a) * pm
    den = (F.sum(pp * pp) + F.sum(ym * ym)) if square else (F.sum(pp) + F.sum(ym))
    loss = F.lit(1.0) - (F.lit(2.0) * F.sum(pp * ym) + smooth) / (den + smooth)
    return df.groupBy(*(group or [])).agg(loss.alias("loss"))


def dice_multiclass(df: DataFrame, logits: str, label: str, k: int, smooth: float = SMOOTH, alpha: float = 0.0,
                    square: bool = False, mask: str | None = None) -> DataFrame:
    """Adds ``loss = sum_c 1 - (2 p'_ic y_ic + s) / (P_c + Y_c + s)`` to every row.

    ``p`` is the softmax of ``logits``, ``p' = (1-p)^alpha * p``, ``y`` the one-hot
    ``label``; ``mask`` (0/1) multiplies both; ``P_c``/``Y_c`` are class totals
    over all rows (of squares with ``square``), ``2 k`` sums in one aggregate
    read as a scalar subquery.  Rows are never grouped, so equal rows stay
    apart; reduce ``loss`` with ``avg`` (mean) or ``sum``, or keep it (none).
    """
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    p = F.transform(softmax(F.col(logits)), lambda v: F.pow(F.lit(1.0) - v * m, F.lit(alpha)) * v * m)
    y = F.transform(one_hot(F.col(label), k), lambda v: v * m)
    x = df.withColumn("_p", p).withColumn("_y", y)
    power = (lambda c: c * c) if square else (lambda c: c)
    tot = x.agg(F.array(*(F.sum(power(F.col("_p")[c])) + F.sum(power(F.col("_y")[c])) for c in range(k))).alias("t"))
    x = x.withColumn("_t", tot.scalar())
    terms = F.zip_with(F.arrays_zip("_p", "_y"), "_t", lambda z, t: F.lit(1.0) - (F.lit(2.0) * z["_p"] * z["_y"] + smooth) / (t + smooth))
    return x.withColumn("loss", F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)).drop("_p", "_y", "_t")


def hard_negatives(df: DataFrame, is_pos: Column, score: str, ratio: float, key: str) -> DataFrame:
    """G16 (OHEM): keep every positive and the ``floor(n_pos * ratio)`` highest-scoring negatives.

    Adds ``kept``.  The cut-off score is found exactly from grouped counts
    (``folds.nth_value``); all negatives above it stay, and of those equal to it
    the ones with the smallest (numeric, unique) keys.  No rank over all rows.
    """
    d = df.withColumn("_pos", F.coalesce(is_pos, F.lit(False)))
    neg = d.where(~F.col("_pos"))
    k = int(d.where("_pos").count() * ratio)
    cut = nth_value(neg, score, k, descending=True)
    if k < 1:
        keep = F.lit(False)
    elif cut is None:
        keep = F.lit(True)
    else:
        value, above = cut
        last, _ = nth_value(neg.where(F.col(score) == F.lit(value)), key, k - above)
        keep = (F.col(score) > F.lit(value)) | ((F.col(score) == F.lit(value)) & (F.col(key) <= F.lit(last)))
    return d.withColumn("kept", F.col("_pos") | F.coalesce(keep, F.lit(False))).drop("_pos")


def hard_negatives_by_class(df: DataFrame, logits: str, label: str, k: int, ratio: float, key: str) -> DataFrame:
    """G16, multi-class: adds ``kept_0 .. kept_{k-1}``.

    Class ``c`` keeps its positives (label ``c``) and the
    ``floor(n_pos * ratio / k)`` other rows with the highest probability of
    ``c`` among those whose arg-max is ``c``.
    """
    out = df.withColumn("_p", softmax(F.col(logits)))
    for c in range(k):
        mine = out.where((F.col(label) == c) | (argmax("_p") == c)).withColumn("_s", F.col("_p")[c])
        kept = hard_negatives(mine, F.col(label) == c, "_s", ratio / k, key).where("kept").select(F.col(key).alias("_k"), F.lit(True).alias(f"kept_{c}"))
        out = out.join(kept, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(f"kept_{c}", F.coalesce(f"kept_{c}", F.lit(False)))
    return out.drop("_p")
