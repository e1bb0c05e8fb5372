"""Ensembles over per-model predictions.

``preds``: ``id, member, text`` (+ ``score`` / ``start_tok`` / ``end_tok``).
``member`` is an integer; a lower member wins ties (the first model in the
ensemble list), so every vote has a total order without relying on the
engine's choice of mode.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hard_vote(preds: DataFrame, value: str = "text", member: str = "member") -> DataFrame:
    """Most frequent answer per id (``id, text, votes``); ties -> earliest member.

    Partial aggregation on ``(id, text)`` runs before the shuffle, so a
    popular answer does not concentrate raw rows in one task.
    """
    g = preds.groupBy("id", value).agg(F.count(F.lit(1)).alias("votes"), F.min(member).alias("_first"))
    b = g.groupBy("id").agg(F.max_by(F.struct(value, "votes"), F.struct("votes", -F.col("_first"))).alias("b"))
    return b.select("id", F.col(f"b.{value}").alias(value), F.col("b.votes").alias("votes"))


def score_vote(preds: DataFrame, member: str = "member") -> DataFrame:
    """Per id, sum the scores of equal answers and keep the best (``id, text, score``)."""
    g = preds.groupBy("id", "text").agg(F.sum("score").alias("score"), F.min(member).alias("_first"))
    b = g.groupBy("id").agg(F.max_by(F.struct("text", "score"), F.struct("score", -F.col("_first"))).alias("b"))
    return b.select("id", "b.text", F.col("b.score").cast("double").alias("score"))


def start_end_vote(preds: DataFrame, member: str = "member") -> DataFrame:
    """Vote start and end token separately, then pair them (``id, s, e``)."""
    s = hard_vote(preds.select("id", member, "start_tok"), "start_tok", member).select("id", F.col("start_tok").alias("s"))
    e = hard_vote(preds.select("id", member, "end_tok"), "end_tok", member).select("id", F.col("end_tok").alias("e"))
    return s.join(e, "id")


def logit_average(logits: DataFrame | pa.Table, member: str = "member") -> DataFrame | pa.Table:
    """Average start/end scores of members that share a tokenizer, per position.

    The output is a position-logits frame (decode it once).  Members are
    summed rather than averaged so integer scores stay exact; the ranking is
    the same.  Given the positions of a block of ids (a table with ``row`` for the
    id, inside a task) it sums them there.
    """
    if isinstance(logits, pa.Table):
        g = logits.group_by(["row", "feature_idx", "pos", "is_context", "ts", "te", "piece"], use_threads=False)
        sums = g.aggregate([("start_logit", "sum"), ("end_logit", "sum")])
        return sums.rename_columns([c.removesuffix("_sum") for c in sums.column_names])
    keys = ["id", "feature_idx", "pos", "is_context", "ts", "te", "tok", "piece"]
    return logits.groupBy(*keys).agg(F.sum("start_logit").alias("start_logit"), F.sum("end_logit").alias("end_logit"),
                                     F.count(F.lit(1)).alias("n_members"))


def two_level_vote(*member_preds: DataFrame) -> DataFrame:
    """Members may themselves be ensembles: union raw and ensembled members, then G7."""
    u = member_preds[0].select("id", "member", "text")
    for p in member_preds[1:]:
        u = u.unionByName(p.select("id", "member", "text"))
    return hard_vote(u)
