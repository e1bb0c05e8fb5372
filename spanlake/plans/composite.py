"""Composite plans: featurise -> score -> decode -> evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.session import shuffle_partitions
from spanlake.config import DecodeConfig, WindowConfig
from spanlake.operators.decode import decode_windows, sweep_best, window_topk, with_predictions
from spanlake.operators.metrics import mean_by_language, with_jaccard
from spanlake.operators.scoring import lexical_answers, lexical_logits, lexical_sweep, lexical_windows, texts_of_ids


def partition_examples(examples: DataFrame, n: int | None = None) -> DataFrame:
    """The one shuffle of the decode chain: ``id, context, question`` by ``id``.

    Tokens, windows, top-n, candidates and the best-span aggregate are all
    keyed by ``id`` (or finer), so they reuse this partitioning.  The partition
    count is explicit: the work after this shuffle is about a hundred times the
    shuffled bytes (text -> windowed tokens), so letting AQE coalesce by
    shuffled size would leave too few tasks.
    """
    return examples.select("id", "context", "question").repartition(n or shuffle_partitions(examples), "id")


def lexical_logits_for(examples: DataFrame, wcfg: WindowConfig, dcfg: DecodeConfig) -> DataFrame:
    return lexical_logits(partition_examples(examples), wcfg, include_special=not dcfg.mask_before_topk)


def lexical_windows_for(examples: DataFrame, wcfg: WindowConfig, dcfg: DecodeConfig, paired: str | None = None, through: tuple = ()) -> DataFrame:
    """``id, windows``: the ranked windows of every id in one row (``through``: steps between scoring and ranking)."""
    return lexical_windows(partition_examples(examples), wcfg, dcfg, paired, through)


def lexical_topk_for(examples: DataFrame, wcfg: WindowConfig, dcfg: DecodeConfig, paired: str | None = None) -> DataFrame:
    """F1 -> F2 -> M2 -> W1 (-> J4): one row per window."""
    return lexical_windows_for(examples, wcfg, dcfg, paired).select("id", F.inline("windows"))


def lexical_answers_for(examples: DataFrame, wcfg: WindowConfig, dcfg: DecodeConfig, k: int) -> DataFrame:
    """F1 -> F2 -> M2 -> W1 -> J4 -> T5: ``id, rk, text, score``."""
    return lexical_answers(partition_examples(examples), wcfg, dcfg, k).select("id", F.inline("answers"))


def lexical_sweep_for(examples: DataFrame, wcfg: WindowConfig, dcfg: DecodeConfig, grid: list[tuple[int, int]]) -> DataFrame:
    """F1 -> F2 -> M2 -> W1 -> G6: ``id, swept``: the best span for the points of a grid that has its maxima in ``dcfg`` (null ids give none).

    An id of one text is scored, ranked and swept in its row.  Texts that share
    an id meet by their positions: each window collects those once, for all points.
    """
    part = partition_examples(examples.where(F.col("id").isNotNull()))  # one shuffle for both: the join by id would filter only one side
    alone = lexical_sweep(part, wcfg, dcfg, grid, shared=False)
    several = texts_of_ids(part).where(F.size("texts") > 1).select("id", F.inline("texts"))
    best = sweep_best(window_topk(lexical_logits(several, wcfg, include_special=not dcfg.mask_before_topk), dcfg.n_best, dcfg.mask_before_topk), grid)
    met = best.groupBy("id").agg(F.collect_list(F.struct("n_best", "max_len", "score", "prediction")).alias("swept"))
    return alone.unionByName(met)


def lexical_predictions(examples: DataFrame, wcfg: WindowConfig, dcfg: DecodeConfig,
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """F1 -> F2 -> M2 -> W1 -> J4 -> G4 -> J1: ``id, prediction, score`` (+ keep) per example."""
    preds = decode_windows(lexical_windows_for(examples, wcfg, dcfg, "best"))
    return with_predictions(examples, preds, keep)


def eval_by_language(examples: DataFrame, wcfg: WindowConfig, dcfg: DecodeConfig) -> DataFrame:
    """Flagship: mean Jaccard of decoded spans overall and per language."""
    preds = lexical_predictions(examples, wcfg, dcfg, keep=("language", "answer_text"))
    return mean_by_language(with_jaccard(preds))
