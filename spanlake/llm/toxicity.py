"""Operator 5: toxicity categories by a chain of linear classifiers.

Categories are predicted in a stated order.  Each has a logistic model with an
L1 penalty over the set of hashed words and word beginnings of the whole text, and over the
probabilities of the categories before it.  For training, those probabilities
are out-of-fold: a row's value comes from a model that has not seen the row, so
a later model learns how far to trust what it will get in use.  The models of
one category (one per fold and the final one) are fitted side by side in Spark
tasks on a bounded sample of labelled rows; scoring is a sum of weights per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm import tables as TA
from spanlake.llm import textbytes as TB

BUCKETS = 1 << 17
STEPS = 250
BEGINNINGS = (4, 5)  # bytes


def word_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each row, and beginnings of words (inflected forms share them): row numbers (ascending) and terms."""
    low = TB.LOWER[data]
    starts, ends, rows = TB.words(low, offsets, TB.NO_WORD)
    sums = TB.prefix_sums(low)
    parts = [rows * BUCKETS + (TB.span_hash(sums, starts, ends) % TB.U64(BUCKETS)).astype(np.int64)]
    for k in BEGINNINGS:
        long = ends - starts > k
        begin = TB.mix(TB.span_hash(sums, starts[long], starts[long] + k) + TB.U64(k))
        parts.append(rows[long] * BUCKETS + (begin % TB.U64(BUCKETS)).astype(np.int64))
    both = np.unique(np.concatenate(parts))
    return both // BUCKETS, both % BUCKETS


@dataclass(frozen=True)
class Linear:
    """Logistic model over word terms and earlier probabilities."""

    bias: float
    words: np.ndarray
    earlier: np.ndarray

    def prob(self, rows: np.ndarray, terms: np.ndarray, before: np.ndarray) -> np.ndarray:
        z = self.bias + np.bincount(rows, self.words[terms], minlength=len(before)) + before @ self.earlier
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, terms: np.ndarray, before: np.ndarray, label: np.ndarray, penalty: float) -> Linear:
    """Accelerated proximal steps with a separate step size for every weight (a diagonal bound on the curvature)."""
    n, k = before.shape
    if not n or label.min() == label.max():
        return Linear(30.0 * (2 * label[0] - 1) if n else -30.0, np.zeros(BUCKETS), np.zeros(k))
    seen = np.bincount(terms, minlength=BUCKETS)
    use = np.flatnonzero(seen >= 3)
    place = np.full(BUCKETS, -1)
    place[use] = np.arange(len(use))
    at = place[terms]
    rows, at = rows[at >= 0], at[at >= 0]
    width = np.bincount(rows, minlength=n) + before.sum(axis=1) + 1.0
    curve = np.concatenate(([width.sum()], np.bincount(at, width[rows], minlength=len(use)), before.T @ width)) / (4 * n)
    curve = np.maximum(curve, 1e-9)
    shrink = np.concatenate(([0.0], np.full(len(use), penalty), np.zeros(k))) / curve
    w, look, t = np.zeros(len(curve)), np.zeros(len(curve)), 1.0
    for _ in range(STEPS):
        z = look[0] + np.bincount(rows, look[1:1 + len(use)][at], minlength=n) + before @ look[1 + len(use):]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        grad = np.concatenate(([err.sum()], np.bincount(at, err[rows], minlength=len(use)), before.T @ err)) / n
        new = look - grad / curve
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    weight = np.zeros(BUCKETS)
    weight[use] = w[1:1 + len(use)]
    return Linear(float(w[0]), weight, w[1 + len(use):])


def sample_rows(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text_col: str, sample: int, folds: int) -> DataFrame:
    """At most ``sample`` labelled rows as ``rid, fold, terms`` and the labels: the first in order of a hash of the id."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*(F.max(c).cast("int").alias(c) for c in categories))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    rows = rows.select(F.xxhash64("_id").alias("rid"), F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(folds)).cast("int").alias("fold"), *categories, "_text")
    names = [*rows.columns[:-1], "terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in TB.slices(batch.column(len(names) - 1)):
                r, term = word_terms(data, offsets)
                at = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]),
                                                  pa.ListArray.from_arrays(pa.array(at), pa.array(term.astype(np.int32)))], names=names)

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("terms", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).dropDuplicates(["rid"])


def fit_category(rows: DataFrame, folds: int, penalty: float) -> DataFrame:
    """Fits of one category: ``rid, prob`` of held-out rows, and one row with the final model's weights.

    ``rows``: ``rid, fold, label`` (null: not used for fitting), ``before``
    (earlier probabilities), ``terms``.  Model ``folds`` is the final one.
    """
    each = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds).cast("long"))).alias("model"), "rid", "fold", "label", "before", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in TA.sorted_groups(batches):
            model = group.column(0)[0].as_py()
            group = group.take(pa.array(np.argsort(group.column(1).to_numpy(), kind="stable")))
            fold = group.column(2).to_numpy()
            label = group.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            lists = group.column(5)
            row = np.repeat(np.arange(len(fold)), np.diff(lists.offsets.to_numpy()))
            term = lists.flatten().to_numpy().astype(np.int64)
            before = np.array(group.column(4).to_pylist(), np.float64).reshape(len(fold), -1)
            use = (fold != model) & ~np.isnan(label)
            number = np.cumsum(use) - 1
            keep = use[row]
            lin = fit(number[row[keep]], term[keep], before[use], label[use], penalty)
            if model < folds:
                held = fold == model
                prob = lin.prob(row, term, before)[held]
                yield pa.RecordBatch.from_arrays([group.column(1).filter(pa.array(held)), pa.array(prob), pa.nulls(len(prob), pa.binary())], names=["rid", "prob", "model"])
            else:
                packed = np.concatenate(([lin.bias], lin.earlier, lin.words)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0.0]), pa.array([packed], pa.binary())], names=["rid", "prob", "model"])

    return each.repartition(folds + 1, "model").sortWithinPartitions("model").mapInArrow(run, "rid long, prob double, model binary")


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], *, id_col: str = "doc_id", text_col: str = "text",
                sample: int = 8000, folds: int = 3, penalty: float = 2e-4) -> list[tuple[str, Linear]]:
    """The chain's models in order, fitted on at most ``sample`` labelled rows; ``labels`` has a 0/1 column per category."""
    rows = TA.written(sample_rows(docs, labels, categories, id_col, text_col, sample, folds), "toxicity-sample")
    before, chain = F.array().cast("array<double>"), []
    rows = rows.withColumn("before", before)
    for c in categories:
        fits = TA.written(fit_category(rows.withColumn("label", F.col(c)), folds, penalty), "toxicity-fits")
        packed = fits.where(F.col("model").isNotNull()).first()
        k = len(chain)
        values = np.frombuffer(bytes(packed["model"]), np.float64) if packed else np.concatenate(([-30.0], np.zeros(k + BUCKETS)))
        chain.append((c, Linear(float(values[0]), values[1 + k:], values[1:1 + k])))
        held = fits.where(F.col("model").isNull()).select("rid", "prob")
        rows = rows.join(held, "rid").withColumn("before", F.concat("before", F.array("prob"))).drop("prob")
    return chain


def score_chain(docs: DataFrame, chain: list[tuple[str, Linear]], *, text_col: str = "text") -> DataFrame:
    """The input with ``p_<category>`` for every category of the chain.

    A null text counts as empty; repeated rows score alike; an empty table gives
    no rows; input columns with the added names are replaced, others pass
    through.  A chain trained without labels gives nearly 0 for every category.
    The broadcast holds ``BUCKETS`` weights per category.
    """
    added = [f"p_{c}" for c, _ in chain]
    docs = docs.drop(*added)
    at = docs.columns.index(text_col)
    models = docs.sparkSession.sparkContext.broadcast([m for _, m in chain])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((0, len(added)))]
            for lo, hi, data, offsets in TB.slices(batch.column(at)):
                rows, terms = word_terms(data, offsets)
                probs = np.zeros((hi - lo, 0))
                for m in models.value:
                    probs = np.column_stack((probs, m.prob(rows, terms, probs)))
                out.append(probs)
            probs = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(probs[:, i]) for i in range(len(added)))], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(a, T.DoubleType()) for a in added)]))
