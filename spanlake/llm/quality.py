"""Operator 7: quality by nearest-neighbour voting in a latent semantic space.

Every whole text becomes term counts: hashed shape trigrams (letters, capitals,
digits and spaces as classes, punctuation as itself), hashed words, and soft
bins of style figures (length, share of repeated words and lines, capitals,
punctuation).  On a bounded sample of labelled rows, term weights and a
truncated singular value decomposition are fitted; the sample's latent vectors
are broadcast, and each document's exact cosine with all of them is a blocked
matrix product.  The nearest labels vote with weights that grow with
similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm import textbytes as TB

SHAPES, WORDS, STYLES, BINS = 2048, 2048, 6, 10
TERMS = SHAPES + WORDS + STYLES * BINS

_SHAPE = np.zeros(256, np.uint32)
_SHAPE[:] = np.arange(256)
_SHAPE[[*range(97, 123)]] = 1
_SHAPE[[*range(65, 91)]] = 2
_SHAPE[[*range(48, 58)]] = 3
_SHAPE[128:] = 4
_SHAPE[[9, 10, 11, 12, 13, 32]] = [5, 6, 6, 6, 6, 5]
_UPPER, _PUNCT = _SHAPE == 2, (_SHAPE > 32) & (_SHAPE < 128)


def _rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _share_new(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Share of distinct values among each row's values (1 for a row without any)."""
    total = np.bincount(rows, minlength=n_rows)
    distinct = np.unique(TB.mix(hashes + rows.astype(TB.U64) * TB.U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.where(total > 0, np.bincount(rows[distinct], minlength=n_rows) / np.maximum(total, 1), 1.0)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense counts (rows x TERMS) of a slice of texts."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    row = _rows_of(offsets)
    length = np.diff(offsets)
    if len(data) >= 3:
        s = _SHAPE[data]
        code = (s[:-2] * np.uint32(0x9E3779B1) + s[1:-1] * np.uint32(0x85EBCA77) + s[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
        own = row[:-2] == row[2:]
        out[:, :SHAPES] = np.bincount(row[:-2][own] * SHAPES + code[own], minlength=n * SHAPES).reshape(n, SHAPES)
    starts, ends, rows = TB.words(TB.LOWER[data], offsets)
    hashes = TB.span_hash(TB.prefix_sums(TB.LOWER[data]), starts, ends)
    out[:, SHAPES:SHAPES + WORDS] = np.bincount(rows * WORDS + (hashes % TB.U64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    line = np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1))
    line = np.unique(line[line < len(data)]) if len(data) else line[:0]
    line_rows = np.searchsorted(offsets, line, "right") - 1
    line_hash = TB.span_hash(TB.prefix_sums(data), line, np.append(line[1:], len(data))[:len(line)]) if len(line) else np.zeros(0, TB.U64)
    some = np.maximum(length, 1)
    count = np.maximum(np.bincount(rows, minlength=n), 1)
    figures = [np.log1p(length) / 14, _share_new(hashes, rows, n), _share_new(line_hash, line_rows, n),
               np.bincount(row, _UPPER[data], minlength=n) / some * 2, np.bincount(row, _PUNCT[data], minlength=n) / some * 4, length / count / 20]
    for i, f in enumerate(figures):
        at = np.clip(f, 0, 1) * (BINS - 1)
        low = np.minimum(at.astype(np.int64), BINS - 2)
        base = SHAPES + WORDS + i * BINS
        out[np.arange(n), base + low] = 1 - (at - low)
        out[np.arange(n), base + low + 1] = at - low
    return out


@dataclass(frozen=True)
class Voters:
    """A fitted vote: term weights, latent axes, labelled vectors and their labels."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.weight) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among each row's nearest labelled vectors (0.5 without any)."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        own, out = self.latent(counts), np.zeros(len(counts))
        for lo in range(0, len(own), 256):
            sim = own[lo:lo + 256] @ self.vectors.T
            k = min(self.neighbours, sim.shape[1])
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sim, top, axis=1), 1e-6).astype(np.float64) ** self.power
            out[lo:lo + 256] = (w * self.labels[top]).sum(axis=1) / w.sum(axis=1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Damped counts times term weights, in place; each kind of term has length 1 so that none drowns the others."""
    x = np.log1p(counts, out=counts)
    x *= weight
    for a, b, share in ((0, SHAPES, 1.0), (SHAPES, SHAPES + WORDS, 0.4), (SHAPES + WORDS, TERMS, 1.0)):
        x[:, a:b] *= share / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-12)
    return x


def fit(counts: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, power: float) -> Voters:
    """Fit on the sample's counts (overwritten): idf-like weights, then a randomised truncated SVD with a fixed seed."""
    n = len(counts)
    seen = np.count_nonzero(counts, axis=0)
    weight = (np.log((1 + n) / (1 + seen)) + 0.2).astype(np.float32)
    x = weighted(counts, weight)
    rank = min(rank, max(1, n), TERMS)
    probe = np.random.default_rng(11).standard_normal((TERMS, min(TERMS, rank + 16))).astype(np.float32)
    basis = x @ probe
    for _ in range(3):
        basis = x @ (x.T @ np.linalg.qr(basis)[0])
    _, _, vt = np.linalg.svd(np.linalg.qr(basis)[0].T @ x, full_matrices=False)
    axes = np.ascontiguousarray(vt[:rank].T)
    return Voters(weight, axes, unit(x @ axes), labels.astype(np.float64), neighbours, power)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int,
          rank: int, neighbours: int, power: float) -> Voters:
    """Fit on at most ``sample`` labelled rows of ``docs``, the first ones in order of a hash of the id."""
    rows = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(rows), F.col(id_col) == F.col("_id")).select("label", text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in TB.slices(batch.column(1)):
                c = term_counts(data, offsets)
                r, t = np.nonzero(c)
                at = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(t.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(c[r, t]))], names=["label", "term", "amount"])

    got = rows.mapInArrow(run, "label int, term array<int>, amount array<float>").toArrow()
    rows = [(t.values.to_numpy(), a.values.to_numpy()) for t, a in zip(got.column("term"), got.column("amount"), strict=True)]
    label = got.column("label").to_numpy()
    order = np.lexsort(([float(t @ a.astype(np.float64)) for t, a in rows], label))  # the same order however the rows arrive
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, j in enumerate(order):
        counts[i, rows[j][0]] = rows[j][1]
    return fit(counts, label[order], rank, neighbours, power)


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  sample: int = 4000, rank: int = 48, neighbours: int = 15, power: float = 8.0) -> DataFrame:
    """The input with ``score`` (0 to 1, higher: label 1 likelier) from a vote fitted on ``labels``.

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1; null labels are
    skipped, of a repeated id the larger label counts); at most ``sample`` of its rows are
    used, which also bounds what is broadcast (sample x rank numbers).  A null
    text counts as empty and is scored like any short text; without any label
    every score is 0.5; repeated rows score alike; an empty table gives no
    rows; an input column named ``score`` is replaced, others pass through.
    """
    voters = docs.sparkSession.sparkContext.broadcast(
        train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample, rank=rank, neighbours=neighbours, power=power))
    docs = docs.drop("score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [voters.value.score(term_counts(data, offsets)) for _, _, data, offsets in TB.slices(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(score) if score else [], pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
