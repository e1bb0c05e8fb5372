"""Schemas and operator parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The labelled example table: one row per question.
QA_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer_text", T.StringType()),
        T.StructField("answer_start", T.IntegerType()),
        T.StructField("language", T.StringType()),
    ]
)


@dataclass(frozen=True)
class WindowConfig:
    """Overlapping-window featurisation (question + context in one sequence).

    ``capacity = max_len - q_len - n_special`` context tokens per window and
    consecutive windows overlap by ``stride`` tokens, so ``step = capacity - stride``.
    """

    max_len: int = 400
    stride: int = 135
    n_special: int = 3  # one CLS and two SEP

    def __post_init__(self):
        if self.stride < 0 or self.max_len <= self.n_special:
            raise ValueError("need stride >= 0 and max_len > n_special")


@dataclass(frozen=True)
class DecodeConfig:
    """n-best span decoding.

    ``mask_before_topk=False`` reproduces the reference: question and CLS
    positions take part in the top-n ranking and only afterwards are dropped.
    """

    n_best: int = 20
    max_answer_len: int = 30
    mask_before_topk: bool = False


# Settings used by the correctness queries (small windows so that documents
# really split into many overlapping windows at the test scale).
TEST_WINDOW = WindowConfig(max_len=64, stride=16, n_special=3)
TEST_DECODE = DecodeConfig(n_best=20, max_answer_len=30)
