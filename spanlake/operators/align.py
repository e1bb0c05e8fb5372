"""Answer alignment and row-level repairs.

All of these are narrow column expressions (no shuffle), so they also run
unchanged on streaming DataFrames (ST2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import prefix_sums

from spanlake.functions.text import lstrip

# Repair classes, in the order the shifts are tried.
REPAIR_CLASSES = ("exact", "off_by_1", "off_by_2")
UNMATCHED = "unmatched"


def _slice_eq(context: Column, start: Column, text: Column) -> Column:
    return (start >= 0) & (F.substr(context, start + 1, F.length(text)) == text)


def repair_answer_offsets(df: DataFrame, start_col: str = "claimed_start", text_col: str = "answer_text",
                          context_col: str = "context", max_shift: int = 2) -> DataFrame:
    """A1 + A4: try the claimed start, then start-1, start-2 (first equal slice wins).

    Adds ``answer_start``, ``answer_end`` (``start + len(text)``) and ``repair``
    (``exact``, ``off_by_1``, ``off_by_2`` or ``unmatched``; unmatched rows get
    NULL offsets instead of failing later).  Shifts below 0 never match.
    """
    ctx, txt, s = F.col(context_col), F.col(text_col), F.col(start_col)
    start = F.lit(None).cast("bigint")
    repair = F.lit(UNMATCHED)
    for shift in range(max_shift, -1, -1):
        ok = _slice_eq(ctx, s - shift, txt)
        start = F.when(ok, (s - shift).cast("bigint")).otherwise(start)
        repair = F.when(ok, F.lit("exact" if shift == 0 else f"off_by_{shift}")).otherwise(repair)
    return (
        df.withColumn("answer_start", start)
        .withColumn("answer_end", F.col("answer_start") + F.length(txt))
        .withColumn("repair", repair)
    )


def alignment_audit(repaired: DataFrame) -> DataFrame:
    """A5: rows per repair class."""
    return repaired.groupBy("repair").agg(F.count(F.lit(1)).alias("n"))


def relocate_answer(df: DataFrame, text_col: str = "answer_text", context_col: str = "context") -> DataFrame:
    """A3: ``answer_start = context.find(answer_text)`` (-1 when absent)."""
    return df.withColumn("answer_start", (F.instr(F.col(context_col), F.col(text_col)) - 1).cast("bigint"))


def keep_if_answer_in_context(df: DataFrame, text_col: str = "answer_text", context_col: str = "context",
                              ) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)``: rows whose answer is / is not a substring of the context."""
    inside = F.col(context_col).contains(F.col(text_col))
    return df.where(inside), df.where(~inside | inside.isNull())


def all_occurrences(df: DataFrame, text_col: str = "answer_text", context_col: str = "context",
                    id_col: str = "id") -> DataFrame:
    """A2: all non-overlapping, left-to-right start offsets of the answer in the context.

    The context is split at the answer taken literally; occurrence ``i`` starts
    where the pieces before it and ``i`` answers end.  Row-local: one output row
    per input row, no shuffle.  Returns ``id, answer_start_list array<bigint>``
    (empty for an empty or missing answer).
    """
    needle, ctx = F.col(text_col), F.coalesce(F.col(context_col), F.lit(""))
    literal = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    parts = F.when(needle.isNull() | (needle == ""), F.array(ctx)).otherwise(F.split(ctx, literal, -1))
    # the last piece follows the last occurrence; occurrence i ends where the pieces up to it and i answers end
    size = F.length(needle)
    ends = prefix_sums(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda part: F.length(part) + size))
    found = F.transform(ends, lambda e: (e - size).cast("bigint"))
    hits = F.when(needle.isNull() | (needle == ""), F.array().cast("array<bigint>")).otherwise(found)
    return df.select(id_col, hits.alias("answer_start_list"))


def to_answers_struct(df: DataFrame, start_col: str = "answer_start", text_col: str = "answer_text") -> DataFrame:
    """P8 + P12: ``answers = {answer_start: [s], text: [t]}``; a missing answer gives empty arrays."""
    has = F.col(start_col).isNotNull() & F.col(text_col).isNotNull()
    return df.withColumn("answers", F.struct(
        F.when(has, F.array(F.col(start_col).cast("int"))).otherwise(F.array().cast("array<int>")).alias("answer_start"),
        F.when(has, F.array(F.col(text_col))).otherwise(F.array().cast("array<string>")).alias("text"),
    ))


def encode_language(df: DataFrame, primary: str, lang_col: str = "language", out: str = "lang_code") -> DataFrame:
    """0 for the primary language, 1 for everything else (NULL included)."""
    return df.withColumn(out, F.when(F.col(lang_col).eqNullSafe(F.lit(primary)), 0).otherwise(1))


def trim_question(df: DataFrame, col: str = "question") -> DataFrame:
    """Strip leading (Unicode) white space of the question."""
    return df.withColumn(col, lstrip(col))
