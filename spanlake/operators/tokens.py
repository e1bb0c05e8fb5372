"""Whitespace tokens with code-point offsets, pair truncation, char -> token.

Tokens are maximal runs of non-white-space; offsets are 0-based, half-open
``[ts, te)`` in code points, so ``substr(text, ts + 1, te - ts) == tok``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.arrays import first_above, prefix_sums
from spanlake.functions.text import TOKEN, pieces


def with_tokens(df: DataFrame, text_col: str = "context") -> DataFrame:
    """F1 inside the row: adds ``pieces``, ``toks``, ``ts`` and ``te``, the token arrays of a text (empty for a blank one).

    A token's end is the running sum of the lengths of the white-space-prefixed
    pieces, so nothing is exploded or shuffled, and rows that repeat an id stay
    apart.  Meant for look-ups (``char_to_token``): array functions are
    interpreted, so work on every token is cheaper on the rows of ``tokenize``.
    """
    df = df.withColumn("pieces", pieces(text_col))
    df = df.withColumns({
        "toks": F.transform("pieces", lambda p: F.regexp_extract(p, TOKEN, 0)),
        "te": prefix_sums(F.transform("pieces", F.length)),
    })
    return df.withColumn("ts", F.zip_with("te", "toks", lambda e, t: e - F.length(t)))


def tokenize(df: DataFrame, id_col: str = "id", text_col: str = "context", keep: tuple[str, ...] = (),
             with_piece: bool = False, outer: bool = False, with_row: bool = False) -> DataFrame:
    """one row per token: ``id, pos, tok, ts, te`` (+ ``keep`` columns).

    The running sum of the whitespace-prefixed piece lengths is each token's
    end offset.  The window is keyed by ``id``; partition the input by ``id``
    first (``repartition``) so that the shuffle moves whole texts, not tokens.
    With ``outer`` a text without tokens gives one row of NULLs; ``with_row``
    adds the tag that tells apart rows that repeat an id (``_row``).
    """
    # the row tag keeps the offsets of rows that repeat an id apart
    w = Window.partitionBy(id_col, "_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_row", F.monotonically_increasing_id())
        .select(id_col, *keep, "_row", (F.posexplode_outer if outer else F.posexplode)(pieces(text_col)).alias("pos", "piece"))
        .withColumn("te", F.sum(F.length("piece")).over(w).cast("int"))
        .withColumn("tok", F.regexp_extract("piece", TOKEN, 0))
        .select(id_col, *keep, "pos", "tok", (F.col("te") - F.length("tok")).alias("ts"), "te",
                *(["piece"] if with_piece else []), *(["_row"] if with_row else []))
    )


def token_count(text) -> F.Column:
    return F.size(pieces(text))


def longest_first(df: DataFrame, budget: int, a_col: str = "context", b_col: str = "question",
                  n_special: int = 3) -> DataFrame:
    """``truncation=True`` (longest first) for a pair, in closed form.

    With ``T = budget - n_special`` tokens for both texts: if both fit they are
    kept; otherwise, with ``s`` the shorter length, the shorter side keeps ``s``
    and the longer ``T - s`` when ``2s <= T``, else the shorter keeps
    ``floor(T/2)`` and the longer ``floor(T/2) + T % 2``.  On equal lengths the
    first text counts as the shorter one.  Adds ``a_kept`` and ``b_kept``.
    """
    la, lb = token_count(F.col(a_col)), token_count(F.col(b_col))
    t = budget - n_special
    short, long_ = F.least(la, lb), F.greatest(la, lb)
    fits = (short + long_) <= t
    short_keep = F.when(short * 2 <= t, short).otherwise(F.lit(t // 2))
    long_keep = F.when(short * 2 <= t, F.lit(t) - short).otherwise(F.lit(t // 2 + t % 2))
    a_longer = la > lb
    a_keep = F.when(fits, la).when(a_longer, long_keep).otherwise(short_keep)
    b_keep = F.when(fits, lb).when(a_longer, short_keep).otherwise(long_keep)
    return df.withColumn("a_kept", a_keep.cast("int")).withColumn("b_kept", b_keep.cast("int"))


def char_to_token(df: DataFrame, char_cols: list[str], sentinel: int, text_col: str = "context", kept: str | None = None) -> DataFrame:
    """Adds ``<char>_token``, the token whose ``[ts, te)`` holds a character offset.

    A binary search in the row's sorted token ends; no tokens are exploded or
    joined.  Characters on white space, outside the text, NULL, or in a token
    beyond the first ``kept`` (a column, for truncated texts) get ``sentinel``.
    """
    names = df.columns
    t = with_tokens(df, text_col) if not {"ts", "te"} & set(names) else df
    for c in char_cols:
        t = t.withColumn("_i", first_above(F.col("te"), F.col(c)))
        inside = (F.get("ts", F.col("_i")) <= F.col(c)) & (F.col(c) >= 0)
        if kept:
            inside = inside & (F.col("_i") < F.col(kept))
        t = t.withColumn(f"{c}_token", F.when(inside, F.col("_i")).otherwise(F.lit(sentinel)))
    return t.select(*names, *[f"{c}_token" for c in char_cols])
