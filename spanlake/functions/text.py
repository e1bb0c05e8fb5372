"""Scalar text expressions (all JVM-side column expressions, no Python UDFs).

Whitespace follows Python's ``str.split()``: Unicode white space, which Java
regular expressions only give with the ``(?U)`` flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regular expressions (Java syntax).
WS_RUN = r"(?U)\s+"
# One token together with the white space in front of it: the running sum of
# piece lengths is the token's end offset.
TOKEN_PIECE = r"(?U)\s*\S+"
TOKEN = r"(?U)\S+"
LEADING_WS = r"(?U)^\s+"
# Unicode White_Space, which (?U)\\s matches (Python's own notion has four control characters more)
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pieces(text) -> Column:
    """Whitespace-prefixed token pieces of a string (empty array for blank text)."""
    return F.regexp_extract_all(col(text), F.lit(TOKEN_PIECE), 0)


def words(text) -> Column:
    """``text.split()``: non-empty whitespace-separated words, in order."""
    return F.filter(F.split(col(text), WS_RUN), lambda x: x != "")


def word_set(text) -> Column:
    """``set(text.lower().split())`` as a distinct array."""
    return F.array_distinct(words(F.lower(col(text))))


def jaccard(a, b) -> Column:
    """Word-set Jaccard of two strings; NULL when both are blank (0/0)."""
    sa, sb = word_set(a), word_set(b)
    inter = F.size(F.array_intersect(sa, sb))
    return F.try_divide(inter, F.size(sa) + F.size(sb) - inter)


def lstrip(text) -> Column:
    """``str.lstrip()`` (Unicode white space, unlike ``ltrim``)."""
    return F.regexp_replace(col(text), LEADING_WS, "")


def slice_text(text, start, end) -> Column:
    """``text[start:end]`` for 0-based, half-open code-point offsets (start >= 0)."""
    return F.substr(col(text), col(start) + 1, col(end) - col(start))


def hash_unit(*parts) -> Column:
    """Deterministic pseudo-random integer in [0, 2^32) from key parts (seeded order key).

    ``md5`` of the ':'-joined parts, first 8 hex digits as an integer; the same
    value in any engine that has md5, so it is reproducible and partition-independent.
    """
    key = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def order_key(*parts) -> Column:
    """Seeded shuffle key: md5 hex string of the ':'-joined parts."""
    return F.md5(F.concat_ws(":", *[col(p).cast("string") for p in parts]))


def fold_of_path(path) -> Column:
    """The fold number at the end of a model path (any number of digits, an optional final slash); NULL without one."""
    return F.regexp_extract(col(path), r"(\d+)/?$", 1).try_cast("int")


def progress_line(epoch, seen, total, loss) -> Column:
    """A progress line of a training log: padded epoch, rows seen of the total, percentage, loss."""
    width = F.length(col(total).cast("string"))
    share = F.format_string("%3.0f", F.lit(100.0) * col(seen) / col(total))
    return F.concat(F.lit("Epoch: "), F.lpad(col(epoch).cast("string"), 2, "0"), F.lit(" ["), F.lpad(col(seen).cast("string"), width, F.lit(" ")), F.lit("/"),
                    col(total).cast("string"), F.lit(" ("), share, F.lit("%)], Train Loss: "), F.format_string("%4.5f", col(loss)))
