"""Operator 9: Merkle fixity audit of web-archive replicas.

A replica is a set of archive files holding WARC records one after the other.
``records`` lays a page table out that way, ``manifest`` keeps each record's
file, byte offset, length and SHA-256, and ``tree`` hashes them upwards:
records of one offset range of a file, the ranges of a file, then files by
thousands up to a single root.  ``audit`` compares two replicas' roots and goes
down only into nodes whose digests differ, level by level, until it has the
damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm import tables as TA

FILE_BITS = 10            # 1,024 consecutive page ids make one file
RANGE_BYTES = 1 << 18     # bytes of a file under one leaf range
FAN_BITS = 12             # 4,096 children of an inner node at most


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id, url, record`` (bytes of a WARC response record with its page as body).

    Null bodies and addresses count as empty.
    """
    body, url = F.coalesce(F.col(body_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def file_number() -> Column:
    """Archive file of a record: blocks of consecutive ids; records without an id spread by digest."""
    loose = F.shiftrightunsigned(F.xxhash64("digest"), 44) + F.lit(1 << 55)
    return F.coalesce(F.shiftrightunsigned(F.col("page_id").cast("long"), FILE_BITS), loose)


def manifest(recs: DataFrame) -> DataFrame:
    """``file, page_id, url, copy, offset, length, digest`` of every record, without the bytes.

    Records of a file lie in order of id, address and digest; ``copy`` counts
    records with equal id and address from 1.
    """
    m = recs.select("page_id", "url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    m = m.withColumn("file", file_number())
    order = Window.partitionBy("file").orderBy("page_id", "url", "digest")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    copy = F.row_number().over(Window.partitionBy("file", "page_id", "url").orderBy("digest"))
    return m.withColumns({"offset": before, "copy": copy})


def tree(m: DataFrame, depth: int, name: str) -> list[DataFrame]:
    """Merkle nodes of a manifest by level, each ``node, part, digest`` and written as a replica would keep it.

    Level 0 holds offset ranges (``node`` is the file, ``part`` the range),
    level 1 files, each higher level groups of the one below, level ``depth``
    the root alone.
    """
    leaf = F.struct("offset", "length", "digest")
    ranges = m.groupBy(F.col("file").alias("node"), F.floor(F.col("offset") / RANGE_BYTES).alias("part")).agg(F.array_sort(F.collect_list(leaf)).alias("r"))
    text = F.concat_ws(";", F.transform("r", lambda x: F.concat_ws(",", x["offset"].cast("string"), x["length"].cast("string"), x["digest"])))
    levels = [TA.written(ranges.select("node", "part", F.sha2(text, 256).alias("digest")), f"{name}-ranges")]
    kids = F.array_sort(F.collect_list(F.struct(F.col("node").alias("a"), F.col("part").alias("b"), F.col("digest").alias("d"))))
    text = F.concat_ws(";", F.transform("kids", lambda k: F.concat_ws(",", k["a"].cast("string"), k["b"].cast("string"), k["d"])))
    for level in range(1, depth + 1):
        up = levels[-1].groupBy(parent(level).alias("up")).agg(kids.alias("kids"))
        levels.append(TA.written(up.select(F.col("up").alias("node"), F.lit(0).cast("long").alias("part"), F.sha2(text, 256).alias("digest")), f"{name}-level"))
    return levels


def parent(level: int) -> Column:
    """Node of ``level`` above a node of the level below."""
    return F.col("node") if level == 1 else F.shiftrightunsigned("node", FAN_BITS)


def depth(*manifests: DataFrame) -> int:
    """Level at which all files of the manifests meet in one root."""
    top = max([m.agg(F.max("file")).first()[0] or 0 for m in manifests], default=0)
    return 1 + -(-top.bit_length() // FAN_BITS)


def audit_replicas(left: DataFrame, right: DataFrame) -> DataFrame:
    """``audit`` of two replicas' ``records``, whose manifests and trees are built and written first."""
    m_left, m_right = TA.written(manifest(left), "left-manifest"), TA.written(manifest(right), "right-manifest")
    d = depth(m_left, m_right)
    return audit((m_left, tree(m_left, d, "left")), (m_right, tree(m_right, d, "right")))


def audit(left: tuple[DataFrame, list[DataFrame]], right: tuple[DataFrame, list[DataFrame]]) -> DataFrame:
    """Records in which two stored replicas (manifest and tree levels of equal depth) differ.

    Columns ``page_id, url, copy, status`` (altered, missing from the right, or
    extra in it), ``file, offset, length, digest`` on the left and
    ``found_length, found_digest`` on the right; no rows if the roots agree.
    Null ids and addresses are compared as values, repeated records one by one;
    empty replicas agree with each other; other columns of the page tables are
    not part of a record.
    """
    (m_left, t_left), (m_right, t_right) = left, right
    bad: DataFrame | None = None
    for level in range(len(t_left) - 1, -1, -1):
        a, b = (t[level].select("node", "part", F.col("digest").alias(d)) for t, d in ((t_left, "da"), (t_right, "db")))
        if bad is not None:
            a, b = (x.join(bad, parent(level + 1) == F.col("up"), "left_semi") for x in (a, b))
        bad = a.join(b, ["node", "part"], "full").where(~F.col("da").eqNullSafe(F.col("db"))).select(F.col("node").alias("up")).distinct()
    files = bad.select(F.col("up").alias("file"))
    a = m_left.join(files, "file", "left_semi").select("file", "page_id", "url", "copy", "offset", "length", "digest")
    b = m_right.join(files, "file", "left_semi").select(F.col("file").alias("fb"), F.col("page_id").alias("pb"), F.col("url").alias("ub"), F.col("copy").alias("cb"),
                                                        F.col("length").alias("found_length"), F.col("digest").alias("found_digest"))
    same = (F.col("file") == F.col("fb")) & F.col("page_id").eqNullSafe(F.col("pb")) & (F.col("url") == F.col("ub")) & (F.col("copy") == F.col("cb"))
    both = a.join(b, same, "full").where(~F.col("digest").eqNullSafe(F.col("found_digest")))
    status = F.when(F.col("found_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("altered")
    return both.select(F.coalesce("page_id", "pb").alias("page_id"), F.coalesce("url", "ub").alias("url"), F.coalesce("copy", "cb").alias("copy"), status.alias("status"),
                       F.coalesce("file", "fb").alias("file"), "offset", "length", "digest", "found_length", "found_digest")
