"""Operator 2: exact substring dedup by blockwise suffix sorting with a difference cover.

A suffix matters through its first ``LENGTH`` bytes: it is a repeat if a suffix
of an earlier place starts with the same bytes.  Suffixes are dealt to buckets
by ranges of the fingerprint of their head and one bucket is sorted at a time,
so memory is bounded by a bucket, never by the corpus.

* **Long ties first.**  Stretches of two neighbouring lines that occur earlier
  settle all suffixes inside them at once.
* **Cover sample.**  Positions whose offset in the document, modulo ``PERIOD``,
  lies in a perfect difference set form the cover sample: any two places have a
  common shift below ``PERIOD`` that brings both onto sampled positions.  The
  window of ``LENGTH - PERIOD + 1`` bytes at a sampled position is its rank
  name.  Two suffixes can tie over ``LENGTH`` bytes only if a sampled position
  in their heads has a name that occurs more than once, so suffixes without one
  never enter a bucket.
* **Buckets.**  The heads of the remaining suffixes are sorted, bucket by
  bucket; equal heads are ordered by document and place.

Texts are packed once into written segments (bucketed by segment, so later
passes read them without a shuffle).  A segment sends each bucket the sorted,
compressed fingerprints it holds, and gets one bit back for each: known
elsewhere, or known earlier.  Places and texts never travel.  Fingerprints have
64 bits; two given different heads agree with probability 2**-64.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm import tables as TA
from spanlake.llm import textbytes as TB
from spanlake.session import scratch_dir, shuffle_partitions

LENGTH = 100
PERIOD, COVER = 57, (0, 1, 6, 15, 22, 26, 45, 55)   # a perfect difference set: every difference modulo 57 occurs
WINDOW = LENGTH - PERIOD + 1
SEGMENT_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20     # bytes of text per bucket, on average
SCAN_BYTES = 24 << 20      # bytes of text per partition of the segment table
IN_COVER = np.zeros(PERIOD, bool)
IN_COVER[list(COVER)] = True
U64 = np.uint64


def packed_segments(docs: DataFrame, id_col: str, text_col: str, total: int) -> tuple[DataFrame, str]:
    """Segments ``seg, ids, lens, body``: texts of a few hundred rows end to end in order of id (null last)."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in TB.slices(batch.column(1), SEGMENT_BYTES):
                own = ids.slice(lo, hi - lo)
                key = own.fill_null(np.iinfo(np.int64).max).to_numpy()
                order = np.argsort(key, kind="stable")
                lens = np.diff(offsets)[order]
                body = data[TB.gather_ranges(offsets[:-1][order], lens)].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([own.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), pa.array([lens.tolist()], pa.list_(pa.int64())),
                                                  pa.array([body], pa.binary())], names=["ids", "lens", "body"])

    segs = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "ids array<long>, lens array<long>, body binary")
    segs = segs.select(F.monotonically_increasing_id().alias("seg"), "*")
    name = f"segments_{uuid.uuid4().hex}"
    # at least as many buckets as shuffle partitions, or Spark shuffles this side of the joins with the replies after all
    parts = max(shuffle_partitions(docs), min(4096, -(-total // SCAN_BYTES)))
    segs.write.format("parquet").option("compression", "zstd").option("path", scratch_dir(spark, "segments")).bucketBy(parts, "seg").saveAsTable(name)
    return spark.table(name), name


class Segment:
    """One segment inside a task: place arrays and the replies of earlier passes."""

    def __init__(self, ids, lens: np.ndarray, body: bytes):
        self.ids = ids
        self.data = np.frombuffer(body, np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(lens)))
        n = len(self.data)
        self.sums = TB.prefix_sums(self.data)
        self.end = np.repeat(self.offsets[1:], lens)
        self.begin = np.repeat(self.offsets[:-1], lens)
        self.whole = self.end - np.arange(n) >= LENGTH   # a full head starts here
        self.dup = np.zeros(n, bool)

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of stretches of two neighbouring lines (or a lone line) that hold a head."""
        n = len(self.data)
        cut = np.unique(np.concatenate((self.offsets, np.flatnonzero(self.data == 10) + 1)))
        cut = cut[cut < n]
        if not len(cut):
            return cut, cut
        stop = self.end[cut]
        after = np.minimum(np.append(cut[1:], n), stop)
        after2 = np.minimum(np.append(cut[2:], [n, n])[:len(cut)], stop)
        ends = np.where(after < stop, after2, after)
        keep = ends - cut >= LENGTH
        return cut[keep], ends[keep]

    def settle(self, bits: np.ndarray) -> None:
        """Apply the reply to ``units``."""
        start, end = self.units()
        hit = repeats(TB.span_hash(self.sums, start, end), bits)
        change = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(change, start[hit], 1)
        np.add.at(change, end[hit] - LENGTH + 1, -1)
        self.dup |= np.cumsum(change)[:-1] > 0

    def samples(self) -> np.ndarray:
        """Cover-sample positions inside a head that is not settled yet."""
        n = len(self.data)
        open_before = np.concatenate(([0], np.cumsum(self.whole & ~self.dup)))
        at = np.flatnonzero(IN_COVER[(np.arange(n) - self.begin) % PERIOD])
        at = at[self.end[at] - at >= WINDOW]
        low = np.maximum(at - PERIOD + 1, self.begin[at])
        return at[open_before[at + 1] > open_before[low]]

    def names(self, at: np.ndarray) -> np.ndarray:
        return TB.span_hash(self.sums, at, at + WINDOW) & U64(0xFFFFFFFFFFFF0000)

    def candidates(self, bits: np.ndarray) -> np.ndarray:
        """Unsettled places whose heads hold a sampled position with a repeated name."""
        at = self.samples()
        names = self.names(at)
        kinds, which, count = np.unique(names, return_inverse=True, return_counts=True)
        hit = at[(bits | (count > 1))[which]] if len(at) else at
        change = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(change, np.maximum(hit - PERIOD + 1, self.begin[hit] if len(hit) else 0), 1)
        np.add.at(change, hit + 1, -1)
        return np.flatnonzero((np.cumsum(change)[:-1] > 0) & self.whole & ~self.dup)

    def heads(self, at: np.ndarray) -> np.ndarray:
        return TB.span_hash(self.sums, at, at + LENGTH)


def repeats(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which entries (in order of place) are not the first of their kind, given the reply for the sorted kinds."""
    kinds, first, which = np.unique(prints, return_index=True, return_inverse=True)
    if not len(kinds):
        return np.zeros(0, bool)
    return bits[which] | (np.arange(len(prints)) != first[which])


def prepared(batch: pa.RecordBatch, i: int, replies: int) -> Segment:
    """Row ``i`` of segments joined with the replies ``r0, r1, ...`` of as many passes."""
    lens = np.array(batch.column("lens")[i].as_py(), np.int64)
    s = Segment(batch.column("ids")[i].as_py(), lens, batch.column("body")[i].as_py())
    bits = []
    for r in range(replies):
        parts = sorted((x["bucket"], x["n"], x["bits"]) for x in batch.column(f"r{r}")[i].as_py() or [])
        bits.append(np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, n, b in parts]) if parts else np.zeros(0, bool))
    if replies > 0:
        s.settle(bits[0])
    s.bits = bits
    return s


def unit_prints(s: Segment) -> np.ndarray:
    return TB.span_hash(s.sums, *s.units())


def sample_prints(s: Segment) -> np.ndarray:
    return s.names(s.samples())


def head_prints(s: Segment) -> np.ndarray:
    return s.heads(s.candidates(s.bits[1]))


def ask_buckets(segs: DataFrame, prints: Callable[[Segment], np.ndarray], replies: int, bits_of_bucket: int, ordered: bool) -> DataFrame:
    """One reply row ``seg, bucket, n, bits`` per segment and bucket for the segment's sorted distinct fingerprints.

    ``ordered``: the bit says that an earlier document of another segment has
    the fingerprint; else that any other segment has it.
    """
    shift = U64(64 - bits_of_bucket)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(batch.num_rows):
                s = prepared(batch, i, replies)
                kinds, first = np.unique(prints(s), return_index=True)
                if not len(kinds):
                    continue
                if ordered:  # ids of the documents that hold the first place of each kind
                    at = place_of(s, prints)
                    ids = np.array([np.iinfo(np.int64).max if x is None else x for x in s.ids], np.int64)
                    keys = ids[np.searchsorted(s.offsets, at[first], "right") - 1]
                bucket = (kinds >> shift).astype(np.int64) if bits_of_bucket else np.zeros(len(kinds), np.int64)
                cut = np.flatnonzero(np.diff(bucket)) + 1
                lo, hi = np.append(0, cut), np.append(cut, len(kinds))
                body = [z.compress(planes(kinds[a:b])) for a, b in zip(lo, hi, strict=True)]
                key = [z.compress(planes(keys[a:b].view(U64))) if ordered else b"" for a, b in zip(lo, hi, strict=True)]
                seg = np.full(len(lo), batch.column("seg")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[lo]), pa.array(seg), pa.array((hi - lo).astype(np.int64)), pa.array(body, pa.binary()), pa.array(key, pa.binary())],
                                                 names=["bucket", "seg", "n", "body", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for group in TA.sorted_groups(batches):
            n, seg = group.column(2).to_numpy(), group.column(1).to_numpy()
            kinds = np.concatenate([unplanes(z.decompress(b)) for b in group.column(3).to_pylist()])
            of = np.repeat(np.arange(len(n)), n)
            if ordered:
                keys = np.concatenate([unplanes(z.decompress(b)) for b in group.column(4).to_pylist()]).view(np.int64)
                order = np.lexsort((seg[of], keys, kinds))
            else:
                order = np.argsort(kinds, kind="stable")
            ranked = kinds[order]
            same = ranked[1:] == ranked[:-1]
            known = np.zeros(len(kinds), bool)
            known[order[1:]] = same
            if not ordered:
                known[order[:-1]] |= same
            ends = np.cumsum(n)
            bits = [np.packbits(known[a:b]).tobytes() for a, b in zip(ends - n, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([group.column(1), group.column(0), group.column(2), pa.array(bits, pa.binary())], names=["seg", "bucket", "n", "bits"])

    sent = segs.mapInArrow(send, "bucket long, seg long, n long, body binary, keys binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "seg long, bucket long, n long, bits binary")


def place_of(s: Segment, prints: Callable[[Segment], np.ndarray]) -> np.ndarray:
    return s.units()[0] if prints is unit_prints else s.candidates(s.bits[1])


def planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit values, highest bytes of all values first (sorted values compress well that way)."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(U64)


def dedup_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller id, or earlier in the same text).

    One row per input row: the id, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs), ``kept_sha256`` of the remaining bytes and, with
    ``with_text``, ``kept`` (binary).  Strings are judged on the input and never
    cross documents.  A null text counts as empty; rows without an id come last
    in the order; rows that share an id come in the order in which they were
    packed, so of repeated rows one stays; an empty table gives no rows; other
    columns are not read.  Ids are cast to long.
    """
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    b = max(0, min(30, (max(1, total) // BUCKET_BYTES).bit_length()))
    segs, name = packed_segments(docs, id_col, text_col, total)

    def joined(base: DataFrame, reply: DataFrame, r: int) -> DataFrame:
        each = reply.groupBy("seg").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(f"r{r}"))
        return base.join(each, "seg", "left")

    rows = segs
    for r, (prints, ordered) in enumerate(((unit_prints, True), (sample_prints, False), (head_prints, True))):
        rows = joined(rows, TA.written(ask_buckets(rows, prints, r, b, ordered), "replies"), r)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = prepared(batch, i, 3)
                at = s.candidates(s.bits[1])
                s.dup[at[repeats(s.heads(at), s.bits[2])]] = True
                n = len(s.data)
                change = np.zeros(n + 1, np.int64)
                hit = np.flatnonzero(s.dup)
                np.add.at(change, hit, 1)
                np.add.at(change, hit + LENGTH, -1)
                gone = np.cumsum(change)[:-1] > 0
                first = np.zeros(n + 1, bool)
                first[s.offsets] = True
                run = gone & (np.concatenate(([True], ~gone[:-1])) | first[:n])
                kept = s.data[~gone].tobytes()
                rows_of = lambda m: np.diff(np.concatenate(([0], np.cumsum(m)))[s.offsets])
                n_gone, n_runs = rows_of(gone), rows_of(run)
                ends = np.cumsum(np.diff(s.offsets) - n_gone).tolist()
                parts = [kept[a:e] for a, e in zip([0, *ends[:-1]], ends, strict=True)]
                cols = [pa.array(s.ids, pa.int64()), pa.array(np.diff(s.offsets)), pa.array(n_gone), pa.array(n_runs), pa.array([hashlib.sha256(p).hexdigest() for p in parts])]
                if with_text:
                    cols.append(pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if with_text else [])
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = TA.written(rows.mapInArrow(finish, schema), "deduped")
    docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return out
