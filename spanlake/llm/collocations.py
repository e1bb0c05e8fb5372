"""Operator 12: phrase collocations by set-oriented mining (SETM) over sorted occurrence relations.

The relation ``R1`` holds every word occurrence with its piece and position,
sorted by both and persisted as Parquet in blocks (a block is a slice of whole
documents, so no piece is cut).  ``R(k+1)`` comes from ``R(k)`` by a merge-join
with itself: two sorted occurrences of one piece whose positions differ by one.
Phrases are group-counted, and each relation is semi-joined with the frequent
phrases before it is extended.  Only ``R1`` is stored; a pass makes the longer
relations of a block from it again, and counts phrases from the block itself.

The semi-joins use bitmaps of key fingerprints, of at most ``MAX_BITS`` bits, so
what is broadcast has a fixed bound; a bitmap lets all frequent phrases through
and a few others, which the exact counts by text then drop.  Before texts are
shuffled, phrases are counted by fingerprint alone (sorted and compressed), which
leaves out those that cannot reach the least count.  Occurrences never travel, only counts do, summed
per block first, so a very frequent word or phrase costs one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm import tables as TA
from spanlake.llm import textbytes as TB
from spanlake.llm.suffixes import planes, unplanes
from spanlake.session import shuffle_partitions

U64 = np.uint64
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
BETWEEN = PIECE_END.copy()
BETWEEN[[0x20, 0x09]] = True
MIN_BITS, MAX_BITS = 1 << 20, 1 << 27   # a semi-join bitmap is at most 16 MB
PROBES = (1, 33)                        # bits of a fingerprint where its two places in a bitmap begin
BITMAP_ROWS = 1 << 15                   # bits of one aggregated bitmap (fixed by Spark's bitmap functions)
GROUP_ROWS = 1 << 21                    # fingerprints that a task holds before it passes counts on
COUNT_BITS = U64(16)                    # lowest bits of a fingerprint, which give way to its count when it travels
MOST = U64((1 << 16) - 1)               # counts stop here while they travel
TOP_PARTS = 64                          # parts of a language that are ranked by themselves first
#: floor(1000000 * a * a / (l * r)); a below 10^16, l and r below 10^18, the product below 10^38
SCORE = ("cast(cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(31,0)) * cast(1000000 as decimal(7,0)) as decimal(38,0)) "
         "div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))")
BLOCKS = "body binary, langs array<string>, sizes array<long>"
COUNTS = "lang string, text string, c long"


def hash_texts(texts: pa.Array) -> np.ndarray:
    """Fingerprints of the strings of an array."""
    out = [TB.span_hash(TB.prefix_sums(data), at[:-1], at[1:]) for _, _, data, at in TB.slices(texts)]
    return np.concatenate(out) if out else np.zeros(0, U64)


def pack(occurrences: pa.Table, words: pa.Table) -> bytes:
    """Both tables of a block of ``R1`` as compressed Arrow streams, laid end to end behind the first one's length.

    Pieces and positions ascend, so their steps are kept, which mostly are 0 and
    1; fingerprints, which do not compress, are found again from the words.
    """
    parts = []
    steps = [np.diff(occurrences[c].to_numpy(), prepend=0) for c in ("piece", "at")]
    small = pa.table([pa.array(x, pa.int32()) for x in (*steps, occurrences["code"].to_numpy())], names=["piece", "at", "code"])
    for t in (small, words.select(["lang", "text"])):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        parts.append(sink.getvalue().to_pybytes())
    return len(parts[0]).to_bytes(8, "little") + parts[0] + parts[1]


def unpack(body: bytes) -> tuple[pa.Table, pa.Table]:
    n = int.from_bytes(body[:8], "little")
    small, words = (pa.ipc.open_stream(pa.py_buffer(x)).read_all().combine_chunks() for x in (body[8:8 + n], body[8 + n:]))
    ascending = [np.cumsum(small[c].to_numpy(), dtype=np.int64) for c in ("piece", "at")]
    h = word_hashes(*(words[c].combine_chunks() for c in ("lang", "text")))
    return pa.table([*ascending, small["code"].to_numpy().astype(np.int64)], names=["piece", "at", "code"]), words.append_column("h", pa.array(h.view(np.int64)))


def word_hashes(lang: pa.Array, text: pa.Array) -> np.ndarray:
    return TB.mix(hash_texts(text) + hash_texts(lang) * U64(3))


def next_hashes(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Fingerprints of phrases and the words behind them."""
    return TB.mix(first * U64(0x9E3779B97F4A7C15) + word)


def phrase_prints(phrases: DataFrame, k: int) -> DataFrame:
    """``h``: the fingerprints of phrases ``lang, text`` of ``k`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.list_flatten(pc.split_pattern(batch.column(1), " "))
            h = word_hashes(batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), k))), words).reshape(-1, k)
            out = h[:, 0]
            for i in range(1, k):
                out = next_hashes(out, h[:, i])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])

    return phrases.select("lang", "text").mapInArrow(run, "h long")


def last_hashes(phrases: pa.Table) -> np.ndarray:
    """Fingerprints of the phrases' last words (of the words themselves in ``R1``)."""
    return phrases["last_h" if "last_h" in phrases.column_names else "h"].to_numpy()


def last_words(phrases: pa.Table) -> pa.Array:
    return pc.replace_substring_regex(phrases["text"].combine_chunks(), "(?s)^.* ", "")


def word_relation(data: np.ndarray, offsets: np.ndarray, langs: pa.Array) -> tuple[pa.Table, pa.Table]:
    """``R1`` of a slice: occurrences ``piece, at, code`` in order and the words ``lang, text, h`` that codes point to."""
    data = TB.LOWER[data]
    starts, ends, rows = TB.words(data, offsets, BETWEEN)
    piece = np.cumsum(PIECE_END[data])[starts] + rows if len(starts) else starts
    length = ends - starts
    body = data[TB.gather_ranges(starts, length)]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate(([0], np.cumsum(length))).astype(np.int64)), pa.py_buffer(body))
    words, names = words.dictionary_encode(), pc.fill_null(langs, "und").dictionary_encode()
    n = max(1, len(words.dictionary))
    key = names.indices.to_numpy().astype(np.int64)[rows] * n + words.indices.to_numpy()
    kinds, code = np.unique(key, return_inverse=True)
    text, lang = words.dictionary.take(pa.array(kinds % n)).cast(pa.string()), names.dictionary.take(pa.array(kinds // n))
    h = pa.array(word_hashes(lang, text).view(np.int64))
    occ = pa.table({"piece": pa.array(piece, pa.int64()), "at": pa.array(np.arange(len(starts)), pa.int64()), "code": pa.array(code, pa.int64())})
    return occ, pa.table({"lang": lang.cast(pa.string()), "text": text, "h": h})


class Bitmap:
    """Membership test of fingerprints in the keys a bitmap was made from (all members pass)."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __contains__(self, h) -> bool:
        return bool(self.has(np.array([h], np.int64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for shift in PROBES:
            at = (h.view(U64) >> U64(shift)) & U64(8 * len(self.bits) - 1)   # a power of two
            ok &= (self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)
        return ok


def bitmap_of(keys: DataFrame) -> Bitmap:
    """Bitmap of the longs ``h`` of a table, built by Spark; at most ``MAX_BITS`` bits reach the driver."""
    size = min(MAX_BITS, max(MIN_BITS, 1 << (32 * keys.count()).bit_length()))
    places = F.array(*[F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(size - 1)) + 1 for shift in PROBES])
    parts = keys.select(F.explode(places).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    bits = np.zeros(size // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most size / 32768 rows of 4 KB
        lo = (r["b"] - 1) * BITMAP_ROWS // 8
        bits[lo:lo + BITMAP_ROWS // 8] = np.frombuffer(r["m"], np.uint8)
    return Bitmap(bits)


def counted(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``h, c``: how often each fingerprint occurs, in portions of about ``GROUP_ROWS`` different ones."""
    held, size = [], 0

    def merged() -> pa.RecordBatch:
        h, c = summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])

    for h in parts:
        held.append(summed(h, np.ones(len(h), np.int64)))
        size += len(held[-1][0])
        if size > GROUP_ROWS:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


def extended(occ: pa.Table, phrases: pa.Table, keep: Bitmap) -> tuple[np.ndarray, ...]:
    """Merge-join of the semi-joined relation with itself: ``piece, at, first code, next code, h`` of phrases one word longer."""
    good = keep.has(phrases["h"].to_numpy())
    code = occ["code"].to_numpy()
    some = good[code] if len(code) else np.zeros(0, bool)
    piece, at, code = occ["piece"].to_numpy()[some], occ["at"].to_numpy()[some], code[some]
    next_to = np.flatnonzero((piece[1:] == piece[:-1]) & (at[1:] == at[:-1] + 1))
    a, b = code[next_to], code[next_to + 1]
    h = next_hashes(phrases["h"].to_numpy().view(U64)[a], last_hashes(phrases).view(U64)[b])
    return piece[next_to], at[next_to], a, b, h.view(np.int64)


def summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, which = np.unique(h, return_inverse=True)
    return kinds, np.bincount(which, c, len(kinds)).astype(np.int64)


def short(h: np.ndarray) -> np.ndarray:
    """Fingerprints of the part of longs ``h`` that ``frequent`` keeps."""
    return TB.mix(h.view(U64) >> COUNT_BITS).view(np.int64)


def merged(x: np.ndarray) -> np.ndarray:
    """Sorted values with one entry a fingerprint; its count, in the lowest bits, is the sum, at most ``MOST``."""
    if not len(x):
        return x
    x = np.sort(x)
    key = x >> COUNT_BITS
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] << COUNT_BITS | np.minimum(np.add.reduceat(x & MOST, first), MOST)


def portions(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """``merged`` fingerprints of a task, about ``GROUP_ROWS`` at a time."""
    held, size = [], 0
    for h in parts:
        held.append(merged(h.view(U64) & ~MOST | U64(1)))
        size += len(held[-1])
        if size > GROUP_ROWS:
            yield merged(np.concatenate(held))
            held, size = [], 0
    if size:
        yield merged(np.concatenate(held))


def steps(x: np.ndarray) -> np.ndarray:
    """``merged`` values with each fingerprint as its distance from the one before."""
    return np.diff(x >> COUNT_BITS, prepend=U64(0)) << COUNT_BITS | x & MOST


def unsteps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x >> COUNT_BITS, dtype=U64) << COUNT_BITS | x & MOST


def frequent(rows: DataFrame, prints: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int) -> DataFrame:
    """``h``: ``short`` of the fingerprints (longs) that ``prints`` finds at least ``least`` times in ``rows``, and of a few others.

    A task sums its own counts and sends each bucket its fingerprints sorted and
    compressed, about 4 bytes each.  A bucket is a range of fingerprints; there are
    more of them than shuffle partitions, and they are summed one at a time.
    """
    parts = shuffle_partitions(rows)
    shift, enough = U64(64 - min(30, parts.bit_length())), U64(min(least, int(MOST)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for kinds in portions(prints(batches)):
            bucket = (kinds >> shift).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket)) + 1
            lo, hi = np.append(0, cut), np.append(cut, len(kinds))
            body = [z.compress(planes(steps(kinds[a:b]))) for a, b in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[lo]), pa.array(body, pa.binary())], names=["bucket", "body"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for group in TA.sorted_groups(batches):
            kinds = merged(np.concatenate([unsteps(unplanes(z.decompress(body.as_py()))) for body in group.column(1)]))
            h = short(kinds[(kinds & MOST) >= enough])
            yield from pa.table([pa.array(h)], names=["h"]).to_batches(max_chunksize=1 << 16)

    sent = rows.mapInArrow(send, "bucket long, body binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(meet, "h long")


def occurrences(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``R1`` in blocks (``body``) with the number of words of each language in the block (``langs, sizes``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in TB.slices(batch.column(1), 2 * TB.SLICE_BYTES):
                occ, words = word_relation(data, offsets, batch.column(0).slice(lo, hi - lo))
                if occ.num_rows:
                    langs = words["lang"].combine_chunks().dictionary_encode()
                    own = np.bincount(langs.indices.to_numpy()[occ["code"].to_numpy()], minlength=len(langs.dictionary))
                    yield pa.RecordBatch.from_arrays([pa.array([pack(occ, words)], pa.binary()), pa.array([langs.dictionary.to_pylist()], pa.list_(pa.string())),
                                                      pa.array([own.tolist()], pa.list_(pa.int64()))], names=["body", "langs", "sizes"])

    return docs.select(F.col(lang_col).cast("string").alias("lang"), text_col).mapInArrow(run, BLOCKS)


def relation(body: bytes, joins: list, texts: bool = True) -> tuple[pa.Table, pa.Table]:
    """A block of ``R(k)``, ``k - 1`` ``joins`` (two broadcast bitmaps each) after ``R1``: occurrences and phrases (without ``texts``, only their fingerprints)."""
    occ, phrases = unpack(body)
    for keep, some in joins:
        piece, at, a, b, h = extended(occ, phrases, Bitmap(keep.value))
        ok = Bitmap(some.value).has(short(h))
        piece, at, a, b, h = (x[ok] for x in (piece, at, a, b, h))
        _, first, code = np.unique(a * max(1, phrases.num_rows) + b, return_index=True, return_inverse=True)
        found = {"h": pa.array(h[first]), "last_h": pa.array(last_hashes(phrases)[b[first]])}
        if texts:
            left, right = phrases.take(pa.array(a[first])), phrases.take(pa.array(b[first]))
            found |= {"lang": left["lang"], "text": pc.binary_join_element_wise(left["text"].combine_chunks(), last_words(right), " ")}
        occ, phrases = pa.table({"piece": pa.array(piece), "at": pa.array(at), "code": pa.array(code, pa.int64())}), pa.table(found)
    return occ, phrases


def block_counts(blocks: DataFrame, joins: list) -> DataFrame:
    """``lang, text, c`` of the phrases of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                occ, phrases = relation(body.as_py(), joins)
                count = pa.array(np.bincount(occ["code"].to_numpy(), minlength=phrases.num_rows))
                yield from pa.table({"lang": phrases["lang"], "text": phrases["text"], "c": count}).combine_chunks().to_batches(max_chunksize=1 << 16)

    return blocks.select("body").mapInArrow(run, COUNTS)


def next_join(blocks: DataFrame, joins: list, keep: Bitmap, min_count: int) -> tuple:
    """The merge-join behind ``joins``: broadcast bitmaps of the phrases that it takes (``keep``) and of those that it may give."""
    context = blocks.sparkSession.sparkContext
    sent = context.broadcast(keep.bits)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        keep = Bitmap(sent.value)
        yield from (extended(*relation(body.as_py(), joins, False), keep)[4] for batch in batches for body in batch.column(0))

    often = TA.written(frequent(blocks.select("body"), prints, min_count), "often")
    return sent, context.broadcast(bitmap_of(often).bits)


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10,
                 inside_percent: int = 50, top: int = 2000) -> DataFrame:
    """Each language's ``top`` best-scoring phrases of 2 to ``max_words`` words: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
    into words at spaces and tabs.  ``a`` is how often the phrase occurs within
    pieces (at least ``min_count``), ``l`` and ``r`` how often the two parts of its
    worst cut do, ``n`` the words of the language; the score of a cut is
    ``floor(1000000 * a * a / (l * r))``, the lowest counts, ties to the first cut.
    A phrase inside a longer one that has at least ``inside_percent`` of its count
    is dropped.  Order: score, then a, both descending, then the phrase in UTF-8
    byte order.  Counts are exact, products are decimals of 38 digits.

    A null language is ``und``, a null or empty text has no words; repeated rows
    and repeated or null ids all count; an empty table gives no rows; no column
    but the two named ones is read.
    """
    blocks = TA.written(occurrences(docs, text_col, lang_col), "words", "uncompressed")   # bodies are compressed
    sizes = blocks.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n"))
    counts, joins = [], []
    for k in range(1, max_words + 1):
        if k > 1:
            joins = [*joins, next_join(blocks, joins, bitmap_of(phrase_prints(counts[-1], k - 1)), min_count)]
        found = block_counts(blocks, joins).groupBy("lang", "text").agg(F.sum("c").alias("c"))
        counts.append(TA.written(found.where(F.col("c") >= min_count).withColumn("k", F.lit(k)), f"frequent_{k}"))
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    words = F.split("text", " ")
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cand = every.where("k > 1").select("lang", F.col("text").alias("phrase"), F.col("c").alias("a"), "k", words.alias("w"))
    # what lies inside a longer candidate of at least that share
    size = F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m")
    inner = cand.where("k > 2").select("lang", "a", "k", "w", size).select("lang", "a", "m", "w", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("i"))
    inner = inner.select("lang", part(F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    cand = cand.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))).drop("longer")
    cuts = cand.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    side = lambda name, count: every.select("lang", F.col("text").alias(name), F.col("c").alias(count))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(SCORE))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = Window.partitionBy("lang", "part").orderBy(*order)
    best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    best = best.withColumn("place", F.row_number().over(few)).where(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
