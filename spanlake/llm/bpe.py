"""Operator 10: byte-level BPE encoding and decoding.

Every match of the pre-split pattern is merged on its own.  A segment tree over
the byte positions of a match holds, at each leaf, the rank of the pair that
starts there (with the position, so that the minimum is the leftmost of the
lowest rank); a merge changes the leaves of the merged position, of the
neighbour that disappears and of the live neighbour to the left, each a
logarithmic point update.

Tasks work on Arrow batches: the pattern's matches are found for a slice of
texts at once from character classes, equal matches are merged once (a bounded
cache keeps them between slices), and all new matches of a slice advance
together, one merge per round, in one array of trees per padded length.  Long
matches get a tree of their own.  Nothing is shuffled; a row's work depends on
its own text only.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanlake.llm import textbytes as TB

NONE = np.int64(1) << 62
BATCH_PIECE = 64          # longer matches are merged one by one
CACHE_PIECES = 800_000    # per worker; beyond it the cache starts anew
LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
# fixed values: the Unicode White_Space characters, the meaning of \s in the pattern
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space or other."""
    if not _CLASSES:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = BLANK
        _CLASSES.append(table)
    return _CLASSES[0]


def split_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of the pattern's matches in a slice of texts; no match crosses a text.

    The pattern is  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ :
    runs of one class, a single space joined to the run after it, the last
    white-space character before a run kept apart, and a lone apostrophe with
    an English ending.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(cp)
    kind = char_classes()[cp]
    row_first = np.zeros(n + 1, bool)
    row_first[np.searchsorted(at, offsets)] = True
    run = np.concatenate(([True], kind[1:] != kind[:-1])) | row_first[:n]
    token = run.copy()
    # a run that follows white space in the same text
    begins = np.flatnonzero(run & ~row_first[:n])
    begins = begins[(kind[begins] != BLANK) & (kind[begins - 1] == BLANK)]
    token[begins - 1] = True
    token[begins[cp[begins - 1] == 0x20]] = False
    # contractions: a one-character run "'" that starts a match, then letters
    quote = np.flatnonzero((cp[:n - 1] == 0x27) & token[:n - 1] & run[:n - 1] & (kind[1:] == LETTER) & ~row_first[1:n]) if n > 1 else []
    if len(quote):
        one = cp[quote + 1]
        two = np.where((quote + 2 < n) & ~row_first[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 3, size)
        quote, size = quote[size > 0], size[size > 0]
        token[quote + 1] = False
        end = quote + size
        inside = (end < n) & ~run[np.minimum(end, n - 1)]
        token[end[inside]] = True
    return at[token]


class Merger:
    """Ranks of one vocabulary, prepared for merging and decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        pairs = {}
        for tok, r in ranks.items():
            for i in range(1, len(tok)):
                a, b = ranks.get(tok[:i]), ranks.get(tok[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pairs = pairs
        self.keys = np.append(keys[order], NONE)
        self.vals = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NONE)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary must hold all 256 single bytes")
        self.length = np.zeros(self.size, np.int64)
        toks = sorted(ranks.items(), key=lambda x: x[1])
        self.length[[r for _, r in toks]] = [len(t) for t, _ in toks]
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(t for t, _ in toks), np.uint8)
        self.cache: dict[int, int] = {}
        self.c_ids, self.c_len = np.zeros(0, np.int32), np.zeros(0, np.int64)

    @classmethod
    def from_rank_file(cls, content: bytes) -> Merger:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a})

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.vals[i], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """Token ids of one match, by a segment tree of its own."""
        n = len(piece)
        size = 1 << max(0, (n - 1).bit_length())
        tok = [int(self.byte[b]) for b in piece]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get, wide, none = self.pairs.get, self.size, int(NONE)
        tree = [none] * (2 * size)

        def leaf(i: int) -> int:
            j = nxt[i]
            r = get(tok[i] * wide + tok[j]) if j < n else None
            return none if r is None else r * size + i

        def put(i: int, v: int) -> None:
            i += size
            tree[i] = v
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                tree[i] = a if a < b else b
                i >>= 1

        for i in range(n):
            tree[size + i] = leaf(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < none and size > 1:
            rank, i = divmod(tree[1], size)
            j = nxt[i]
            tok[i], nxt[i] = rank, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            put(j, none)
            put(i, leaf(i))
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i]))
        out, i = [], 0
        while i < n:
            out.append(tok[i])
            i = nxt[i]
        return out

    def merge_many(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids and their counts for matches of at most ``size`` bytes, one merge each per round."""
        m = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        tok = self.byte[raw]
        live = np.arange(size) < lens[:, None]
        nxt = np.minimum(np.arange(1, size + 1) + np.zeros((m, 1), np.int64), lens[:, None])
        prv = np.arange(-1, size - 1) + np.zeros((m, 1), np.int64)
        tree = np.full((m, 2 * size), NONE)
        rank = self.pair_ranks(tok[:, :-1], tok[:, 1:])
        ok = live[:, 1:] & (rank < NONE)
        tree[:, size:2 * size - 1] = np.where(ok, rank * size + np.arange(size - 1), NONE)
        w = size
        while w > 1:
            tree[:, w // 2:w] = np.minimum(tree[:, w:2 * w:2], tree[:, w + 1:2 * w:2])
            w //= 2

        def put(rows, at, values):
            at = at + size
            tree[rows, at] = values
            while True:
                at = at >> 1
                if not len(at) or at[0] == 0:
                    return
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        def leaf(rows, i):
            j = nxt[rows, i]
            inside = j < lens[rows]
            r = self.pair_ranks(tok[rows, i], tok[rows, np.minimum(j, size - 1)])
            return np.where(inside & (r < NONE), r * size + i, NONE)

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root % size
            j = nxt[rows, i]
            k = nxt[rows, j]
            tok[rows, i], nxt[rows, i], live[rows, j] = root // size, k, False
            has = k < lens[rows]
            prv[rows[has], k[has]] = i[has]
            put(rows, j, np.full(len(rows), NONE))
            put(rows, i, leaf(rows, i))
            p = prv[rows, i]
            has = p >= 0
            put(rows[has], p[has], leaf(rows[has], p[has]))
            rows = rows[tree[rows, 1] < NONE]
        return tok[live], live.sum(axis=1)

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Merge matches not met before and keep their ids in the cache."""
        base, ids, counts, order = len(self.c_len), [self.c_ids], [self.c_len], []
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)  # a match that is a token itself is taken as it is
            if whole is not None:
                groups.setdefault(0, []).append(i)
            else:
                groups.setdefault(max(8, 1 << (len(p) - 1).bit_length()) if len(p) <= BATCH_PIECE else -1, []).append(i)
        for size, group in groups.items():
            step = max(1, (1 << 19) // size) if size > 0 else len(group)
            for lo in range(0, len(group), step):
                part = group[lo:lo + step]
                own = [pieces[i] for i in part]
                if size > 0:
                    flat, n = self.merge_many(own, size)
                else:
                    lists = [[self.ranks[p]] for p in own] if size == 0 else [self.merge_one(p) for p in own]
                    flat, n = np.array([x for y in lists for x in y], np.int64), np.fromiter(map(len, lists), np.int64, len(lists))
                ids.append(flat.astype(np.int32))
                counts.append(n)
                order += part
        self.c_ids, self.c_len = np.concatenate(ids), np.concatenate(counts)
        self.cache.update(zip(hashes[order].tolist() if order else [], range(base, base + len(order)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a slice of texts, laid end to end, and each text's offsets into them."""
        starts = split_points(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        kinds, first, which = np.unique(TB.span_hash(TB.prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.c_ids, self.c_len = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)
        new = [i for i, h in enumerate(kinds.tolist()) if h not in self.cache]
        raw = data.tobytes()
        self.learn(kinds[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        entry = np.fromiter(map(self.cache.__getitem__, kinds.tolist()), np.int64, len(kinds))[which]
        c_first = np.cumsum(self.c_len) - self.c_len
        n = self.c_len[entry]
        ids = self.c_ids[TB.gather_ranges(c_first[entry], n)].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(n)))
        return ids, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, laid end to end."""
        return self.flat[TB.gather_ranges(self.first[ids], self.length[ids])]


def encode_documents(docs: DataFrame, rank_file: str, *, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again, one output row per input row.

    ``rank_file`` is a tiktoken rank file on the driver; its ranks (under 1 MB)
    are broadcast.  Columns: the id, ``n_tokens``, ``ids_sha256`` (ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256`` and, with
    ``with_ids``, ``ids`` as array<int>.

    A null text counts as empty (no tokens, digests of no bytes); a null id stays
    null; repeated rows give repeated results; an empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    with open(rank_file, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    made: list[Merger] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Merger.from_rank_file(content.value))
        m = made[0]
        for batch in batches:
            for lo, hi, data, offsets in TB.slices(batch.column(1)):
                ids, at = m.encode(data, offsets)
                back = m.decode(ids)
                ends = np.concatenate(([0], np.cumsum(m.length[ids])))[at]
                packed, a, e = ids.astype("<u4").tobytes(), at.tolist(), ends.tolist()
                rows = range(hi - lo)
                back = back.tobytes()
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(packed[4 * a[i]:4 * a[i + 1]]).hexdigest() for i in rows]),
                        pa.array([hashlib.sha256(back[e[i]:e[i + 1]]).hexdigest() for i in rows])]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(id_col, text_col)
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else [])
    kind = src.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return src.mapInArrow(run, schema)
