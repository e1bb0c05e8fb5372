"""Operator 13: alignment of two tokenizers' tokens, Arrow-native inside tasks, merged by Spark.

A task encodes a slice of texts with both tokenizers into Arrow lists, flattens
them with their parent indices, and gets every token's end by a cumulative sum
that starts anew at each text.  A hash join on (text, end) gives the offsets
where tokens of both sides end; running counts of these number the groups.
The sides are joined on the group (in large groups after repeated ids are
counted), and products of their counts, summed by text and id pair, are the links.

Over the corpus, ``Table.group_by`` counts in how many texts of a block a pair
is linked, Spark sums these partial counts, finds each A id's highest (at most
one row per id of the vocabulary, broadcast), and sends every block the counts
of its own pairs.  A pair is one row per block, however often it occurs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm import tables as TA
from spanlake.llm import textbytes as TB
from spanlake.session import shuffle_partitions

BLOCK_BYTES = 4 << 20    # bytes of text whose pairs are counted together
SHIFT = 32               # a pair is a long: A id in the upper half, B id in the lower one
END_BITS = 40            # a document's end key is a long: its number in the slice, then the byte where a token ends
KEPT_CHUNKS = 1 << 19    # chunks whose ids a task remembers; beyond that it starts anew
TOGETHER = 256           # chunks that the libraries are asked about as one text
FACTS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes and decimal names of every id."""

    def __init__(self, entries: list[bytes]):
        self.length = np.fromiter(map(len, entries), np.int64, len(entries))
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[TB.gather_ranges(self.first[ids], self.length[ids])]

    def cut(self, ids: np.ndarray, text: bytes, ends: np.ndarray) -> np.ndarray | None:
        """How many ids belong to each part of ``text`` (parts end at ``ends``); None if the ids do not spell the parts."""
        have = np.cumsum(self.length[ids])
        if not len(ids) or have[-1] != len(text) or self.joined(ids).tobytes() != text:
            return None
        last = np.searchsorted(have, ends)
        return np.diff(last + 1, prepend=0) if (have[last] == ends).all() else None


class Grown:
    """An array that grows at its end; room is doubled, so that all growth together copies each value about twice."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1 << 10, kind), 0

    def __len__(self) -> int:
        return self.size

    @property
    def values(self) -> np.ndarray:
        return self.room[:self.size]

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.room):
            self.room = np.concatenate((self.values, np.zeros(max(need, 2 * len(self.room)) - self.size, self.room.dtype)))
        self.room[self.size:need] = more
        self.size = need


class Pair:
    """Both tokenizers inside a task."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        alphabet = byte_alphabet()
        entries = [b""] * self.a.get_vocab_size()
        added = {x["id"] for x in json.loads(a_file)["added_tokens"]}
        for token, i in self.a.get_vocab().items():
            entries[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
        self.a_bytes = Vocabulary(entries)
        self.b_bytes = Vocabulary([piece_bytes(self.b, i) for i in range(self.b.get_piece_size())])
        n = max(len(entries), self.b.get_piece_size())
        self.names = [Vocabulary([b"%d%s" % (i, end) for i in range(n)]) for end in (b",", b"|", b";")]

        self.by_chunk = self.separable(json.loads(a_file))
        self.forget()

    def separable(self, a_spec: dict) -> bool:
        """Whether no token of either side crosses a chunk's start (see ``chunks``)."""
        pre = a_spec.get("pre_tokenizer") or {}
        a_ok = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not a_spec.get("normalizer")
        pieces = (self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        return bool(a_ok) and not any("▁" in p for p in pieces)

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.sizes, self.firsts = ([Grown(t), Grown(t)] for t in (np.int32, np.int64, np.int64))

    def ask(self, texts: list[str]) -> list[list]:
        """Both libraries' ids of texts that begin with the added space."""
        a = self.a.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [[x.ids for x in a], self.b.encode([t[1:] for t in texts], add_bos=False, add_eos=False, num_threads=1) if texts else []]

    def ask_chunks(self, full: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides the ids of chunks, end to end in their order, and how many each has.

        Up to ``TOGETHER`` successive plain chunks are asked about as one text,
        whose ids are cut at the chunks' ends.  Where a side's ids do not spell
        that text, or one passes over an end, its chunks are asked about singly.
        """
        second = full[np.minimum(starts + 1, len(full) - 1)]
        plain = self.by_chunk & (ends - starts > 1) & (full[starts] == 32) & (second > 32) & (second < 127) & (full[ends - 1] != 32)
        length = ends - starts
        laid = full[TB.gather_ranges(starts, length)].tobytes()
        at = np.concatenate(([0], np.cumsum(length)))
        joins = np.append(False, plain[1:] & plain[:-1]) if len(plain) else plain
        place = np.arange(len(plain))
        joins &= (place - np.maximum.accumulate(np.where(joins, 0, place))) % TOGETHER > 0
        runs = np.append(np.flatnonzero(~joins), len(plain)).tolist()
        texts = [laid[at[lo]:at[hi]] for lo, hi in zip(runs[:-1], runs[1:], strict=True)]
        asked = self.ask([t.decode() for t in texts])
        ids, sizes = ([], []), ([], [])
        for r, text in enumerate(texts):
            lo, hi = runs[r], runs[r + 1]
            own = [np.asarray(x[r], np.int32) for x in asked]
            cut = [np.array([len(x)]) if hi - lo == 1 else v.cut(x, text, at[lo + 1:hi + 1] - at[lo])
                   for v, x in zip((self.a_bytes, self.b_bytes), own, strict=True)]
            if any(c is None for c in cut):
                single = self.ask([laid[at[i]:at[i + 1]].decode() for i in range(lo, hi)])
                own = [np.concatenate([np.asarray(x, np.int32) for x in side]) for side in single]
                cut = [np.fromiter(map(len, side), np.int64, hi - lo) for side in single]
            for k in range(2):
                ids[k].append(own[k])
                sizes[k].append(cut[k])
        return [(np.concatenate(i or [np.zeros(0, np.int32)]), np.concatenate(n or [np.zeros(0, np.int64)])) for i, n in zip(ids, sizes, strict=True)]

    def encode(self, full: np.ndarray, at: np.ndarray) -> list[pa.ListArray]:
        """Ids of both sides of the texts ``full[at[i]:at[i + 1]]``, each with its added space; empty ones have none."""
        starts = chunks(full, at) if self.by_chunk else at[:-1][np.diff(at) > 0]
        ends = np.append(starts[1:], len(full)) if len(starts) else starts
        which, kinds = pd.factorize(TB.span_hash(TB.prefix_sums(full), starts, ends))
        first = np.empty(len(kinds), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        if len(self.known) > KEPT_CHUNKS or not self.by_chunk:
            self.forget()
        keys = kinds.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        base, out = len(self.known), []
        self.known.update((keys[i], base + k) for k, i in enumerate(new))
        entry = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]
        for side, (ids, sizes) in enumerate(self.ask_chunks(full, starts[first[new]], ends[first[new]])):
            self.ids[side].extend(ids)
            at_id = np.cumsum(sizes) - sizes + (len(self.ids[side]) - len(ids))
            self.sizes[side].extend(sizes)
            self.firsts[side].extend(at_id)
            n = self.sizes[side].values[entry]
            flat = self.ids[side].values[TB.gather_ranges(self.firsts[side].values[entry], n)]
            total = np.concatenate(([0], np.cumsum(n)))
            out.append(pa.ListArray.from_arrays(pa.array(total[np.searchsorted(starts, at)], pa.int32()), pa.array(flat, pa.int32())))
        return out


KEPT: dict[bytes, Pair] = {}  # the pair that this worker used last, so that its next tasks need not load it again


def kept_pair(a_file: bytes, b_file: bytes) -> Pair:
    key = hashlib.sha256(hashlib.sha256(a_file).digest() + b_file).digest()
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Pair(a_file, b_file)
    return KEPT[key]


def chunks(full: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of chunks: texts, and single spaces before a printable ASCII character.

    A byte-level pre-tokenizer begins a match there, and a piece vocabulary
    without a space mark behind another character cannot join over it, so the
    tokens of a text are those of its chunks.
    """
    n = len(full)
    cut = np.zeros(n + 1, bool)
    space = full == 32
    cut[1:n - 1] = space[1:-1] & ~space[:-2] & (full[2:] > 32) & (full[2:] < 127) if n > 2 else False
    cut[at] = True
    cut[n] = False
    return np.flatnonzero(cut)


def piece_bytes(model, i: int) -> bytes:
    if model.is_byte(i):
        return bytes([int(model.id_to_piece(i)[3:5], 16)])
    return model.id_to_piece(i).replace("▁", " ").encode()


def same_bytes(vocab: Vocabulary, ids: np.ndarray, rows: np.ndarray, want: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text whether its tokens' joined bytes are the wanted ones (``want[at[i]:at[i + 1]]``)."""
    n = len(at) - 1
    own = np.concatenate(([0], np.cumsum(np.bincount(rows, vocab.length[ids], n).astype(np.int64))))
    have = vocab.joined(ids)
    if len(have) == len(want) and (own == at).all() and (have == want).all():
        return np.ones(n, bool)
    return np.fromiter((np.array_equal(have[own[i]:own[i + 1]], want[at[i]:at[i + 1]]) for i in range(n)), bool, n)


def flattened(lists: pa.ListArray, vocab: Vocabulary, good: np.ndarray) -> pa.Table:
    """Tokens ``text, id, end, i`` of the good texts, ``end`` counted from the text's start."""
    rows, ids = pc.list_parent_indices(lists), pc.list_flatten(lists)
    keep = pa.array(good).take(rows)
    rows, ids = rows.filter(keep).cast(pa.int64()), ids.filter(keep)
    ends = pc.cumulative_sum(pa.array(vocab.length).take(ids)) if len(ids) else pa.array([], pa.int64())
    text = rows.to_numpy()
    first = np.flatnonzero(np.diff(text, prepend=-1))  # the sum starts anew at each text
    before = np.concatenate(([0], ends.to_numpy()[first[1:] - 1])) if len(first) else first
    ends = pc.subtract(ends, pa.array(np.repeat(before, np.diff(np.append(first, len(text)))), pa.int64()))
    return pa.table({"text": rows, "id": ids.cast(pa.int64()), "end": ends, "i": pa.array(np.arange(len(ids)))})


def align(pair: Pair, data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], list[str], pa.Table]:
    """Facts and group digests of a slice of texts, and its links ``text, ab, m`` (times a text links the pair)."""
    n = len(offsets) - 1
    some = np.diff(offsets) > 0
    want_at = offsets + np.concatenate(([0], np.cumsum(some)))
    want = np.full(int(want_at[-1]), 32, np.uint8)
    want[TB.gather_ranges(want_at[:-1] + some, np.diff(offsets))] = data
    a, b = pair.encode(want, want_at)
    good = some.copy()
    for lists, vocab in ((a, pair.a_bytes), (b, pair.b_bytes)):
        good &= same_bytes(vocab, lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy(), want, want_at)
    ta, tb = flattened(a, pair.a_bytes, good), flattened(b, pair.b_bytes, good)
    keys = [pa.table({"document_end": pc.add(pc.shift_left(t["text"], END_BITS), t["end"]), name: t["i"]}) for t, name in ((ta, "i"), (tb, "j"))]
    both = keys[0].join(keys[1], "document_end", join_type="inner", use_threads=False)
    group_text = np.sort(both["document_end"].to_numpy()) >> END_BITS
    sides, groups = [], []
    for t, col in ((ta, "i"), (tb, "j")):
        ends = np.zeros(t.num_rows, np.int64)
        ends[both[col].to_numpy()] = 1
        group = np.cumsum(ends) - ends
        groups.append(group)
        sides.append(pa.table({"group": pa.array(group), "id": t["id"], "c": pa.array(np.ones(t.num_rows, np.int64))}))
    sizes = [np.bincount(g, minlength=both.num_rows) for g in groups]
    if int(sizes[0] @ sizes[1]) > 2 * sum(map(len, groups)):  # large groups: count repeated ids before they meet
        sides = [t.group_by(["group", "id"], use_threads=False).aggregate([("c", "sum")]).rename_columns(["group", "id", "c"]).sort_by("group") for t in sides]
    ga, gb = sides[0]["group"].to_numpy(), sides[1]["group"].to_numpy()
    per_group = np.bincount(gb, minlength=both.num_rows)  # B's rows of a group lie together: each A row meets that range
    from_a = np.repeat(np.arange(len(ga)), per_group[ga])
    from_b = TB.gather_ranges((np.cumsum(per_group) - per_group)[ga], per_group[ga])
    (a_id, a_c), (b_id, b_c) = ([t[c].to_numpy()[i] for c in ("id", "c")] for t, i in zip(sides, (from_a, from_b), strict=True))
    links = pa.table({"text": group_text[ga[from_a]], "ab": (a_id << SHIFT) + b_id, "m": a_c * b_c})
    links = links.group_by(["text", "ab"], use_threads=False).aggregate([("m", "sum")]).rename_columns(["text", "ab", "m"])
    count = lambda rows, weight=None: np.bincount(rows, weight, n)[:n].astype(np.int64)
    total = np.zeros(n, np.int64)
    np.add.at(total, links["text"].to_numpy(), links["m"].to_numpy())
    facts = {"n_a": count(ta["text"].to_numpy()), "n_b": count(tb["text"].to_numpy()), "n_groups": count(group_text), "n_links": total}
    return facts, group_digests(pair, ta, tb, groups, good), links


def group_digests(pair: Pair, ta: pa.Table, tb: pa.Table, groups: list[np.ndarray], good: np.ndarray) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for every good text, an empty string for the others."""
    group = np.concatenate(groups)
    side = np.repeat([0, 1], [ta.num_rows, tb.num_rows])
    order = np.lexsort((side, group))  # stable: ids keep their order
    group, side = group[order], side[order]
    ids = np.concatenate((ta["id"].to_numpy(), tb["id"].to_numpy()))[order]
    text = np.concatenate((ta["text"].to_numpy(), tb["text"].to_numpy()))[order]
    last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True) if len(ids) else np.zeros(0, bool)
    kind = np.where(last, side + 1, 0)
    stock = np.concatenate([v.flat for v in pair.names])
    base = np.cumsum([0] + [len(v.flat) for v in pair.names[:-1]])
    first, length = (np.stack([getattr(v, f) for v in pair.names]) for f in ("first", "length"))
    size = length[kind, ids]
    body = stock[TB.gather_ranges(base[kind] + first[kind, ids], size)].tobytes()
    ends = np.concatenate(([0], np.cumsum(np.bincount(text, size, len(good)).astype(np.int64)))).tolist()
    return [hashlib.sha256(body[ends[i]:ends[i + 1] - 1]).hexdigest() if ok else "" for i, ok in enumerate(good.tolist())]


def pack_links(links: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """A block's distinct pairs, in how many of its texts each is linked, and its links as pair numbers by text, compressed."""
    df = links.group_by("ab", use_threads=False).aggregate([([], "count_all")]).sort_by("ab")
    pairs, text = df["ab"].to_numpy(), links["text"].to_numpy()
    number = np.searchsorted(pairs, links["ab"].to_numpy())
    order = np.lexsort((number, text))
    per_text = np.bincount(text, minlength=n).astype("<i4")
    step = np.diff(number[order], prepend=0).astype("<i4")
    body = per_text.tobytes() + step.tobytes() + links["m"].to_numpy()[order].astype("<i8").tobytes()
    return pairs, df["count_all"].to_numpy(), zstandard.compress(body, 3)


def unpack_links(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, pair number, m`` of a block's links."""
    raw = zstandard.decompress(body)
    per_text = np.frombuffer(raw, "<i4", n)
    total = int(per_text.sum())
    step = np.frombuffer(raw, "<i4", total, 4 * n)
    return np.repeat(np.arange(n), per_text), np.cumsum(step, dtype=np.int64), np.frombuffer(raw, "<i8", total, 4 * (n + total))


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align space+text as tokenizer A (byte-level, .json) and text as tokenizer B (.model, adds the space) cut it.

    One output row per input row: the id, ``n_a, n_b`` (tokens), ``n_groups``
    (between byte offsets where tokens of both end), ``n_links`` (A-B token
    pairs that share a group), ``n_best`` (links whose id pair is linked in as
    many texts as any pair of its A id), ``count_sum`` (texts that link the
    pair, summed over links) and ``groups_sha256``.

    A null or empty text, and one whose tokens do not spell space+text, has no
    tokens: zeros and an empty digest.  A null id stays null; rows that repeat
    count each by itself; an empty table gives no rows; other columns, whatever
    their names, are not read.  Whole texts are aligned.
    """
    spark = docs.sparkSession
    files = []
    for path in (a_file, b_file):
        with open(path, "rb") as f:
            files.append(f.read())
    sent = spark.sparkContext.broadcast(tuple(files))  # a few megabytes, whatever the corpus
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema[0].dataType.simpleString()
    facts_type = f"array<struct<{', '.join(f'{c}: bigint' for c in FACTS)}, groups_sha256: string>>".replace(" ", "")
    columns = ["block", "pair", "ab", "texts", "ids", "facts", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = kept_pair(*sent.value)
        block = TaskContext.get().partitionId() << 32
        for held in filled(pair, batches):
            yield from block_rows(block, held, columns)
            block += 1

    found = TA.written(src.mapInArrow(run, f"block long, pair int, ab long, texts long, ids array<{id_type}>, facts {facts_type}, body binary"), "links")
    parts = shuffle_partitions(docs)
    pairs = found.where("ab is not null").select("block", "pair", "ab", "texts").repartition(parts, "ab")
    counts = pairs.groupBy("ab").agg(F.sum("texts").alias("c"))
    best = F.broadcast(counts.groupBy(F.shiftright("ab", SHIFT).alias("a")).agg(F.max("c").alias("best")))  # at most A's vocabulary
    flagged = pairs.join(counts, "ab").join(best, F.shiftright("ab", SHIFT) == F.col("a")).select("block", "pair", "c", (F.col("c") == F.col("best")).alias("top"))
    rows = found.where("body is not null").select("block", F.lit(-1).alias("pair"), "ids", "facts", "body").unionByName(flagged, allowMissingColumns=True)
    rows = rows.select("block", "pair", "c", "top", "ids", "facts", "body").repartition(parts, "block").sortWithinPartitions("block", "pair")
    names = [id_col, *FACTS[:4], "n_best", "count_sum", "groups_sha256"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in TA.sorted_groups(batches):
            ids, facts = group.column(4)[0].values, group.column(5)[0].values
            n = len(ids)
            text, number, m = unpack_links(group.column(6)[0].as_py(), n)
            c, top = group.column(2).slice(1).to_numpy(zero_copy_only=False).astype(np.int64), group.column(3).slice(1).to_numpy(zero_copy_only=False).astype(bool)
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], text, m * top[number])
            np.add.at(sums[1], text, m * c[number])
            own = {f.name: facts.field(k) for k, f in enumerate(facts.type)}
            yield pa.RecordBatch.from_arrays([ids, *(own[f] for f in FACTS), pa.array(sums[0]), pa.array(sums[1]), own["groups_sha256"]], names=names)

    return rows.mapInArrow(finish, f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string")


def filled(pair: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """Ids, facts, digests and links of slices that fill a block."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    size = rows = 0
    for batch in batches:
        for lo, hi, data, offsets in TB.slices(batch.column(1)):
            facts, digests, links = align(pair, data, offsets)
            links = links.set_column(0, "text", pc.add(links["text"], rows))
            for part, x in zip(held, (batch.column(0).slice(lo, hi - lo), facts, digests, links), strict=True):
                part.append(x)
            size, rows = size + len(data), rows + hi - lo
            if size >= BLOCK_BYTES:
                yield held
                held, size, rows = ([], [], [], []), 0, 0
    if rows:
        yield held


def block_rows(block: int, held: tuple[list, list, list, list], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Output rows of a block: its texts, then its pairs by number."""
    ids, facts, digests, links = pa.concat_arrays(held[0]), held[1], [d for x in held[2] for d in x], pa.concat_tables(held[3])
    n = len(ids)
    pairs, texts, body = pack_links(links, n)
    own = pa.StructArray.from_arrays([*(pa.array(np.concatenate([x[f] for x in facts])) for f in FACTS), pa.array(digests, pa.string())], names=[*FACTS, "groups_sha256"])
    one = pa.array([0, n], pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                                      pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, own), pa.array([body], pa.binary())], names=names)
    k = len(pairs)
    t = pa.table([pa.array(np.full(k, block)), pa.array(np.arange(k), pa.int32()), pa.array(pairs), pa.array(texts, pa.int64()),
                  pa.nulls(k, pa.list_(ids.type)), pa.nulls(k, pa.list_(own.type)), pa.nulls(k, pa.binary())], names=names)
    yield from t.to_batches(max_chunksize=1 << 16)
