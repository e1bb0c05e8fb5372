"""Operator 10 against the reference tokenizer library and an exact round trip."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from spanlake.llm import bpe
from spanlake.llm import textbytes as TB

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def merger():
    with open(FILE, "rb") as f:
        return bpe.Merger.from_rank_file(f.read())


@pytest.fixture(scope="module")
def tik():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_encode_as_the_library_does(merger, tik):
    r = random.Random(5)
    chars = list("ab'stremvdl  \n\t\r\x85\xa0 é漢字1²٣😀.,!_\x1c​Ḁⅷ")
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 30))) for _ in range(5000)]
    texts += ["it's we'll they've 'sx ''s  's\n's \n 'd x'", "", "a" * 700, "ab" * 400, " " * 300, "é" * 333, "<|endoftext|>"]
    out = []
    for lo, hi, data, offsets in TB.slices(pa.array(texts), 4096):
        ids, at = merger.encode(data, offsets)
        out += [ids[at[i]:at[i + 1]].tolist() for i in range(hi - lo)]
        assert merger.decode(ids).tobytes() == data.tobytes()
    assert out == [tik.encode_ordinary(t) for t in texts]


def test_both_merges_agree(merger):
    pieces = [b"hello", b" thinking", b"aaaaaaaa", "überß".encode(), b"\xff\xfe", b"x" * 40]
    ids, n = merger.merge_many(pieces, 64)
    assert [ids[a:b].tolist() for a, b in zip([0, *n.cumsum()[:-1]], n.cumsum())] == [merger.merge_one(p) for p in pieces]


def test_cache_starts_anew(tik, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    with open(FILE, "rb") as f:
        m = bpe.Merger.from_rank_file(f.read())
    for text in ("one two three four five", "five four seven", "one one eight"):
        _, _, data, offsets = next(TB.slices(pa.array([text])))
        assert m.encode(data, offsets)[0].tolist() == tik.encode_ordinary(text)


def test_query_columns_and_edges(spark, docs_of, tik):
    texts = [(1, "Hello world, it's me"), (2, None), (3, ""), (None, "x y"), (1, "Hello world, it's me"), (4, "long " * 30000)]
    out = bpe.encode_documents(docs_of(texts), FILE, with_ids=True).collect()
    want = []
    for i, t in texts:
        ids = tik.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in out) == sorted(want)
    assert bpe.encode_documents(docs_of([]), FILE).count() == 0
