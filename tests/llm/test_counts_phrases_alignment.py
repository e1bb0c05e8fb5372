"""Operators 11, 12 and 13 against the tokenizer libraries and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlake.llm import alignment, collocations, tables, tokencounts
from spanlake.llm import queries as Q

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=B_FILE)


@pytest.fixture(scope="module")
def bytelevel():
    t = Tokenizer.from_file(A_FILE)
    t.encode_special_tokens = True
    return t


ODD = ["", None, " ", "\n\n", "a", "x<|endoftext|>y <s> </s> <unk> <0x0A>", "漢字かな😀 ünï▁x", "  two  spaces ", "tab\there\x00nul", "long " * 30000,
       "é" * 3000, "́́a", "the cat sat", "the cat sat", "​zero", "a" * 5000]


def table(docs_of, texts):
    return docs_of(list(enumerate(texts)) + [(None, "the cat sat"), (None, "the cat sat"), (3, "\n\n"), (3, "other text")])


def check_counts(out, rows, pieces):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    want = sorted((i if i is not None else -1, len((t or "").encode()), n, n > 4096) for i, t in rows for n in [len(pieces.encode(t or ""))])
    assert got == want


def test_token_counts(spark, docs_of, pieces, monkeypatch):
    docs = table(docs_of, ODD).withColumn("digest", F.lit("clash"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = tokencounts.count_tokens(docs, B_FILE)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    check_counts(out, rows, pieces)
    monkeypatch.setattr(tokencounts, "KEPT_DIGESTS", 2)
    monkeypatch.setattr(tables, "HOT_KEYS", 1)
    check_counts(tokencounts.count_tokens(docs, B_FILE), rows, pieces)
    assert tokencounts.count_tokens(docs_of([]), B_FILE).count() == 0


def test_cache_encodes_distinct_misses_only(spark, docs_of, pieces, bytelevel, tmp_path):
    cache = str(tmp_path / "cache")
    first, more = docs_of([(1, "one two"), (2, "one two"), (None, "one two"), (3, None)]), docs_of([(4, "one two"), (5, "three"), (5, "three"), (6, "")])
    check_counts(tokencounts.count_tokens(first, B_FILE, cache), [(1, "one two"), (2, "one two"), (None, "one two"), (3, None)], pieces)
    stored = lambda: spark.read.schema(tokencounts.CACHE).parquet(cache)
    assert stored().count() == 2
    # a stored count is used, not computed again: a planted wrong one comes back
    version = tokencounts.tokenizer_version("sentencepiece", open(B_FILE, "rb").read())
    planted = spark.createDataFrame([("three", 99)], "t string, n_tokens long").select(F.unhex(F.sha2("t", 256)).alias("digest"), "n_tokens", F.lit(version).alias("tokenizer"))
    planted.write.mode("append").partitionBy("tokenizer").parquet(cache)
    got = {(r["doc_id"], r["n_tokens"]) for r in tokencounts.count_tokens(more, B_FILE, cache).collect()}
    assert got == {(4, len(pieces.encode("one two"))), (5, 99), (6, 0)} and stored().count() == 3
    other = {(r["doc_id"], r["n_tokens"]) for r in tokencounts.count_tokens(more, A_FILE, cache).collect()}
    assert (5, len(bytelevel.encode("three").ids)) in other and stored().count() == 6
    with pytest.raises(ValueError):
        tokencounts.count_tokens(more, "ranks.tiktoken")


def test_token_counts_query(spark, pieces):
    out = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in Q.op11_token_counts(spark, SF).collect()}
    rows = Q.read(spark, SF, "documents").collect()
    assert out == {r["doc_id"]: (len(b := (r["text"] or "").encode()), n := len(pieces.encode(b.decode())), n > 4096) for r in rows}


def mined(rows, max_words=3, min_count=10, percent=50, top=2000):
    """Collocations by counting every contiguous phrase."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        drop = {p[i:i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= percent * cand[p[i:i + m]]}
        best = []
        for p, a in cand.items():
            if p not in drop:
                s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def chatter(spark):
    r = random.Random(6)
    words = ["new", "York", "city", "the", "of", "ÉTÉ", "été", "a-b", "x", " ", "<y>", "é"]
    rows = []
    for i in range(240):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for _ in range(r.randint(0, 40)))
        rows.append((i, t + r.choice(["", " new york city", "the the the the"]), r.choice(["en", "en", "fr", None, ""])))
    rows += [(None, None, "en"), (1, "", "de"), (1, " . , ", "it"), (2, "w " * 5000, "xx"), (3, "only once", "zz")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.lit("clash")), [(lang, t) for _, t, lang in rows]


@pytest.mark.parametrize("words,least,percent,top", [(3, 10, 50, 2000), (4, 5, 80, 7), (2, 2, 50, 40)])
def test_collocations(chatter, monkeypatch, words, least, percent, top):
    docs, rows = chatter
    monkeypatch.setattr(collocations, "GROUP_ROWS", 50)
    monkeypatch.setattr(collocations, "TOP_PARTS", 3)
    out = collocations.collocations(docs.repartition(5), max_words=words, min_count=least, inside_percent=percent, top=top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(t == "bigint" for c, t in out.dtypes if c not in ("lang", "phrase"))
    assert sorted(tuple(r) for r in out.collect()) == mined(rows, words, least, percent, top)


def test_collocations_of_small_blocks_and_none(spark, chatter, monkeypatch):
    docs, rows = chatter
    monkeypatch.setattr(collocations.TB, "SLICE_BYTES", 300)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == mined(rows)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("lang = 'zz'")).count() == 0


def test_score_passes_64_bits(spark):
    """The score's arithmetic holds for counts of ten billion."""
    big = 10_000_000_019
    q = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 7).alias("l"), F.lit(3 * big).alias("r")).selectExpr(collocations.SCORE + " as score")
    assert q.first()["score"] == 1000000 * big * big // ((big + 7) * 3 * big)


def test_bitmap_lets_all_members_pass(spark):
    r = random.Random(2)
    keys = [r.randint(-2**63, 2**63 - 1) for _ in range(3000)] + [0, -1, 2**63 - 1, -2**63]
    b = collocations.bitmap_of(spark.createDataFrame([(k,) for k in keys], "h long"))
    assert all(k in b for k in keys)
    assert sum(r.randint(-2**63, 2**63 - 1) in b for _ in range(3000)) < 100
    assert collocations.bitmap_of(spark.createDataFrame([], "h long")).bits.sum() == 0


def test_frequent_fingerprints_travel_small_and_none_is_lost(spark, monkeypatch, tmp_path):
    """What occurs often enough over all tasks comes back, also counts past what travels; a fingerprint takes under 8 bytes of shuffle."""
    monkeypatch.setattr(collocations, "GROUP_ROWS", 20_000)
    r = np.random.default_rng(4)
    kinds = r.integers(-2**63, 2**63 - 1, 150_000)
    rows = spark.createDataFrame([(int(x),) for x in np.concatenate((kinds, kinds[:500], np.repeat(kinds[7], 200_000)))], "h long").repartition(3)
    prints = lambda batches: (b.column(0).to_numpy() for b in batches)
    for least, want in ((2, kinds[:500]), (100_000, kinds[7:8])):
        assert sorted(x["h"] for x in collocations.frequent(rows, prints, least).collect()) == sorted(collocations.short(want).tolist())
    assert collocations.frequent(rows.limit(0), prints, 1).count() == 0
    x = collocations.merged(kinds.view(np.uint64) & ~collocations.MOST | np.uint64(1))
    assert (collocations.unsteps(collocations.steps(x)) == x).all()
    assert len(zstandard.compress(collocations.planes(collocations.steps(x)), 1)) < 5 * len(kinds)


def test_blocks_hold_counts_only_once(spark, chatter, monkeypatch):
    """Only the words' relation is stored, a row a block; a write leaves the session's settings as they were."""
    seen, write = {}, tables.written

    def written(df, name, compression=None):
        seen[name] = out = write(df, name, compression)
        return out

    monkeypatch.setattr(tables, "written", written)
    docs, _ = chatter
    collocations.collocations(docs.repartition(5)).count()
    assert seen["words"].count() <= 5 and set(seen) == {"words", "often", "frequent_1", "frequent_2", "frequent_3"}
    assert spark.conf.get(tables.SHUFFLE_CLEANUP, "false") == "false"


def byte_ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def aligned(rows, bytelevel, pieces):
    """Alignment by walking over both token lists."""
    alphabet = alignment.byte_alphabet()
    per = []
    for i, text in rows:
        a, b = (bytelevel.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        ab = [bytes(alphabet[c] for c in bytelevel.id_to_token(x)) for x in a]
        bb = [bytes([int(pieces.id_to_piece(x)[3:5], 16)]) if pieces.is_byte(x) else pieces.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            per.append((i, [], [], [], Counter()))
            continue
        ae, be = byte_ends(ab), byte_ends(bb)
        cuts = sorted(set(ae) & set(be))
        groups = [([], []) for _ in cuts]
        for ids, ends, side in ((a, ae, 0), (b, be, 1)):
            g = 0
            for x, e in zip(ids, ends):
                groups[g][side].append(x)
                g += e == cuts[g]
        links = Counter()
        for ga, gb in groups:
            for x, c in Counter(ga).items():
                for y, d in Counter(gb).items():
                    links[x, y] += c * d
        per.append((i, a, b, groups, links))
    count = Counter(p for *_, links in per for p in links)
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    out = []
    for i, a, b, groups, links in per:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((-1 if i is None else i, len(a), len(b), len(groups), sum(links.values()), sum(m for p, m in links.items() if count[p] == best[p[0]]),
                    sum(m * count[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out)


@pytest.mark.parametrize("block,slice_bytes", [(alignment.BLOCK_BYTES, 1 << 20), (2000, 700)])
def test_alignment(spark, docs_of, bytelevel, pieces, prose, monkeypatch, block, slice_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment.TB, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(alignment.TB.slices, "__defaults__", (slice_bytes,))
    docs = table(docs_of, ODD + [prose(i, 40) + " isn't it? 'quoted' 1234" for i in range(12)]).withColumn("ab", F.lit("clash"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = alignment.align_tokenizers(docs.repartition(3), A_FILE, B_FILE)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in out.collect()) == aligned(rows, bytelevel, pieces)


def test_alignment_leaves_out_what_the_tokens_do_not_spell():
    pair = alignment.Pair(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())
    texts = ["plain text", "a▁b", "more"]  # U+2581 itself comes back as a space
    lo, hi, data, offsets = next(alignment.TB.slices(pa.array(texts)))
    facts, digests, links = alignment.align(pair, data, offsets)
    assert facts["n_a"][1] == facts["n_b"][1] == 0 and digests[1] == "" and facts["n_a"][0] > 0 and facts["n_b"][2] > 0
    assert set(links["text"].to_pylist()) == {0, 2}


def test_chunks_encode_as_whole_texts(bytelevel, pieces, monkeypatch):
    """Ids of texts put together from cached chunks are those of the libraries on whole texts."""
    r = random.Random(11)
    chars = list("ab'stremvdl  \n\t\r\x85\xa0 é漢1²٣😀.,!_\x1c​Ḁ\u2003\u3000-") + ["  ", " a", " 's", " \n", "\xa0 x"]
    texts = ["".join(r.choice(chars) for _ in range(r.randint(1, 40))) for _ in range(3000)] + ["", " ", "  ", "   x", "x ", "x" * 600, "a  b   c"]
    pair = alignment.Pair(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())
    assert pair.by_chunk
    want = [bytelevel.encode(" " + t, add_special_tokens=False).ids if t else [] for t in texts], [pieces.encode(t) if t else [] for t in texts]
    for kept, chunked in ((1 << 18, True), (100, True), (5, False)):
        monkeypatch.setattr(alignment, "KEPT_CHUNKS", kept)
        pair.by_chunk = chunked
        got = [], []
        for lo in range(0, len(texts), 500):
            full = [(" " + t if t else "").encode() for t in texts[lo:lo + 500]]
            lists = pair.encode(alignment.np.frombuffer(b"".join(full), alignment.np.uint8), alignment.np.array([0, *byte_ends(full)]))
            for out, part in zip(got, lists):
                out.extend(part.to_pylist())
        assert got == want


def test_alignment_query_and_empty_table(spark, docs_of, bytelevel, pieces):
    rows = [(r["doc_id"], r["text"]) for r in Q.read(spark, SF, "documents").collect()]
    assert sorted(tuple(r) for r in Q.op13_alignment(spark, SF).collect()) == aligned(rows, bytelevel, pieces)
    assert alignment.align_tokenizers(docs_of([]), A_FILE, B_FILE).count() == 0
    assert alignment.align_tokenizers(docs_of([(1, None), (2, "")]), A_FILE, B_FILE).count() == 2


def test_lookup_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_KEYS", 2)
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    values = rows.groupBy("k").agg(F.count("*").alias("c")).where("k <> 5")
    got = sorted(tuple(r) for r in tables.lookup(rows, values, ["k"], "c").select("id", "k", "c").collect())
    assert got == sorted(tuple(r) for r in rows.join(values, "k").select("id", "k", "c").collect())
