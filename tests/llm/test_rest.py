"""Operators 3, 5, 7 and 9 and the pipeline."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanlake.llm import fixity, mixing, quality, toxicity
from spanlake.llm import queries as Q


# --- operator 3 ------------------------------------------------------------------------

def edf(weights):
    """Earliest-deadline-first over one period, slot by slot."""
    h, done, out = sum(weights), [0] * len(weights), []
    for t in range(h):
        due = [(-(-(k + 1) * h // w), i) for i, (k, w) in enumerate(zip(done, weights)) if k * h // w <= t]
        i = min(due)[1]
        done[i] += 1
        out.append(i)
    return out


def check_mix(out, shares, block):
    """Every block in its window, one block a slot, and less than one block off the given shares at every slot."""
    total = sum(shares.values())
    sizes = Counter(x["source"] for x in out)
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    slots = {}
    for x in out:
        k, w = x["mix_block"], shares[x["source"]]
        assert k * total // w <= x["mix_slot"] < -(-(k + 1) * total // w)
        assert x["mix_release"] <= x["mix_slot"] < x["mix_deadline"] and x["mix_key"] // block == x["mix_slot"]
        slots.setdefault(x["mix_slot"], set()).add((x["source"], k))
    assert all(len(s) == 1 for s in slots.values()) and len({x["mix_key"] for x in out}) == len(out)
    given = Counter()
    for t in sorted(slots):
        (s, k), = slots[t]
        assert k == given[s]
        given[s] += 1
        if len(shares) < 50 or t % 97 == 0:
            for n, w in shares.items():
                if given[n] < blocks[n]:
                    assert abs(given[n] * total - (t + 1) * w) < total
    assert given == blocks
    return slots


def test_mix_follows_edf_and_deviates_less_than_a_block(spark, docs_of):
    r = random.Random(3)
    source = [r.choice(["a"] * 10 + ["b"] * 4 + ["c", None]) for _ in range(900)]
    docs = docs_of([(i, "x") for i in range(900)], source)
    shares = {"a": 50, "b": 30, "c": 20, None: 17}
    targets = spark.createDataFrame([(s, 3 * w) for s, w in shares.items()], "source string, share long")
    out = mixing.mix_sources(docs, targets, block_docs=4).collect()
    assert len(out) == 900 and "_mx_w" not in out[0].asDict()
    slots = check_mix(out, shares, 4)
    names, weights = zip(*sorted(shares.items(), key=lambda x: -x[1]))
    run = edf(weights)
    assert all(next(iter(s))[0] == names[run[t % 117]] for t, s in slots.items())


@pytest.mark.parametrize("small,large", [(2000, 2000), (200, 200), (601, 7919)])
def test_mix_of_many_small_sources_keeps_the_given_shares(spark, small, large):
    rows = spark.range(3 * large).select(F.col("id").alias("doc_id"), F.lit("big").alias("source"))
    rows = rows.unionByName(spark.range(3 * small).select((F.col("id") + 10**6).alias("doc_id"), F.concat(F.lit("s"), F.col("id") % small).alias("source")))
    targets = spark.createDataFrame([("big", large)], "source string, share long")
    out = mixing.mix_sources(rows, targets, block_docs=1).collect()
    assert len(out) == 3 * (small + large)
    check_mix(out, {"big": large} | {f"s{i}": 1 for i in range(small)}, 1)


def test_mix_of_many_different_shares(spark):
    shares = {f"s{i}": i + 1 for i in range(60)}
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 60).alias("source"))
    targets = spark.createDataFrame(list(shares.items()), "source string, share long")
    check_mix(mixing.mix_sources(rows, targets, block_docs=2).collect(), shares, 2)


def test_mix_refuses_endless_schedules(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 10)
    with pytest.raises(Exception, match="steps"):
        mixing.mix_sources(docs_of([(i, "x") for i in range(640)], ["a"] * 320 + ["b"] * 320), spark.createDataFrame([("a", 7), ("b", 9)], "source string, share long"))


def test_mix_defaults_and_edges(spark, docs_of):
    docs = docs_of([(i, None) for i in range(40)] + [(None, "x"), (3, "x")], ["a"] * 30 + ["b"] * 12).withColumn("mix_key", F.lit("old"))
    out = mixing.mix_sources(docs)
    assert out.count() == 42 and out.columns[:-5] == [c for c in docs.columns if c != "mix_key"]
    assert mixing.mix_sources(docs_of([])).count() == 0
    assert mixing.mix_sources(docs_of([(1, "x")])).first()["mix_slot"] == 0


def test_many_ranges_of_a_hot_source(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 16)
    docs = docs_of([(i, "x") for i in range(600)], ["hot"] * 500 + ["b"] * 100)
    out = mixing.mix_sources(docs, block_docs=1).collect()
    assert sorted(x["mix_block"] for x in out if x["source"] == "hot") == list(range(500))


# --- operator 9 ------------------------------------------------------------------------

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("clash")).withColumn("digest", F.lit(1))


def test_audit_finds_exactly_the_damage(spark):
    rows = [(i * 37, f"http://x/{i}", "body %d " % i * (i % 50)) for i in range(300)]
    rows += [(None, None, None), (None, "u", ""), (5, "u", "same"), (5, "u", "same"), (5, "u", "other")]
    bad = [r for r in rows if r[0] not in (37 * 7, 37 * 299)]
    bad = [(i, u, (h or "") + "!") if i == 37 * 120 or (i is None and u is None) else (i, u, h) for i, u, h in bad] + [(999_999, "new", "n")]
    out = fixity.audit_replicas(fixity.records(pages(spark, rows)), fixity.records(pages(spark, bad))).collect()
    got = sorted((x["page_id"] or -1, x["status"]) for x in out)
    # a record without an id lies where its digest puts it: changed bytes are one lost and one new record
    assert [g for g in got if g[0] != -1] == [(37 * 7, "missing"), (37 * 120, "altered"), (37 * 299, "missing"), (999_999, "extra")]
    assert {g[1] for g in got if g[0] == -1} <= {"missing", "extra", "altered"} and any(g[0] == -1 for g in got)
    assert fixity.audit_replicas(fixity.records(pages(spark, rows)), fixity.records(pages(spark, rows[::-1]))).count() == 0


def test_audit_of_empty_replicas(spark):
    empty, one = fixity.records(pages(spark, [])), fixity.records(pages(spark, [(1, "u", "h")]))
    assert fixity.audit_replicas(empty, empty).count() == 0
    assert [r["status"] for r in fixity.audit_replicas(one, empty).collect()] == ["missing"]
    assert [r["status"] for r in fixity.audit_replicas(empty, one).collect()] == ["extra"]


def test_offsets_are_running_lengths(spark):
    m = fixity.manifest(fixity.records(pages(spark, [(i, "u", "x" * i) for i in range(50)]))).orderBy("page_id").collect()
    assert [r["offset"] for r in m] == [sum(x["length"] for x in m[:i]) for i in range(50)]


# --- operators 5 and 7 -----------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark, docs_of, prose):
    r = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        junk, rude = i % 4 == 0, r.random() < 0.3
        words = prose(i, r.randint(30, 120)).split()
        if rude:
            words[r.randint(0, len(words) - 1)] = r.choice(["vileword", "nastyterm", "vilewords"])
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words)))
        marks.append((i, 0 if junk else 1, int(rude)))
    return docs_of(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    out = quality.score_quality(docs.withColumn("score", F.lit("clash")), labels.where("doc_id % 5 <> 0"), sample=200)
    x = out.join(labels, "doc_id").where("doc_id % 5 = 0").select("quality", "score").collect()
    assert sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in x) / len(x) >= 0.95
    assert out.count() == 400 and all(0 <= r["score"] <= 1 for r in out.select("score").collect())


def test_quality_edges(spark, docs_of, labelled):
    docs, labels = labelled
    odd = docs_of([(1, None), (2, ""), (3, "x"), (None, "a b"), (3, "x"), (4, "y" * 300_000)])
    seen = docs.unionByName(odd)
    out = quality.score_quality(odd, labels.limit(0)).collect()
    assert [r["score"] for r in out] == [0.5] * 6
    scored = quality.score_quality(seen, labels.where("doc_id > 10"), sample=100).where("n_chars is null or n_chars < 4 or n_chars = 300000").collect()
    assert len(scored) >= 6 and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_chain_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.train_chain(docs, marks.where("doc_id % 5 <> 0"), ["low_quality", "toxic"])
    assert [c for c, _ in chain] == ["low_quality", "toxic"] and len(chain[1][1].earlier) == 1
    out = toxicity.score_chain(docs.withColumn("p_toxic", F.lit("clash")), chain)
    x = out.join(marks, "doc_id").where("doc_id % 5 = 0").collect()
    assert sum((r["p_toxic"] >= 0.5) == (r["toxic"] == 1) for r in x) / len(x) >= 0.95


def test_chain_edges(spark, docs_of, labelled):
    docs, labels = labelled
    odd = docs_of([(1, None), (2, ""), (None, "a b"), (2, "")])
    none = toxicity.train_chain(docs, labels.limit(0).select("doc_id", "toxic"), ["toxic"])
    assert all(r["p_toxic"] < 1e-6 for r in toxicity.score_chain(odd, none).collect())
    ones = toxicity.train_chain(docs, labels.select("doc_id", F.lit(1).alias("toxic")), ["toxic"])
    assert all(r["p_toxic"] > 1 - 1e-6 for r in toxicity.score_chain(odd, ones).collect())
    gaps = toxicity.train_chain(docs, labels.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("toxic")).alias("toxic")), ["toxic"])
    assert toxicity.score_chain(odd, gaps).count() == 4 and toxicity.score_chain(docs.limit(0), gaps).count() == 0


# --- queries and pipeline --------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    rel = duck.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda rows, cols: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(rel.fetchall(), list(rel.columns))


def test_every_dealt_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


def test_op7_contract(spark):
    out = Q.op7_quality_votes(spark, SF)
    rows = out.collect()
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as P
    from tests.llm.test_dedup import linked, shingle_set
    docs = Q.read(spark, SF, "documents")
    kept, frames = docs, []
    for name, stage in P.STAGES:
        kept = P.TA.written(stage(spark, kept, SF), name)
        frames.append(kept)
        if name != "encoding":
            assert kept.columns == docs.columns
    first, near, sub, mixed, enc = ([r.asDict() for r in f.collect()] for f in frames)
    scores = {r["doc_id"]: r["score"] for r in Q.quality_scores(docs, Q.read(spark, SF, "labels")).collect()}
    assert {r["doc_id"] for r in first} == {i for i, s in scores.items() if s >= Q.KEEP_QUALITY}
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in first}
    ids = sorted(sets)
    left = {r["doc_id"] for r in near}
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and linked(sets[a], sets[b], 80):
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert left == {i for i in ids if group[i] == i}
    assert {r["doc_id"] for r in sub} == left and all(r["n_chars"] == len(r["text"]) for r in sub)
    assert sorted(r["doc_id"] for r in mixed) == sorted(left)
    assert {r["doc_id"] for r in enc} == left and all(r["n_tokens"] >= 0 for r in enc)
    run = [r.asDict() for r in P.run(spark, SF).collect()]
    assert sorted(map(str, run)) == sorted(map(str, enc))
    assert math.isfinite(len(run))


def test_pipeline_rows_carry_the_mix(spark, docs_of):
    import corpus_pipeline as P

    docs = docs_of([(i, f"text {i}") for i in range(120)], ["a"] * 80 + ["b"] * 30 + ["c"] * 10)
    want = {r["doc_id"]: r["mix_key"] for r in mixing.mix_sources(docs).collect()}
    mixed = P.mixing_stage(spark, docs, SF)
    out = P.encoding_stage(spark, mixed.repartition(7), SF)
    assert {r["doc_id"]: r["mix_key"] for r in out.collect()} == want and len(set(want.values())) == 120
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "mix_key"]
