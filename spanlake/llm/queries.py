"""One query per training-data operator, over whole tables with production parameters.

``ORACLES`` holds DuckDB SQL where SQL can express the operator; the others are
held against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import (alignment, bpe, collocations, fixity, mixing, neardup, paragraphs, pivots, projections, quality, suffixes, tokencounts,
                          toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """A public vocabulary used by the queries; a parameter of the operators themselves."""
    import public_tokenizers
    return public_tokenizers.path(name)


def rank_file() -> str:
    return tokenizer_file("byte_bpe_multi_50k.tiktoken")


@register("op1_projections")
def op1_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return projections.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@register("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(read(spark, sf_dir, "documents"))


@register("op4_pivots", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op4_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return pivots.top_products(vectors, vectors.where("vec_id % 20 = 0"))


OP3_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, CAST(floor(sqrt(count(*)) * 1000) AS BIGINT) AS share FROM documents GROUP BY source
), shares AS (SELECT source, greatest(1, CAST((1000 * share) // sum(share) OVER () AS BIGINT)) AS share FROM sizes
), common AS (SELECT list_reduce(list(share), lambda a, b: gcd(a, b)) AS g FROM shares
), plan AS (
  SELECT source, share // g AS w, count(*) OVER (PARTITION BY share) AS m, row_number() OVER (PARTITION BY share ORDER BY source NULLS FIRST) - 1 AS p,
         dense_rank() OVER (ORDER BY share DESC) AS c, CAST(sum(share // g) OVER () AS BIGINT) AS h FROM shares, common
), classes AS (SELECT c, any_value(w * m) AS w, any_value(h) AS h FROM plan GROUP BY c
), edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, c, w, h, CAST(0 AS BIGINT) AS done, false AS runs FROM classes
  UNION ALL
  SELECT t + 1, c, w, h, done + CASE WHEN best = 1 THEN 1 ELSE 0 END, best = 1
  FROM (SELECT *, row_number() OVER (ORDER BY ((done * h) // w > t + 1), ((done + 1) * h + w - 1) // w, c) AS best
        FROM edf WHERE t + 1 < h)
), slots AS (SELECT c, t, row_number() OVER (PARTITION BY c ORDER BY t) - 1 AS j FROM edf WHERE runs
), ranked AS (
  SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':7'), d.doc_id) - 1 AS r
  FROM documents d
)
SELECT r.doc_id, r.source, r.r // 16 AS mix_block, ((r.r // 16) * p.h) // p.w AS mix_release,
       (((r.r // 16) + 1) * p.h + p.w - 1) // p.w AS mix_deadline,
       (((r.r // 16) * p.m + p.p) // (p.m * p.w)) * p.h + s.t AS mix_slot,
       ((((r.r // 16) * p.m + p.p) // (p.m * p.w)) * p.h + s.t) * 16 + r.r % 16 AS mix_key
FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source JOIN slots s ON s.c = p.c AND s.j = ((r.r // 16) * p.m + p.p) % (p.m * p.w)
"""


@register("op3_pfair_mix", OP3_SQL)
def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_key")


def second_replica(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` with stated damage: one altered byte, lost pages, and pages stored twice."""
    hit = F.col("page_id") % 97 == 13
    body = F.when(hit, F.concat(F.substring("html", 1, 9), F.lit("#"), F.substring(F.col("html"), F.lit(11), F.length("html")))).otherwise(F.col("html"))
    kept = pages.select("page_id", "url", body.alias("html")).where("page_id % 211 <> 5")
    return kept.unionByName(kept.where("page_id % 307 = 7"))


OP9_SQL = """
WITH damaged AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN substr(html, 1, 9) || '#' || substr(html, 11) ELSE html END AS html
  FROM pages WHERE page_id % 211 <> 5
), stores AS (
  SELECT 'a' AS store, page_id, url, html FROM pages
  UNION ALL SELECT 'b', page_id, url, html FROM damaged
  UNION ALL SELECT 'b', page_id, url, html FROM damaged WHERE page_id % 307 = 7
), recs AS (
  SELECT store, page_id, coalesce(url, '') AS url, 'WARC/1.0' || nl || 'WARC-Type: response' || nl || 'WARC-Target-URI: ' || coalesce(url, '') || nl
    || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(coalesce(html, '')) || nl || nl || coalesce(html, '') || nl || nl AS rec
  FROM (SELECT *, chr(13) || chr(10) AS nl FROM stores)
), facts AS (
  SELECT store, page_id, url, strlen(rec) AS length, sha256(rec) AS digest, page_id >> 10 AS file FROM recs
), m AS (
  SELECT *, row_number() OVER (PARTITION BY store, file, page_id, url ORDER BY digest) AS copy,
    coalesce(sum(length) OVER (PARTITION BY store, file ORDER BY page_id, url, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM facts
), a AS (SELECT * FROM m WHERE store = 'a'), b AS (SELECT * FROM m WHERE store = 'b')
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.url, b.url) AS url, coalesce(a.copy, b.copy) AS copy,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'altered' END AS status,
  coalesce(a.file, b.file) AS file, CAST(a."offset" AS BIGINT) AS "offset", a.length, a.digest, b.length AS found_length, b.digest AS found_digest
FROM a FULL JOIN b ON a.file = b.file AND a.page_id = b.page_id AND a.url = b.url AND a.copy = b.copy
WHERE a.digest IS DISTINCT FROM b.digest
"""


@register("op9_merkle_audit", OP9_SQL)
def op9_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return fixity.audit_replicas(fixity.records(pages), fixity.records(second_replica(pages)))


TOXIC = 0.4


@register("op5_toxicity_chain")
def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.train_chain(docs, labels, ["low_quality", "toxic"])
    out = toxicity.score_chain(docs, chain)
    return out.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= TOXIC).cast("int").alias("toxic"))


@register("op6_paragraph_dedup")
def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paragraphs.paragraph_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("dedup_removed").alias("n_removed"), F.col("dedup_words").alias("n_words"), F.col("dedup_spans").alias("spans"))


KEEP_QUALITY = 0.7


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality scores learned without the held-out quarter of the labels."""
    seen = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return quality.score_quality(docs, seen)


@register("op7_quality_votes")
def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_scores(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score",
                      (F.col("score") >= KEEP_QUALITY).cast("int").alias("predicted"))


@register("op8_neardup")
def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), neardup.Similarity(shingle=3, percent=85))


@register("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), rank_file())


@register("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), limit=4096)


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, p, row_number() OVER () AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), lists AS (
  SELECT lang, piece, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), r1 AS (SELECT lang, piece, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM lists
), f1 AS (SELECT lang, w AS phrase, count(*) AS f FROM r1 GROUP BY ALL
), r2 AS (SELECT a.lang, a.piece, a.pos, a.w AS w1, b.w AS w2 FROM r1 a JOIN r1 b ON a.piece = b.piece AND b.pos = a.pos + 1
), f2 AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS phrase, count(*) AS f FROM r2 GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT a.lang, a.w1, a.w2, b.w2 AS w3, a.w1 || ' ' || a.w2 || ' ' || b.w2 AS phrase, count(*) AS f
  FROM r2 a JOIN r2 b ON a.piece = b.piece AND b.pos = a.pos + 1 GROUP BY ALL HAVING count(*) >= 10
), parts AS (SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, phrase, f FROM f2
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT f2.lang, f2.phrase, f2.f AS a, 1 AS k, w1 AS x, w2 AS y FROM f2 LEFT JOIN longer l ON l.lang = f2.lang AND l.phrase = f2.phrase
  WHERE l.f IS NULL OR 100 * l.f < 50 * f2.f
  UNION ALL SELECT lang, phrase, f, 1, w1, w2 || ' ' || w3 FROM f3
  UNION ALL SELECT lang, phrase, f, 2, w1 || ' ' || w2, w3 FROM f3
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, p.f AS l, q.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
  FROM cuts c JOIN parts p ON p.lang = c.lang AND p.phrase = c.x JOIN parts q ON q.lang = c.lang AND q.phrase = c.y
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), n AS (SELECT lang, count(*) AS n FROM r1 GROUP BY lang
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@register("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), max_words=3, min_count=10, inside_percent=50, top=2000)


@register("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
