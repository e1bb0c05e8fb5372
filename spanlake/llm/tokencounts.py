"""Operator 11: token counts behind a cache of content digests.

A count depends on nothing but a text's normalised content and the tokenizer's
version, so counts are stored by both digests.  Rows carry digests only; the
digests are joined to the stored counts, one text of each digest without one is
encoded, its count is appended to the cache, and all rows are answered from
there.  The text travels once, for misses, spread by digest and id, so copies of
one text under many ids are not gathered in a task; rows that repeat both may be
encoded once in each task that meets them, and are stored once.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm import tables as TA
from spanlake.session import scratch_dir

CACHE = "digest binary, n_tokens long, tokenizer string"
KEPT_DIGESTS = 1 << 20   # counts that an encoding task remembers to skip copies


def library_of(file: str) -> str:
    """The library that reads a tokenizer file: ``tokenizers`` for .json, ``sentencepiece`` for .model."""
    if file.endswith(".json"):
        return "tokenizers"
    if file.endswith(".model"):
        return "sentencepiece"
    raise ValueError(f"not a .json or .model tokenizer: {file}")


def counter(library: str, content: bytes) -> Callable[[str], int]:
    """Number of tokens of a text as the library gives them, nothing added, cut or padded."""
    if library == "sentencepiece":
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda text: len(model.encode(text, add_bos=False, add_eos=False))
    from tokenizers import Tokenizer
    model = Tokenizer.from_str(content.decode())
    model.no_truncation()
    model.no_padding()
    return lambda text: len(model.encode(text, add_special_tokens=False))


def tokenizer_version(library: str, content: bytes) -> str:
    """Digest of the tokenizer file and of the library release that reads it."""
    return hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode() + content).hexdigest()


def no_null(text: Column) -> Column:
    """The normal form by default: null is empty, all else stays (the tokenizers of the queries tell other forms apart)."""
    return F.coalesce(text, F.lit(""))


def stored(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer version in the cache folder (none yet: no rows)."""
    spark = docs.sparkSession
    try:
        have = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        have = spark.createDataFrame([], CACHE)
    return have.where(F.col("tokenizer") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer_file: str, cache: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, normalise: Callable[[Column], Column] = no_null) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row; counts of new texts are appended to ``cache``.

    ``cache`` is a shared folder that later calls may use again, for other tables
    and tokenizers too; by default a new one under the checkpoint folder.  Several
    writers may append at once: a count stored twice is the same count.
    ``normalise`` must not merge texts that the tokenizer tells apart.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows give repeated results, whether ids or texts repeat; an empty
    table gives no rows; other columns are not read.  Whole texts are encoded.
    """
    spark, library = docs.sparkSession, library_of(tokenizer_file)
    with open(tokenizer_file, "rb") as f:
        content = f.read()
    version = tokenizer_version(library, content)
    cache = cache or scratch_dir(spark, "token_counts")
    sent = spark.sparkContext.broadcast(content)  # a few megabytes, whatever the corpus
    src = docs.select(F.col(id_col).alias("id"), normalise(F.col(text_col)).alias("text"), F.octet_length(no_null(F.col(text_col))).cast("long").alias("n_bytes"))
    src = src.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = TA.written(src.select("id", "n_bytes", "digest"), "digests")
    kinds = TA.written(rows.groupBy("digest").agg(F.count("*").alias("c"), F.min(F.struct(F.col("id").isNull().alias("z"), "id")).alias("of")), "contents")
    misses = kinds.join(stored(docs, cache, version), "digest", "left_anti").select(F.col("digest").alias("d"), F.col("of.id").alias("of"))
    made: list[Callable[[str], int]] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(counter(library, sent.value))
        count, seen = made[0], set()
        for batch in batches:
            digests, n = [], []
            for digest, text in zip(batch.column(0), batch.column(1)):
                digest = digest.as_py()
                if digest in seen:
                    continue
                if len(seen) >= KEPT_DIGESTS:
                    seen.clear()
                seen.add(digest)
                digests.append(digest)
                n.append(count(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    texts = src.select("id", "digest", "text").join(TA.written(misses, "misses"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("of")))
    new = texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long").dropDuplicates(["digest"])
    new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = stored(docs, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = TA.written(kinds.select("digest", "c").join(counts, "digest"), "counts")
    out = TA.lookup(rows, counts, ["digest"], "c")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
