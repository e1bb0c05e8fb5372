"""Example tables derived from the provided tables (FIXTURES.md §3).

Each builder is a lazy, narrow transformation of a scan (no shuffle unless
stated), so the fixtures grow with the input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.arrays import let
from spanlake.functions.text import TOKEN, pieces
from spanlake.sources.tables import table

SPAN_WORDS = 7  # words that the question (five) and the answer inside it need around the middle


def _tok(pcs: Column, i: Column) -> Column:
    return F.regexp_extract(F.element_at(pcs, i + 1), TOKEN, 0)


def _end(pcs: Column, i: Column) -> Column:
    """End offset of token ``i``: total length of pieces ``0..i``."""
    return F.length(F.array_join(F.slice(pcs, 1, i + 1), ""))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example per document.

    The answer is the three middle words (tokens ``k..k+2``, ``k = n div 2``);
    the question is those plus one word on each side, so a lexical scorer finds
    the neighbourhood but not the exact span.  ``claimed_start`` is the true
    start shifted by ``id % 4`` (input for the offset repair operators).
    Documents of fewer than ``SPAN_WORDS`` words become examples without an
    answer (P12): an empty question, and NULL answer columns.
    """
    return qa_from_documents(table(spark, sf_dir, "documents"))


def qa_from_documents(documents: DataFrame) -> DataFrame:
    """:func:`qa` over any documents frame (batch or streaming; row-local only)."""
    d = documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("text").alias("context"))

    def spans(p: Column) -> Column:
        def around(k: Column) -> Column:
            def bounds(end_k: Column) -> Column:
                start = end_k - F.length(_tok(p, k))
                end = end_k + F.length(F.element_at(p, k + 2)) + F.length(F.element_at(p, k + 3))
                return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"),
                                F.substr("context", start + 1, end - start).alias("text"))

            has = F.size(p) >= SPAN_WORDS
            question = F.when(has, F.concat_ws(" ", *[_tok(p, k + j) for j in (-1, 0, 1, 2, 3)])).otherwise("")
            return F.struct(F.size(p).alias("n_tok"), k.cast("bigint").alias("k"), F.when(has, let(_end(p, k), bounds)).alias("at"), question.alias("question"))

        return let(F.floor(F.size(p) / 2).cast("int"), around)

    # the pieces are cut once a row, however many columns and pushed filters ask for what is derived from them
    d = d.withColumn("_q", let(pieces("context"), spans))
    return d.select("id", "language", "context", "_q.n_tok", "_q.k", F.col("_q.at.start").alias("answer_start"), F.col("_q.at.end").alias("answer_end"),
                    "_q.question", F.col("_q.at.text").alias("answer_text"), (F.col("_q.at.start") + F.col("id") % 4).alias("claimed_start"))


GRAM = 4


def contains_join(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs (doc_id, text) x passages (item_id, btext)`` on ``contains(text, btext)``, by equi-joins.

    A passage of three or more words can only occur where each of its inner
    words (white space on both sides) is a whole word of the document, so it is
    keyed on the inner word that the fewest documents hold; shorter passages are
    keyed on their first characters.  Candidates are verified with
    ``contains``.  A key that many documents hold is left to the skew join.
    """
    words = F.regexp_extract_all(F.col("btext"), F.lit(TOKEN), 0)
    p = passages.where(F.col("btext").isNotNull()).withColumn("_w", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    inner = p.where(F.size("_w") > 0).select("item_id", "btext", F.explode(F.array_distinct("_w")).alias("_key"))
    doc_words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(TOKEN), 0))).alias("_key"))
    known = doc_words.join(inner.select("_key").distinct(), "_key", "left_semi")
    held = known.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    rare = inner.join(held, "_key", "left").groupBy("item_id", "btext").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("key"))).alias("_r"))
    long_p = rare.where(F.col("_r.n") > 0).select("item_id", "btext", F.col("_r.key").alias("_key"))
    short_p = p.where(F.size("_w") == 0).select("item_id", "btext", F.substring("btext", 1, GRAM).alias("_key"))
    # documents are cut into grams only if there is a short passage at all
    cut = docs.where(short_p.select(F.lit(1)).exists())
    at = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))
    sizes = F.array(*[F.lit(n) for n in range(GRAM + 1)])
    grams = F.flatten(F.transform(at, lambda i: F.transform(sizes, lambda n: F.substr(F.col("text"), i, n))))
    doc_grams = cut.select("doc_id", F.explode(F.array_distinct(grams)).alias("_key"))
    cand = known.join(long_p, "_key").unionByName(doc_grams.join(short_p, "_key")).select("doc_id", "item_id", "btext")
    return cand.join(docs, "doc_id").where(F.col("text").contains(F.col("btext")))


def qa_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers really contained in a document: documents x benchmark on ``contains``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("btext"))
    j = contains_join(d, b)
    return j.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("item_id").cast("string")).alias("id"),
        F.col("lang").alias("language"),
        F.col("text").alias("context"),
        F.col("btext").alias("answer_text"),
        (F.instr("text", F.col("btext")) - 1).cast("bigint").alias("answer_start"),
    )


TURNS = 1_000_000  # turns of a conversation that the numeric id has room for


def qa_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn (question) followed by an assistant turn (context)."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select(F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"),
                                                     F.col("text").alias("context"))
    j = u.join(a, (F.col("conv_id") == F.col("a_conv")) & (F.col("a_turn") == F.col("turn") + 1))
    return j.select((F.col("conv_id") * TURNS + F.col("turn")).alias("id"), "question", "context")


N_MODELS = 5


def _offsets(pcs: Column, i: Column) -> tuple[Column, Column]:
    te = _end(pcs, i)
    return te - F.length(_tok(pcs, i)), te


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five models' predicted spans per ``qa`` example with an answer (ties and majorities both occur).

    ``id, member, start_tok, end_tok, score, text, language, answer_text``;
    the model axis is an ``explode`` of a fixed sequence (no join).
    """
    q = qa(spark, sf_dir).where(F.col("answer_start").isNotNull()).withColumn("_p", pieces("context"))
    m = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1))).alias("member"))
    idb, mb = F.col("id"), F.col("member").cast("bigint")
    s = F.col("k") - 1 + (idb * 31 + mb * 17 + (idb % 5) * mb * mb) % 3
    m = m.withColumn("start_tok", s.cast("bigint")).withColumn("end_tok", (s + 2).cast("bigint"))
    m = m.withColumn("score", ((idb * 7919 + mb * 104729) % 1009).cast("bigint"))
    si = F.col("start_tok").cast("int")
    ts, te_s = _offsets(F.col("_p"), si)
    te = te_s + F.length(F.element_at("_p", si + 2)) + F.length(F.element_at("_p", si + 3))
    m = m.withColumn("text", F.substr("context", ts + 1, te - ts))
    return m.select("id", F.col("member").cast("int").alias("member"), "start_tok", "end_tok", "score", "text",
                    "language", "answer_text", "context")


RUN_EVENTS = 64


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run history: a run is an event type and a block of ``RUN_EVENTS`` event ids; every event is an epoch of its run.

    ``run`` is ``<type>-<block>``; epochs are numbered in event order.  Runs are
    small and many, so no event type is one task.
    """
    from pyspark.sql import Window
    block = F.floor(F.col("event_id") / RUN_EVENTS)
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", block.cast("string")).alias("run"), "event_id", "value")
    h = e.withColumn("_rn", F.row_number().over(Window.partitionBy("run").orderBy("event_id")))
    return h.select(
        "run", (F.col("_rn") - 1).cast("int").alias("epoch"),
        (((F.col("event_id") * 37) % 100) / F.lit(100.0).cast("double")).alias("jaccard"),
        F.col("value").alias("val_loss"), (F.lit(10) + F.col("event_id") % 7).cast("bigint").alias("seconds"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lexicon from neighbouring words of ``benchmark``: ``word = lower(w_j)``,
    ``raw = w_{j+1} || '-' || w_j`` (narrow: pairs come from each item's own word array)."""
    b = table(spark, sf_dir, "benchmark").select(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "").alias("w"))
    pairs = F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"),
                         F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    x = b.select(F.explode(pairs).alias("z"))
    return x.select(F.lower("z.a").alias("word"), F.concat(F.col("z.b"), F.lit("-"), F.col("z.a")).alias("raw"))


STOP_N = 20


def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent lower-cased document words (count desc, word asc): a
    top-k report, so the limit is the feature."""
    d = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"(?U)\s+")).alias("word"))
    c = d.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    return c.orderBy(F.desc("_n"), F.asc("word")).limit(STOP_N).select("word")


LANGS = ("de", "en", "es", "fr")


def memory(qa_df: DataFrame) -> DataFrame:
    """Translation memory keyed ``(id, field, via_lang)``.

    ``via_lang`` = one of de/en/es/fr other than the row's own, picked by
    ``id % 3`` in alphabetical order; ``back_text`` is the field unchanged,
    except that for ``id % 5 = 0`` the answer becomes ``answer_text || ' x'``.
    """
    others = F.filter(F.array(*[F.lit(x) for x in LANGS]), lambda x: x != F.col("language"))
    via = F.element_at(others, (F.col("id") % 3 + 1).cast("int"))
    fields = F.array(
        F.struct(F.lit("context").alias("field"), F.col("context").alias("back_text")),
        F.struct(F.lit("question").alias("field"), F.col("question").alias("back_text")),
        F.struct(F.lit("answer").alias("field"),
                 F.when(F.col("id") % 5 == 0, F.concat("answer_text", F.lit(" x"))).otherwise(F.col("answer_text"))
                 .alias("back_text")),
    )
    return qa_df.select("id", via.alias("via_lang"), F.inline(fields))
