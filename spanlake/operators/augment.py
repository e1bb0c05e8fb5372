"""Text augmentation by table lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import WS_RUN, hash_unit, order_key

# Characters kept in a normalised synonym (fixed value).
SYNONYM_CHARS = "[^ a-z]"


def normalize_synonyms(lexicon: DataFrame) -> DataFrame:
    """``_`` and ``-`` become spaces, lower-case, keep only ``[ a-z]``, distinct,
    drop the word itself and empty results.  ``lexicon``: ``word, raw``."""
    syn = F.regexp_replace(F.lower(F.translate("raw", "_-", "  ")), SYNONYM_CHARS, "")
    out = lexicon.select("word", syn.alias("synonym")).distinct()
    return out.where((F.col("synonym") != F.col("word")) & (F.col("synonym") != ""))


def word_rows(df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """``id, pos, w``: non-empty whitespace-separated words in order."""
    x = df.select(id_col, F.posexplode(F.split(F.col(text_col), WS_RUN)).alias("pos", "w"))
    return x.where(F.col("w") != "")


def remove_stop_words(words: DataFrame, stop: DataFrame) -> DataFrame:
    """Words whose lower-case form is not a stop word (broadcast anti join;
    the stop list is a fixed-size top-k table)."""
    return words.join(F.broadcast(stop.select(F.col("word").alias("_lw"))), F.lower("w") == F.col("_lw"), "left_anti")


def top_words(words: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent lower-cased words (count desc, word asc): a top-k report
    (partial counts before the shuffle on the word, then a bounded ``limit``)."""
    c = words.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("_n"))
    return c.orderBy(F.desc("_n"), F.asc("word")).limit(k).select("word")


def synonym_replacement(docs: DataFrame, synonyms: DataFrame, stop: DataFrame | None, n: int, seed: int,
                        text_col: str = "text", id_col: str = "id", stop_k: int = 20) -> DataFrame:
    """Replace up to ``n`` distinct non-stop words (each everywhere it occurs) by one synonym.

    Words are visited in a seeded random order (``md5(word:id:seed)``); words
    without synonyms are skipped and do not count; the synonym is picked by a
    seeded hash, for the chosen words only.  Words are re-joined with single
    spaces.  ``docs`` should be partitioned by ``id``: every step is keyed by
    ``id``, a text's distinct words are found and its words replaced inside its
    row, and the at most ``n`` chosen replacements travel as a small map joined
    on ``id`` alone, so nothing is shuffled again.  ``stop=None`` derives the
    stop list (``stop_k`` most frequent words) from the same texts.  Rows that
    repeat an id share the words of all their texts, by position; a null id has
    no words.  Output: ``id, text, n_replaced``.
    """
    from pyspark.sql import Window
    stop = top_words(word_rows(docs, text_col, id_col), stop_k) if stop is None else stop
    placed = F.filter(F.transform(F.split("_t", WS_RUN), lambda w, i: F.struct(i.alias("pos"), w.alias("w"))), lambda x: x["w"] != "")
    one = docs.select(F.col(id_col), F.col(text_col).alias("_t")).select(id_col, placed.alias("_p"))
    whole = one.groupBy(id_col).agg(F.collect_list("_p").alias("_p"), F.count(F.lit(1)).alias("_rows"))
    cand = whole.select(id_col, F.explode(F.array_distinct(F.flatten(F.transform("_p", lambda t: t["w"])))).alias("w"))
    cand = remove_stop_words(cand, stop).withColumn("word", F.lower("w")).join(synonyms.select("word").distinct(), "word", "left_semi")
    rk = F.row_number().over(Window.partitionBy(id_col).orderBy(order_key("w", id_col, F.lit(seed)), "w"))
    chosen = cand.withColumn("_rk", rk).where(F.col("_rk") <= n)
    pick = chosen.join(synonyms, "word").groupBy(id_col, "w").agg(
        F.min_by("synonym", order_key("synonym", "w", id_col, F.lit(seed))).alias("syn"))
    repl = pick.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("w", "syn"))).alias("_m"))
    new = F.transform(F.flatten("_p"), lambda x: F.struct(x["pos"].alias("pos"), F.coalesce(F.try_element_at("_m", x["w"]), x["w"]).alias("nw")))
    text = F.transform(F.when(F.size("_p") > 1, F.sort_array(new)).otherwise(new), lambda x: x["nw"])
    known = F.col(id_col).isNotNull()
    out = whole.join(repl, id_col, "left").select(
        id_col, F.when(known, F.array_join(text, " ")).otherwise("").alias("text"),
        F.coalesce(F.size("_m"), F.lit(0)).cast("bigint").alias("n_replaced"), "_rows")
    return out.select(id_col, "text", "n_replaced", F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))).alias("_row")).drop("_row")


def back_translate(examples: DataFrame, memory: DataFrame, prob_pct: int, seed: int) -> DataFrame:
    """X4 (re-aimed): each field goes "via" another language and back with probability
    ``prob_pct``% (seeded hash per id and field); the round trip is a join to a
    translation-memory table ``(id, field, via_lang, back_text)``; fields without a
    memory row pass through unchanged.  Where the memory knows several languages
    for an example, one is chosen by seeded hash."""
    mem = memory.groupBy("id", "via_lang").agg(
        *[F.max(F.when(F.col("field") == f, F.col("back_text"))).alias(f"_m_{f}") for f in ("context", "question",
                                                                                           "answer")])
    mine = F.struct("via_lang", *[f"_m_{f}" for f in ("context", "question", "answer")])
    mem = mem.groupBy("id").agg(F.min_by(mine, F.struct(hash_unit("id", "via_lang", F.lit(seed)), "via_lang")).alias("_m")).select("id", "_m.*")
    j = examples.join(mem, "id", "left")
    out = j
    for f, col in (("context", "context"), ("question", "question"), ("answer", "answer_text")):
        apply = (hash_unit("id", F.lit(f), F.lit(seed)) % 100) < prob_pct
        out = out.withColumn(col, F.when(apply & F.col(f"_m_{f}").isNotNull(), F.col(f"_m_{f}")).otherwise(F.col(col)))
    return out.drop("_m_context", "_m_question", "_m_answer")
