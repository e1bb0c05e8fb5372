"""Operator 3: mix sources to target weights by Pfair scheduling (DataFrame and SQL functions only).

Documents of a source form blocks in a seeded order.  With integer weights
``w`` that add up to the period ``H``, block ``k`` of a source is released at
slot ``floor(k * H / w)`` and due by slot ``ceil((k + 1) * H / w)``.  In each
slot the released block with the earliest deadline runs.  One block runs per
slot and the weights fill the period, so every block meets its window and at
every slot a source that still has blocks has received less than one block more
or less than its share.  All lags are zero at the end of a period, so the
schedule repeats and a block's slot is arithmetic.  A source that runs out
leaves its slots idle; the order of the others stays as scheduled.

The weights are the given shares over their greatest common divisor, never
rounded.  Sources of equal weight are scheduled as one and served in turn: if
the class of ``m`` sources is less than one block off, its member at turn ``p``
is more than ``-(p + 1) / m`` and less than ``(m - p) / m`` blocks off, so the
bound holds for each.  Slots are computed once per weight, for one period or as
far as there are blocks, whichever is shorter.

Rows are ranked where one shuffle has put them; the slots they need come from
the narrow side as a short array per range of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm import tables as TA

RANK_ROWS = 1024          # rows of a source that one range holds, on average
MAX_STEPS = 500_000_000   # slots times different weights that are scheduled; more is refused

EUCLID = """aggregate(shares, 0L, (g, x) -> aggregate(sequence(1, 92), named_struct('a', g, 'b', x),
  (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a))"""

RUN = """aggregate(
  sequence(0L, (steps - 1) div 256),
  named_struct('done', transform(weights, x -> 0L), 'run', cast(array() as array<int>)),
  (state, b) -> transform(array(aggregate(
      sequence(b * 256, least(b * 256 + 255, steps - 1)),
      named_struct('done', state.done, 'run', cast(array() as array<int>)),
      (s, t) -> transform(
        array(array_min(transform(numbers, i -> if((get(s.done, i) * h) div get(weights, i) <= t,
          named_struct('due', ((get(s.done, i) + 1) * h + get(weights, i) - 1) div get(weights, i), 'i', i), null)))),
        p -> named_struct('done', transform(s.done, (d, i) -> if(i = p.i, d + 1, d)), 'run', concat(s.run, array(p.i))))[0])),
    z -> named_struct('done', z.done, 'run', concat(state.run, z.run)))[0],
  state -> state.run)"""


def schedule(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plan of the sources and slots of their classes.

    ``sources`` has ``source, blocks`` and the target ``share`` (positive long).
    The plan adds ``w, h`` (weight, period), ``c`` (class; larger weights
    first), ``m`` (its sources) and ``p`` (turn, by name); the slots are ``c, j,
    slot``: where the class has its ``j``-th block of a period.
    """
    classes = sources.groupBy("share").agg(F.count("*").alias("m"), F.max("blocks").alias("b"))
    one = classes.agg(F.sort_array(F.collect_list(F.struct("share", "m", "b")), asc=False).alias("cl")).where(F.size("cl") > 0)
    one = one.withColumn("shares", F.expr("transform(cl, x -> x.share)")).withColumn("g", F.expr(EUCLID))
    one = one.withColumn("weights", F.expr("transform(cl, x -> x.share div g * x.m)")).withColumn("h", F.expr("aggregate(weights, 0L, (a, x) -> a + x)"))
    ends = "array_max(transform(cl, x -> (x.b * h + x.share div g - 1) div (x.share div g)))"
    one = one.withColumn("steps", F.expr(f"greatest(1L, least(h, {ends}))")).withColumn("numbers", F.expr("sequence(0, size(cl) - 1)"))
    refused = F.raise_error(F.lit(f"more than {MAX_STEPS} steps: choose shares with a smaller sum over their common divisor"))
    one = one.withColumn("steps", F.when(F.col("steps") * F.size("cl") > MAX_STEPS, refused.cast("long")).otherwise(F.col("steps")))
    one = TA.written(one.withColumn("run", F.expr(RUN)).select("cl", "g", "h", "run"), "schedule")
    slots = one.select(F.posexplode("run").alias("slot", "c"))
    slots = slots.select("c", (F.row_number().over(Window.partitionBy("c").orderBy("slot")) - 1).cast("long").alias("j"), F.col("slot").cast("long").alias("slot"))
    own = one.select("g", "h", F.posexplode("cl").alias("c", "x")).select("c", F.col("x.share").alias("share"), F.col("x.m").alias("m"), F.expr("x.share div g").alias("w"), "h")
    turn = F.row_number().over(Window.partitionBy("share").orderBy("source")) - 1
    return sources.withColumn("p", turn.cast("long")).join(own, "share"), slots


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, *, id_col: str = "doc_id", source_col: str = "source",
                block_docs: int = 16, seed: int = 7) -> DataFrame:
    """Every input row with ``mix_block, mix_release, mix_deadline, mix_slot, mix_key``; sort by ``mix_key`` for the mixed order.

    ``targets`` has ``source, share`` (positive integers, only their ratios
    count and are kept exactly; a source without a target gets share 1); by
    default the share is the square root of the source's size in whole
    thousandths of the sum (1 at least), which lifts small sources.  No row is
    dropped: blocks of a source beyond the end of another keep their slots.  A
    null source is a source of its own; null ids are ordered as empty text;
    repeated rows are documents of their own (equal keys may swap); an empty
    table gives no rows; input columns named like the added ones or starting
    with ``_mx`` are replaced.
    """
    added = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_key"]
    docs = docs.drop(*[c for c in docs.columns if c in added or c.startswith("_mx")])
    key = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))  # never null
    sizes = TA.written(docs.groupBy(key.alias("source")).agg(F.count("*").alias("n")), "sizes")
    if targets is None:
        root = sizes.withColumn("root", F.floor(F.sqrt("n") * 1000).cast("long"))
        share = root.crossJoin(F.broadcast(root.agg(F.sum("root").alias("total")))).select("source", "n", F.expr("greatest(1L, 1000 * root div total)").alias("share"))
    else:
        name = F.col("source")
        goal = targets.select(F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), name.cast("string"))).alias("source"), F.col("share").cast("long").alias("share"))
        share = sizes.join(goal.where("share > 0"), "source", "left").select("source", "n", F.coalesce("share", F.lit(1).cast("long")).alias("share"))
    plan, slots = schedule(share.select("source", "n", "share", F.ceil(F.col("n") / block_docs).alias("blocks")))
    # ranges of a source, so that a hot one is ranked by many tasks: by its size if it is one of the largest, else by the most it can have
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.orderBy(F.desc("n"), "source").limit(TA.HOT_KEYS).select(F.col("source").alias("_mx_hot"), F.col("n").alias("_mx_n"))
    rows = docs.withColumns({
        "_mx_source": key,
        "_mx_order": F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))),
    })
    rows = rows.join(F.broadcast(hot), F.col("_mx_source") == F.col("_mx_hot"), "left")  # at most HOT_KEYS rows
    parts = F.ceil(F.coalesce("_mx_n", F.lit(total // TA.HOT_KEYS + 1)) / RANK_ROWS)
    rows = rows.withColumn("_mx_part", F.floor(F.conv(F.substring("_mx_order", 1, 8), 16, 10).cast("long") * parts / (1 << 32))).drop("_mx_hot", "_mx_n")
    ranges = rows.groupBy("_mx_source", "_mx_part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("_mx_source").orderBy("_mx_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_mx_before", before).join(plan.withColumnRenamed("source", "_mx_source"), "_mx_source")
    blocks = ranges.withColumn("k", F.expr(f"explode(sequence(_mx_before div {block_docs}, (_mx_before + rows - 1) div {block_docs}))"))
    blocks = blocks.withColumn("turn", F.expr("k * m + p")).withColumns({"j": F.expr("turn % (m * w)"), "base": F.expr("turn div (m * w) * h")})
    blocks = blocks.join(slots, ["c", "j"])
    ranges = blocks.groupBy("_mx_source", "_mx_part").agg(
        F.first("_mx_before").alias("_mx_before"), F.first("w").alias("_mx_w"), F.first("h").alias("_mx_h"),
        F.sort_array(F.collect_list(F.struct("k", (F.col("base") + F.col("slot")).alias("slot")))).alias("_mx_slots"))
    rows = rows.withColumn("_mx_local", F.row_number().over(Window.partitionBy("_mx_source", "_mx_part").orderBy("_mx_order", id_col)))
    rows = rows.join(ranges, ["_mx_source", "_mx_part"]).withColumn("_mx_rank", F.col("_mx_before") + F.col("_mx_local") - 1)
    rows = rows.withColumn("mix_block", F.expr(f"_mx_rank div {block_docs}"))
    rows = rows.withColumns({
        "mix_release": F.expr("mix_block * _mx_h div _mx_w"),
        "mix_deadline": F.expr("((mix_block + 1) * _mx_h + _mx_w - 1) div _mx_w"),
        "mix_slot": F.expr(f"get(_mx_slots, cast(mix_block - _mx_before div {block_docs} as int)).slot"),
    })
    rows = rows.withColumn("mix_key", F.col("mix_slot") * block_docs + F.col("_mx_rank") % block_docs)
    return rows.select(*docs.columns, *added)
