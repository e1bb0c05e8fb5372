"""M1 / M2: scores per sequence position (``start_logit``, ``end_logit``).

Output contract of every scorer (the "position logits" frame)::

    id, feature_idx, pos, start_logit, end_logit, is_context, ts, te, tok, piece

``is_context`` rows carry the context character offsets ``[ts, te)`` of the
token, the token and its white-space-prefixed piece (so a span's text can be
rebuilt inside its window); CLS and question rows have NULLs there.  The decoder ranks over all
rows and keeps only ``is_context`` candidates (the reference's ``None`` offsets).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.config import DecodeConfig, WindowConfig
from spanlake.functions.arrays import let
from spanlake.functions.text import TOKEN, WHITE, pieces
from spanlake.operators.decode import ANSWERS, SWEPT, answers_block, best_of_grid, pair_block, top_block, windows_type
from spanlake.operators.tokens import tokenize
from spanlake.operators.windows import explode_windows, with_geometry
from spanlake.session import ship_by_value

# Fixed constants of the built-in lexical scorer (stand-in for the model).
MATCH_WEIGHT = 1000
NOISE_MOD = 997
ID_MULT = 7919
WINDOW_MULT = 104729
START_POS_MULT = 1299709
END_POS_MULT = 15485863
NEIGHBOURS = 4


def _noise(id_num: Column, feature_idx: Column, pos: Column, pos_mult: int) -> Column:
    return (
        id_num.cast("bigint") * ID_MULT + feature_idx.cast("bigint") * WINDOW_MULT + pos.cast("bigint") * pos_mult
    ) % NOISE_MOD


def _numeric_id(c: Column, numeric: bool) -> Column:
    if numeric:
        return c
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def lexical_logits(examples: DataFrame, cfg: WindowConfig, include_special: bool = True,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """M2: integer start/end scores from question-word overlap.

    ``start_logit(pos) = 1000 * #{j in [pos, pos+4] : lower(tok_j) in Q} + noise``,
    ``end_logit`` the same over ``[pos-4, pos]``, where ``Q`` is the set of
    lower-cased question tokens and neighbours are counted inside the same
    segment of the same window only.  ``noise`` is a hash of
    ``(id, feature_idx, pos)`` modulo 997, so scores tie rarely but do tie.

    ``examples`` (``id, context, question``) should be partitioned by ``id``;
    ``keep`` carries example-level columns (such as answer offsets) onto every row.
    The neighbour flags come from the same document-ordered window as the token
    offsets (one sort per partition) and are clipped to each window's bounds
    arithmetically; CLS and question rows are generated from the first context
    token of each window, so no second scan or shuffle is needed.
    """
    numeric = dict(examples.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint")
    ex = examples.withColumn("_qset", F.array_distinct(F.transform(
        F.regexp_extract_all(F.col("question"), F.lit(r"(?U)\S+"), 0), F.lower)))
    g = with_geometry(ex, cfg)
    toks = tokenize(g, "id", "context", keep=("q_len", "n_ctx", "capacity", "step", "n_windows", "_qset", *keep),
                    with_piece=True, outer=True, with_row=True)
    # an example without context tokens still has one window, of CLS and question rows only
    toks = toks.withColumn("_empty", F.col("pos").isNull()).withColumn("pos", F.coalesce("pos", F.lit(0)))
    toks = toks.withColumn("_f", F.array_contains(F.col("_qset"), F.lower("tok")).cast("int"))
    doc = Window.partitionBy("id", "_row").orderBy("pos")  # rows that repeat an id are texts of their own
    for j in range(1, NEIGHBOURS + 1):
        toks = toks.withColumn(f"_a{j}", F.lead("_f", j, 0).over(doc)).withColumn(f"_b{j}", F.lag("_f", j, 0).over(doc))
    wt = explode_windows(toks.where(F.col("n_windows") > 0))
    p = F.col("p")
    fwd, bwd = F.col("_f"), F.col("_f")
    for j in range(1, NEIGHBOURS + 1):
        fwd = fwd + F.when(p + j < F.col("win_end"), F.col(f"_a{j}")).otherwise(0)
        bwd = bwd + F.when(p - j >= F.col("win_start"), F.col(f"_b{j}")).otherwise(0)
    wt = wt.withColumn("_cs", fwd).withColumn("_ce", bwd)
    # -1 = the context token itself; 0..Q = CLS and question positions (first token of a window only)
    if include_special:
        kinds = F.when(F.col("_empty"), F.sequence(F.lit(0), F.col("q_len"))).when(p == F.col("win_start"), F.sequence(F.lit(-1), F.col("q_len"))).otherwise(F.array(F.lit(-1)))
    else:
        kinds = F.when(F.col("_empty"), F.array().cast("array<int>")).otherwise(F.array(F.lit(-1)))
    wt = wt.select("*", F.explode(kinds).alias("_k"))
    k = F.col("_k")
    q = F.col("q_len")
    is_ctx = k < 0
    pos = F.when(is_ctx, F.col("pos")).otherwise(k).cast("int")
    n_fwd = F.when(is_ctx, F.col("_cs")).when(k == 0, 0).otherwise(F.least(q, k + NEIGHBOURS) - k + 1)
    n_bwd = F.when(is_ctx, F.col("_ce")).when(k == 0, 0).otherwise(k - F.greatest(F.lit(1), k - NEIGHBOURS) + 1)
    idn = _numeric_id(F.col("id"), numeric)
    fid = F.col("feature_idx")
    return wt.select(
        "id",
        "feature_idx",
        pos.alias("pos"),
        (n_fwd.cast("bigint") * MATCH_WEIGHT + _noise(idn, fid, pos, START_POS_MULT)).alias("start_logit"),
        (n_bwd.cast("bigint") * MATCH_WEIGHT + _noise(idn, fid, pos, END_POS_MULT)).alias("end_logit"),
        is_ctx.alias("is_context"),
        F.when(is_ctx, F.col("ts")).alias("ts"),
        F.when(is_ctx, F.col("te")).alias("te"),
        F.when(is_ctx, F.col("tok")).alias("tok"),
        F.when(is_ctx, F.col("piece")).alias("piece"),
        *keep,
    )


TEXT_BLOCK = 128  # ids scored together: bounds a task's memory whatever the size of an Arrow batch


def _counted(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place inside the owner of ``sizes.sum()`` elements laid end to end."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]


def _offsets_of(cut: pa.ListArray, n: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of texts laid end to end, their offsets ``ts`` and ``te`` in their own text, and every text's first piece."""
    cut = cut.flatten()
    chars = pc.utf8_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    own = pc.utf8_length(pc.utf8_ltrim(cut, characters=WHITE)).to_numpy(zero_copy_only=False)
    tok0 = np.cumsum(n) - n
    ends = np.concatenate(([0], np.cumsum(chars)))
    te = ends[1:] - np.repeat(ends[tok0], n)
    return cut, te - own, te, tok0


def _windows_of(q: np.ndarray, n: np.ndarray, cfg: WindowConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts of ``n`` tokens, as in with_geometry: the text of each, its number there, its first token and size."""
    cap = cfg.max_len - cfg.n_special - q
    step = cap - cfg.stride
    text, fid = _within(np.where(step > 0, 1 - (-np.maximum(n - cap, 0) // np.maximum(step, 1)), 0))
    ws = fid * step[text]
    return text, fid, ws, np.minimum(cap[text], n[text] - ws)


def _question_lengths(q: pa.Array, cfg: WindowConfig) -> np.ndarray:
    return pc.fill_null(q, cfg.max_len).to_numpy(zero_copy_only=False).astype(np.int64)


def _score_block(base: pa.Array, texts: pa.ListArray, cfg: WindowConfig, include_special: bool) -> pa.Table:
    """The position-logits rows of a block of ids; ``row`` is the id's place in the block."""
    row = np.repeat(np.arange(len(texts)), _counted(texts))
    q, cut, hits = texts.flatten().flatten()
    q, n = _question_lengths(q, cfg), _counted(cut)
    cut, ts, te, tok0 = _offsets_of(cut, n)
    found = np.concatenate(([0], np.cumsum(pc.fill_null(hits.flatten(), False).to_numpy(zero_copy_only=False).astype(np.int64))))
    text, fid, ws, size = _windows_of(q, n, cfg)
    first = tok0[text] + ws
    w, i = _within(size)
    at = first[w] + i
    fwd = found[np.minimum(at + NEIGHBOURS + 1, (first + size)[w])] - found[at]
    bwd = found[at + 1] - found[np.maximum(at - NEIGHBOURS, first[w])]
    pos = q[text[w]] + 2 + i
    n_ctx = len(w)
    if include_special:  # 0 = CLS, 1..Q = the question
        sw, k = _within(q[text] + 1)
        w, pos = np.concatenate((w, sw)), np.concatenate((pos, k))
        fwd = np.concatenate((fwd, np.where(k == 0, 0, np.minimum(q[text[sw]], k + NEIGHBOURS) - k + 1)))
        bwd = np.concatenate((bwd, np.where(k == 0, 0, k - np.maximum(1, k - NEIGHBOURS) + 1)))
    is_ctx = np.arange(len(w)) < n_ctx
    at = np.concatenate((at, np.zeros(len(w) - n_ctx, np.int64)))
    owner, f = row[text[w]], fid[w]
    unknown = pc.is_null(base).to_numpy(zero_copy_only=False)[owner]
    seed = pc.fill_null(base, 0).to_numpy(zero_copy_only=False)[owner] + f * WINDOW_MULT

    def logit(count: np.ndarray, mult: int) -> pa.Array:
        return pa.array(count * MATCH_WEIGHT + np.fmod(seed + pos * mult, NOISE_MOD), pa.int64(), mask=unknown)

    def of_token(values: np.ndarray) -> pa.Array:
        return pa.array((values[at] if len(values) else at).astype(np.int32), pa.int32(), mask=~is_ctx)

    return pa.table({
        "row": pa.array(owner, pa.int64()), "feature_idx": pa.array(f, pa.int32()), "pos": pa.array(pos, pa.int32()),
        "start_logit": logit(fwd, START_POS_MULT), "end_logit": logit(bwd, END_POS_MULT), "is_context": pa.array(is_ctx),
        "ts": of_token(ts), "te": of_token(te), "piece": cut.take(pa.array(at, mask=~is_ctx))})


def texts_of_ids(examples: DataFrame) -> DataFrame:
    """``id, texts``: the context and question of every row of an id; the partitioning by ``id`` satisfies it."""
    return examples.groupBy("id").agg(F.collect_list(F.struct("context", "question")).alias("texts"))


def _lexical_rows(examples: DataFrame, cfg: WindowConfig, decode: DecodeConfig, through: tuple[Callable[[pa.Table], pa.Table], ...],
                  finish: Callable[[pa.ListArray], pa.ListArray], name: str, kind: str, shared: bool = True) -> DataFrame:
    """``id`` and what ``finish`` makes of its ranked windows, for blocks of ids (without ``shared`` those of one row only)."""
    per_id = texts_of_ids(examples)
    per_id = per_id if shared else per_id.where(F.size("texts") == 1)
    numeric = dict(examples.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint")

    def marked(x: Column) -> Column:
        def of(q: Column) -> Column:
            asked = F.transform(q, F.lower)
            return F.struct(F.size(q).alias("q_len"), pieces(x["context"]).alias("pieces"), let(F.array_distinct(asked), lambda a: F.transform(
                F.regexp_extract_all(x["context"], F.lit(TOKEN), 0), lambda t: F.array_contains(a, F.lower(t)))).alias("hits"))

        return let(F.regexp_extract_all(x["question"], F.lit(TOKEN), 0), of)

    rows = per_id.select("id", (_numeric_id(F.col("id"), numeric).cast("bigint") * ID_MULT).alias("base"), F.transform("texts", marked).alias("texts"))
    for shipped in (_score_block, top_block, WindowConfig, *through):
        ship_by_value(shipped)
    include_special = not decode.mask_before_topk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TEXT_BLOCK):
                part = b.slice(lo, TEXT_BLOCK)
                scored = _score_block(part.column("base"), part.column("texts"), cfg, include_special)
                for step in through:
                    scored = step(scored)
                yield pa.RecordBatch.from_arrays([part.column("id"), finish(top_block(scored, part.num_rows, decode.n_best))], names=["id", name])

    return rows.mapInArrow(run, T.StructType([examples.schema["id"], T.StructField(name, T.DataType.fromDDL(kind))]))


def lexical_windows(examples: DataFrame, cfg: WindowConfig, decode: DecodeConfig, paired: str | None = None,
                    through: tuple[Callable[[pa.Table], pa.Table], ...] = ()) -> DataFrame:
    """M2 and W1 with one row per id: ``id, windows``, where ``inline(windows)`` gives the rows of
    ``window_topk(lexical_logits(examples))``.

    Spark cuts the texts and marks the question's words; a task scores and ranks
    blocks of ids with numpy, so no token ever is a row.  Rows that repeat an id
    meet in its row (one aggregate, which the partitioning by ``id`` satisfies).
    ``through`` are steps on a block's positions between scoring and ranking;
    with ``paired`` a window also holds its best valid pair or every one (J4).
    """
    def finish(windows: pa.ListArray) -> pa.ListArray:
        return pair_block(windows, decode.max_answer_len, paired) if paired else windows

    return _lexical_rows(examples, cfg, decode, through, finish, "windows", windows_type(paired))


def lexical_answers(examples: DataFrame, cfg: WindowConfig, decode: DecodeConfig, k: int) -> DataFrame:
    """M2, W1, J4 and T5 with one row per id: ``id, answers``, where ``inline(answers)`` gives the rows of
    ``nbest_list(span_candidates(window_topk(lexical_logits(examples))), k)``; no pair of positions is a row."""
    return _lexical_rows(examples, cfg, decode, (), lambda windows: answers_block(windows, decode.max_answer_len, k), "answers", ANSWERS)


def lexical_sweep(examples: DataFrame, cfg: WindowConfig, decode: DecodeConfig, grid: list[tuple[int, int]], shared: bool = True) -> DataFrame:
    """M2, W1 and G6 with one row per id: ``id, swept``, every grid point's best span as ``sweep_best`` finds it (NULL where there is none).

    Windows are ranked once, at the grid maxima in ``decode``; without ``shared``
    ids that rows share are left out.
    """
    pts = sorted(set(grid))
    return _lexical_rows(examples, cfg, decode, (), lambda windows: best_of_grid(windows, pts), "swept", SWEPT, shared)


def model_logits(features: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame],
                 schema: str = "id bigint, feature_idx int, pos int, start_logit double, end_logit double"
                 ) -> DataFrame:
    """M1: apply a user batch scorer to feature rows with ``mapInPandas``.

    ``predict`` receives a pandas batch of feature rows (for instance the
    ``tokens``/``attention_mask`` arrays of ``sequence_arrays``) and returns one
    row per scored position.  Load the model lazily inside ``predict`` so each
    Python worker loads it once; Arrow batches keep the transfer vectorised.
    """

    ship_by_value(predict)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield predict(b)

    return features.mapInPandas(run, schema=schema)


def attach_offsets(scores: DataFrame, wtoks: DataFrame) -> DataFrame:
    """Key join of scorer output to window tokens (positional alignment by key)."""
    t = wtoks.select("id", "feature_idx", "pos", "ts", "te", "tok", "piece")
    return scores.join(t, ["id", "feature_idx", "pos"], "left").withColumn("is_context", F.col("ts").isNotNull())


KEPT = {"feature_idx": "int", "pos": "int", "start_logit": None, "end_logit": None}  # columns of the scores; logits keep a kind of their own


def _pack(columns: list[np.ndarray], known: list[np.ndarray]) -> bytes:
    """Values and validity as one compressed string; bytes of equal weight lie together, as most of them repeat."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    raw = b"".join([*planes, *(b"" if k.all() else np.packbits(k).tobytes() for k in known)])
    head = np.array([len(columns[0]), len(raw), *(not k.all() for k in known)], np.int32)
    return head.tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(packed: bytes, dtypes: list[np.dtype]) -> list[pa.Array]:
    n, size, *holes = np.frombuffer(packed, np.int32, 2 + len(dtypes)).tolist()
    raw = np.frombuffer(pa.Codec("zstd").decompress(packed[4 * (2 + len(dtypes)):], size, asbytes=True), np.uint8)
    out, at = [], 0
    for t in dtypes:
        out.append(np.ascontiguousarray(raw[at:at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).ravel())
        at += n * t.itemsize
    for c, hole in enumerate(holes):
        mask = None
        if hole:
            mask = np.unpackbits(raw[at:at + -(-n // 8)], count=n) == 0
            at += -(-n // 8)
        out[c] = pa.array(out[c], mask=mask)
    return out


def packed_scores(scores: DataFrame) -> tuple[DataFrame, list[np.dtype]]:
    """``id, part``: scores that follow each other and have one id as a compressed value, and the kinds of its columns.

    Positions would be shuffled and sorted as rows of some 50 bytes; so they
    travel with about 3.
    """
    kinds = {"double": np.float64, "bigint": np.int64}
    logit = "double" if {"float", "double"} & {dict(scores.dtypes)[c] for c in ("start_logit", "end_logit")} else "bigint"
    dtypes = [np.dtype(np.int32 if t else kinds[logit]) for t in KEPT.values()]
    ship_by_value(_pack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            ends = np.append(np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1, b.num_rows)
            known = [pc.is_valid(c).to_numpy(zero_copy_only=False) for c in b.columns[1:]]
            values = [pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in b.columns[1:]]
            starts = np.append(0, ends[:-1])
            parts = [_pack([v[lo:hi] for v in values], [k[lo:hi] for k in known]) for lo, hi in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), pa.array(parts, pa.binary())], names=["id", "part"])

    plain = scores.where(F.col("id").isNotNull()).select("id", *[F.col(c).cast(t or logit).alias(c) for c, t in KEPT.items()])
    return plain.mapInArrow(run, T.StructType([scores.schema["id"], T.StructField("part", T.BinaryType())])), dtypes


def _align_block(texts: pa.ListArray, parts: pa.ListArray, dtypes: list[np.dtype], cfg: WindowConfig) -> pa.Table:
    """J3 on a block of ids: every scored position with the context token at its key, or several where texts share the id."""
    held = _counted(texts)
    own = np.cumsum(held) - held
    q, cut = texts.flatten().flatten()
    q, n = _question_lengths(q, cfg), _counted(cut)
    cut, ts, te, tok0 = _offsets_of(cut, n)
    step = cfg.max_len - cfg.n_special - q - cfg.stride
    each = [_unpack(p, dtypes) for p in parts.flatten().to_pylist()]
    columns = [pa.concat_arrays([e[c] for e in each] or [pa.array([], pa.from_numpy_dtype(t))]) for c, t in enumerate(dtypes)]
    row = np.repeat(np.repeat(np.arange(len(parts)), _counted(parts)), [len(e[0]) for e in each] or [])
    known = pc.and_(pc.is_valid(columns[0]), pc.is_valid(columns[1])).to_numpy(zero_copy_only=False)
    fid, pos = (pc.fill_null(c, 0).to_numpy().astype(np.int64) for c in columns[:2])
    # the windows of a text lie by arithmetic: texts that share an id are asked one after the other
    met, tokens, rest = [], [], np.ones(len(row), bool)
    for t in range(int(held.max(initial=0))):
        of = np.flatnonzero(known & (held[row] > t))
        text = own[row[of]] + t
        at = fid[of] * step[text] + pos[of] - q[text] - 2
        last = np.minimum(fid[of] * step[text] + cfg.max_len - cfg.n_special - q[text], n[text])
        inside = (step[text] > 0) & (fid[of] >= 0) & (pos[of] >= q[text] + 2) & (at < last)
        # the last window is the first that reaches the text's end
        inside &= (fid[of] == 0) | ((fid[of] - 1) * step[text] + cfg.max_len - cfg.n_special - q[text] < n[text])
        met.append(of[inside])
        tokens.append(tok0[text[inside]] + at[inside])
        rest[of[inside]] = False
    alone = np.flatnonzero(rest)
    take = pa.array(np.concatenate((*met, alone)).astype(np.int64))
    is_ctx = np.arange(len(take)) < len(take) - len(alone)
    at = pa.array(np.concatenate((*tokens, np.zeros(len(alone)))).astype(np.int64), mask=~is_ctx)
    return pa.table({"row": pa.array(row).take(take), **{c: v.take(take) for c, v in zip(KEPT, columns, strict=True)}, "is_context": pa.array(is_ctx),
                     "ts": pa.array(ts, pa.int32()).take(at), "te": pa.array(te, pa.int32()).take(at), "piece": cut.take(at)})


def aligned_windows(scores: DataFrame, examples: DataFrame, cfg: WindowConfig, decode: DecodeConfig, paired: str | None = None) -> DataFrame:
    """J3 and W1 with one row per id: ``id, windows``, where ``inline(windows)`` gives the rows of
    ``window_topk(attach_offsets(scores, windowed_tokens(examples)))`` for the ids of ``examples``.

    Scores travel packed and meet their texts by ``id``; a task cuts windows,
    aligns positions by key and ranks them for blocks of ids, so no position is
    shuffled or sorted as a row.
    """
    packed, dtypes = packed_scores(scores)
    per_id = texts_of_ids(examples.where(F.col("id").isNotNull()))
    both = per_id.join(packed.groupBy("id").agg(F.collect_list("part").alias("parts")), "id")
    cut = F.transform("texts", lambda x: F.struct(F.size(F.regexp_extract_all(x["question"], F.lit(TOKEN), 0)).alias("q_len"), pieces(x["context"]).alias("pieces")))
    for shipped in (_align_block, top_block, WindowConfig):
        ship_by_value(shipped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TEXT_BLOCK):
                part = b.slice(lo, TEXT_BLOCK)
                scored = _align_block(part.column("texts"), part.column("parts"), dtypes, cfg)
                if decode.mask_before_topk:
                    scored = scored.filter(scored["is_context"])
                windows = top_block(scored, part.num_rows, decode.n_best)
                if paired:
                    windows = pair_block(windows, decode.max_answer_len, paired)
                yield pa.RecordBatch.from_arrays([part.column("id"), windows], names=["id", "windows"])

    logit = "double" if dtypes[-1].kind == "f" else "bigint"
    out = T.StructType([examples.schema["id"], T.StructField("windows", T.DataType.fromDDL(windows_type(paired, logit)))])
    return both.select("id", cut.alias("texts"), "parts").mapInArrow(run, out)
