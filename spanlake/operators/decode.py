"""N-best span decoding.

Plan shape: everything is keyed by ``id`` (windows by ``(id, feature_idx)``),
so with examples partitioned by ``id`` the whole decode runs without another
shuffle of token-sized data:

1. one aggregate per window collects its scored positions (at most
   ``max_len`` entries, a bound fixed by the configuration, not by the data);
2. W1  the top ``n_best`` starts and ends are the first entries of the
       position list sorted by ``(logit desc, pos desc)`` (ties to the higher
       position).  By default CLS and question positions take part in the
       ranking (they use up budget) and are dropped afterwards (P4);
3. J4  valid (start, end) pairs of the window: ``s <= e`` and
       ``e - s + 1 <= max_answer_len`` (P5), ``score = start + end``;
4. G4  per ``id`` the best candidate; ties go to the first candidate in
       (window, start rank, end rank) order, as a stable sort of the candidate
       list gives.  Examples without a candidate get ``''`` and 0.0.

The span text is rebuilt from the window's own token pieces, so the context is
never joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.config import DecodeConfig
from spanlake.functions.text import LEADING_WS, WHITE
from spanlake.session import ship_by_value


def window_topk(logits: DataFrame, n_best: int, mask_before_topk: bool = False) -> DataFrame:
    """W1 + P4 per window: ``id, feature_idx, starts, ends, pieces``.

    ``starts``/``ends``: arrays of ``struct(logit, pos, rk, ts|te)`` for the
    context positions among the top ``n_best``, in rank order (``rk`` counts
    all ranked positions, so CLS/question entries use up budget unless
    ``mask_before_topk``); ``pieces``: the window's context tokens
    ``struct(pos, piece)`` in order.
    """
    src = logits.where("is_context") if mask_before_topk else logits
    per_window = src.groupBy("id", "feature_idx").agg(
        F.collect_list(F.struct(F.col("start_logit").alias("logit"), "pos", "is_context", "ts")).alias("_s"),
        F.collect_list(F.struct(F.col("end_logit").alias("logit"), "pos", "is_context", "te")).alias("_e"),
        F.collect_list(F.when(F.col("is_context"), F.struct("pos", "piece"))).alias("_p"),
    )

    def ranked(arr: str, off: str) -> Column:
        # (logit desc, pos desc): the tie rule of W1
        top = F.slice(F.sort_array(F.col(arr), asc=False), 1, n_best)
        with_rk = F.transform(top, lambda x, i: F.struct(
            x["logit"].alias("logit"), x["pos"].alias("pos"), (i + 1).alias("rk"), x[off].alias(off),
            x["is_context"].alias("is_context")))
        return F.filter(with_rk, lambda x: x["is_context"])

    return per_window.select(
        "id", "feature_idx",
        ranked("_s", "ts").alias("starts"),
        ranked("_e", "te").alias("ends"),
        F.sort_array("_p").alias("pieces"),
    )


WINDOW = {
    "feature_idx": "int", "starts": "array<struct<logit:bigint,pos:int,rk:int,ts:int,is_context:boolean>>",
    "ends": "array<struct<logit:bigint,pos:int,rk:int,te:int,is_context:boolean>>", "pieces": "array<struct<pos:int,piece:string>>"}
PAIRED = {
    "best": {"at": "struct<i:int,j:int>"},
    "every": {"pairs": "array<struct<score:bigint,nsrank:int,nerank:int,s_pos:int,e_pos:int,s_char:int,e_char:int>>"}}


def windows_type(paired: str | None = None, logit: str = "bigint") -> str:
    """Type of an id's windows as :func:`top_block` and :func:`pair_block` give them."""
    return f"array<struct<{','.join(f'{n}:{t}' for n, t in (WINDOW | PAIRED.get(paired, {})).items())}>>".replace("bigint", logit)


def _lists(counts: np.ndarray, names: list[str], columns: list[pa.Array]) -> pa.ListArray:
    flat = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), flat)


def _descending(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Integers whose ascending order is the descending one of scores: not-a-number first, null last, as Spark sorts them."""
    if pa.types.is_floating(values.type):
        x = pc.fill_null(values, 0).to_numpy().astype(np.float64) + 0.0
        bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
        key = np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits)
    else:
        key = pc.fill_null(values, 0).to_numpy().astype(np.int64)
    return ~np.where(pc.is_null(values).to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, key)


def top_block(scored: pa.Table, rows: int, n_best: int) -> pa.ListArray:
    """:func:`window_topk` on the positions of a block of ids: the windows of each ``row``, in order."""
    def ints(name: str) -> np.ndarray:
        return pc.fill_null(scored[name], 0).to_numpy().astype(np.int64)

    pos, ctx = ints("pos"), scored["is_context"].to_numpy()
    windows, w = np.unique(ints("row") << 32 | ints("feature_idx"), return_inverse=True)

    def ranked(logit: str, off: str) -> pa.ListArray:
        # texts that share an id can tie on score and position: then as sort_array orders the rest
        tie = np.where(ctx, -1 - ints("ts" if logit == "start_logit" else "te"), 0)
        order = np.lexsort((tie, -pos, _descending(scored[logit]), w))
        counts = np.bincount(w, minlength=len(windows))
        rk = np.arange(len(w)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        kept = (rk <= n_best) & ctx[order]
        top = order[kept]
        take = pa.array(top)
        return _lists(np.bincount(w[top], minlength=len(windows)), ["logit", "pos", "rk", off, "is_context"],
                      [scored[logit].take(take), scored["pos"].take(take), pa.array(rk[kept], pa.int32()), scored[off].take(take), scored["is_context"].take(take)])

    inside = np.flatnonzero(ctx)
    inside = inside[np.lexsort((pos[inside], w[inside]))]
    if len(inside) and ((np.diff(w[inside]) == 0) & (np.diff(pos[inside]) == 0)).any():
        held = pa.table({"w": w[inside], "pos": pos[inside], "piece": scored["piece"].take(pa.array(inside))})
        inside = inside[pc.sort_indices(held, [("w", "ascending"), ("pos", "ascending"), ("piece", "ascending")]).to_numpy()]
    take = pa.array(inside)
    texts = _lists(np.bincount(w[inside], minlength=len(windows)), ["pos", "piece"], [scored["pos"].take(take), scored["piece"].take(take)])
    return _lists(np.bincount(windows >> 32, minlength=rows), ["feature_idx", "starts", "ends", "pieces"],
                  [pa.array(windows & 0xFFFFFFFF, pa.int32()), ranked("start_logit", "ts"), ranked("end_logit", "te"), texts])


def pair_block(windows: pa.ListArray, max_answer_len: int, paired: str) -> pa.ListArray:
    """The windows of :func:`top_block`, each with the places of its best valid pair (``at``) or with every one (``pairs``)."""
    flat = windows.flatten()
    if paired == "best":
        starts, ends = flat.field("starts"), flat.field("ends")
        sides = [_field(x, f) for x in (starts, ends) for f in ("logit", "pos", "rk")]
        found = pa.concat_arrays([a.flatten() for a in _best_pairs([(1 << 30, max_answer_len)])(iter([sides]))] or [pa.array([], pa.struct([("i", pa.int32()), ("j", pa.int32())]))])
    else:
        found = _every_pair(flat.field("starts"), flat.field("ends"), max_answer_len)
    fields = [flat.field(n) for n in WINDOW]
    return _lists(pc.list_value_length(windows).to_numpy(), [*WINDOW, *PAIRED[paired]], [*fields, found])


def _field(lists: pa.ListArray, name: str) -> pa.ListArray:
    return pa.ListArray.from_arrays(lists.offsets, lists.values.field(name))


def _every_pair(starts: pa.ListArray, ends: pa.ListArray, max_answer_len: int) -> pa.ListArray:
    """J4 + P5: the valid pairs of each window, by start rank, then end rank."""
    n = len(starts)
    s_pos, e_pos = _field(starts, "pos"), _field(ends, "pos")
    gap = _dense(e_pos, n, _width(e_pos), FAR)[:, None, :] - _dense(s_pos, n, _width(s_pos), -FAR)[:, :, None]
    w, i, j = np.nonzero((gap >= 0) & (gap < min(max_answer_len, FAR >> 1)))
    s, e = (x.values.take(pa.array(x.offsets.to_numpy()[w] + k)) for x, k in ((starts, i), (ends, j)))
    columns = [pc.add(s.field("logit"), e.field("logit")), pc.negate(s.field("rk")), pc.negate(e.field("rk")),
               s.field("pos"), e.field("pos"), s.field("ts"), e.field("te")]
    return _lists(np.bincount(w, minlength=n), ["score", "nsrank", "nerank", "s_pos", "e_pos", "s_char", "e_char"], columns)


def _texts(pieces: pa.ListArray, w: np.ndarray, s_pos: np.ndarray, e_pos: np.ndarray) -> pa.Array:
    """:func:`_span_text` of positions ``s_pos .. e_pos`` of the windows ``w``."""
    ends = pieces.offsets.to_numpy()
    first = pieces.values.field("pos").to_numpy(zero_copy_only=False)[ends[w]] if len(w) else w
    a = ends[w] + s_pos - first
    size = np.maximum(np.minimum(a + e_pos - s_pos + 1, ends[w + 1]) - a, 0)
    till = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(till[-1]) + np.repeat(a - till[:-1], size)
    spans = pa.ListArray.from_arrays(pa.array(till, pa.int32()), pieces.values.field("piece").take(pa.array(at)))
    return pc.utf8_ltrim(pc.binary_join(spans, ""), characters=WHITE)


ANSWERS = "array<struct<rk:int,text:string,score:double>>"


def answers_block(windows: pa.ListArray, max_answer_len: int, k: int) -> pa.ListArray:
    """J4 and T5 on the windows of a block of ids (:func:`top_block`): the answers of each as :func:`nbest_list` ranks them.

    An id's pairs are sorted once; texts are built from the best ones on until
    ``k`` distinct ones, or all, are found.
    """
    flat = windows.flatten()
    pairs = _every_pair(flat.field("starts"), flat.field("ends"), max_answer_len)
    w = np.repeat(np.arange(len(flat)), pc.list_value_length(pairs).to_numpy())
    owner = np.repeat(np.arange(len(windows)), pc.list_value_length(windows).to_numpy())[w]
    found = pairs.flatten()
    order = np.lexsort((_descending(found.field("score")), owner))  # pairs lie by window and ranks, which settle ties
    s_pos, e_pos = (found.field(c).to_numpy().astype(np.int64) for c in ("s_pos", "e_pos"))
    size = np.bincount(owner, minlength=len(windows))
    begin = np.cumsum(size) - size
    todo, wide, held = np.flatnonzero(size), 2 * k, []
    while len(todo):
        n = np.minimum(size[todo], wide)
        own = np.repeat(np.arange(len(todo)), n)
        at = order[np.arange(len(own)) + np.repeat(begin[todo] - np.cumsum(n) + n, n)]
        text = _texts(flat.field("pieces"), w[at], s_pos[at], e_pos[at])
        _, new = np.unique(own << 32 | text.dictionary_encode().indices.to_numpy(), return_index=True)
        new.sort()
        count = np.bincount(own[new], minlength=len(todo))
        rank = np.arange(len(new)) - np.repeat(np.cumsum(count) - count, count) + 1
        done = (count >= k) | (n == size[todo])
        new, rank = (x[done[own[new]] & (rank <= k)] for x in (new, rank))
        held.append((todo[own[new]], rank, at[new], text.take(pa.array(new))))
        todo, wide = todo[~done], 4 * wide
    ids, rank, at = (np.concatenate([h[c] for h in held] or [np.zeros(0, np.int64)]) for c in range(3))
    text = pa.concat_arrays([h[3] for h in held] or [pa.array([], pa.string())])
    by_id = np.argsort(ids, kind="stable")
    score = found.field("score").take(pa.array(at[by_id])).cast(pa.float64())
    return _lists(np.bincount(ids, minlength=len(windows)), ["rk", "text", "score"], [pa.array(rank[by_id], pa.int32()), text.take(pa.array(by_id)), score])


SWEPT = "array<struct<n_best:int,max_len:int,score:double,prediction:string>>"


def best_of_grid(windows: pa.ListArray, pts: list[tuple[int, int]]) -> pa.ListArray:
    """G6 on the windows of a block of ids: the best span of each for every grid point, NULL where there is none."""
    flat, rows = windows.flatten(), len(windows)
    starts, ends = flat.field("starts"), flat.field("ends")
    sides = [_field(x, f) for x in (starts, ends) for f in ("logit", "pos", "rk")]
    places = pa.concat_arrays([a.flatten() for a in _best_pairs(pts)(iter([sides]))] or [pa.array([], pa.struct([("i", pa.int32()), ("j", pa.int32())]))])
    at = np.flatnonzero(pc.is_valid(places.field("i")).to_numpy(zero_copy_only=False))
    w, c = at // len(pts), at % len(pts)
    i, j = (places.field(f).take(pa.array(at)).to_numpy() for f in ("i", "j"))
    s, e = (x.values.take(pa.array(x.offsets.to_numpy()[w] + k)) for x, k in ((starts, i), (ends, j)))
    score = pc.add(s.field("logit"), e.field("logit"))
    own = np.repeat(np.arange(rows), pc.list_value_length(windows).to_numpy())[w] * len(pts) + c
    order = np.lexsort((_descending(score), own))  # windows lie in order, which settles ties
    best = order[np.flatnonzero(np.diff(own[order], prepend=-1))]
    text = _texts(flat.field("pieces"), w[best], *(x.field("pos").take(pa.array(best)).to_numpy().astype(np.int64) for x in (s, e)))
    there = np.full(rows * len(pts), -1)
    there[own[best]] = np.arange(len(best))
    take = pa.array(there, mask=there < 0)
    grid = [pa.array(np.tile([p[f] for p in pts], rows), pa.int32()) for f in (0, 1)]
    return _lists(np.full(rows, len(pts)), ["n_best", "max_len", "score", "prediction"], [*grid, score.take(pa.array(best)).take(take).cast(pa.float64()), text.take(take)])


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Without this the optimizer may inline the expression that produces an
    array column into a per-element lambda (it counts one textual reference),
    re-sorting the array once per element.
    """
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def _valid_ends(ends: Column, s: Column, max_answer_len) -> Column:
    return F.filter(ends, lambda e: (e["pos"] >= s["pos"]) & (e["pos"] - s["pos"] < max_answer_len))


def _pair(s: Column, e: Column) -> Column:
    return F.struct(
        (s["logit"] + e["logit"]).alias("score"), (-s["rk"]).alias("nsrank"), (-e["rk"]).alias("nerank"),
        s["pos"].alias("s_pos"), e["pos"].alias("e_pos"), s["ts"].alias("s_char"), e["te"].alias("e_char"))


def _pairs(max_answer_len: int) -> Column:
    """J4 + P5 inside one window: every valid pair (for the candidate table)."""
    return _let(F.col("ends"), lambda ends: F.flatten(F.transform(
        F.col("starts"), lambda s: F.transform(_valid_ends(ends, s, max_answer_len), lambda e: _pair(s, e)))))


def _best_pair(max_answer_len, n_best=None) -> Column:
    """Best valid pair of one window without building all pairs.

    For a start, the best end is the first valid entry of the rank-ordered
    end list (highest logit, then lowest end rank); the window's best is then
    the maximum over starts of ``(score, -start rank, -end rank)``.  With
    ``n_best`` (a column, for sweeps) only entries ranked within it take part.
    """
    starts, ends = F.col("starts"), F.col("ends")
    if n_best is not None:
        starts = F.filter(starts, lambda x: x["rk"] <= n_best)
        ends = F.filter(ends, lambda x: x["rk"] <= n_best)
    return _let(ends, lambda ends: F.array_max(F.flatten(F.transform(
        starts,
        lambda s: F.transform(F.slice(_valid_ends(ends, s, max_answer_len), 1, 1), lambda e: _pair(s, e))))))


def _dense(column: pa.Array, rows: int, width: int, fill) -> np.ndarray:
    """List column -> ``rows x width``, short lists filled up."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(column.flatten(), 0).to_numpy(zero_copy_only=False)
    out = np.full((rows, width), fill, np.float64 if values.dtype.kind == "f" else np.int64)
    out[np.arange(width) < size[:, None]] = values
    return out


def _blocks(columns: Iterator[tuple[pa.Array, ...]], block: int) -> Iterator[list[pa.Array]]:
    for batch in columns:
        for lo in range(0, len(batch[0]), block):
            part = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).slice(lo, block) for c in batch]
            yield [p if isinstance(p.type, pa.ListType) else p.cast(pa.list_(p.type.value_type)) for p in part]


def _width(*columns: pa.Array) -> int:
    return max(1, *(pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns))


PAIR_BLOCK = 1024  # windows whose starts and ends meet together
FAR = 1 << 40      # no position


def _best_pairs(grid: list[tuple[int, int]]):
    """Per window and grid point ``(n_best, max_answer_len)`` the places of the best valid pair in the rank-ordered lists.

    For a start, the best end is the first valid entry of the list (highest
    logit, then lowest rank), whatever ``n_best`` cuts off below it; the window's
    best is the first start with the largest score among those.
    """
    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for s_logit, s_pos, s_rk, e_logit, e_pos, e_rk in _blocks(columns, PAIR_BLOCK):
            n, ks, ke = len(s_pos), _width(s_pos), _width(e_pos)
            sl, el = _dense(s_logit, n, ks, 0), _dense(e_logit, n, ke, 0)
            sr, er = _dense(s_rk, n, ks, FAR), _dense(e_rk, n, ke, FAR)
            gap = _dense(e_pos, n, ke, FAR)[:, None, :] - _dense(s_pos, n, ks, 0)[:, :, None]
            at = np.arange(n)[:, None]
            found = {}
            for m in {m for _, m in grid}:
                valid = (gap >= 0) & (gap < m)
                first = valid.argmax(axis=2)
                found[m] = first, np.where(np.take_along_axis(valid, first[:, :, None], axis=2)[:, :, 0], er[at, first], FAR), sl + el[at, first]
            i, j = np.zeros((n, len(grid)), np.int64), np.zeros((n, len(grid)), np.int64)
            none = np.zeros((n, len(grid)), bool)
            for c, (nb, m) in enumerate(grid):
                first, rank, score = found[m]
                ok = (sr <= nb) & (rank <= nb)
                best = np.where(ok, score, -np.inf if score.dtype.kind == "f" else np.iinfo(np.int64).min).argmax(axis=1)
                best = np.where(ok[at[:, 0], best], best, ok.argmax(axis=1))  # a score of minus infinity is a score
                i[:, c], j[:, c], none[:, c] = best, first[at[:, 0], best], ~ok.any(axis=1)
            none = none.ravel()
            places = pa.StructArray.from_arrays([pa.array(x.ravel(), pa.int32(), mask=none) for x in (i, j)], names=["i", "j"])
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(grid), pa.int32()), places)

    return run


def _at_places(at: Column, starts: Column | str = "starts", ends: Column | str = "ends") -> Column:
    """The pair of start ``i`` and end ``j``; NULL where there is none."""
    s, e = F.get(starts, at["i"]), F.get(ends, at["j"])
    return F.when(at["i"].isNotNull(), _pair(s, e))


def _span_text(c: Column, pieces: Column | None = None) -> Column:
    """``context[s_char:e_char]`` rebuilt from the window's pieces (leading white space dropped)."""
    pieces = F.col("pieces") if pieces is None else pieces
    first = F.try_element_at(pieces, F.lit(1))["pos"]
    span = F.slice(pieces, c["s_pos"] - first + 1, c["e_pos"] - c["s_pos"] + 1)
    return F.regexp_replace(F.array_join(F.transform(span, lambda x: x["piece"]), ""), LEADING_WS, "")


def span_candidates(topk: DataFrame, max_answer_len: int, n_texts: int | None = None) -> DataFrame:
    """J4 rows: ``id, feature_idx, srank, erank, s_pos, e_pos, s_char, e_char, score, text``.

    With ``n_texts`` a window gives only the best candidate of each of its first
    ``n_texts`` distinct texts: no other candidate of the window can be among the
    ``n_texts`` distinct texts of an example, as those are ahead of it.
    """
    if n_texts is None:
        pairs = F.col("pairs") if "pairs" in topk.columns else _pairs(max_answer_len)  # already paired within max_answer_len
        c = topk.select("id", "feature_idx", "pieces", F.explode(pairs).alias("c"))
        text = _span_text(F.col("c"))
    else:
        # a pair begins with its score and ranks, so pairs sort by them
        pairs = F.sort_array(_pairs(max_answer_len), asc=False)
        each = _let(pairs, lambda cs: F.transform(cs, lambda c: F.struct(c.alias("c"), _span_text(c).alias("text"))))
        first = _let(each, lambda es: _let(es["text"], lambda ts: F.transform(
            F.slice(F.array_distinct(ts), 1, n_texts), lambda t: F.get(es, (F.array_position(ts, t) - 1).cast("int")))))
        c = topk.select("id", "feature_idx", F.inline_outer(first)).where(F.col("c").isNotNull())
        text = F.col("text")
    return c.select(
        "id", "feature_idx",
        (-F.col("c.nsrank")).alias("srank"), (-F.col("c.nerank")).alias("erank"),
        F.col("c.s_pos").alias("s_pos"), F.col("c.e_pos").alias("e_pos"),
        F.col("c.s_char").alias("s_char"), F.col("c.e_char").alias("e_char"),
        F.col("c.score").alias("score"), text.alias("text"),
    )


def window_best(topk: DataFrame, max_answer_len: int) -> DataFrame:
    """Best candidate of each window (no candidate rows are materialised)."""
    b = topk.select("id", "feature_idx", "pieces", _best_pair(max_answer_len).alias("b"))
    return b.where(F.col("b").isNotNull()).select(
        "id", "feature_idx", F.col("b.score").alias("score"), F.col("b.nsrank").alias("nsrank"),
        F.col("b.nerank").alias("nerank"), F.col("b.s_char").alias("s_char"), F.col("b.e_char").alias("e_char"),
        _span_text(F.col("b")).alias("text"))


def sweep_best(topk: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """Best span per ``(n_best, max_len, id)`` for every grid point in one pass.

    ``topk`` must be ranked at the grid maxima.  Starts and ends of a window meet
    once; a start's best end within an answer length is the same for every
    ``n_best`` that keeps it, so a grid point only compares the starts.  An
    example's best windows are found for all grid points in one aggregate, and
    only its results are exploded.
    """
    pts = sorted(set(grid))
    ship_by_value(_best_pairs)
    places = F.arrow_udf(_best_pairs(pts), "array<struct<i:int,j:int>>", F.ArrowUDFType.SCALAR_ITER)
    p = topk.withColumn("_at", places("starts.logit", "starts.pos", "starts.rk", "ends.logit", "ends.pos", "ends.rk"))
    res = F.transform("_at", lambda a: _let(_at_places(a), lambda b: F.when(b.isNotNull(), F.struct(
        b["score"].alias("score"), b["nsrank"].alias("nsrank"), b["nerank"].alias("nerank"), _span_text(b).alias("text")))))
    x = p.select("id", "feature_idx", res.alias("r"))

    def best(c: int) -> Column:
        r = F.get("r", F.lit(c))
        order = F.when(r.isNotNull(), F.struct(r["score"], -F.col("feature_idx"), r["nsrank"], r["nerank"]))
        return F.max_by(F.struct(r["score"].alias("score"), r["text"].alias("text")), order).alias(f"b{c}")

    per = x.groupBy("id").agg(*[best(c) for c in range(len(pts))])
    rows = F.array(*[F.struct(F.lit(n).alias("n_best"), F.lit(m).alias("max_len"), F.col(f"b{c}").alias("w")) for c, (n, m) in enumerate(pts)])
    out = per.select("id", F.inline(rows)).where(F.col("w").isNotNull())
    return out.select("n_best", "max_len", "id", F.col("w.score").cast("double").alias("score"),
                      F.col("w.text").alias("prediction"))


def best_spans(wbest: DataFrame) -> DataFrame:
    """``id, score, s_char, e_char, text`` per example with at least one candidate."""
    order = F.struct("score", -F.col("feature_idx"), "nsrank", "nerank")
    b = wbest.groupBy("id").agg(F.max_by(F.struct("score", "s_char", "e_char", "text"), order).alias("b"))
    return b.select("id", "b.score", "b.s_char", "b.e_char", "b.text")


def best_in_rows(rows: DataFrame) -> DataFrame:
    """G4 where an id's windows are one row (``id, windows``, paired by ``best``): what ``best_spans(window_best(...))`` gives, without a shuffle."""
    def best(w: Column) -> Column:
        return _let(_at_places(w["at"], w["starts"], w["ends"]), lambda b: F.when(b.isNotNull(), F.struct(
            b["score"].alias("score"), (-w["feature_idx"]).alias("nfid"), b["nsrank"].alias("nsrank"), b["nerank"].alias("nerank"),
            b["s_char"].alias("s_char"), b["e_char"].alias("e_char"), b["s_pos"].alias("s_pos"), b["e_pos"].alias("e_pos"))))

    def with_text(ws: Column) -> Column:
        def text(b: Column) -> Column:
            own = F.try_element_at(F.filter(ws, lambda w: w["feature_idx"] == -b["nfid"]), F.lit(1))
            return F.struct(b.alias("b"), _let(own["pieces"], lambda p: _span_text(b, p)).alias("text"))

        return _let(F.array_max(F.transform(ws, best)), text)

    r = rows.select("id", with_text(F.col("windows")).alias("r")).where(F.col("r.b").isNotNull())
    return r.select("id", "r.b.score", "r.b.s_char", "r.b.e_char", "r.text")


def decode_windows(rows: DataFrame) -> DataFrame:
    """:func:`decode_spans` on rows of ``id, windows`` (paired by ``best``)."""
    best = best_in_rows(rows)
    return best.select("id", F.col("text").alias("prediction"), F.col("score").cast("double").alias("score"), "s_char", "e_char")


def decode_spans(logits: DataFrame, cfg: DecodeConfig = DecodeConfig()) -> DataFrame:
    """M3 on a position-logits frame: ``id, prediction, score, s_char, e_char``.

    Only examples with a candidate appear; use :func:`with_predictions` to give
    every example a row (``''`` / 0.0 otherwise).
    """
    topk = window_topk(logits, cfg.n_best, cfg.mask_before_topk)
    best = best_spans(window_best(topk, cfg.max_answer_len))
    return best.select("id", F.col("text").alias("prediction"), F.col("score").cast("double").alias("score"),
                       "s_char", "e_char")


def with_predictions(examples: DataFrame, preds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``examples left join predictions``; missing -> ``''`` and 0.0."""
    j = examples.select("id", *keep).join(preds.select("id", "prediction", "score"), "id", "left")
    return j.select("id", *keep, F.coalesce("prediction", F.lit("")).alias("prediction"),
                    F.coalesce("score", F.lit(0.0)).alias("score"))


def null_score(logits: DataFrame) -> DataFrame:
    """Per example the largest ``start[CLS] + end[CLS]`` over its windows."""
    return (
        logits.where(F.col("pos") == 0)
        .groupBy("id")
        .agg(F.max(F.col("start_logit") + F.col("end_logit")).alias("null_score"))
    )


def nbest_list(cands: DataFrame, k: int) -> DataFrame:
    """T5: ranked answer list per example: distinct texts, each with its best score.

    ``id, rk, text, score``; a text ranks by its best candidate in the same
    total order as ``best_spans``; at most ``k`` per example (the feature).
    """
    order = F.struct("score", -F.col("feature_idx"), -F.col("srank"), -F.col("erank"))
    per_text = cands.groupBy("id", "text").agg(F.max(order).alias("_o"))
    w = Window.partitionBy("id").orderBy(F.desc("_o"))
    return (
        per_text.withColumn("rk", F.row_number().over(w))
        .where(F.col("rk") <= k)
        .select("id", "rk", "text", F.col("_o.score").cast("double").alias("score"))
    )
