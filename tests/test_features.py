"""The feature table against a plain Python reading of its rules."""

import re

import pytest

from spanlake.config import WindowConfig
from spanlake.operators.features import MODES, feature_table, project_features
from spanlake.plans import fixtures as X
from tests.conftest import SF_SMALL

SCHEMA = "id long, context string, question string, start_char int, end_char int, ts string, w string, _keep string"


def spans(text):
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]


def expected(row, cfg):
    i, context, question, start, end = row[:5]
    stripped = question.lstrip() if question is not None else None
    q, c = spans(stripped), spans(context)
    room = cfg.max_len - cfg.n_special - len(q)
    out, at = [], 0
    while room > cfg.stride:
        part = c[at:at + room]
        pad = room - len(part)
        labels = (0, 0)
        if start is not None and part and part[0][1] <= start and part[-1][2] >= end:
            labels = (max(k for k, t in enumerate(part) if t[1] <= start) + len(q) + 2, min(k for k, t in enumerate(part) if t[2] >= end) + len(q) + 2)
        out.append((i, len(out), context, stripped,
                    ["<s>", *[t[0] for t in q], "</s>", *[t[0] for t in part], "</s>", *["<pad>"] * pad],
                    [1] * (cfg.max_len - pad) + [0] * pad,
                    [(0, 0), *[t[1:] for t in q], (0, 0), *[t[1:] for t in part], (0, 0), *[(0, 0)] * pad],
                    [0] * (len(q) + 2) + [1] * len(part) + [0] * (pad + 1), *labels))
        if at + room >= len(c):
            break
        at += room - cfg.stride
    return out


ROWS = [
    (1, "one two  three\tfour five six seven eight nine ten eleven", "  what three", 9, 14),
    (1, "the same id again, with another text and more words than one window holds at all", "which", 0, 3),
    (1, "the same id again, with another text and more words than one window holds at all", "which", 0, 3),
    (2, "no answer here", "why", None, None),
    (3, "", "blank context", None, None),
    (4, None, None, None, None),
    (5, "a question that leaves no room", " ".join("abcdefghij"), 0, 1),
    (6, " ".join(f"w{k}é" for k in range(3000)), "where", 30, 47),
    (None, "漢字 mit Zeichen", "", 0, 2),
]


@pytest.mark.parametrize("cfg", [WindowConfig(12, 3, 3), WindowConfig(40, 0, 3)])
def test_feature_rows(spark, cfg):
    df = spark.createDataFrame([(*r, "clash", "clash", f"k{r[0]}") for r in ROWS], SCHEMA).repartition(3)
    out = feature_table(df, cfg, keep=("ts", "_keep"))
    got = sorted(([r.example_id, r.feature_idx, r.context, r.question, r.tokens, r.attention_mask,
                   [tuple(o) for o in r.offset_mapping], r.sequence_ids, r.start_position, r.end_position] for r in out.collect()), key=repr)
    assert got == sorted((list(r) for row in ROWS for r in expected(row, cfg)), key=repr)
    assert {(r.ts, r._keep) for r in out.where("example_id = 6").select("ts", "_keep").collect()} == {("clash", "k6")}
    assert all(len(r.tokens) == len(r.offset_mapping) == len(r.sequence_ids) == len(r.attention_mask) == cfg.max_len for r in out.collect())


def test_projections_and_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    feats = feature_table(df, WindowConfig(12, 3, 3))
    assert feats.count() == 0
    for mode, columns in MODES.items():
        assert project_features(feats, mode).columns == columns
    assert project_features(feats, "train", keep=("feature_idx",)).columns == [*MODES["train"], "feature_idx"]
    with pytest.raises(ValueError):
        project_features(feats, "other")


def test_feature_table_moves_nothing(spark):
    """One scan and no exchange or join beyond those of the examples."""
    from __spark_entry__ import queries
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    base, p = plan(X.qa(spark, SF_SMALL)), plan(queries()["feature_table"](spark, SF_SMALL))
    assert [p.count(x) for x in ("Exchange", "Join", "Scan parquet")] == [base.count(x) for x in ("Exchange", "Join", "Scan parquet")]
