"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

warm-up run is discarded and the median of ``$BENCH_RUNS`` (default 3) runs is
reported.  Queries use the production window setting (400 / 135) and the
reference's decode defaults (n_best 20, max answer length 30).  Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from spanlake.config import DecodeConfig, WindowConfig  # noqa: E402
from spanlake.operators import decode as D  # noqa: E402
from spanlake.operators.augment import normalize_synonyms, synonym_replacement  # noqa: E402
from spanlake.operators.ensemble import hard_vote  # noqa: E402
from spanlake.operators.tokens import tokenize  # noqa: E402
from spanlake.operators.windows import window_labels, windowed_tokens  # noqa: E402
from spanlake.plans import catalog  # noqa: E402
from spanlake.plans import fixtures as X  # noqa: E402
from spanlake.plans.composite import eval_by_language, lexical_logits_for, lexical_predictions  # noqa: E402
from spanlake.plans.queries_eval import GRID_MAX, SWEEP_GRID  # noqa: E402
from spanlake.session import local_session, shuffle_partitions  # noqa: E402
from spanlake.sources.tables import table  # noqa: E402

WCFG = WindowConfig(max_len=400, stride=135)
DCFG = DecodeConfig(n_best=20, max_answer_len=30)


def by_id(df, col="id"):
    return df.repartition(shuffle_partitions(df), col)


def q_eval_by_language(spark, d):
    return eval_by_language(X.qa(spark, d), WCFG, DCFG)


def q_best_span(spark, d):
    return lexical_predictions(X.qa(spark, d), WCFG, DCFG)


def q_decode_sweep(spark, d):
    ex = X.qa(spark, d)
    tk = D.window_topk(lexical_logits_for(ex, WCFG, GRID_MAX), GRID_MAX.n_best)
    best = D.sweep_best(tk, SWEEP_GRID)
    j = best.join(ex.select("id", "language", "answer_text"), "id")
    from spanlake.functions.text import jaccard
    return j.groupBy("n_best", "max_len", "language").agg(F.avg(jaccard("answer_text", "prediction")).alias("m"))


def q_window_labels(spark, d):
    ex = X.qa(spark, d)
    part = by_id(ex.select("id", "context", "question", F.col("answer_start").alias("start_char"),
                           F.col("answer_end").alias("end_char")))
    return window_labels(windowed_tokens(part, WCFG, keep=("start_char", "end_char")))


def q_token_offsets(spark, d):
    docs = by_id(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("context")))
    t = tokenize(docs, "id", "context")
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("n_tok"), F.sum("ts").alias("sum_ts"), F.max("te").alias("max_te"))


def q_hard_vote(spark, d):
    return hard_vote(X.preds(spark, d))


def q_occurrence_lists(spark, d):
    return catalog.queries()["occurrence_lists"](spark, d)


def q_synonym_replace(spark, d):
    docs = by_id(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    syn = normalize_synonyms(X.lexicon(spark, d))
    return synonym_replacement(docs, syn, None, 3, 9353)


QUERIES = {
    "eval_by_language": q_eval_by_language,
    "best_span": q_best_span,
    "decode_sweep": q_decode_sweep,
    "window_labels": q_window_labels,
    "token_offsets": q_token_offsets,
    "hard_vote": q_hard_vote,
    "occurrence_lists": q_occurrence_lists,
    "synonym_replace": q_synonym_replace,
}


def run_once(spark, fn, d, group: str) -> float:
    spark.sparkContext.setJobGroup(group, group)
    t0 = time.perf_counter()
    fn(spark, d).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def exchanges(spark, fn, d) -> int:
    """Exchange operators (shuffles and broadcasts) in the physical plan before execution."""
    plan = fn(spark, d)._jdf.queryExecution().executedPlan().toString()
    return sum(1 for line in plan.split("\n") if "Exchange " in line and "Reused" not in line)


def event_log_metrics(log_dir: str) -> dict[str, dict[str, int]]:
    """Shuffle bytes written and bytes spilled per job group, from Spark's event log."""
    stage_group: dict[int, str] = {}
    out: dict[str, dict[str, int]] = {}
    files = sorted(os.path.join(root, f) for root, _, names in os.walk(log_dir) for f in names
                   if f.startswith("events_") or f.startswith("local-") or f.startswith("app-"))
    for path in files:
        with open(path) as fh:
            for line in fh:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    m = ev.get("Task Metrics") or {}
                    if not group:
                        continue
                    acc = out.setdefault(group, {"shuffle_bytes": 0, "spill_bytes": 0})
                    acc["shuffle_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    acc["spill_bytes"] += m.get("Memory Bytes Spilled", 0) + m.get("Disk Bytes Spilled", 0)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    log_dir = tempfile.mkdtemp(prefix="spanlake-eventlog-")  # local bench scratch, read back below
    # two tasks per core after the id shuffle: token expansion varies per document
    spark = local_session(cpus=cpus, app="spanlake-bench", shuffle_partitions=2 * int(cpus), event_log_dir=log_dir)
    out, n_exchanges = {}, {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        run_once(spark, fn, sf_dir, f"warmup:{name}")  # discarded
        out[name] = round(statistics.median(run_once(spark, fn, sf_dir, f"timed:{name}") for _ in range(runs)), 3)
        n_exchanges[name] = exchanges(spark, fn, sf_dir)
    spark.stop()
    ev = event_log_metrics(log_dir)
    detail = {name: {"exchanges": n_exchanges[name],
                     "shuffle_bytes_per_run": ev.get(f"timed:{name}", {}).get("shuffle_bytes", 0) // runs,
                     "spill_bytes_per_run": ev.get(f"timed:{name}", {}).get("spill_bytes", 0) // runs}
              for name in out}
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
                      "cpus": int(cpus), "runs": runs, "window": [WCFG.max_len, WCFG.stride], "plan": detail}))


if __name__ == "__main__":
    main()
