
from spanlake.config import DecodeConfig, WindowConfig
from spanlake.plans import fixtures as X
from spanlake.plans.composite import lexical_predictions
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_decode_has_one_exchange_on_id(spark):
    ex = X.qa(spark, SF_SMALL)
    p = _plan(lexical_predictions(ex, WindowConfig(), DecodeConfig()))
    exchanges = [l for l in p.split("\n") if "Exchange hashpartitioning" in l]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_labels_and_character_lookups_move_no_text(spark):
    """F5 and F6 stay inside the row: no exchange, no join and no scan beyond those of the examples."""
    from __spark_entry__ import queries
    base = _plan(X.qa(spark, SF_SMALL))
    for name in ("window_labels", "char_to_token"):
        p = _plan(queries()[name](spark, SF_SMALL))
        assert (p.count("Exchange"), p.count("Join"), p.count("Scan parquet")) == (base.count("Exchange"), base.count("Join"), base.count("Scan parquet"))


def test_history_keeps_every_event(spark):
    from spanlake.sources.tables import table
    assert X.history(spark, SF_SMALL).count() == table(spark, SF_SMALL, "events").count()


def test_relocate_has_no_nested_loop(spark):
    p = _plan(X.qa_bench(spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_scan_prunes_columns(spark):
    from __spark_entry__ import queries
    p = _plan(queries()["token_offsets"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_sweep_reads_candidates_once(spark):
    from __spark_entry__ import queries
    p = _plan(queries()["decode_sweep"](spark, SF_SMALL))
    # one per-window collection of scored positions feeds every grid point
    assert p.count("partial_collect_list(struct(logit, start_logit") == 1
