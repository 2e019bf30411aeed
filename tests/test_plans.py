"""Plan shape of the registered queries: the scale properties we rely on, checked on explain output."""

import contextlib
import io

import pytest

from adlens.plans import catalog as C

SLOW = {"isolation_forest", "forest_findings", "stream_daily", "cooldown_dedup", "normalize_events"}


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(C.queries()) - SLOW))
def test_no_cartesian_and_no_row_udf(spark, sf_small, name):
    p = plan_of(C.queries()[name](spark, sf_small))
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p                      # no row-at-a-time Python UDF
    assert "BroadcastNestedLoopJoin" not in p


def test_rollup_prunes_columns_and_aggregates_partially(spark, sf_small):
    p = plan_of(C.queries()["campaign_summary"](spark, sf_small))
    assert "partial_sum" in p
    li = [ln for ln in p.splitlines() if ln.startswith("ReadSchema") and "l_orderkey" in ln][0]
    assert "l_comment" not in li and "l_shipdate" not in li and "l_shipmode" not in li
