"""Physical plan shape of the inspection: the properties the scale design relies on."""

import re

from netsift.plans import catalog
from conftest import SF001


def _plan(df) -> str:
    df.collect()  # final adaptive plan
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_verdict_plan_shape(spark):
    ins = catalog.inspection(spark, SF001)
    plan = _plan(ins.verdicts)
    flow_exchanges = re.findall(r"Exchange hashpartitioning\(capture_id#\d+, src_ip", plan)
    assert len(flow_exchanges) == 1, plan
    sorts = [l for l in plan.split("\n") if re.search(r"\bSort \[capture_id", l)]
    assert len(sorts) == 1, plan
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    # Payload and frame bytes never cross the flow exchange.
    exchange_line = [l for l in plan.split("\n") if "Exchange hashpartitioning(capture_id" in l][0]
    assert "payload" not in exchange_line and "data#" not in exchange_line


def test_flow_reports_reuse_partitioning(spark):
    ins = catalog.inspection(spark, SF001)
    plan = _plan(ins.flows)
    assert len(re.findall(r"Exchange hashpartitioning\(capture_id#\d+, src_ip", plan)) == 1, plan
