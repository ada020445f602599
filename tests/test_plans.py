"""Plan shape: what must hold for a thousand times the data."""

import re

import pytest

from conftest import SMALL
from watchloom.plans import load_all
from watchloom.session import load

QUERIES, _ = load_all()
# eager streaming and graph jobs leave only a scan behind
BATCH = [n for n, f in QUERIES.items() if not f.__module__.endswith(("streams", "graphs"))]


def physical(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_row_udf(spark, name):
    plan = physical(QUERIES[name](spark, SMALL))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)


def test_time_window_reaches_the_scan(spark):
    plan = physical(QUERIES["daily_kpi"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan


def test_activity_bound_reaches_the_scan(spark):
    assert "LessThan(o_orderdate," in physical(QUERIES["activity_snapshot"](spark, SMALL))


@pytest.mark.parametrize("name", ["latest_per_key", "last_n_per_key", "best_candidate"])
def test_rank_is_limited_before_the_shuffle(spark, name):
    plan = physical(QUERIES[name](spark, SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_group_max_uses_no_window(spark):
    assert "Window" not in physical(QUERIES["backup_families"](spark, SMALL))


def test_row_rules_share_one_scan(spark):
    from watchloom.operators.rules import Rule, count_violations

    t = {"lineitem": load(spark, SMALL, "lineitem")}
    rules = [Rule(i, "c", str(i), "lineitem", f"l_linenumber = {i}") for i in range(1, 6)]
    assert physical(count_violations(t, rules)).count("FileScan") == 1


def test_events_are_parsed_once(spark):
    from watchloom.operators.capture_reports import block_incidents
    from watchloom.plans.adapters import block_event_xml
    from watchloom.plans.captures import written
    from watchloom.sources.captures import read_event_capture

    cap = read_event_capture(spark, written(block_event_xml(spark, SMALL)))
    plan = physical(block_incidents(cap))
    assert len(re.findall(r"from_xml\(", plan)) == 2  # the event and the report inside it


@pytest.mark.parametrize("name", ["daily_kpi", "text_log", "slow_ops", "quiet_alerts", "stale_entities"])
def test_results_do_not_depend_on_the_session_zone(spark, name):
    seen = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        seen.append(sorted(map(str, QUERIES[name](spark, SMALL).collect())))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen[0] == seen[1]


def test_captures_are_packed_and_cut(spark, monkeypatch):
    """Capture files take a fraction of their text, none holds more than its share of events, and all events are read."""
    from watchloom.plans import captures
    from watchloom.sources.captures import read_event_capture

    monkeypatch.setattr(captures, "EVENTS_PER_FILE", 1000)
    event = "concat('<event name=\"e\" timestamp=\"2024-01-31T00:00:00.', id, 'Z\"><data name=\"d\"><value>', id, '</value></data></event>')"
    path = captures.written(spark.range(5000).coalesce(1).selectExpr("id event_id", f"{event} xml"), "packed")
    files = [(r[0], r[1]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]
    assert len(files) == 5 and all(p.endswith(".gz") for p, _ in files) and sum(n for _, n in files) < 5000 * 40
    got = read_event_capture(spark, path).selectExpr("count(*)", "count(distinct event.data[0].value)").first()
    assert tuple(got) == (5000, 5000)
