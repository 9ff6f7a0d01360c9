"""Plan checks (SURVEY §5 (5)): the physical plans we want, not just the right rows."""

from fleetlens.catalog import load_all

SF = "/root/testdata/sf0.001"
REG = load_all()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_image_availability_has_no_nested_loop(spark):
    p = plan(REG["image_availability"].build(spark, SF))
    assert "NestedLoop" not in p and "CartesianProduct" not in p


def scans(df) -> int:
    """File scans that the plan names before it runs (a frame that has run shows that plan too)."""
    return plan(df).split("== Initial Plan ==")[-1].count("FileScan parquet")


def test_each_plan_reads_its_tables_few_times(spark):
    most = {"run_report": 2, "tx_percentiles": 1, "run_compare": 1, "image_availability": 2, "issue_route": 3, "profile_audit": 3,
            "idle_sessions": 1, "health_state": 2, "tx_total": 1}
    got = {name: scans(REG[name].build(spark, SF)) for name in most}
    assert all(got[name] <= n for name, n in most.items()), got


def test_run_report_scans_the_log_once(spark):
    p = plan(REG["run_report"].build(spark, SF))
    assert p.count("events.parquet") == 1


def test_log_tail_uses_window_group_limit(spark):
    df = REG["log_tail"].build(spark, SF)
    assert "WindowGroupLimit" in plan(df)


def test_measured_window_pushes_filter_to_scan(spark):
    df = REG["measured_window"].build(spark, SF)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p


def test_no_cartesian_products_anywhere(spark):
    bad = []
    for name, e in REG.items():
        if name in ("readiness_stream", "health_stream", "config_docs"):
            continue
        p = plan(e.build(spark, SF))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(name)
    assert not bad


def test_scans_read_only_needed_columns(spark):
    df = REG["tx_summary"].build(spark, SF)
    p = plan(df)
    # fx_tx needs event_id? no: tx_summary reads user_id, event_type and event_id (for ok)
    assert "props" not in p.split("ReadSchema")[1].split("\n")[0]
