from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchloom import session as W
from watchloom.functions.events import data_field
from watchloom.operators.alerting import quiet_alerts
from watchloom.operators.tables import clear_partition, copy_tables
from watchloom.sources.alerts import alert_rows, write_alerts
from watchloom.sources.captures import normalise_block_reports, read_event_capture
from watchloom.sources.history import append_snapshot, purge_history, purge_stored, read_history
from watchloom.sources.remote import fill_markers
from watchloom.sources.remote import run_query, sql_literal
from watchloom.sources.textlog import parse_log_lines


@pytest.fixture
def capture(tmp_path):
    body = "".join(
        f'<event name="e{i % 3}" timestamp="2024-01-01T23:59:{i % 60:02d}.5Z">\n  <data name="n">\n    <value>{i}</value></data>\n</event>\n'
        for i in range(5000)
    )
    (tmp_path / "a.xml").write_text(f'<events>\n<event name="bare" timestamp="2024-01-01T00:00:00Z"/>\n{body}</events>\n')
    return str(tmp_path)


def test_large_capture_is_split_without_loss(spark, capture):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        cap = read_event_capture(spark, capture)
        assert cap.rdd.getNumPartitions() >= 4
        got = cap.agg(F.count("*"), F.sum(data_field("event", "n", "long"))).first()
        assert tuple(got) == (5001, 5000 * 4999 // 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_capture_reader(spark, capture):
    cap = read_event_capture(spark, capture, 210, ["e1", "bare"])
    fast = sorted(tuple(r) for r in cap.select("log_date", "log_ts", "category", data_field("event", "n", "long").alias("n")).collect())
    assert len(fast) == 1668
    assert fast[0][1] == datetime(2024, 1, 1, 3, 30) and str(fast[-1][0]) == "2024-01-02"


def test_end_tag_inside_cdata_loses_nothing(spark, tmp_path):
    def event(i, body):
        return f'<event name="e" timestamp="2024-01-01T00:00:00Z"><data name="t"><value><![CDATA[{body}]]></value></data><data name="n"><value>{i}</value></data></event>'

    tmp_path = tmp_path / "cap dir+1,2"
    tmp_path.mkdir()
    (tmp_path / "odd one, 100%+.xml").write_text("<events>" + event(1, "plain") + event(2, "x </event> y") + event(3, "z") + "</events>")
    (tmp_path / "even.xml").write_text("<events>" + event(4, "w") + "</events>")
    cap = read_event_capture(spark, str(tmp_path / "*.xml"), 60)
    got = cap.select(data_field("event", "n", "long").alias("n"), data_field("event", "t", "string").alias("t"), "log_ts").orderBy("n").collect()
    assert [(r.n, r.t) for r in got] == [(1, "plain"), (2, "x </event> y"), (3, "z"), (4, "w")]
    assert {r.log_ts for r in got} == {datetime(2024, 1, 1, 1)}


def test_report_fallbacks(spark):
    report = '<blocked-process-report><blocked-process><process spid="5" ecid="0"/></blocked-process><blocking-process><process spid="6" ecid="1"/></blocking-process></blocked-process-report>'
    df = spark.createDataFrame([(report, datetime(2024, 1, 1)), (report, None), ("<blocked-process-report/>", None)], "x string, t timestamp_ntz")
    out = normalise_block_reports(df, "table", "x", "t").collect()
    assert len(out) == 2
    assert {r.monitorloop == "2024-01-01 00:00:00" or len(r.monitorloop) == 32 for r in out} == {True}
    assert (out[0].blocked_spid, out[0].blocking_spid, out[0].blocking_ecid) == (5, 6, 1)


def test_log_lines(spark):
    df = spark.createDataFrame([("2024-01-31 10:20:30.12 spid51      Hello  world",), ("   continued",)], "value string")
    out = parse_log_lines(df).collect()
    assert [(r.process, r.text) for r in out] == [("spid51", "Hello  world")]


def test_history_roundtrip_and_purge(spark, tmp_path):
    path = str(tmp_path / "h")
    for day in (1, 5, 9):
        append_snapshot(spark.range(2), path, datetime(2024, 1, day, 12))
    kept = purge_history(read_history(spark, path), "log_time", 4, datetime(2024, 1, 9, 12))
    assert sorted({r.log_time.day for r in kept.collect()}) == [5, 9]


def test_purge_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "h")
    append_snapshot(spark.range(2), path, datetime(2024, 1, 1))
    kept = purge_history(read_history(spark, path), "log_time", 4, datetime(2024, 1, 9))
    plan = kept._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "simple")
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_alert_defaults(spark, tmp_path):
    df = spark.createDataFrame([(None, None, datetime(2024, 1, 1))], "k string, b string, t timestamp_ntz")
    alerts = write_alerts(alert_rows(df, "k", "b", "srv", "t"), str(tmp_path / "a"), console=True)
    r = alerts.first()
    assert r.alert_type == "UNKNOWN" and r.alert_text == "<instance_name>srv</instance_name>\r\n<UNKNOWN/>"
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1


def test_parameters_are_bound(spark):
    out = run_query(spark, "SELECT :v AS v", {"v": "x' OR '1'='1"})
    assert out.first().v == "x' OR '1'='1"
    assert sql_literal("O'Brien") == "'O''Brien'" and sql_literal(None) == "NULL"


def test_copy_and_clear(spark, tmp_path):
    df = spark.range(25).select("id", (F.col("id") % 3).alias("p"), F.lit("x").alias("computed"))
    report = copy_tables(
        spark, {"a": df, "b": df}, str(tmp_path), except_=("b",), skip_columns={"a": ["computed"]}, sort_keys={"a": ["id"]},
        partition_by={"a": ["p"]}, batch_rows=10,
    ).collect()
    assert [(r.object_name, r.columns, r.row_count, r.batch_count) for r in report] == [("a", "id,p", 25, 3)]
    clear_partition(spark, str(tmp_path / "a"), "p=1")
    assert spark.read.parquet(str(tmp_path / "a")).count() == 17


def fold(secs, quiet):
    out, last = [], None
    for s in sorted(set(secs)):
        if last is None or s >= last + quiet:
            out.append(s)
            last = s
    return out


def test_quiet_periods_against_a_plain_loop(spark):
    """A hot alert breaching for days on end, a sparse one, and one without quiet time."""
    import random

    rnd = random.Random(1)
    base = 1704067200
    hot = [base + rnd.randrange(3 * 86400) for _ in range(4000)]
    sparse = [base + 7000 * i for i in range(30)]
    rows = [("hot", 300, s) for s in hot] + [("sparse", 300, s) for s in sparse] + [("each", 0, s) for s in hot[:50]]
    df = spark.createDataFrame(rows, "alert string, quiet int, s long").select(
        "alert", "quiet", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")
    )
    out = quiet_alerts(df.repartition(5)).select("alert", F.unix_timestamp(F.col("fired_at").cast("timestamp")).alias("s")).collect()
    got = {a: sorted(r.s for r in out if r.alert == a) for a in ("hot", "sparse", "each")}
    assert got == {"hot": fold(hot, 300), "sparse": sparse, "each": sorted(set(hot[:50]))}


@pytest.mark.parametrize("fan", [2, 32])
def test_quiet_periods_over_years(spark, monkeypatch, fan):
    """Stretches of stretches; quiet times of seconds, of days and longer than the gaps; null servers."""
    import random

    from watchloom.operators import quiet

    monkeypatch.setattr(quiet, "FAN", fan)
    rnd = random.Random(fan)
    base = 1704067200
    made = {
        ("a", "dense", 7): [base + k for k in range(0, 90000, 3)],
        ("b", "years", 200_000): [base + rnd.randrange(800 * 86400) for _ in range(3000)],
        ("b", "dense", 90_001): [base + rnd.randrange(100 * 86400) for _ in range(2000)],
        (None, "sparse", 60): [base + k * 40 * 86400 + d for k in range(9) for d in (0, 59, 60, 86399)],
        ("a", "old", 3600): [-86400 * 3 + k * 1800 for k in range(50)],
    }
    rows = [(*k, s) for k, secs in made.items() for s in secs]
    df = spark.createDataFrame(rows, "server string, alert string, quiet int, s long").select("server", "alert", "quiet", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    out = quiet_alerts(df.repartition(3), by=["server"]).select("server", "alert", F.unix_timestamp(F.col("fired_at").cast("timestamp")).alias("s")).collect()
    got = {(r.server, r.alert): [] for r in out}
    for r in out:
        got[r.server, r.alert].append(r.s)
    assert {k: sorted(v) for k, v in got.items()} == {k[:2]: fold(v, k[2]) for k, v in made.items()}
    assert quiet_alerts(df.where("false"), by=["server"]).count() == 0


def test_quiet_period_carries_over(spark):
    df = spark.createDataFrame([("a", 100, datetime(1970, 1, 1, 0, 0, 50)), ("a", 100, datetime(1970, 1, 1, 0, 2, 0))], "alert string, quiet int, ts timestamp_ntz")
    last = spark.createDataFrame([("a", 10)], "alert string, sec long")
    assert [r.fired_at for r in quiet_alerts(df, last).collect()] == [datetime(1970, 1, 1, 0, 2, 0)]


def test_servers_do_not_silence_each_other(spark):
    at = [datetime(2024, 1, 1, 0, 0, s) for s in (0, 10, 20)]
    df = spark.createDataFrame([("A", "x", 60, at[0]), ("B", "x", 60, at[1]), ("A", "x", 60, at[2])], "server string, alert string, quiet int, ts timestamp_ntz")
    assert sorted((r.server, r.fired_at) for r in quiet_alerts(df, by=["server"]).collect()) == [("A", at[0]), ("B", at[1])]


def test_a_value_with_a_marker_stays_text():
    assert fill_markers("a = :ab AND b = ':ab' AND c = :c::int", {"ab": ":c", "c": " OR 1=1 --"}) == "a = ':c' AND b = ':ab' AND c = ' OR 1=1 --'::int"
    assert fill_markers("x = :x", {"x": "it's"}) == "x = 'it''s'"
    with pytest.raises(KeyError):
        fill_markers("x = :y", {})


def test_purge_deletes_stored_rows(spark, tmp_path):
    path = str(tmp_path / "h")
    for day in (1, 5, 9):
        for hour in (3, 12):
            append_snapshot(spark.range(2), path, datetime(2024, 1, day, hour))
    for _ in range(2):
        purge_stored(spark, path, "log_time", 4, datetime(2024, 1, 9, 6))
        left = sorted({(r.log_time.day, r.log_time.hour) for r in spark.read.parquet(path).collect()})
        assert left == [(5, 12), (9, 3), (9, 12)] and not (tmp_path / "h" / "log_date=2024-01-01").exists()
    purge_stored(spark, path, "log_time", 4, datetime(2024, 1, 9, 13))
    assert not (tmp_path / "h" / "log_date=2024-01-05").exists() and spark.read.parquet(path).count() == 4


def test_late_snapshots_come_out_marked(spark, tmp_path):
    from watchloom.streaming.jobs import delta_writer

    write = delta_writer(str(tmp_path / "out"), str(tmp_path / "state"), ["server", "e"], "snap", ["n"])
    batches = [[("A", "x", 1, 10), ("B", "x", 1, 5), ("A", "x", 2, 13)], [("A", "x", 2, 11), ("A", "x", 3, 12), ("B", None, 3, 7)]]
    for k, rows in enumerate(batches):
        for _ in range(2):  # a replay changes nothing
            write(spark.createDataFrame(rows, "server string, e string, snap long, n long"), k)
    write(spark.createDataFrame([], "server string, e string, snap long, n long"), 2)
    assert sorted(p.name for p in (tmp_path / "state").glob("batch_id=*")) == ["batch_id=1", "batch_id=2"]
    got = sorted(((r.server, r.e, r.snap, r.n, r.is_late, r.is_reset) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == sorted([("A", "x", 1, 10, False, False), ("A", "x", 2, 3, False, False), ("B", "x", 1, 5, False, False), ("A", "x", 2, None, True, False), ("A", "x", 3, -1, False, True), ("B", None, 3, 7, False, False)], key=repr)


class FakeSession:
    """Only what ``scratch_root`` looks at."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"fake-{master}"})()


def test_scratch_follows_the_cluster_setting(spark):
    assert W.scratch_root(FakeSession("yarn", "hdfs://nn/shared/")) == "hdfs://nn/shared"
    assert W.scratch_root(FakeSession("local[2]", "/mnt/shared")) == "/mnt/shared"
    with pytest.raises(RuntimeError):
        W.scratch_root(FakeSession("yarn"))
    private = W.scratch_root(FakeSession("local[2]"))
    assert private == W.scratch_root(FakeSession("local[2]"))


def test_materialised_tables_live_in_the_scratch_folder(spark):
    df, n, path = W.materialize_counted(spark.range(7), "t")
    assert n == 7 and df.count() == 7 and path.startswith(f"{W.scratch_root(spark)}/watchloom-{spark.sparkContext.applicationId}/t-")
    assert "LogicalRDD" not in df._jdf.queryExecution().optimizedPlan().toString()
