"""Keyed state of streams: restarts, late rows, odd keys, expiry."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from watchloom.operators.alerting import breaches, quiet_alerts
from watchloom.streaming import jobs as J
from watchloom.streaming.stateful import counter_growth, quiet_period_alerts, rocksdb_state

START = datetime(2024, 1, 1)


class Feed:
    """A folder that grows slice by slice; each catch-up is a query of its own from the checkpoint."""

    def __init__(self, spark, folder, schema, job):
        self.spark, self.folder, self.schema, self.job = spark, folder, schema, job

    def add(self, rows):
        frame = self.spark.createDataFrame(rows, self.schema)
        frame.write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(frame.schema).parquet(f"{self.folder}/in")
        with rocksdb_state(self.spark):
            J.run_available(self.job(stream), f"{self.folder}/ckpt", f"{self.folder}/out")
        return self

    def rows(self):
        return sorted((tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").collect()), key=repr)


def test_growth_survives_restarts_and_marks_late_rows(spark, tmp_path):
    day = [START + timedelta(days=d) for d in range(40)]
    job = lambda s: counter_growth(s, ["server", "e"], "snap", "ts", ["n", "m"], "1 hour", idle_days=20)
    feed = Feed(spark, str(tmp_path), "server string, e date, snap string, ts timestamp_ntz, n long, m long", job)
    big, e = 2**62 + 1, START.date()
    # Rows out of order inside a slice; a null key; a null counter; numbers that no double holds.
    feed.add([("A", e, "2", day[1], big + 3, None), ("A", e, "1", day[0], big, 4), ("B", None, "1", day[0], 5, 1)])
    feed.add([("A", e, "2", day[1], 1, 1), ("A", e, "3", day[2], 7, 9), ("B", None, "3", day[2], 7, 3), ("A", e, "9", None, 4, 4)])
    feed.add([("A", e, "1", day[0], 0, 0), ("A", e, "30", day[30], 8, 10), ("B", None, "1", day[1], 0, 0)])
    feed.add([("Z", None, "40", day[39], 0, 0)])
    key = {"A": ("A", e), "B": ("B", None)}
    want = [
        ("A", 1, big, 4, False, False), ("A", 2, 3, None, False, False), ("B", 1, 5, 1, False, False),
        ("A", 9, None, None, False, True), ("A", 3, 7 - big - 3, None, True, False), ("B", 3, 2, 2, False, False),
        ("A", 1, None, None, False, True), ("B", 1, None, None, False, True),
        ("A", 30, 8, 10, False, False),  # silent for over 20 days: a first snapshot again
        ("A", 2, None, None, False, True),  # a second row of a pending snapshot
    ]
    got = [(r[0], int(r[2]), *r[3:]) for r in feed.rows()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {(r[0], r[1]) for r in feed.rows()} == set(key.values())


@pytest.mark.parametrize("by", [["server"], []])
def test_streamed_fires_equal_the_batch(spark, tmp_path, by):
    """A busy alert, a sparse one, one without quiet time; rows out of order by less than the lateness."""
    rnd = random.Random(len(by))
    spec = [("Hot", "h", ">", 1.0, 300), ("Sparse", "s", "<", 5.0, 90_000), ("Each", "p", ">", 0.0, 0)]
    rows = [(rnd.choice(["a", "b", None]), rnd.choice("hhhhsp"), rnd.random() * 8, START + timedelta(seconds=rnd.randrange(3 * 86400), microseconds=rnd.randrange(10**6))) for _ in range(1500)]
    rows.sort(key=lambda r: (r[3].timestamp() + rnd.randrange(3000)))
    schema = "server string, metric string, value double, ts timestamp_ntz"
    feed = Feed(spark, str(tmp_path), schema, lambda s: quiet_period_alerts(s, spec, "1 hour", by=by))
    for lo in range(0, 1500, 500):
        feed.add(rows[lo : lo + 500])
    late = ("a", "h", 9.0, START)
    feed.add([("a", "none", 0.0, START + timedelta(days=9))]).add([late, late, ("a", "h", 9.0, None)])
    got = feed.rows()
    frame = spark.createDataFrame(rows, schema)
    want = quiet_alerts(breaches(frame, spec, by=by), by=by).select(*by, "alert", "fired_at", F.lit(False))
    assert [r for r in got if not r[-1]] == sorted((tuple(r) for r in want.collect()), key=repr)
    head = ("a",) if by else ()
    assert [r for r in got if r[-1]] == sorted([(*head, "Hot", START, True), (*head, "Hot", None, True)], key=repr)


def test_the_session_setting_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before


def test_keys_in_time_send_no_frame():
    """A key whose rows are all in time asks for its last snapshot once, and sends nothing back."""
    import pandas as pd

    from watchloom.streaming.stateful import _Growth

    calls = []

    class State:
        def get(self):
            calls.append("get")

        def appendList(self, rows):
            calls.append(rows)

        def registerTimer(self, ms):
            calls.append(ms)

        def getCurrentWatermarkInMs(self):
            return 10

    grown = _Growth(None)
    grown.handle = grown.pending = grown.last = State()
    frame = pd.DataFrame({"ms": [30, 20], "snap": ["b", "a"], "counters": ["[2]", "[1]"]})
    assert list(grown.handleInputRows(("k",), iter([frame]), State())) == []
    assert calls == ["get", [(30, "b", "[2]"), (20, "a", "[1]")], 20]
    (late,) = grown.handleInputRows(("k",), iter([pd.DataFrame({"ms": [None, 5, 40], "snap": ["x", "y", "z"], "counters": ["[1]"] * 3})]), State())
    assert late["snap"].tolist() == ["x", "y"] and late["is_late"].all()
