"""Alert rules: thresholds with a quiet period, and error-code / severity alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.times import ntz
from watchloom.operators.quiet import fires
from watchloom.sources.alerts import alert_rows

# Fixed values: (alert, metric, comparison, bound, quiet seconds).
METRIC_ALERTS = [
    ("HighTransactions", "General Statistics|Transactions", ">", 40.0, 180),
    ("HighUserConnections", "General Statistics|User Connections", ">", 600.0, 300),
    ("LowCacheHitRatio", "Buffer Manager|Buffer cache hit ratio", "<", 0.9, 60),
    ("OpenedTransaction", "Transactions|Longest Transaction Running Time", ">", 600.0, 300),
    ("WaitingTasks", "User Settable|Query|User counter 1", ">", 15.0, 300),
]
# Error numbers with an alert of their own.
CODE_ALERTS = [
    (825, "ReadRetryRequired"),
    (1205, "Deadlocks"),
    (1480, "AvailabilityRoleChange"),
    (35264, "DataMovementSuspended"),
    (35265, "DataMovementResumed"),
]
# Fatal severities.
SEVERITY_ALERTS = [
    (19, "FatalErrorInResource"),
    (20, "FatalErrorInCurrentProcess"),
    (21, "FatalErrorInDatabaseProcess"),
    (22, "TableIntegritySuspect"),
    (23, "DatabaseIntegritySuspect"),
    (24, "HardwareError"),
    (25, "FatalError"),
]


def breaches(
    samples: DataFrame, spec: list[tuple], metric: str = "metric", value: str = "value", ts: str = "ts", by: list[str] | None = None
) -> DataFrame:
    """(by, alert, quiet, ts) of samples beyond an alert's bound; works on streams."""
    hits = []
    for name, m, op, bound, quiet in spec:
        beyond = F.col(value) > bound if op == ">" else F.col(value) < bound
        hits.append(F.when((F.col(metric) == m) & beyond, F.struct(F.lit(name).alias("alert"), F.lit(quiet).alias("quiet"))))
    fired = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return samples.select(*(by or []), F.inline(fired), F.col(ts).alias("ts"))


def second_of(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp."""
    epoch = ntz("1970-01-01 00:00:00")
    return F.timestamp_diff("SECOND", epoch, F.col(ts) if isinstance(ts, str) else ts)


def time_of(second: str) -> Column:
    """Zone-less timestamp of whole seconds since 1970."""
    return ntz("1970-01-01 00:00:00") + F.make_dt_interval(secs=F.col(second).cast("decimal(18,6)"))


def quiet_alerts(hits: DataFrame, last_fires: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, alert, fired_at): breaches that fire, each followed by the alert's quiet time.

    Alerts are evaluated once a second and per ``by`` (the server), so breaches shrink first to
    distinct seconds, however many rows one alert holds; of different quiet times in one second the
    longest counts. Which seconds fire is found by functions of whole days that are composed over time
    (``operators.quiet``). ``last_fires`` (by, alert, sec) silences breaches still inside an earlier
    quiet time.
    """
    keys = [*(by or []), "alert"]
    always = hits.where("quiet = 0").select(*keys, F.date_trunc("second", "ts").cast("timestamp_ntz").alias("fired_at")).distinct()
    secs = hits.where("quiet > 0").select(*keys, "quiet", second_of("ts").alias("sec")).where("sec IS NOT NULL")
    secs = secs.groupBy(*keys, "sec").agg(F.max("quiet").alias("quiet"))
    if last_fires is not None:
        names = [f"_k{i}" for i in range(len(keys))]
        prior = last_fires.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("sec").alias("_last"))
        same = F.lit(True)
        for k, n in zip(keys, names):
            same = same & F.col(k).eqNullSafe(F.col(n))
        secs = secs.join(prior, same, "left").where(F.col("_last").isNull() | (F.col("sec") >= F.col("_last") + F.col("quiet"))).drop("_last", *names)
    return fires(secs, keys).select(*keys, time_of("sec").alias("fired_at")).unionByName(always)


def code_alerts(
    errors: DataFrame, error: str, severity: str, text: str, ts: str, instance: str, codes: list[tuple] | None = None, severities: list[tuple] | None = None
) -> DataFrame:
    """Alert rows for listed error numbers and fatal severities; works on streams.

    The code tables are short literals, so they become a map lookup rather than a join.
    """
    by_code = _lookup(codes if codes is not None else CODE_ALERTS)
    by_severity = _lookup(severities if severities is not None else SEVERITY_ALERTS)
    names = F.array(by_code[F.col(error).cast("int")], by_severity[F.col(severity).cast("int")])
    named = errors.withColumn("_alert", F.explode(F.filter(names, lambda n: n.isNotNull())))
    body = F.concat(F.lit("<message>"), F.col(text), F.lit("</message>"))
    return alert_rows(named.withColumn("_body", body), "_alert", "_body", instance, ts)


def _lookup(pairs: list[tuple]) -> Column:
    if not pairs:
        return F.create_map().cast("map<int,string>")
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])
