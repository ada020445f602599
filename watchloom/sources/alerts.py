"""Alert rows and their sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.times import ntz


def alert_rows(df: DataFrame, alert_type: str, alert_text: str, instance: str | Column, alert_time: str | datetime | Column) -> DataFrame:
    """(alert_time, alert_type, alert_text): nulls get placeholders, the instance is prefixed."""
    inst = F.lit(instance) if isinstance(instance, str) else instance
    when = F.col(alert_time) if isinstance(alert_time, str) else ntz(alert_time)
    body = F.coalesce(F.col(alert_text), F.lit("<UNKNOWN/>"))
    return df.select(
        when.alias("alert_time"),
        F.coalesce(F.col(alert_type), F.lit("UNKNOWN")).alias("alert_type"),
        F.concat(F.lit("<instance_name>"), inst, F.lit("</instance_name>\r\n"), body).alias("alert_text"),
    )


def write_alerts(alerts: DataFrame, table_path: str | None = None, console: bool = False) -> DataFrame:
    """Append alert rows to a history path and / or print the newest; returns them either way."""
    if table_path:
        dated = alerts.withColumn("log_date", F.to_date("alert_time"))
        dated.write.mode("append").partitionBy("log_date").parquet(table_path)
    if console:
        alerts.orderBy(F.col("alert_time").desc()).show(truncate=False)
    return alerts
