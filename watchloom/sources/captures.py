"""Readers for exported XML event captures and blocked-process reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.events import EVENT_SCHEMA, data_field, parse_event, parsed_rows

REPORT_SCHEMA = (
    "_monitorLoop string, "
    "`blocked-process` struct<process: struct<_spid: string, _ecid: string, inputbuf: string>>, "
    "`blocking-process` struct<process: struct<_spid: string, _ecid: string, inputbuf: string>>"
)
END_TAG = "</event>"
TRACE_EVENT_SCHEMA = "_name string, Column array<struct<_name: string, _VALUE: string>>"


def event_time(text: Column, offset_min: int = 0) -> Column:
    """Zone-less local time of an ISO UTC event timestamp."""
    utc = F.to_timestamp_ntz(F.regexp_replace(text, "Z$", ""))
    return utc + F.expr(f"INTERVAL '{int(offset_min)}' MINUTE") if offset_min else utc


def _head(xml: str, attribute: str) -> Column:
    """An attribute of the event element, read from the raw text without parsing it."""
    value = F.regexp_extract(F.col(xml), rf"^\s*<event[^>]*\s{attribute}=[\"']([^\"']*)[\"']", 1)
    return F.nullif(value, F.lit(""))


def read_event_capture(
    spark: SparkSession, glob: str, offset_min: int = 0, categories: list[str] | None = None, streaming: bool = False
) -> DataFrame:
    """(log_date, log_ts, category, event) rows of XML capture files, in batch or as a stream.

    Files are read as text records ending in ``</event>``, so one large file is split
    between tasks and unwanted categories are dropped before any XML is parsed. That tag
    inside CDATA would cut an event in two: a first pass over the text finds the files that hold
    an open CDATA at a cut, and those alone are read whole by the XML reader. In a stream such a
    file is an error.
    """
    reader = spark.readStream if streaming else spark.read
    chunks = reader.option("lineSep", END_TAG).text(glob)
    if streaming:
        stop = F.when(_open_cdata("value"), F.raise_error(F.lit("event end tag inside CDATA: read this capture in batch"))).otherwise(F.col("value"))
        return _split_chunks(chunks.withColumn("value", stop), offset_min, categories)
    named = chunks.withColumn("_file", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))
    # names of odd files: a small fact that decides how each file is read
    odd = [r[0] for r in named.where(_open_cdata("value")).select("_file").distinct().collect()]
    if not odd:
        return _split_chunks(chunks, offset_min, categories)
    plain = _split_chunks(named.where(~F.col("_file").isin(odd)), offset_min, categories)
    raw = spark.read.format("xml").option("rowTag", "event").schema(EVENT_SCHEMA).load(odd)
    stamped = raw.select(event_time(F.col("_timestamp"), offset_min).alias("log_ts"), F.col("_name").alias("category"), F.struct("*").alias("event"))
    stamped = stamped.where(F.col("category").isin(list(categories))) if categories else stamped
    return plain.unionByName(stamped.select(F.to_date("log_ts").alias("log_date"), "log_ts", "category", "event"))


def _open_cdata(text: str) -> Column:
    """Whether the text ends inside a CDATA section."""
    rest = F.substring_index(text, "<![CDATA[", -1)
    return F.col(text).contains("<![CDATA[") & ~rest.contains("]]>")


def _split_chunks(chunks: DataFrame, offset_min: int, categories: list[str] | None) -> DataFrame:
    # a chunk is what follows the last end tag: perhaps a prologue or events without
    # content, then one event lacking its end tag
    pieces = F.split(F.concat("value", F.lit(END_TAG)), r"(?=<event[\s/>])")
    events = chunks.select(F.explode(F.filter(pieces, lambda p: p.rlike(r"^<event[\s/>]"))).alias("xml"))
    return capture_from_text(events, "xml", offset_min, categories)


def capture_from_text(df: DataFrame, xml_col: str, offset_min: int = 0, categories: list[str] | None = None) -> DataFrame:
    """The same shape from a text column holding one event per row.

    Category and time come from the raw head of the event: later filters on them, time
    windows above all, run before the one parse of the whole event.
    """
    events = df.select(
        event_time(_head(xml_col, "timestamp"), offset_min).alias("log_ts"), _head(xml_col, "name").alias("category"), F.col(xml_col).alias("_xml")
    )
    if categories:
        events = events.where(F.col("category").isin(list(categories)))
    return events.select(F.to_date("log_ts").alias("log_date"), "log_ts", "category", parse_event("_xml").alias("event"))


def normalise_block_reports(df: DataFrame, kind: str, xml: str = "xml", end_time: str | None = None) -> DataFrame:
    """Blocked-process reports of any origin in one shape; rows lacking either spid are dropped.

    ``kind``: ``table`` or ``file`` (report text plus an end-time column), ``session``
    (captured event around the report) or ``document`` (trace-document event element).
    The monitor loop falls back to the end time, then to the report's own fingerprint
    (``unknown`` for documents).
    """
    if kind in ("table", "file"):
        src = df.select(F.col(xml).alias("_report"), F.col(end_time).cast("timestamp_ntz").alias("end_time"))
    elif kind == "session":
        ev = df.select(parse_event(xml).alias("event"))
        src = ev.select(data_field("event", "blocked_process").alias("_report"), event_time(F.col("event._timestamp")).alias("end_time"))
    elif kind == "document":
        ev = df.select(F.from_xml(F.col(xml), TRACE_EVENT_SCHEMA).alias("e")).where(F.col("e._name") == "Blocked process report")

        def column_text(name):
            return F.get(F.filter(F.col("e.Column"), lambda c: c["_name"] == name), F.lit(0))["_VALUE"]

        src = ev.select(
            column_text("TextData").alias("_report"),
            F.to_timestamp_ntz(F.replace(F.substring(column_text("EndTime"), 1, 19), F.lit("T"), F.lit(" "))).alias("end_time"),
        )
    else:
        raise ValueError(f"unknown report kind {kind!r}")
    side = {s: f"r.`{s}-process`.process" for s in ("blocked", "blocking")}
    last_resort = F.lit("unknown") if kind == "document" else F.md5(F.col("_report").cast("binary"))
    r = src.withColumn("r", F.from_xml(F.col("_report"), REPORT_SCHEMA))
    spids = {
        f"{s}_{part}": F.col(f"{side[s]}._{part}").try_cast("int") for s in ("blocked", "blocking") for part in ("spid", "ecid")
    }
    loop = F.coalesce(F.col("r._monitorLoop"), F.date_format("end_time", "yyyy-MM-dd HH:mm:ss"), last_resort)
    columns = {"monitorloop": loop, "end_time": F.col("end_time"), **spids, "report": F.col("_report")}
    return parsed_rows(r, columns, lambda x: x["blocked_spid"].isNotNull() & x["blocking_spid"].isNotNull())
