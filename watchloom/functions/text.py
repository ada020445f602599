"""Text expressions and text jobs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_pattern(text: str) -> str:
    """A regex matching ``text`` itself."""
    return "\\Q" + text + "\\E" if "\\E" not in text else re.escape(text)


def strip_chars(df: DataFrame, col: str, char_class: str, out: str = "stripped", removed: str = "removed") -> DataFrame:
    """Delete every character of a bracket class (``^a-z`` keeps letters), ignoring case."""
    clean = F.regexp_replace(F.col(col), f"(?i)[{char_class}]", "")
    return df.withColumn(out, clean).withColumn(removed, F.length(col) - F.length(out))


def split_rows(df: DataFrame, col: str, delimiter: str, out: str = "parameter", position: str = "position") -> DataFrame:
    """One row per piece with its 1-based position; empty pieces stay, nothing is trimmed."""
    pieces = F.split(F.col(col), F.lit(literal_pattern(delimiter)), -1)
    return df.select("*", F.posexplode(pieces).alias("_pos", out)).withColumn(position, F.col("_pos") + 1).drop("_pos")


def tags(col: str | Column) -> Column:
    """Non-blank pieces of a comma-separated tag list."""
    return F.filter(F.split(_col(col), ","), lambda t: F.length(F.trim(t)) > 0)


def has_any_tag(col: str | Column, wanted: list[str]) -> Column:
    keep = [w for w in wanted if w.strip()]
    if not keep:
        return F.lit(False)
    return F.arrays_overlap(tags(col), F.array(*[F.lit(w) for w in keep]))


def match_tags(df: DataFrame, tags_col: str, wanted: list[str]) -> DataFrame:
    """Rows carrying any wanted tag: no explode, so no duplicates to remove."""
    return df.where(has_any_tag(tags_col, wanted))


def slice_statement(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """Part of a statement between UTF-16 byte offsets; end -1 means to the end of the text."""
    text, start, end = _col(text), _col(start), _col(end)
    stop = F.when(end == -1, F.length(text) * 2).otherwise(end)
    first = F.floor(start / 2).cast("int") + 1
    size = F.floor((stop - start) / 2).cast("int") + 1
    return F.substr(text, first, size)


def file_name(path: str | Column) -> Column:
    """Text after the last slash or backslash."""
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def folder_name(path: str | Column) -> Column:
    """Text up to and including the last slash or backslash."""
    return F.regexp_extract(_col(path), r"^(.*[/\\])?[^/\\]*$", 1)


def file_extension(path: str | Column) -> Column:
    """Text after the last dot, null when there is none."""
    return F.when(F.instr(_col(path), ".") > 0, F.regexp_extract(_col(path), r"([^.]*)$", 1))


def extract_refs(df: DataFrame, content: str, marker: str, name_pattern: str, out: str = "ref_name") -> DataFrame:
    """Names found on the lines of a text that contain ``marker`` (case-insensitive).

    The lines are filtered inside the array, so only matching lines become rows.
    """
    lines = F.filter(F.split(F.col(content), "\n"), lambda s: F.contains(F.lower(s), F.lit(marker.lower())))
    names = F.transform(lines, lambda s: F.regexp_replace(F.regexp_extract(s, name_pattern, 1), "[\r\n]", ""))
    return df.withColumn(out, F.explode(F.filter(names, lambda s: F.length(s) > 0)))


def extract_matches(df: DataFrame, content: str, pattern: str, out: str = "ref_name", group: int = 1) -> DataFrame:
    """Every match of a pattern in a text, one row each with its position."""
    found = F.regexp_extract_all(F.col(content), F.lit(pattern), group)
    return df.select("*", F.posexplode(found).alias("ref_no", out))


def extract_log_fields(df: DataFrame, specs: dict[str, str], text: str = "text") -> DataFrame:
    """Named first-group captures of a log line; no match gives null."""
    cols = {}
    for name, pattern in specs.items():
        cols[name] = F.when(F.col(text).rlike(pattern), F.trim(F.regexp_extract(F.col(text), pattern, 1)))
    return df.withColumns(cols)


def extent_pages(col: str | Column) -> Column:
    """Pages of one ``(file:first) - (file:last)`` range; a range names extents of eight pages."""
    c = _col(col)
    first = F.regexp_extract(c, r"^[^:]*:\s*([0-9]+)", 1).try_cast("long")
    last = F.regexp_extract(c, r"^[^)]*\)[^:]*:\s*([0-9]+)", 1).try_cast("long")
    return F.coalesce(last, first) + 7 - first + 1


def render_template(df: DataFrame, template: str, values: dict[str, Column], registry: list[str], out: str = "rendered") -> DataFrame:
    """Replace each registered ``{%NAME%}`` token; registered names without a value become ''.

    As with nested ``replace``, a null value makes the result null, but only when its token
    occurs in the template.
    """
    text, lost = F.col(template), F.lit(False)
    for name in registry:
        token = F.lit("{%" + name + "%}")
        value = values.get(name, F.lit("")).cast("string")
        # the running text is used once per step, so the expression grows linearly
        text = F.replace(text, token, F.coalesce(value, F.lit("")))
        if name in values:
            lost = lost | (value.isNull() & F.contains(F.col(template), token))
    return df.withColumn(out, F.when(~lost, text))


def code_label(col: str | Column, labels: dict, default: str | None = None) -> Column:
    out = None
    for code, label in labels.items():
        out = F.when(_col(col) == code, label) if out is None else out.when(_col(col) == code, label)
    return out.otherwise(default) if default is not None else out
