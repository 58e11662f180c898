"""Value formatting used by the reports, as ``Column -> Column`` functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report formats.
EXCERPT_LIMIT = 500
EXCERPT_MARK = "...(省略)"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
HOURS_FORMAT = "%d時間%d分%d秒 (%d ms)"
MINUTES_FORMAT = "%d分%d秒 (%d ms)"
SECONDS_FORMAT = "%d秒 (%d ms)"


def html_escape(text: Column) -> Column:
    """Escape the five HTML special characters; NULL becomes empty."""
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#39;"),
    ):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return F.coalesce(text, F.lit(""))


def excerpt_cut(text: Column, limit: int = EXCERPT_LIMIT) -> Column:
    """The first ``limit`` characters."""
    return F.left(text, F.lit(limit))


def excerpt_mark(text: Column, limit: int = EXCERPT_LIMIT) -> Column:
    """The omission mark when the text is longer than ``limit``, else empty."""
    return F.when(F.length(text) > limit, F.lit(EXCERPT_MARK)).otherwise(F.lit(""))


def excerpt(text: Column, limit: int = EXCERPT_LIMIT) -> Column:
    """Text cut to ``limit`` characters with the omission mark; display only."""
    return F.concat(excerpt_cut(text, limit), excerpt_mark(text, limit))


def duration_text(ms: Column) -> Column:
    """Milliseconds as hours, minutes and seconds with the exact value behind."""
    seconds = F.call_function("div", ms, F.lit(1000))
    minutes = F.call_function("div", ms, F.lit(60_000))
    hours = F.call_function("div", ms, F.lit(3_600_000))
    return (
        F.when(
            hours > 0,
            F.format_string(HOURS_FORMAT, hours, minutes % 60, seconds % 60, ms),
        )
        .when(minutes > 0, F.format_string(MINUTES_FORMAT, minutes, seconds % 60, ms))
        .otherwise(F.format_string(SECONDS_FORMAT, seconds, ms))
    )


def percent_text(rate: Column) -> Column:
    """Two decimals and a percent sign."""
    return F.format_string("%.2f%%", rate)


def list_text(items: Column) -> Column:
    """``[a, b]``."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, TIMESTAMP_FORMAT)
