"""Own sources and reports of a compare job.

A source is anything that gives articles: a Spark data source by its format name (also one registered with
``spark.dataSource.register``), or a function. A report is a name and a function that makes lines of
the stored comparison and the summary. Reports are written by Spark's committing text writer, so one that fails
leaves no lines behind, and the others are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.plans.html_report import html_lines
from lexdrift.plans.text_report import text_lines

ARTICLE_COLUMNS = ("id", "title", "title_annotation", "text", "last_modified")
SEQ = "struct<file: string, block: bigint, idx: bigint>"


@dataclass(frozen=True)
class ArticleSource:
    """``read`` gives rows with ``title`` and ``text``, and as far as there are any ``seq`` (a struct of file, block and
    idx, by which reports are ordered), ``id``, ``title_annotation``, ``last_modified`` and ``reject``."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    path: str = ""

    @staticmethod
    def of_format(
        name: str, format: str, path: str | None = None, options: Mapping[str, str] | None = None
    ) -> ArticleSource:
        """A Spark data source whose columns are named as above."""

        def read(spark: SparkSession) -> DataFrame:
            return spark.read.format(format).options(**(options or {})).load(path)

        return ArticleSource(name, read, path or format)

    def articles(self, spark: SparkSession) -> DataFrame:
        """The rows as a job takes them. Without ``seq`` they are numbered as they lie in the splits of the source."""
        rows = self.read(spark)
        missing = {"title", "text"} - set(rows.columns)
        if missing:
            raise ValueError(f"{self.name}: no column {', '.join(sorted(missing))}")
        place = F.monotonically_increasing_id()
        task, idx = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
        numbered = F.struct(F.lit(self.path).alias("file"), task.alias("block"), idx.alias("idx"))
        seq = F.col("seq") if "seq" in rows.columns else numbered

        def column(name: str) -> Column:
            kind = "timestamp_ntz" if name == "last_modified" else "string"
            return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)

        reject = [F.col("reject")] if "reject" in rows.columns else []
        return rows.select(seq.cast(SEQ).alias("seq"), *[column(c) for c in ARTICLE_COLUMNS], *reject)


@dataclass(frozen=True)
class Report:
    """``lines(compared, summary)`` gives a column ``value``, in the order in which lines are to follow each other.
    ``compared`` has texts and results of differing records, of all if the job keeps all."""

    name: str
    lines: Callable[[DataFrame, DataFrame], DataFrame] = field(compare=False)

    def write(self, compared: DataFrame, summary: DataFrame, path: str) -> None:
        lines = self.lines(compared, summary)
        if lines.columns != ["value"]:
            raise ValueError(f"report {self.name}: lines have one column, value")
        lines.write.text(path)


TEXT = Report("text", text_lines)
HTML = Report("html", html_lines)
_REPORTS = {r.name: r for r in (TEXT, HTML)}


def resolve_reports(reports: list[Report | str]) -> list[Report]:
    """Reports by name or as they are; every name once."""
    found = []
    for report in reports:
        if isinstance(report, str) and report not in _REPORTS:
            raise ValueError(f"unknown report {report!r}; built in: {sorted(_REPORTS)}")
        found.append(_REPORTS[report] if isinstance(report, str) else report)
    names = [r.name for r in found]
    if len(set(names)) < len(names):
        raise ValueError(f"reports must have different names: {', '.join(names)}")
    return found
