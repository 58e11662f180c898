"""Compare jobs: read, clean, analyze with both versions, store, report.

The corpus is read and analyzed once. What comes out is stored as one table with the
flags of every record and the details of the differing ones; counters and both reports
are then made from that table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.operators.analyzers import Analyzer, resolve
from lexdrift.operators.compare import compare, preview
from lexdrift.operators.sequence import limit_records
from lexdrift.operators.summary import RunInfo, run_summary
from lexdrift.plans.options import CompareOptions
from lexdrift.plans.plugins import HTML, TEXT, ArticleSource, Report, resolve_reports
from lexdrift.plans.workspace import stored
from lexdrift.sources import columnar, dump
from lexdrift.sources.audit import require_parquet
from lexdrift.sources.leading import leading_files
from lexdrift.sources.survey import (
    broken_files,
    can_open,
    leading_pages,
    list_files,
    load_survey,
    read_surveyed,
)

XML, PARQUET = "XML", "Parquet"
DETAIL_COLUMNS = ("text", "old", "new")


@dataclass(frozen=True)
class CompareResult:
    """Stored outcome of a run. ``preview``, only for runs of up to 10 records, is a table of
    its own: what ``compared`` holds does not depend on the number of records."""

    compared: DataFrame
    summary: DataFrame
    compared_path: str
    summary_path: str
    text_report_path: str | None
    html_report_path: str | None
    preview: DataFrame | None
    report_paths: dict[str, str] = field(default_factory=dict)


def lean(compared: DataFrame, keep_all: bool = False) -> DataFrame:
    """``compared`` with text and results only where a report needs them; a failed record
    keeps its text, so that the failure can be repeated."""
    if keep_all:
        return compared
    needed = F.col("has_difference") | F.col("error").isNotNull()
    return compared.select(
        *[
            F.when(needed, F.col(c)).alias(c) if c in DETAIL_COLUMNS else c
            for c in compared.columns
        ]
    )


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _run(
    articles: DataFrame,
    options: CompareOptions,
    source_type: str,
    broken: int | None = None,
    reports: list[Report] | None = None,
) -> CompareResult:
    started = _now()
    spark = articles.sparkSession
    root = options.output_path.rstrip("/")
    old, new = resolve(options.old), resolve(options.new)

    counted = F.col("reject").isNull() if "reject" in articles.columns else None
    chosen = limit_records(articles, options.max_records, counted=counted)
    keep_all = options.keep_results == "all"
    compared = compare(chosen, old, new, options.distinct_types, all_results=keep_all)
    compared_path = f"{root}/compared"
    table = stored(lean(compared, keep_all), "compared", compared_path)
    shown = None
    if options.previews:
        whole = compare(chosen, old, new, options.distinct_types)
        shown = stored(preview(whole, options.max_records), "preview", f"{root}/preview")

    info = RunInfo(
        old_analyzer=old.name,
        new_analyzer=new.name,
        old_components=old.components,
        new_components=new.components,
        run_id=uuid4().hex,
        source_path=options.input_path,
        source_type=source_type,
        max_records=options.max_records,
        start_time=started,
        end_time=_now(),
        broken_files=broken,
    )
    summary_path = f"{root}/run_summary"
    summary = stored(run_summary(table, info), "run_summary", summary_path)

    wanted = [r for r in (TEXT, HTML) if options.wants(r.name)] if reports is None else reports
    paths = {r.name: f"{root}/report_{r.name}" for r in wanted}
    for report in wanted:
        report.write(table, summary, paths[report.name])
    return CompareResult(
        compared=table,
        summary=summary,
        compared_path=compared_path,
        summary_path=summary_path,
        text_report_path=paths.get("text"),
        html_report_path=paths.get("html"),
        preview=shown,
        report_paths=paths,
    )


def compare_dump(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    old: Analyzer | str,
    new: Analyzer | str,
    max_records: int = -1,
    report_format: str = "both",
    strict: bool = False,
    distinct_types: bool = False,
    page_tag: str = dump.PAGE_TAG,
    keep_results: str = "differing",
    skip_broken_files: bool = False,
    survey: DataFrame | str | None = None,
) -> CompareResult:
    """Compare two analyzers over a page dump. Empty articles take part.

    Pages that cannot be parsed are rows of ``compared`` with their XML's start in ``reject``
    and are counted in the summary; ``strict`` makes them, and a dump without any page, an error.

    With a ``survey`` of the dump, or the folder of a stored one (:func:`lexdrift.sources.survey.survey_pages`), gzip
    files are read by many tasks, comments and CDATA may span pages, and broken files are counted in
    the summary. A limit reads the dump in growing runs of ranges and stops inside a file; where only Spark
    can open the files it stops behind one."""
    options = CompareOptions(
        old, new, input_path, output_path, max_records, report_format, strict, distinct_types, keep_results
    )

    def read(paths: str | list[str]) -> DataFrame:
        return dump.read_articles(spark, paths, strict, page_tag, skip_broken_files, keep_rejects=True)

    def finish(pages: DataFrame) -> DataFrame:
        return dump.articles_of_pages(pages, strict, page_tag, keep_rejects=True)

    counted, salvage, broken = F.col("reject").isNull(), skip_broken_files and not strict, None
    if survey is not None:
        survey = load_survey(spark, survey) if isinstance(survey, str) else survey
        broken = broken_files(survey).count()
        articles = finish(read_surveyed(survey, page_tag, salvage))
    elif max_records != -1:
        files = [(r["file"], r["size"]) for r in list_files(spark, input_path).collect()]
        if files and can_open(min(files)[0]):
            articles, seen = leading_pages(
                spark, files, max_records, finish, counted, page_tag, skip_broken_files=salvage
            )
            broken = broken_files(seen).count()
        else:
            names = spark.read.text(input_path).inputFiles()
            articles = read(leading_files(read, names, max_records, counted) or input_path)
    else:
        articles = read(input_path)
    result = _run(articles, options, XML, broken)
    if strict:
        counts = result.summary.select("total_processed", "failed_count").head()
        if not sum(counts):
            raise ValueError(f"no <{page_tag}> elements in {input_path}")
    return result


def compare_parquet(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    old: Analyzer | str,
    new: Analyzer | str,
    max_records: int = -1,
    report_format: str = "text",
    strict: bool = False,
    distinct_types: bool = False,
    keep_results: str = "differing",
) -> CompareResult:
    """Compare two analyzers over Parquet articles. Empty articles are left out."""
    options = CompareOptions(
        old, new, input_path, output_path, max_records, report_format, strict, distinct_types, keep_results
    )
    require_parquet(spark, input_path)
    paths = input_path
    if max_records != -1:
        files = spark.read.parquet(input_path).inputFiles()
        paths = leading_files(lambda part: columnar.read_articles(spark, part), files, max_records)
    return _run(columnar.read_articles(spark, paths or input_path), options, PARQUET)


def compare_source(
    spark: SparkSession,
    source: ArticleSource,
    output_path: str,
    old: Analyzer | str,
    new: Analyzer | str,
    max_records: int = -1,
    reports: list[Report | str] | None = None,
    distinct_types: bool = False,
    keep_results: str = "differing",
) -> CompareResult:
    """Compare two analyzers over any source of articles, with any reports (default: the text report). Each report is
    written under its name, ``report_<name>``. Rows of the source are taken as they are."""
    wanted = resolve_reports(["text"] if reports is None else reports)
    options = CompareOptions(
        old, new, source.path or source.name, output_path, max_records, "text", False, distinct_types, keep_results
    )
    return _run(source.articles(spark), options, source.name, reports=wanted)
