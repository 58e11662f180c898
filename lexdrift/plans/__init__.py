from lexdrift.plans.html_report import html_rows, html_summary, write_html_report
from lexdrift.plans.jobs import CompareResult, compare_dump, compare_parquet, compare_source
from lexdrift.plans.options import CompareOptions
from lexdrift.plans.plugins import ArticleSource, Report
from lexdrift.plans.text_report import body_lines, frame_lines, write_text_report

__all__ = [
    "ArticleSource",
    "CompareOptions",
    "CompareResult",
    "Report",
    "body_lines",
    "compare_dump",
    "compare_parquet",
    "compare_source",
    "frame_lines",
    "html_rows",
    "html_summary",
    "write_html_report",
    "write_text_report",
]
