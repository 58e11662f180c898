"""HTML report content: run information, summary cards, differing records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexdrift.functions.render import (
    duration_text,
    excerpt_cut,
    excerpt_mark,
    html_escape,
    list_text,
    percent_text,
    timestamp_text,
)
from lexdrift.functions.text import is_blank
from lexdrift.operators.analyzers import SLOTS
from lexdrift.operators.compare import differing
from lexdrift.operators.sequence import with_ordinal
from lexdrift.plans.text_report import limit_text, source_label

# Report markup. {name} marks a value.
INFO_START = """\
    <div class="info-section">
      <h2>実行情報</h2>
      <table class="info-table">
"""
INFO_ROW = """\
        <tr><th>{label}</th><td>{value}</td></tr>
"""
INFO_COMPONENTS = (
    '        <tr><td colspan="2"><details><summary>{label} files ({count} files)</summary>'
    '<ul class="jar-list">{items}</ul></details></td></tr>\n'
)
INFO_COMPONENT = "<li>{name}</li>"
INFO_END = """\
      </table>
    </div>
"""
START_LABEL = "実行開始時刻"
END_LABEL = "実行終了時刻"
DURATION_LABEL = "実行時間"
OLD_LABEL = "Old JAR/Dir"
NEW_LABEL = "New JAR/Dir"
OLD_COMPONENTS_LABEL = "Old JAR"
NEW_COMPONENTS_LABEL = "New JAR"
SOURCE_LABELS = {"XML": "Wikipedia XML", "Parquet": "Wiki40b Parquet"}
LIMIT_LABEL = "最大レコード数"
CARDS = """\
    <h2>処理結果サマリー</h2>
    <div class="summary-section">
      <div class="summary-card info">
        <div class="label">総処理数</div>
        <div class="number">{total}</div>
      </div>
      <div class="summary-card warning">
        <div class="label">差分あり</div>
        <div class="number">{different}</div>
        <div class="label">{diff_rate}</div>
      </div>
      <div class="summary-card success">
        <div class="label">一致</div>
        <div class="number">{match}</div>
        <div class="label">{match_rate}</div>
      </div>
      <div class="summary-card info">
        <div class="label">スキップ</div>
        <div class="number">{skipped}</div>
      </div>
      <div class="summary-card warning">
        <div class="label">失敗</div>
        <div class="number">{failed}</div>
      </div>
    </div>
"""
DETAIL_HEADING = """\
    <h2>差分詳細 ({different}件)</h2>
"""
NO_DIFFERENCE = """\
    <p>差分はありません。</p>
"""
TABLE_START = """\
    <table class="diff-table">
      <thead>
        <tr>
          <th style="width: 50px;">#</th>
          <th>タイトル</th>
          <th style="width: 200px;">差分タイプ</th>
          <th style="width: 100px;">詳細</th>
        </tr>
      </thead>
      <tbody>
"""
TABLE_END = """\
      </tbody>
    </table>
"""
RECORD = """\
        <tr id="row-{no}">
          <td>{no}</td>
          <td>{title}</td>
          <td>{badges}</td>
          <td><span class="toggle-detail" onclick="toggleDetail('detail-{no}')">表示/非表示</span></td>
        </tr>
        <tr id="detail-{no}" class="detail-row">
          <td colspan="4">
            <div class="comparison">
              <div class="comparison-panel old-panel">
                <h4>OLD</h4>
{old}              </div>
              <div class="comparison-panel new-panel">
                <h4>NEW</h4>
{new}              </div>
            </div>
{source}          </td>
        </tr>
"""
BADGE = '<span class="diff-type {type}">{label}</span> '
RESULT = """\
                <div class="result-item">
                  <div class="result-label">Terms:</div>
                  <div class="result-value">{terms}</div>
                </div>
                <div class="result-item">
                  <div class="result-label">POS:</div>
                  <div class="result-value">{pos}</div>
                </div>
                <div class="result-item">
                  <div class="result-label">Total Cost:</div>
                  <div class="result-value">{cost}</div>
                </div>
"""
SOURCE_TEXT = (
    '            <details style="margin-top: 15px;">\n'
    "              <summary>元テキスト</summary>\n"
    '              <div style="padding: 10px; background: #f9f9f9; margin-top: 10px; '
    'white-space: pre-wrap; font-size: 13px;">{excerpt}{mark}</div>\n'
    "            </details>\n"
)


def fill(template: str, **values: Column) -> Column:
    """A template as one string expression."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[
            values[part].cast("string") if n % 2 else F.lit(part)
            for n, part in enumerate(parts)
            if n % 2 or part
        ]
    )


def _results(version: str) -> Column:
    blocks = []
    for slot in SLOTS:
        result = F.col(f"{version}.{slot}")
        blocks.append(
            fill(
                RESULT,
                terms=html_escape(list_text(result["terms"])),
                pos=html_escape(list_text(result["pos"])),
                cost=result["total_cost"],
            )
        )
    return F.concat(*blocks)


def record_html(number: str = "row_no") -> Column:
    """Both table rows of one differing record."""
    badges = F.array_join(
        F.transform("diff_types", lambda t: fill(BADGE, type=t, label=F.upper(t))), ""
    )
    text = F.col("text")
    source = F.when(is_blank(text), F.lit("")).otherwise(
        fill(SOURCE_TEXT, excerpt=html_escape(excerpt_cut(text)), mark=excerpt_mark(text))
    )
    return fill(
        RECORD,
        no=F.col(number),
        title=html_escape(F.col("title")),
        badges=badges,
        old=_results("old"),
        new=_results("new"),
        source=source,
    )


def html_rows(compared: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``(seq, row_no, html)`` of the differing records, numbered in input order.

    Reads ``compared`` twice: pass the stored table of a run."""
    keys = ["seq"] if carry is None else carry
    numbered = with_ordinal(differing(compared), "row_no")
    return numbered.select(*keys, "row_no", record_html().alias("html"))


def info_html() -> Column:
    """Run information table over a run summary row."""
    def row(label: Column, value: Column) -> Column:
        return fill(INFO_ROW, label=label, value=value)

    def optional(condition: Column, html: Column) -> Column:
        return F.when(condition, html).otherwise(F.lit(""))

    def components(label: str, name: str) -> Column:
        items = F.array_join(
            F.transform(name, lambda c: fill(INFO_COMPONENT, name=html_escape(c))), ""
        )
        return optional(
            F.size(name) > 0,
            fill(INFO_COMPONENTS, label=F.lit(label), count=F.size(name), items=items),
        )

    start, end, ms = F.col("start_time"), F.col("end_time"), F.col("duration_ms")
    return F.concat(
        F.lit(INFO_START),
        optional(start.isNotNull(), row(F.lit(START_LABEL), timestamp_text(start))),
        optional(end.isNotNull(), row(F.lit(END_LABEL), timestamp_text(end))),
        optional(ms > 0, row(F.lit(DURATION_LABEL), duration_text(ms))),
        row(F.lit(OLD_LABEL), html_escape(F.col("old_analyzer"))),
        components(OLD_COMPONENTS_LABEL, "old_components"),
        row(F.lit(NEW_LABEL), html_escape(F.col("new_analyzer"))),
        components(NEW_COMPONENTS_LABEL, "new_components"),
        row(source_label(SOURCE_LABELS), html_escape(F.col("source_path"))),
        row(F.lit(LIMIT_LABEL), html_escape(limit_text())),
        F.lit(INFO_END),
    )


def cards_html() -> Column:
    """Summary cards over a run summary row."""
    return fill(
        CARDS,
        total=F.col("total_processed"),
        different=F.col("difference_count"),
        diff_rate=percent_text(F.col("diff_rate")),
        match=F.col("match_count"),
        match_rate=percent_text(F.col("match_rate")),
        skipped=F.col("skipped_count"),
        failed=F.col("failed_count"),
    )


def details_heading_html() -> Column:
    """Heading of the details, and the message when there are none."""
    heading = fill(DETAIL_HEADING, different=F.col("difference_count"))
    return F.when(F.col("difference_count") > 0, heading).otherwise(
        F.concat(heading, F.lit(NO_DIFFERENCE))
    )


def html_summary(summary: DataFrame) -> DataFrame:
    """``(info, cards, details)`` for one run."""
    return summary.select(
        info_html().alias("info"),
        cards_html().alias("cards"),
        details_heading_html().alias("details"),
    )


def html_lines(compared: DataFrame, summary: DataFrame) -> DataFrame:
    """The report content, piece by piece in order."""
    any_difference = F.col("difference_count") > 0
    head = summary.select(
        F.concat(
            info_html(),
            cards_html(),
            details_heading_html(),
            F.when(any_difference, F.lit(TABLE_START)).otherwise(F.lit("")),
        ).alias("value")
    )
    # Sorted before formatting, so that the sampling pass of the sort formats nothing.
    numbered = with_ordinal(differing(compared), "row_no").orderBy("row_no")
    rows = numbered.select(record_html().alias("value"))
    tail = summary.filter(any_difference).select(F.lit(TABLE_END).alias("value"))
    # Every piece ends with a line end, which the text sink adds itself.
    pieces = head.union(rows).union(tail)
    return pieces.select(F.left("value", F.length("value") - 1).alias("value"))


def write_html_report(compared: DataFrame, summary: DataFrame, path: str) -> None:
    """The report content as part files that follow each other."""
    html_lines(compared, summary).write.text(path)
