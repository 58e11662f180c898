"""Plain text report: run header, differing records in input order, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexdrift.functions.render import list_text, timestamp_text
from lexdrift.operators.analyzers import SLOTS
from lexdrift.operators.compare import differing, differs

HEADER, BODY, SUMMARY = 0, 1, 2

# Report texts.
RULE = "========================================"
RUN_HEADING = "実行情報"
DETAIL_HEADING = "差分詳細"
SUMMARY_HEADING = "処理結果サマリー"
START_LABEL = "実行開始時刻: "
END_LABEL = "実行終了時刻: "
OLD_LABEL = "Old JAR/Dir: "
NEW_LABEL = "New JAR/Dir: "
COMPONENT_PREFIX = "  - "
SOURCE_LABELS = {"XML": "Wikipedia XML: ", "Parquet": "Wiki40b Parquet: "}
LIMIT_LABEL = "最大レコード数: "
LIMITED = " (制限あり)"
UNLIMITED = "全件処理"
DURATION_LABEL = "実行時間: "
DURATION_UNIT = " msec"
TOTAL_LABEL = "total processed: "
DIFFERENT_LABEL = "falseCounter: "
SKIPPED_LABEL = "skippedCounter: "
FAILED_LABEL = "failedCounter: "
TITLE_LABEL = "Title: "
FACET_MESSAGES = {
    "cost": "analyze result[cost] is different!!",
    "term": "analyze result[termList] is different!!",
    "pos": "analyze result[posList] is different!!",
}


def _facet_text(version: str, slot: str, facet: str) -> Column:
    result = F.col(f"{version}.{slot}")
    value = {
        "cost": result["total_cost"].cast("string"),
        "term": list_text(result["terms"]),
        "pos": list_text(result["pos"]),
    }[facet]
    return F.concat(F.lit(f"  {version}["), value, F.lit("]"))


def record_lines() -> Column:
    """Lines of one differing record: its title, then three lines per differing facet."""
    none = F.array().cast("array<string>")
    blocks = [F.array(F.concat(F.lit(TITLE_LABEL), F.coalesce("title", F.lit("null"))))]
    for slot in SLOTS:
        for facet, message in FACET_MESSAGES.items():
            lines = F.array(
                F.lit(message), _facet_text("old", slot, facet), _facet_text("new", slot, facet)
            )
            blocks.append(F.when(differs(slot, facet), lines).otherwise(none))
    return F.concat(*blocks)


def _when_set(condition: Column, *lines: Column) -> Column:
    return F.when(condition, F.array(*lines)).otherwise(F.array().cast("array<string>"))


def limit_text() -> Column:
    limit = F.col("max_records")
    return F.when(
        limit > 0, F.concat(limit.cast("string"), F.lit(LIMITED))
    ).otherwise(F.lit(UNLIMITED))


def source_label(labels: dict[str, str]) -> Column:
    return F.when(F.col("source_type") == "Parquet", labels["Parquet"]).otherwise(labels["XML"])


def header_lines() -> Column:
    """Run information and the heading of the details; none when nothing was processed."""
    def components(name: str) -> Column:
        return F.transform(name, lambda c: F.concat(F.lit(COMPONENT_PREFIX), c))

    def heading(text: str) -> Column:
        return F.array(F.lit(RULE), F.lit(text), F.lit(RULE))

    lines = F.concat(
        heading(RUN_HEADING),
        _when_set(
            F.col("start_time").isNotNull(),
            F.concat(F.lit(START_LABEL), timestamp_text(F.col("start_time"))),
        ),
        F.array(F.concat(F.lit(OLD_LABEL), "old_analyzer")),
        components("old_components"),
        F.array(F.concat(F.lit(NEW_LABEL), "new_analyzer")),
        components("new_components"),
        F.array(
            F.concat(source_label(SOURCE_LABELS), "source_path"),
            F.concat(F.lit(LIMIT_LABEL), limit_text()),
            F.lit(""),
        ),
        heading(DETAIL_HEADING),
        F.array(F.lit("")),
    )
    return F.when(F.col("total_processed") > 0, lines).otherwise(
        F.array().cast("array<string>")
    )


def summary_lines() -> Column:
    def counter(label: str, name: str) -> Column:
        return F.concat(F.lit(label), F.col(name).cast("string"))

    return F.concat(
        F.array(F.lit(""), F.lit(RULE), F.lit(SUMMARY_HEADING), F.lit(RULE)),
        _when_set(
            F.col("end_time").isNotNull(),
            F.concat(F.lit(END_LABEL), timestamp_text(F.col("end_time"))),
        ),
        _when_set(
            F.col("duration_ms") > 0,
            F.concat(
                F.lit(DURATION_LABEL), F.col("duration_ms").cast("string"), F.lit(DURATION_UNIT)
            ),
        ),
        F.array(
            counter(TOTAL_LABEL, "total_processed"),
            counter(DIFFERENT_LABEL, "difference_count"),
            counter(SKIPPED_LABEL, "skipped_count"),
            counter(FAILED_LABEL, "failed_count"),
        ),
    )


def body_lines(compared: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``(seq, line_no, line)`` of the differing records, unsorted."""
    keys = ["seq"] if carry is None else carry
    return differing(compared).select(*keys, F.posexplode(record_lines()).alias("line_no", "line"))


def frame_lines(summary: DataFrame) -> DataFrame:
    """``(section, line_no, line)`` of the header and the summary."""
    parts = [
        summary.select(F.lit(section).alias("section"), F.posexplode(lines).alias("line_no", "line"))
        for section, lines in ((HEADER, header_lines()), (SUMMARY, summary_lines()))
    ]
    return parts[0].unionByName(parts[1])


def text_lines(compared: DataFrame, summary: DataFrame) -> DataFrame:
    """The report, one line per row, in order.

    Records are sorted, then turned to lines: the sort moves no lines, and its
    sampling pass formats none. Header and summary stand before and behind as parts of
    their own."""
    body = differing(compared).orderBy("seq").select(F.explode(record_lines()).alias("value"))
    head = summary.select(F.explode(header_lines()).alias("value"))
    tail = summary.select(F.explode(summary_lines()).alias("value"))
    return head.union(body).union(tail)


def write_text_report(compared: DataFrame, summary: DataFrame, path: str) -> None:
    """The report as part files that follow each other."""
    text_lines(compared, summary).write.text(path)
