from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lexdrift.functions.render import timestamp_text
from lexdrift.operators import RunInfo, differing, failed, preview, run_summary
from lexdrift.operators.compare import (
    difference_types,
    facet_differences,
    has_difference,
    skipped_flag,
)
from lexdrift.plans import body_lines, frame_lines, html_rows, html_summary
from lexdrift.plans.text_report import write_text_report
from lexdrift.plans.html_report import write_html_report

RESULT = "struct<total_cost:bigint,terms:array<string>,pos:array<string>>"
PAIR = f"struct<title:{RESULT},text:{RESULT}>"
SCHEMA = f"n bigint, title string, text string, old {PAIR}, new {PAIR}, error string"


def both(cost=100, term="単語", pos="名詞", terms=None):
    result = (cost, terms or [term], [pos])
    return (result, result)


def pair(title, text):
    return (title, text)


def records(spark, *rows):
    """Rows of (title, text, old, new[, error]) with the comparison columns added."""
    data = [(n, *(r if len(r) == 5 else (*r, None))) for n, r in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    seq = F.struct(F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"),
                   F.col("n").alias("idx")).alias("seq")
    ok = F.col("error").isNull()
    return df.select(seq, "*").repartition(3).select(
        "*",
        F.when(ok, skipped_flag()).otherwise(0).alias("skipped"),
        has_difference().alias("has_difference"),
        F.when(ok, difference_types()).otherwise(F.array().cast("array<string>")).alias("diff_types"),
    )


def one(spark, old, new, title="川の名前", text="山から海へ"):
    return records(spark, (title, text, old, new)).collect()[0]


def lines(df):
    rows = body_lines(df).collect()
    return [r["line"] for r in sorted(rows, key=lambda r: (r["seq"], r["line_no"]))]


def test_cost_only(spark):
    row = one(spark, both(100), both(200))
    assert row["has_difference"] and row["diff_types"] == ["cost", "cost"]


def test_distinct_types(spark):
    df = records(spark, ("t", "x", both(100), both(200)))
    assert df.select(difference_types(distinct=True).alias("d")).collect()[0]["d"] == ["cost"]


def test_terms_only(spark):
    assert one(spark, both(term="川"), both(term="河"))["diff_types"] == ["term"]


def test_pos_only(spark):
    assert one(spark, both(pos="名詞"), both(pos="動詞"))["diff_types"] == ["pos"]


def test_order_of_first_appearance(spark):
    title = ((1, ["a"], ["n"]), (1, ["a"], ["v"]))
    text = ((1, ["a"], ["n"]), (2, ["b"], ["n"]))
    row = one(spark, pair(title[0], text[0]), pair(title[1], text[1]))
    assert row["diff_types"] == ["pos", "cost", "term"]


def test_equal(spark):
    row = one(spark, both(), both())
    assert not row["has_difference"] and row["diff_types"] == []


def test_order_matters(spark):
    assert one(spark, both(terms=["a", "b"]), both(terms=["b", "a"]))["has_difference"]


def test_facets(spark):
    same = (1, ["a"], ["n"])
    df = records(spark, ("t", "x", pair(same, same), pair((2, ["a"], ["n"]), (1, ["b"], ["n"]))))
    row = df.select(*[c.alias(n) for n, c in facet_differences().items()]).collect()[0]
    assert row.asDict() == {
        "title_cost": True, "title_term": False, "title_pos": False,
        "text_cost": False, "text_term": True, "text_pos": False,
    }


def mixed(spark):
    rows = [("t", "x", both(), both())] * 5
    rows += [(None, "", both(), both()), ("", None, both(), both())]
    rows += [(f"d{n}", "x", both(1), both(2)) for n in range(3)]
    rows += [("f", "x", None, None, "boom")]
    return records(spark, *rows)


INFO = RunInfo(
    "old-1", "new-2", "/in", "XML", 10,
    datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2, 3, 5, 6),
    ("a.jar", "b.jar"), ("c<d",),
)


def test_run_summary(spark):
    row = run_summary(mixed(spark), INFO).collect()[0]
    assert (row["total_processed"], row["difference_count"], row["match_count"]) == (10, 3, 7)
    assert (row["skipped_count"], row["failed_count"]) == (2, 1)
    assert row["diff_rate"] == pytest.approx(30.0) and row["match_rate"] == pytest.approx(70.0)
    assert row["duration_ms"] == 61000
    assert row["start_time"] == INFO.start_time


def test_run_summary_of_nothing(spark):
    row = run_summary(mixed(spark).filter("n < 0"), INFO).collect()[0]
    assert row["total_processed"] == 0 and row["diff_rate"] == 0 and row["match_rate"] == 0


def test_split_by_outcome(spark):
    df = mixed(spark)
    assert {r["title"] for r in differing(df).collect()} == {"d0", "d1", "d2"}
    assert [r["title"] for r in failed(df).collect()] == ["f"]


def test_preview(spark):
    rows = preview(mixed(spark), 6).collect()
    assert [r["title"] for r in rows] == ["t"] * 5 + [None]
    assert rows[0]["old_terms"] == ["単語"] and rows[0]["new_total_cost"] == 100
    for bad in (0, 11, -1):
        with pytest.raises(ValueError):
            preview(mixed(spark), bad)


def test_text_lines(spark):
    old = pair((100, ["a", "b"], ["n", "n"]), (5, ["x"], ["n"]))
    new = pair((200, ["ab"], ["n", "n"]), (5, ["x"], ["v"]))
    df = records(spark, ("題", "x", old, new), ("same", "x", both(), both()))
    assert lines(df) == [
        "Title: 題",
        "analyze result[cost] is different!!", "  old[100]", "  new[200]",
        "analyze result[termList] is different!!", "  old[[a, b]]", "  new[[ab]]",
        "analyze result[posList] is different!!", "  old[[n]]", "  new[[v]]",
    ]


def test_text_frame(spark):
    rows = frame_lines(run_summary(mixed(spark), INFO)).collect()
    head = [r["line"] for r in sorted(rows, key=lambda r: (r["section"], r["line_no"])) if r["section"] == 0]
    tail = [r["line"] for r in sorted(rows, key=lambda r: (r["section"], r["line_no"])) if r["section"] == 2]
    rule = "=" * 40
    assert head == [
        rule, "実行情報", rule, "実行開始時刻: 2024-01-02 03:04:05",
        "Old JAR/Dir: old-1", "  - a.jar", "  - b.jar", "New JAR/Dir: new-2", "  - c<d",
        "Wikipedia XML: /in", "最大レコード数: 10 (制限あり)", "",
        rule, "差分詳細", rule, "",
    ]
    assert tail == [
        "", rule, "処理結果サマリー", rule, "実行終了時刻: 2024-01-02 03:05:06", "実行時間: 61000 msec",
        "total processed: 10", "falseCounter: 3", "skippedCounter: 2", "failedCounter: 1",
    ]


def test_no_header_when_nothing_was_processed(spark):
    empty = run_summary(mixed(spark).filter("n < 0"), INFO)
    assert {r["section"] for r in frame_lines(empty).collect()} == {2}


def test_timestamp_text(column):
    assert column(timestamp_text, [datetime.datetime(2024, 1, 2, 3, 4, 5, 678000)], "timestamp_ntz") == [
        "2024-01-02 03:04:05"
    ]


def read_parts(path):
    parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    return "".join(p.read_text() for p in parts)


def test_written_text_report(spark, tmp_path):
    df = mixed(spark)
    write_text_report(df, run_summary(df, INFO), str(tmp_path / "r"))
    text = read_parts(tmp_path / "r")
    assert text.startswith("=" * 40 + "\n実行情報\n")
    assert text.endswith("failedCounter: 1\n")
    titles = [line for line in text.splitlines() if line.startswith("Title: ")]
    assert titles == ["Title: d0", "Title: d1", "Title: d2"]
    assert text.index("差分詳細") < text.index("Title: d0") < text.index("Title: d2") < text.index("処理結果サマリー")


def test_html_rows(spark):
    text = "<b>" + "y" * 600
    rows = [("s", "x", both(), both()), ("A & B", text, both(1), both(2)), ("C", "", both(1), both(1, term="z"))]
    got = sorted(html_rows(records(spark, *rows)).collect(), key=lambda r: r["row_no"])
    assert [r["row_no"] for r in got] == [1, 2]
    first, second = got[0]["html"], got[1]["html"]
    assert '<tr id="row-1">' in first and "<td>A &amp; B</td>" in first
    assert first.count('<span class="diff-type cost">COST</span>') == 2
    assert "&lt;b&gt;" + "y" * 497 + "...(省略)</div>" in first
    assert "元テキスト" not in second and '<span class="diff-type term">TERM</span>' in second
    assert '<div class="result-value">[z]</div>' in second
    assert first.count("Total Cost:") == 4


def test_html_summary(spark):
    row = html_summary(run_summary(mixed(spark), INFO)).collect()[0]
    assert "<th>実行時間</th><td>1分1秒 (61000 ms)</td>" in row["info"]
    assert "<li>c&lt;d</li>" in row["info"] and "Old JAR files (2 files)" in row["info"]
    assert "<th>Wikipedia XML</th><td>/in</td>" in row["info"]
    assert '<div class="number">10</div>' in row["cards"]
    assert "30.00%" in row["cards"] and "70.00%" in row["cards"]
    assert "差分詳細 (3件)" in row["details"]


def test_html_without_differences(spark):
    df = mixed(spark).filter("not has_difference")
    row = html_summary(run_summary(df, INFO)).collect()[0]
    assert "差分詳細 (0件)" in row["details"] and "差分はありません。" in row["details"]


def test_written_html_report(spark, tmp_path):
    df = mixed(spark)
    write_html_report(df, run_summary(df, INFO), str(tmp_path / "h"))
    html = read_parts(tmp_path / "h")
    assert html.index("実行情報") < html.index("<tbody>") < html.index('id="row-1"')
    assert html.index('id="row-1"') < html.index('id="row-2"') < html.index('id="row-3"') < html.index("</tbody>")
    assert "\n\n" not in html
