"""Own sources and reports of a job."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexdrift import BASIC_1, BASIC_2, ArticleSource, Report, compare_source


def verses():
    """A data source in Python: so many articles, cut into parts. Made here, so that it travels with the job."""

    class Reader(DataSourceReader):
        def __init__(self, n):
            self.n = n

        def partitions(self):
            return [InputPartition(k) for k in range(3)]

        def read(self, partition):
            for k in range(partition.value, self.n, 3):
                yield f"t{k}", "same" if k % 2 else f"x{k}", k

    class Verses(DataSource):
        @classmethod
        def name(cls):
            return "verses"

        def schema(self):
            return "title string, text string, id int"

        def reader(self, schema):
            return Reader(int(self.options["n"]))

    return Verses


def files_of(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if not f.startswith((".", "_")))


def ids_report(compared, summary):
    rows = compared.filter("has_difference").orderBy("seq").select(F.concat(F.lit("- "), "id").alias("value"))
    return summary.select(F.concat(F.lit("of "), F.col("total_processed").cast("string")).alias("value")).union(rows)


def test_registered_source_and_own_report(spark, tmp_path):
    spark.dataSource.register(verses())
    source = ArticleSource.of_format("verses", "verses", options={"n": "20"})
    run = compare_source(
        spark, source, str(tmp_path / "out"), BASIC_1, BASIC_2, reports=["text", Report("ids", ids_report), "html"]
    )
    assert set(run.report_paths) == {"text", "ids", "html"}
    lines = [r["value"] for r in spark.read.text(run.report_paths["ids"]).collect()]
    # Titles like t1 are cut differently by the two analyzers.
    assert "of 20" in lines and sorted(lines)[:20] == sorted(f"- {k}" for k in range(20))
    row = run.summary.head()
    assert (row["source_type"], row["total_processed"], row["difference_count"]) == ("verses", 20, 20)
    titles = [r["value"] for r in spark.read.text(run.report_paths["text"]).filter("value LIKE 'Title: %'").collect()]
    assert sorted(titles) == sorted(f"Title: t{k}" for k in range(20))


def test_source_function_with_limit(spark, tmp_path):
    seq = F.struct(F.lit("f").alias("file"), F.lit(0).alias("block"), F.col("id").alias("idx"))
    source = ArticleSource(
        "numbers", lambda s: s.range(100).select(seq.alias("seq"), "id", F.lit("t").alias("title"), F.lit("a1").alias("text"))
    )
    run = compare_source(spark, source, str(tmp_path / "out"), BASIC_1, BASIC_2, max_records=7, reports=[])
    assert sorted(int(r["id"]) for r in run.compared.collect()) == list(range(7))
    assert run.report_paths == {} and run.text_report_path is None


def test_failed_report_leaves_no_lines(spark, tmp_path):
    def failing(compared, summary):
        bad = F.when(F.col("id") == "7", F.raise_error(F.lit("no such line"))).otherwise(F.col("id"))
        return compared.orderBy("seq").select(bad.cast("string").alias("value"))

    source = ArticleSource("rows", lambda s: s.range(30).select("id", F.lit("t1").alias("title"), F.lit("b").alias("text")))
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="no such line"):
        compare_source(spark, source, out, BASIC_1, BASIC_2, reports=["text", Report("bad", failing)])
    assert files_of(f"{out}/report_text") and not files_of(f"{out}/report_bad")


def test_bad_sources_and_reports_are_refused(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="no column text"):
        compare_source(spark, ArticleSource("x", lambda s: s.range(1).select(F.lit("t").alias("title"))), out, BASIC_1, BASIC_2)
    source = ArticleSource("x", lambda s: s.range(1).select(F.lit("t").alias("title"), F.lit("t").alias("text")))
    for reports, message in ((["pdf"], "unknown report"), (["text", "text"], "different names")):
        with pytest.raises(ValueError, match=message):
            compare_source(spark, source, out, BASIC_1, BASIC_2, reports=reports)
    with pytest.raises(ValueError, match="one column"):
        compare_source(spark, source, out, BASIC_1, BASIC_2, reports=[Report("two", lambda c, s: c.select("id", "title"))])
