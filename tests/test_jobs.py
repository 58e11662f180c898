from __future__ import annotations

import gzip
from dataclasses import replace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_dump import HEAD, TAIL, page

from lexdrift import BASIC_1, BASIC_2, CompareOptions, PythonAnalyzer, compare_dump, compare_parquet
from lexdrift.plans.workspace import new_folder, shared_folder
from lexdrift.streaming import read_shards, start_compare


def write_parquet(path, rows):
    pq.write_table(pa.table({"id": [str(i) for i, _ in rows], "text": [t for _, t in rows]}), str(path))


def test_options():
    ok = dict(old=BASIC_1, new=BASIC_2, input_path="i", output_path="o")
    assert CompareOptions(**ok).max_records == -1
    assert CompareOptions(**ok, max_records=10).previews
    assert not CompareOptions(**ok, max_records=11).previews
    for bad in (
        {"old": None}, {"new": ""}, {"input_path": ""}, {"max_records": 0}, {"max_records": -2},
        {"report_format": "pdf"}, {"old": "nobody"},
    ):
        with pytest.raises(ValueError):
            CompareOptions(**{**ok, **bad})


def test_dump_job(spark, tmp_path):
    pages = [page("A1", "x"), page("Help:z", "y"), page("B", "y2"), page("C", "same"), page("", "")]
    (tmp_path / "d.xml").write_text(HEAD + "\n".join(pages) + TAIL)
    result = compare_dump(spark, str(tmp_path / "d.xml"), str(tmp_path / "out"), "basic-1", "basic-2")
    rows = {r["title"]: r for r in result.compared.collect()}
    assert set(rows) == {"A1", "B", "C", ""}
    assert rows["A1"]["has_difference"] and rows["B"]["has_difference"]
    assert rows["C"]["text"] is None and rows["B"]["text"] == "y2"
    summary = result.summary.collect()[0]
    assert (summary["total_processed"], summary["difference_count"], summary["skipped_count"]) == (4, 2, 1)
    assert summary["source_type"] == "XML" and summary["old_analyzer"] == "basic-1"
    assert summary["duration_ms"] > 0 and result.preview is None
    for path in (result.text_report_path, result.html_report_path):
        parts = sorted((tmp_path / "out" / path.rsplit("/", 1)[1]).glob("part-*"))
        text = "".join(p.read_text() for p in parts)
        assert text.index("A1") < text.index("y2") if "row-1" in text else "Title: A1\n" in text


def test_parquet_job(spark, tmp_path):
    write_parquet(tmp_path / "a.parquet", [(n, f"t{n}\nbody") for n in range(20)] + [(20, "")])
    result = compare_parquet(
        spark, str(tmp_path / "a.parquet"), str(tmp_path / "out"), BASIC_1, BASIC_2, max_records=3
    )
    assert result.html_report_path is None and result.text_report_path is not None
    assert result.summary.collect()[0]["total_processed"] == 3
    assert [r["title"] for r in result.preview.collect()] == ["t0", "t1", "t2"]
    assert [r["text"] for r in result.preview.collect()] == ["t0\nbody", "t1\nbody", "t2\nbody"]


def test_parquet_job_refuses_broken_input(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"<html>not parquet</html>")
    with pytest.raises(ValueError, match="bad magic"):
        compare_parquet(spark, str(tmp_path / "a.parquet"), str(tmp_path / "out"), BASIC_1, BASIC_2)


def test_failed_records_do_not_stop_a_job(spark, tmp_path):
    def factory():
        def run(text):
            if "7" in text:
                raise RuntimeError("seven")
            return [(text, "x", 1)]

        return run

    write_parquet(tmp_path / "a.parquet", [(n, f"t{n}") for n in range(20)])
    result = compare_parquet(
        spark, str(tmp_path / "a.parquet"), str(tmp_path / "out"),
        PythonAnalyzer("p1", factory), PythonAnalyzer("p2", factory), report_format="both",
    )
    summary = result.summary.collect()[0]
    assert (summary["total_processed"], summary["failed_count"], summary["difference_count"]) == (18, 2, 0)


def test_limit_counts_before_failures(spark, tmp_path):
    def factory():
        def run(text):
            raise RuntimeError("always")

        return run

    write_parquet(tmp_path / "a.parquet", [(0, ""), *[(n, f"t{n}") for n in range(1, 20)]])
    result = compare_parquet(
        spark, str(tmp_path / "a.parquet"), str(tmp_path / "out"), BASIC_1,
        PythonAnalyzer("p", factory), max_records=5,
    )
    summary = result.summary.collect()[0]
    assert (summary["total_processed"], summary["failed_count"]) == (0, 5)


def test_shared_folder_comes_from_the_session(spark):
    assert new_folder(spark, "x").startswith(shared_folder(spark) + "/lexdrift-x-")


def test_stream_takes_only_new_shards(spark, tmp_path):
    shards, sink, checkpoint = (str(tmp_path / d) for d in ("in", "sink", "check"))
    (tmp_path / "in").mkdir()
    texts = [f"t{n}\nbody" if n % 2 else "plain\nbody" for n in range(40)] + [""]
    for n in range(4):
        rows = [(i, t) for i, t in enumerate(texts) if i % 4 == n]
        write_parquet(tmp_path / "in" / f"s{n}.parquet", rows)

    def run():
        stream = read_shards(spark, shards, files_per_trigger=2)
        query = start_compare(stream, sink, checkpoint, BASIC_1, BASIC_2)
        query.awaitTermination()
        return query

    query = run()
    assert query.lastProgress["batchId"] >= 1
    first = spark.read.parquet(sink)
    assert first.count() == 40 and first.filter("has_difference").count() == 20
    write_parquet(tmp_path / "in" / "s9.parquet", [(99, "new1\nx")])
    run()
    assert spark.read.parquet(sink).count() == 41


def test_stream_refuses_large_tables(spark, tmp_path, monkeypatch):
    from lexdrift import LexiconAnalyzer

    monkeypatch.setattr("lexdrift.operators.row_lexicon.TABLE_BYTES", 1)

    write_parquet(tmp_path / "a.parquet", [(1, "x")])
    lexicon = spark.createDataFrame([("v", "x", "n", 1)], "version string, surface string, pos string, cost bigint")
    with pytest.raises(ValueError, match="too large to be looked up in a stream"):
        start_compare(
            read_shards(spark, str(tmp_path)), "s", "c", BASIC_1, LexiconAnalyzer("l", "x", lexicon, "v")
        )


def test_rejects_are_counted_and_not_processed(spark, tmp_path):
    bad = page("B").replace("</title>", "</title><bad>")
    (tmp_path / "d.xml").write_text(HEAD + page("A", "x1") + bad + page("C", "y2") + page("D").split("</text>")[0])
    run = compare_dump(spark, str(tmp_path / "d.xml"), str(tmp_path / "out"), BASIC_1, BASIC_2)
    (row,) = run.summary.collect()
    assert (row["total_processed"], row["failed_count"], row["rejected_count"], row["skipped_count"]) == (2, 0, 2, 0)
    assert [bool(r["reject"]) for r in run.compared.orderBy("seq").collect()] == [False, True, False, True]
    limited = compare_dump(
        spark, str(tmp_path / "d.xml"), str(tmp_path / "two"), BASIC_1, BASIC_2, max_records=2
    ).summary.collect()[0]
    assert limited["total_processed"] == 2
    with pytest.raises(Exception, match="malformed page"):
        compare_dump(spark, str(tmp_path / "d.xml"), str(tmp_path / "s"), BASIC_1, BASIC_2, strict=True)


def test_strict_refuses_a_dump_without_pages(spark, tmp_path):
    (tmp_path / "d.xml").write_text(HEAD + page("A") + TAIL)
    with pytest.raises(ValueError, match="no <wiki> elements"):
        compare_dump(spark, str(tmp_path / "d.xml"), str(tmp_path / "out"), BASIC_1, BASIC_2, strict=True, page_tag="wiki")


def test_stored_results_do_not_depend_on_the_limit(spark, tmp_path):
    write_parquet(tmp_path / "a.parquet", [(n, "same" if n % 2 else f"t{n}") for n in range(30)])
    runs = [
        compare_parquet(spark, str(tmp_path / "a.parquet"), str(tmp_path / f"o{n}"), BASIC_1, BASIC_2, max_records=n)
        for n in (10, 11)
    ]
    small, large = (r.compared.orderBy("seq").collect() for r in runs)
    assert runs[0].compared.schema == runs[1].compared.schema
    assert small == large[:10] and runs[0].preview.count() == 10 and runs[1].preview is None
    kept = compare_parquet(
        spark, str(tmp_path / "a.parquet"), str(tmp_path / "all"), BASIC_1, BASIC_2, keep_results="all"
    )
    assert all(r["text"] for r in kept.compared.collect())


@pytest.mark.parametrize("name", ["a b.parquet", "50% ü.parquet"])
def test_parquet_names(spark, tmp_path, name):
    write_parquet(tmp_path / name, [(1, "t1")])
    run = compare_parquet(spark, str(tmp_path), str(tmp_path.parent / f"{tmp_path.name}-out"), BASIC_1, BASIC_2)
    assert run.summary.collect()[0]["total_processed"] == 1


def test_results_that_are_no_data_fail_their_record(spark, tmp_path):
    def factory():
        def run(text):
            if text == "t1":
                return [("\ud800", "x", 1)]
            return [(text, "x", 1 << 70 if text == "t2" else 1)]

        return run

    write_parquet(tmp_path / "a.parquet", [(n, f"t{n}") for n in range(4)])
    run = compare_parquet(
        spark, str(tmp_path / "a.parquet"), str(tmp_path / "out"),
        PythonAnalyzer("q1", factory), PythonAnalyzer("q2", factory),
    )
    assert run.summary.collect()[0]["failed_count"] == 2
    texts = {r["text"] for r in run.compared.where("error IS NOT NULL").collect()}
    assert texts == {"t1", "t2"}


def test_limit_leaves_later_files_unopened(spark, tmp_path):
    """The last files cannot be read to their end: opening one would stop the job."""
    dumps, tables = tmp_path / "dumps", tmp_path / "tables"
    dumps.mkdir(), tables.mkdir()
    for n in range(8):
        pages = HEAD + "\n".join(page(f"T{n}x{i}", f"y{i}") for i in range(3)) + TAIL
        packed = gzip.compress(pages.encode())
        (dumps / f"d{n}.xml.gz").write_bytes(packed if n < 4 else packed[:-20])
        write_parquet(tables / f"p{n}.parquet", [(n * 3 + i, f"T{n}x{i}") for i in range(3)])
    whole = (tables / "p7.parquet").read_bytes()
    # The data page is spoilt, the footer is not.
    (tables / "p7.parquet").write_bytes(whole[:4] + b"\0" * 40 + whole[44:])

    wanted = {"T0x0", "T0x1", "T0x2", "T1x0", "T1x1"}
    of_dumps = compare_dump(spark, str(dumps), str(tmp_path / "o1"), BASIC_1, BASIC_2, max_records=5)
    assert {r["title"] for r in of_dumps.compared.collect()} == wanted
    of_tables = compare_parquet(spark, str(tables), str(tmp_path / "o2"), BASIC_1, BASIC_2, max_records=5)
    assert {r["title"] for r in of_tables.compared.collect()} == wanted
    with pytest.raises(Exception):
        compare_dump(spark, str(dumps), str(tmp_path / "o3"), BASIC_1, BASIC_2, max_records=23)
    with pytest.raises(Exception):
        compare_parquet(spark, str(tables), str(tmp_path / "o4"), BASIC_1, BASIC_2, max_records=24)


def test_limit_with_names_that_are_patterns(spark, tmp_path):
    (tmp_path / "in dir").mkdir()
    for n in range(3):
        write_parquet(tmp_path / "in dir" / f"p[{n}].parquet", [(n * 3 + i, f"T{n}x{i}") for i in range(3)])
    run = compare_parquet(
        spark, str(tmp_path / "in dir"), str(tmp_path / "o"), BASIC_1, BASIC_2, max_records=4
    )
    assert {r["title"] for r in run.compared.collect()} == {"T0x0", "T0x1", "T0x2", "T1x0"}


def test_components_and_run_id(spark, tmp_path):
    write_parquet(tmp_path / "a.parquet", [(0, "t")])
    old = replace(BASIC_1, components=("a", "b"))
    runs = [
        compare_parquet(spark, str(tmp_path / "a.parquet"), str(tmp_path / out), old, BASIC_2).summary.head()
        for out in ("o1", "o2")
    ]
    assert runs[0]["old_components"] == ["a", "b"] and runs[0]["new_components"] == []
    assert runs[0]["run_id"] != runs[1]["run_id"]
