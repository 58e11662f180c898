from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexdrift.sources import audit, audit_parquet, columnar, is_parquet, read_split, require_parquet


def write(path, ids, texts, type_=pa.string(), **options):
    table = pa.table(
        {
            "wikidata_id": pa.array(ids, type_),
            "text": pa.array(texts, type_),
            "version_id": pa.array(ids, type_),
        }
    )
    pq.write_table(table, str(path), **options)


def test_fields_by_position(spark, tmp_path):
    write(tmp_path / "a.parquet", ["Q1", "Q2"], ["題\n本文。", "x"])
    rows = columnar.read_articles(spark, str(tmp_path / "a.parquet")).orderBy("seq").collect()
    assert [(r["id"], r["title"], r["text"]) for r in rows] == [("Q1", "題", "題\n本文。"), ("Q2", "x", "x")]
    assert rows[0]["title_annotation"] is None and rows[0]["last_modified"] is None


def test_binary_columns_and_bad_bytes(spark, tmp_path):
    write(tmp_path / "a.parquet", [b"Q1", b"Q2", b"Q3"], [b"\xe3\x81\x82\xff", b"", None], pa.binary())
    rows = columnar.read_articles(spark, str(tmp_path / "a.parquet")).collect()
    assert [(r["id"], r["text"]) for r in rows] == [("Q1", "あ�")]


def test_empty_text_is_dropped(spark, tmp_path):
    write(tmp_path / "a.parquet", ["1", "2", "3", "4"], ["", None, " ", "x"])
    rows = columnar.read_articles(spark, str(tmp_path / "a.parquet")).orderBy("seq").collect()
    assert [(r["id"], r["title"]) for r in rows] == [("3", ""), ("4", "x")]


def test_third_column_is_pruned_and_filter_is_pushed(spark, tmp_path):
    write(tmp_path / "a.parquet", ["1"], ["x"])
    plan = columnar.read_articles(spark, str(tmp_path / "a.parquet"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "version_id" not in physical
    assert "IsNotNull(text)" in physical and "Not(EqualTo(text,))" in physical


def test_sequence_follows_rows(spark, tmp_path):
    for n in range(3):
        write(tmp_path / f"p{n}.parquet", [f"{n}-{i}" for i in range(500)], ["x"] * 500, row_group_size=50)
    rows = columnar.read_columns(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["id"] for r in rows] == [f"{n}-{i}" for n in range(3) for i in range(500)]


@pytest.fixture
def splits(tmp_path):
    for name, file in columnar.SPLIT_FILES.items():
        write(tmp_path / file, [name], [name])
    return str(tmp_path)


def test_splits(spark, splits):
    assert {(r["split"], r["id"]) for r in read_split(spark, splits, "ALL").collect()} == {
        (n, n) for n in ("train", "validation", "test")
    }
    assert [(r["split"], r["id"]) for r in read_split(spark, splits, "Validation").collect()] == [
        ("validation", "validation")
    ]


def test_split_names():
    assert columnar.split_names("TRAIN") == ["train"]
    assert columnar.split_names("all") == ["train", "validation", "test"]
    assert list(columnar.SPLIT_FILES.values()) == ["train.parquet", "validation.parquet", "test.parquet"]
    with pytest.raises(ValueError, match="unknown split"):
        columnar.split_names("dev")


def test_audit(spark, tmp_path):
    (tmp_path / "good.parquet").write_bytes(b"PAR1payloadPAR1")
    (tmp_path / "eight.parquet").write_bytes(b"PAR1PAR1")
    (tmp_path / "page.parquet").write_bytes(b"<html>not parquet</html>")
    (tmp_path / "tail.parquet").write_bytes(b"PAR1payload")
    (tmp_path / "short.parquet").write_bytes(b"PAR1PAR")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in audit_parquet(spark, str(tmp_path)).collect()}
    assert {name: (r["valid"], r["reason"]) for name, r in rows.items()} == {
        "good.parquet": (True, None),
        "eight.parquet": (True, None),
        "page.parquet": (False, "bad magic"),
        "tail.parquet": (False, "bad magic"),
        "short.parquet": (False, "too small"),
    }
    assert rows["good.parquet"]["length"] == 15
    with pytest.raises(ValueError, match="3 of 5"):
        require_parquet(spark, str(tmp_path))


def test_audit_of_one_path(spark, tmp_path):
    write(tmp_path / "a.parquet", ["1"], ["x"])
    require_parquet(spark, str(tmp_path / "a.parquet"))
    assert is_parquet(spark, str(tmp_path / "a.parquet"))
    assert not is_parquet(spark, str(tmp_path / "missing.parquet"))
    with pytest.raises(Exception, match="(?i)does not exist|not_found"):
        require_parquet(spark, str(tmp_path / "missing.parquet"))


def test_files_of_other_stores_are_judged_by_spark(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "a b"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 nothing PAR1")
    found = audit.audit_parquet(spark, str(tmp_path), "*.parquet")
    unchecked = found.select("path", "length", F.lit(None).cast("boolean").alias("valid"), F.lit("not checked").alias("reason"))
    rows = audit._judged_by_spark(unchecked, [str(tmp_path)], "*.parquet").collect()
    assert {(r["path"].endswith("/bad.parquet"), r["valid"], r["reason"]) for r in rows} == {
        (False, True, None), (True, None, "not checked"),
    }
    assert audit._foreign(["viewfs://store/x"]) and not audit._foreign(["/a", "file:/b c", "relative"])
