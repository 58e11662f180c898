"""Streams over dump files, restarts, and counters kept by the engine."""

from __future__ import annotations

import bz2
import gzip
import time

import pyarrow as pa
import pyarrow.parquet as pq

from lexdrift import BASIC_1, BASIC_2, LexiconAnalyzer, compare_dump
from lexdrift.operators.summary import COUNTERS, count_records
from lexdrift.streaming import read_counters, read_dump_shards, read_shards, start_compare, start_counters

HEAD, TAIL = "<mediawiki>\n", "\n</mediawiki>\n"


def page(title, text):
    return f"<page>\n<title>{title}</title>\n<id>{title}</id>\n<revision><text>{text}</text></revision>\n</page>"


def write_dump(path, name, n):
    pages = [page(f"{name}{k}", f"a{k}" if k % 2 else "same") for k in range(n)]
    data = (HEAD + "\n".join(pages) + TAIL).encode()
    kind = "xml bz2 gz".split()[len(list(path.iterdir())) % 3]
    (path / f"{name}.{kind}").write_bytes({"xml": data, "bz2": bz2.compress(data), "gz": gzip.compress(data)}[kind])
    return [f"{name}{k}" for k in range(n)]


def test_dump_stream_goes_on_where_it_was_stopped(spark, tmp_path):
    shards, sink, checkpoint = tmp_path / "shards", str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    shards.mkdir()
    want = [t for n in range(6) for t in write_dump(shards, f"f{n}x", 7 + n)]
    query = start_compare(read_dump_shards(spark, str(shards), files_per_trigger=1), sink, checkpoint, BASIC_1, BASIC_2)
    while query.isActive and not query.recentProgress:
        time.sleep(0.05)
    query.stop()
    want += write_dump(shards, "late", 5)
    start_compare(read_dump_shards(spark, str(shards), files_per_trigger=1), sink, checkpoint, BASIC_1, BASIC_2).awaitTermination()
    rows = spark.read.parquet(sink)
    assert sorted(r["title"] for r in rows.collect()) == sorted(want)
    batch = compare_dump(spark, str(shards), str(tmp_path / "batch"), BASIC_1, BASIC_2, report_format="text").compared
    columns = ["id", "title", "skipped", "has_difference", "diff_types", "error"]
    assert sorted(map(str, rows.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
    # Places order the records of a file.
    for file in {r["seq"]["file"] for r in rows.collect()}:
        own = rows.filter(rows["seq"]["file"] == file).orderBy("seq").collect()
        numbers = [int(r["title"].rsplit("x", 1)[-1].removeprefix("late")) for r in own]
        assert numbers == sorted(numbers)


def test_malformed_pages_of_a_stream_are_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.xml").write_text(HEAD + page("A", "x") + "<page><title>B</title><bad></page>" + page("C", "y") + "<page><title>D")
    sink = str(tmp_path / "sink")
    start_compare(read_dump_shards(spark, str(tmp_path / "in")), sink, str(tmp_path / "c"), BASIC_1, BASIC_2).awaitTermination()
    counts = count_records(spark.read.parquet(sink)).head()
    assert (counts["total_processed"], counts["rejected_count"], counts["failed_count"]) == (2, 2, 0)


def test_counters_follow_the_table_once(spark, tmp_path):
    shards = tmp_path / "shards"
    shards.mkdir()
    sink, checkpoint, counters = (str(tmp_path / n) for n in ("sink", "checkpoint", "counters"))
    lexicon = spark.createDataFrame([("v", "a", "x", 1 << 62)], "version string, surface string, pos string, cost bigint")
    dear = LexiconAnalyzer("dear", r"\w+", lexicon, "v", unknown_cost=1)

    def write(name, texts):
        table = {"id": [f"{name}{k}" for k in range(len(texts))], "text": texts}
        pq.write_table(pa.table(table | {"version": table["id"]}), str(shards / f"{name}.parquet"))

    def update():
        start_compare(read_shards(spark, str(shards)), sink, checkpoint, BASIC_1, dear).awaitTermination()
        start_counters(spark, sink, counters).awaitTermination()
        got = read_counters(spark, counters).head()
        want = count_records(spark.read.parquet(sink)).head()
        assert {c: got[c] for c in COUNTERS} == {c: want[c] for c in COUNTERS}
        return got

    write("one", ["b c", "a\na", "d1"])
    first = update()
    assert (first["total_processed"], first["failed_count"]) == (2, 1)
    assert update() == first
    write("two", ["b"] * 10)
    assert update()["total_processed"] == 12
