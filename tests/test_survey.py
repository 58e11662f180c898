"""Surveys of dumps: ranges, restart points and states against a reader of whole files."""

from __future__ import annotations

import bz2
import gzip
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexdrift import BASIC_1, BASIC_2, compare_dump
from lexdrift.catalog import derived, queries
from lexdrift.sources import dump, inflate, survey
from lexdrift.sources.ranges import Source, bzip2_pieces, mark_places

HEAD, TAIL = "<mediawiki>\n", "\n</mediawiki>\n"


def page(title, text="t"):
    return f"<page>\n<title>{title}</title>\n<id>1</id>\n<revision><text>{text}</text></revision>\n</page>"


def made(seed: int, n: int, marks: bool = True) -> str:
    """Pages with comments and CDATA that hold marks and whole pages, texts that do not compress, and long stretches
    without any mark."""
    rng = random.Random(seed)
    out = [HEAD]
    for k in range(n):
        kind = rng.randrange(9) if marks else 9
        noise = "".join(rng.choices("abcdefghijklmnop qrstuvwxyz", k=rng.choice([5, 50, 3000])))
        one = page(f"T{k}", noise)
        if kind == 0:
            one = f"<!-- {page('no', 'x')}\n{page('nor', 'y')} <![CDATA[ -->" + one
        elif kind == 1:
            one = page(f"T{k}", f"a<![CDATA[ </page> <page> <!-- {noise} ]]>b")
        elif kind == 2:
            one = page(f"T{k}", "x<!-- ]]> </page> -->y<!---->z<!--->-->")
        elif kind == 3:
            one = one.replace("</page>", "</page \n>")
        elif kind == 4:
            one = "<!--" + "-" * rng.randrange(8) + "-->" + one
        out.append(one + rng.choice(["", "\n", "  "]))
    return "".join(out) + TAIL


def plain_reader(text: str) -> list[str]:
    """All pages, read from one end to the other."""
    pages, page_, at, state = [], "", 0, 0
    for found in re.finditer(r"<!--|-->|<!\[CDATA\[|\]\]>|</page\s*>|\Z", text):
        mark = found.group()
        if state == 0:
            page_ += text[at : found.start()]
            at = found.start()
            if mark == "<!--":
                state, at = 1, found.end()
            elif mark == "<![CDATA[":
                state = 2
            elif mark.startswith("</") or not mark:
                start = re.search(r"<page[\s>]", page_)
                if start:
                    pages.append(page_[start.start() :])
                page_, at = "", found.end()
        elif state == 1 and mark == "-->":
            state, at = 0, found.end()
        elif state == 2 and mark == "]]>":
            page_ += text[at : found.end()]
            state, at = 0, found.end()
        elif state == 2 and not mark:
            pages.append((page_ + text[at:])[re.search(r"<page[\s>]", page_ + text[at:]).start() :])
    return pages


# A comment that ends at once, as in <!--->, would be read by the expression above as two marks.
def reader(text: str) -> list[str]:
    return plain_reader(text.replace("<!--->-->", "").replace("<!---->", ""))


def packed(text: str, kind: str, rng: random.Random) -> bytes:
    data = text.encode()
    cut = rng.randrange(len(data) + 1)
    if kind == "xml":
        return data
    if kind == "bz2":
        return bz2.compress(data[:cut], 1) + bz2.compress(data[cut:], rng.choice([1, 9]))
    if kind == "gz":
        return gzip.compress(data[:cut], 1) + gzip.compress(data[cut:], rng.choice([0, 6])) + b"\0" * rng.choice([0, 100])
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)  # one member with flushes and stored blocks
    return engine.compress(data[:cut]) + engine.flush(zlib.Z_SYNC_FLUSH) + engine.compress(data[cut:]) + engine.flush()


def pages_of(rows) -> list[str]:
    found = sorted(rows.collect(), key=lambda r: (r["seq"]["file"], r["seq"]["block"], r["seq"]["idx"]))
    return [r["page"] for r in found]


@pytest.mark.parametrize("suffix", ["xml", "bz2", "gz", "one.gz"])
@pytest.mark.parametrize("seed, span", [(1, 1000), (2, 7777), (3, 20_000)])
def test_ranges_equal_a_whole_read(spark, tmp_path, suffix, seed, span):
    text = made(seed, 400 if suffix != "bz2" else 900)
    (tmp_path / f"d.{suffix}").write_bytes(packed(text, suffix, random.Random(seed)))
    found = survey.survey_pages(spark, str(tmp_path), span=span)
    assert found.count() > 5 and found.filter("reason is not null or lost").count() == 0
    assert pages_of(survey.read_surveyed(found)) == reader(text)
    # Pages of all ranges, and the pages before each, as counted.
    rows = found.orderBy("n").collect()
    assert sum(r["pages"] for r in rows) == len(reader(text))
    assert [r["before"] for r in rows] == [sum(r["pages"] for r in rows[:k]) for k in range(len(rows))]


@pytest.mark.parametrize("suffix", ["xml", "bz2", "gz"])
def test_pages_equal_those_of_the_text_source(spark, tmp_path, suffix):
    text = made(9, 300, marks=False)
    data = packed(text, suffix, random.Random(1)).rstrip(b"\0") if suffix != "gz" else gzip.compress(text.encode())
    (tmp_path / f"d.{suffix}").write_bytes(data)
    found = survey.survey_pages(spark, str(tmp_path), span=3000)
    assert pages_of(survey.read_surveyed(found)) == pages_of(dump.read_pages(spark, str(tmp_path)))


def test_gzip_is_read_by_many_tasks(spark, tmp_path):
    text = made(5, 600)
    (tmp_path / "d.gz").write_bytes(gzip.compress(text.encode()))
    folder = str(tmp_path / "survey")
    survey.survey_pages(spark, str(tmp_path / "d.gz"), span=40_000, folder=folder)
    again = survey.load_survey(spark, folder)
    assert again.filter("window is not null").count() > 5
    rows = survey.read_surveyed(again)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert pages_of(rows) == reader(text)


def test_without_a_zlib_library_gzip_is_one_piece(spark, tmp_path, monkeypatch):
    text = made(6, 200)
    data = gzip.compress(text[:500].encode()) + gzip.compress(text[500:].encode())
    (tmp_path / "d.gz").write_bytes(data)
    monkeypatch.setattr(inflate, "_library", lambda: None)
    with Source(str(tmp_path / "d.gz")) as read:
        assert b"".join(out for out, _, _ in inflate.without_restarts(read)).decode() == text
    (part,) = survey.gzip_ranges(str(tmp_path / "d.gz"), 1000)
    assert b"".join(data for data, _, _ in part.pieces(Source(part.file))).decode() == text
    (tmp_path / "cut.gz").write_bytes(data[:-30])
    with pytest.raises(inflate.BrokenStream), Source(str(tmp_path / "cut.gz")) as read:
        list(inflate.without_restarts(read))


def test_restart_points_of_stored_blocks_and_members(tmp_path):
    rng = random.Random(3)
    noise = rng.randbytes(300_000)
    data = b"".join(gzip.compress(noise[k : k + 70_000] + b"a" * 50_000, 6) for k in range(0, 300_000, 70_000))
    (tmp_path / "d.gz").write_bytes(data)
    whole = gzip.decompress(data)
    with Source(str(tmp_path / "d.gz")) as read:
        *points, size = inflate.restart_points(read, 10_000)
        assert size == len(whole) and len(points) > 10 and any(p.window is None for p in points)
        for point in points:
            assert b"".join(out for out, _, _ in inflate.read_from(read, point)) == whole[point.out :]


def test_marks_at_every_bit():
    mark = 0x314159265359
    for bit in range(8):
        data = ((mark << (16 - bit)) | 1).to_bytes(9, "big")
        shift = int.from_bytes(data, "big").bit_length()
        assert mark_places(data, mark) == [72 - shift - (48 - mark.bit_length())]


def test_false_bzip2_marks_are_read_over(tmp_path):
    """The mark occurs in compressed data by chance: here as the raw bytes between two streams' blocks."""
    text = random.Random(1).randbytes(50_000)
    data = bz2.compress(text)
    (tmp_path / "a.bz2").write_bytes(data)
    with Source(str(tmp_path / "a.bz2")) as read:
        assert b"".join(out for out, _, _ in bzip2_pieces(read, 0, read.size)) == text


def test_broken_files_are_told_exactly(spark, tmp_path):
    text = made(4, 500, marks=False)
    whole = {"a.xml.gz": gzip.compress(text.encode()), "b.xml.bz2": bz2.compress(text.encode(), 1), "c.xml": text.encode()}
    cut = {"d.xml.gz": whole["a.xml.gz"][:-5000], "e.xml.bz2": whole["b.xml.bz2"][:-9000]}
    spoilt = bytearray(whole["b.xml.bz2"])
    spoilt[len(spoilt) // 2] ^= 255
    for name, data in {**whole, **cut, "f.xml.bz2": bytes(spoilt), "g.xml.gz": b"nothing"}.items():
        (tmp_path / name).write_bytes(data)
    found = survey.survey_pages(spark, str(tmp_path), span=50_000)
    broken = {r["file"].rsplit("/", 1)[-1]: r for r in survey.broken_files(found).collect()}
    assert set(broken) == {"d.xml.gz", "e.xml.bz2", "f.xml.bz2", "g.xml.gz"}
    assert "ends inside" in broken["d.xml.gz"]["reason"] and "ends inside" in broken["e.xml.bz2"]["reason"]
    for name, row in broken.items():
        assert row["bytes_there"] == (tmp_path / name).stat().st_size >= row["bytes_read"]
    assert 0.2 < broken["f.xml.bz2"]["bytes_read"] / broken["f.xml.bz2"]["bytes_there"] < 0.8
    with pytest.raises(Exception, match="BrokenStream"):
        survey.read_surveyed(found).collect()
    pages = {}
    for r in survey.read_surveyed(found, skip_broken_files=True).collect():
        pages.setdefault(r["seq"]["file"].rsplit("/", 1)[-1], []).append(r)
    want = reader(text)
    for name in whole:
        assert len(pages[name]) == len(want)
    for name in ("d.xml.gz", "e.xml.bz2", "f.xml.bz2"):
        got = [r["page"] for r in sorted(pages[name], key=lambda r: (r["seq"]["block"], r["seq"]["idx"]))]
        assert 10 < len(got) < len(want) and got[:-1] == want[: len(got) - 1] and want[len(got) - 1].startswith(got[-1])
    run = compare_dump(spark, str(tmp_path), str(tmp_path / "out"), BASIC_1, BASIC_2, skip_broken_files=True, survey=found)
    assert run.summary.head()["broken_files"] == 4


@pytest.mark.parametrize("suffix", ["xml", "bz2", "gz"])
def test_limit_reads_few_ranges(spark, tmp_path, monkeypatch, suffix):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(40_000)]
    many = HEAD + "\n".join(page(f"T{n}", " ".join(rng.choices(words, k=100))) for n in range(4000)) + TAIL
    data = {"xml": lambda b: b, "bz2": lambda b: bz2.compress(b, 1), "gz": gzip.compress}[suffix](many.encode())
    (tmp_path / f"d.{suffix}").write_bytes(data)
    monkeypatch.setattr(survey, "SPAN", 100_000)
    files = [(str(tmp_path / f"d.{suffix}"), len(data))]
    for wanted, most in ((10, 2), (700, 0.6)):
        rows, seen = survey.leading_pages(spark, files, wanted, lambda pages: pages, span=100_000)
        first = rows.orderBy("seq").limit(wanted).collect()
        assert [r["page"].split("title>")[1] for r in first] == [f"T{n}</" for n in range(wanted)]
        # Ten records lie in the first range; seven hundred in about a sixth of the file.
        if wanted == 10:
            assert seen.count() <= most
        else:
            assert seen.agg(F.max("read_to").alias("n")).head()["n"] <= most * len(data)
    run = compare_dump(spark, str(tmp_path), str(tmp_path / "out"), BASIC_1, BASIC_2, max_records=10)
    assert {r["title"] for r in run.compared.collect()} == {f"T{n}" for n in range(10)}


def test_limit_over_files_and_past_the_end(spark, tmp_path):
    for n in range(5):
        text = HEAD + "\n".join(page(f"F{n}x{k}" if k % 3 else f"Help:{k}", "y" * 200) for k in range(30)) + TAIL
        data = text.encode()
        (tmp_path / f"d{n}.{['xml', 'gz', 'bz2'][n % 3]}").write_bytes([data, gzip.compress(data), bz2.compress(data)][n % 3])
    want = [f"F{n}x{k}" for n in range(5) for k in range(30) if k % 3]
    for wanted in (1, 33, 100, 1000):
        run = compare_dump(spark, str(tmp_path), str(tmp_path / f"out{wanted}"), BASIC_1, BASIC_2, max_records=wanted)
        got = [r["title"] for r in run.compared.orderBy("seq").collect()]
        assert got == want[:wanted]


def test_empty_inputs(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(b"")
    (tmp_path / "b.bz2").write_bytes(bz2.compress(b""))
    (tmp_path / "c.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "d.xml").write_text("<mediawiki>no page</mediawiki>")
    found = survey.survey_pages(spark, str(tmp_path))
    assert survey.read_surveyed(found).count() == 0
    assert survey.broken_files(found).count() == 0
    run = compare_dump(spark, str(tmp_path), str(tmp_path / "out"), BASIC_1, BASIC_2, max_records=3)
    assert run.summary.head()["total_processed"] == 0


def test_another_page_tag(spark, tmp_path):
    text = HEAD + "".join(page(f"T{n}").replace("page>", "mw:page>") for n in range(50)) + TAIL
    (tmp_path / "d.xml").write_text(text)
    found = survey.survey_pages(spark, str(tmp_path), page_tag="mw:page", span=300)
    assert survey.read_surveyed(found, page_tag="mw:page").count() == 50


def test_packed_dumps_are_written_in_bounded_files(spark, tmp_path, monkeypatch):
    """No task writes or reads all pages, and the files follow each other."""
    monkeypatch.setattr(derived, "PACKED_BYTES", 20_000)
    rows = [(n, f"Title {n}\n" + "word " * 40, "en", "src1") for n in range(1000)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for codec, engine in (("gzip", gzip), ("bzip2", bz2)):
        path = derived.write_packed_dump(spark, str(tmp_path), codec)
        files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
        texts = [engine.open(f.removeprefix("file:")).read() for f in files]
        assert len(files) > 5 and max(map(len, texts)) < sum(map(len, texts)) / 4
        assert re.findall(rb"<title>Title (\d+)<", b"".join(texts)) == [b"%d" % n for n in range(1000)]
    assert queries.gzip_ranges(spark, str(tmp_path)).count() == 1000
    limited = queries.limit_in_file(spark, str(tmp_path))
    assert sorted(int(r["id"]) for r in limited.collect()) == list(range(queries.LIMIT))


def test_gzip_files_are_looked_through_by_tasks_of_their_own(spark, tmp_path):
    for n in range(12):
        (tmp_path / f"{n}.gz").write_bytes(gzip.compress(made(n, 3).encode()))
    files = survey.list_files(spark, str(tmp_path))
    tasks = survey._gzip_files(files, 1000).select(F.spark_partition_id().alias("p"), "file").distinct().groupBy("p").count()
    assert [r["count"] for r in tasks.collect()] == [1] * 12
