from __future__ import annotations

import bz2
import datetime
import gzip

import pytest

from lexdrift.sources import dump

HEAD = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">\n<siteinfo><base>x</base></siteinfo>\n'
TAIL = "\n</mediawiki>\n"


def page(title="Test Page", text="test", extra="", time="2023-01-01T00:00:00Z", ident="<id>7</id>"):
    return (
        f"  <page>\n    <title>{title}</title>\n    <ns>0</ns>{ident}\n    <revision>\n"
        f"      <id>1</id>\n      <timestamp>{time}</timestamp>\n"
        f'      <text bytes="5" xml:space="preserve">{text}</text>\n    </revision>{extra}\n  </page>'
    )


@pytest.fixture
def read(spark, tmp_path):
    def run(*pages, name="d.xml", wrap=lambda b: b, **options):
        body = HEAD + "\n".join(pages) + TAIL
        (tmp_path / name).write_bytes(wrap(body.encode()))
        rows = dump.read_articles(spark, str(tmp_path / name), **options)
        return rows.orderBy("seq").collect()

    return run


def test_fields(read):
    (row,) = read(page("  Test Page (note) x ", " x &amp; y "))
    assert row["title"] == "Test Page"
    assert row["title_annotation"] == "note"
    assert row["id"] == "7"
    assert row["text"] == "x & y"
    assert row["last_modified"] == datetime.datetime(2023, 1, 1)


@pytest.mark.parametrize(
    "name, wrap", [("d.xml", lambda b: b), ("d.xml.gz", gzip.compress), ("d.xml.bz2", bz2.compress)]
)
def test_compression(read, name, wrap):
    rows = read(*[page(f"T{n}", f"text {n}") for n in range(50)], name=name, wrap=wrap)
    assert [(r["title"], r["text"]) for r in rows] == [(f"T{n}", f"text {n}") for n in range(50)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("朝。\n夜", "朝。夜"),
        ("朝\n夜", "朝\n夜"),
        ("\n\n朝。\n夜\n\n      ", "朝。夜"),
        ("朝<![CDATA[\n夜]]>昼", "朝\n夜昼"),
        ("a\r\nb\rc", "a\nb\nc"),
        ("null", "null"),
        ("", ""),
        ("  \n ", ""),
    ],
)
def test_text(read, text, expected):
    assert read(page(text=text))[0]["text"] == expected


def test_id_only_in_revision(read):
    assert read(page(ident=""))[0]["id"] is None


def test_prefixed_elements(read):
    import re
    prefixed = re.sub(r"<(/?)(\w)", r"<\1mw:\2", page("T (n)", "x &lt;b&gt;"))
    admin = re.sub(r"<(/?)(\w)", r"<\1mw:\2", page("Help:T"))
    (row,) = read(prefixed, admin, page_tag="mw:page")
    assert (row["title"], row["title_annotation"], row["id"], row["text"]) == ("T", "n", "7", "x <b>")
    assert row["last_modified"] == datetime.datetime(2023, 1, 1)


def test_admin_pages_are_dropped(read):
    rows = read(page("Help:X"), page("Ａ：Ｂ"), page("a&#58;b"), page("ok", "see <![CDATA[<title>a:b</title>]]>"))
    assert [r["title"] for r in rows] == ["Ａ：Ｂ", "ok"]


def test_page_without_fields_is_kept(read):
    (row,) = read("<page></page>")
    assert (row["title"], row["id"], row["text"], row["last_modified"]) == (None,) * 4


def test_last_revision_wins(read):
    second = "<revision><text>later</text></revision>"
    (row,) = read(page(text="first", extra=second))
    assert row["text"] == "later"
    assert row["last_modified"] == datetime.datetime(2023, 1, 1)


def test_bad_time(read):
    assert read(page(time="nope"))[0]["last_modified"] is None
    with pytest.raises(Exception, match="(?i)nope|parse"):
        read(page(time="nope"), strict=True)


def test_cut_page(spark, tmp_path):
    body = HEAD + page("A") + page("B") + page("C").split("</text>")[0]
    (tmp_path / "d.xml").write_text(body)
    parsed = dump.parse_pages(dump.read_pages(spark, str(tmp_path / "d.xml")))
    assert [r["title"] for r in dump.to_articles(parsed).orderBy("seq").collect()] == ["A", "B"]
    (rejected,) = dump.rejected_pages(parsed).collect()
    assert "<title>C</title>" in rejected["record"]
    with pytest.raises(Exception, match="malformed page"):
        dump.to_articles(parsed, strict=True).collect()


def test_truncated_archive(spark, tmp_path):
    import random
    rng = random.Random(3)
    pages = [page(f"T{n}", "".join(rng.choices("abcdefgh ", k=2000))) for n in range(300)]
    packed = gzip.compress((HEAD + "\n".join(pages) + TAIL).encode())
    (tmp_path / "d.xml.gz").write_bytes(packed[: len(packed) // 2])
    path = str(tmp_path / "d.xml.gz")
    with pytest.raises(Exception):
        dump.read_articles(spark, path).collect()
    titles = [r["title"] for r in dump.read_articles(spark, path, skip_broken_files=True).orderBy("seq").collect()]
    assert 0 < len(titles) < 300
    assert titles == [f"T{n}" for n in range(len(titles))]
    with pytest.raises(Exception):
        dump.read_articles(spark, str(tmp_path / "d.xml.gz"), strict=True).collect()


@pytest.mark.parametrize("name, wrap", [("d.xml", lambda b: b), ("d.xml.bz2", bz2.compress)])
def test_many_splits_keep_every_page_once_and_in_order(spark, tmp_path, name, wrap):
    import random
    rng = random.Random(5)
    n = 3000
    pages = [page(f"T{i}", "".join(rng.choices("abcdefgh \n", k=rng.randint(0, 1500)))) for i in range(n)]
    (tmp_path / name).write_bytes(wrap((HEAD + "\n".join(pages) + TAIL).encode()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = dump.read_articles(spark, str(tmp_path / name)).select("seq", "title")
        assert rows.rdd.getNumPartitions() > 8
        titles = [r["title"] for r in rows.orderBy("seq").collect()]
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert titles == [f"T{i}" for i in range(n)]


def test_page_forms(read):
    """Blanked end tags leave several pages in a chunk; comments are no pages; CDATA is text."""
    hidden = "<!-- " + page("hidden") + " -->"
    rows = read(page("A").replace("</page>", "</page >"), page("B").replace("</page>", "</page\n>"), hidden,
                page("C", "<![CDATA[<!-- kept -->]]>"))
    assert [r["title"] for r in rows] == ["A", "B", "C"]
    assert rows[2]["text"] == "<!-- kept -->"


def test_other_encoding_is_a_reject(spark, tmp_path):
    (tmp_path / "d.xml").write_bytes((HEAD + page("A") + TAIL).encode("utf-16"))
    parsed = dump.parse_pages(dump.read_pages(spark, str(tmp_path / "d.xml")))
    assert dump.rejected_pages(parsed).count() >= 1
    with pytest.raises(Exception, match="malformed page"):
        dump.to_articles(parsed, strict=True).collect()


def test_only_gzip_files_are_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for n in range(3 * cores):
        pages = (HEAD + "\n".join(page(f"T{n}x{i}", "y") for i in range(3)) + TAIL).encode()
        (tmp_path / f"d{n}.xml.bz2").write_bytes(bz2.compress(pages))
    (tmp_path / "last.xml.gz").write_bytes(gzip.compress((HEAD + page("Z", "y") + TAIL).encode()))
    size = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(size, "1k")
    try:
        pages = dump.read_pages(spark, str(tmp_path))
        plan = pages._jdf.queryExecution().executedPlan().toString()
        titles = {r["title"] for r in dump.read_articles(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(size)
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 1
    assert titles == {"Z"} | {f"T{n}x{i}" for n in range(3 * cores) for i in range(3)}
