"""Inputs of the catalogue queries, derived from the given tables.

The ``documents`` table is the corpus. Shapes it does not have (administrative titles,
annotations, control characters, blank fields, page XML) are produced from its own
columns, by language, for every row.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.functions.render import html_escape
from lexdrift.functions.text import derive_title
from lexdrift.plans.workspace import new_folder
from lexdrift.sources import columnar, dump
from lexdrift.sources.ranges import Source
from lexdrift.sources.spread import spread

FORM_TEXT = "</page>\n<page> <!-- x"
BROKEN_BYTES = 40
#: Text of one compressed file.
PACKED_BYTES = 128 << 20


def corpus_path(sf_dir: str) -> str:
    return f"{sf_dir}/documents.parquet"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, id, text, lang, source)``."""
    return spread(columnar.read_columns(spark, corpus_path(sf_dir), ["lang", "source"]))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columnar.read_articles(spark, corpus_path(sf_dir), ["lang", "source"])


def by_lang(otherwise: Column, **cases: Column) -> Column:
    """One expression per language."""
    result = F
    for lang, value in cases.items():
        result = result.when(F.col("lang") == lang, value)
    return result.otherwise(otherwise)


def marked_text() -> Column:
    """Texts with the marker lines of the corpus format."""
    text = F.col("text")
    return by_lang(
        text,
        de=F.concat(F.lit("\n_START_ARTICLE_\n "), text),
        fr=F.concat(F.lit("_START_SECTION_ x\n_START_PARAGRAPH_\n\n"), text),
        es=F.lit("\n _START_ARTICLE_ \n_START_SECTION_\n"),
    )


def broken_lines() -> Column:
    """Texts with other line ends and with blanks around them."""
    text, lf = F.col("text"), F.lit("\n")
    return by_lang(
        text,
        fr=F.replace(text, lf, F.lit("\r\n")),
        de=F.replace(text, lf, F.lit("\r")),
        es=F.replace(text, lf, F.lit(" \t\n  \n ")),
    )


def page_title() -> Column:
    """Titles with an administrative prefix, an annotation, or outer blanks."""
    title = derive_title(F.col("text"))
    return by_lang(
        title,
        de=F.concat(F.lit("Help:"), title),
        fr=F.concat(title, F.lit(" ("), F.col("source"), F.lit(") x")),
        es=F.concat(F.lit(" \t"), title, F.lit("：\n")),
    )


def page_text() -> Column:
    return F.when(F.col("source") == "src0", F.lit("")).otherwise(F.col("text"))


def page_time() -> Column:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(start + F.make_dt_interval(secs=F.col("id").cast("bigint")), dump.REVISION_TIME)


def page_xml() -> Column:
    return F.concat(
        F.lit("  <page>\n    <title>"),
        html_escape(page_title()),
        F.lit("</title>\n    <ns>0</ns>\n    <id>"),
        F.col("id"),
        F.lit("</id>\n    <revision>\n      <id>1"),
        F.col("id"),
        F.lit("</id>\n      <timestamp>"),
        page_time(),
        F.lit('</timestamp>\n      <text bytes="0" xml:space="preserve">'),
        html_escape(page_text()),
        F.lit("</text>\n    </revision>\n  </page>"),
    )


def write_dump(spark: SparkSession, sf_dir: str) -> str:
    """The corpus as page XML in the shared folder."""
    path = new_folder(spark, "dump")
    corpus(spark, sf_dir).select(page_xml().alias("value")).write.text(path)
    return path


def write_compressed_dump(spark: SparkSession, sf_dir: str) -> list[str]:
    """English pages as bzip2, the others as gzip."""
    paths = []
    rows = corpus(spark, sf_dir)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for codec, chosen in (("bzip2", english), ("gzip", ~english)):
        path = new_folder(spark, f"dump-{codec}")
        rows.filter(chosen).select(page_xml().alias("value")).write.text(path, compression=codec)
        paths.append(path)
    return paths


def _write_packed(rows: DataFrame, path: str, codec: str) -> None:
    """Pages of ``rows`` in order, in one compressed file, or in several of about ``PACKED_BYTES`` of text that follow
    each other by name: a file is written by one task, and a gzip file is looked through by one."""
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-size // PACKED_BYTES)
    parted = rows.repartitionByRange(n, "seq") if n > 1 else rows.coalesce(1)
    pages = parted.sortWithinPartitions("seq").select(page_xml().alias("value"))
    pages.write.mode("append").text(path, compression=codec)


def write_packed_dump(spark: SparkSession, sf_dir: str, codec: str, rows: DataFrame | None = None) -> str:
    """All pages, in order, in as few compressed files as tasks can write and read."""
    path = new_folder(spark, f"dump-{codec}")
    _write_packed(corpus(spark, sf_dir) if rows is None else rows, path, codec)
    return path


def write_page_forms(spark: SparkSession, sf_dir: str) -> str:
    """The page dump with comments that hold several pages (Spanish) and with end tags in CDATA (French)."""
    path = new_folder(spark, "forms")
    hidden = F.concat(F.lit("<!-- "), page_xml(), F.lit("\n"), page_xml(), F.lit(" ]]> <![CDATA[ -->"))
    end = F.lit("<![CDATA[" + FORM_TEXT + "]]></text>")
    forms = by_lang(
        page_xml(),
        es=F.concat(hidden, page_xml(), hidden),
        fr=F.replace(page_xml(), F.lit("</text>"), end),
    )
    corpus(spark, sf_dir).select(forms.alias("value")).write.text(path)
    return path


def write_breaking_dump(spark: SparkSession, sf_dir: str) -> str:
    """A plain file with the English pages, a gzip file of the French and a bzip2 file of the German ones that break
    off inside their first page, and whole gzip files of the Spanish ones, one if they are few."""
    path = new_folder(spark, "breaking")
    rows = corpus(spark, sf_dir)
    lang = F.coalesce("lang", F.lit(""))
    rows.filter(~lang.isin("fr", "de", "es")).select(page_xml().alias("value")).write.text(path)
    for name, codec in (("fr", "gzip"), ("de", "bzip2"), ("es", "gzip")):
        chosen = rows.filter(lang == name)
        if chosen.isEmpty():
            continue
        if name == "es":
            _write_packed(chosen, path, codec)
            continue
        whole = write_packed_dump(spark, sf_dir, codec, chosen)
        file = spark.read.format("binaryFile").load(whole).agg(F.min("path")).head()[0]
        # The start of a compressed stream with nothing of its first block, or too little for a page.
        write_bytes(f"{path}/cut-{name}.{file.rsplit('.', 1)[-1]}", read_bytes(file, BROKEN_BYTES))
    return path


def read_bytes(uri: str, n: int) -> bytes:
    with Source(uri) as read:
        return read(0, n)


def write_bytes(uri: str, data: bytes) -> None:
    """A small file in the shared folder."""
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def write_cut_dump(spark: SparkSession, sf_dir: str) -> str:
    """The page dump and one more file that breaks off inside the latest page."""
    path = write_dump(spark, sf_dir)
    latest = corpus(spark, sf_dir).agg(
        *[
            F.max_by(c, F.col("id").cast("bigint")).alias(c)
            for c in ("id", "text", "lang", "source")
        ]
    )
    cut = F.substring_index(page_xml(), "</text>", 1)
    latest.select(cut.alias("value")).write.mode("append").text(path)
    return path


def write_splits(spark: SparkSession, sf_dir: str) -> str:
    """The corpus as three splits: English, French, the rest."""
    root = new_folder(spark, "splits")
    rows = corpus(spark, sf_dir).select("id", "text", "lang")
    lang = F.col("lang")
    for name, chosen in (
        ("train", lang == "en"),
        ("validation", lang == "fr"),
        ("test", F.coalesce(~lang.isin("en", "fr"), F.lit(True))),
    ):
        rows.filter(chosen).write.parquet(f"{root}/{columnar.SPLIT_FILES[name]}")
    return root


def write_shards(spark: SparkSession, sf_dir: str) -> str:
    """The corpus as Parquet shards in one folder, language after language."""
    root = new_folder(spark, "shards")
    rows = corpus(spark, sf_dir).select("id", "text", "lang")
    lang, named = F.col("lang"), ("en", "fr", "de", "es")
    rest = F.coalesce(~lang.isin(*named), F.lit(True))
    for chosen in (*[lang == name for name in named], rest):
        rows.filter(chosen).write.mode("append").parquet(root)
    return root


def lexicon(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    """``(version, surface, pos, cost)`` from the words of the benchmark texts.

    The old version lists every word, the new one only words used more than once, with
    another part of speech for long words."""
    words = (
        spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        .select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("surface"))
        .groupBy("surface")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    size = F.length("surface")
    old_pos = F.when(size <= 3, "short").otherwise("long")
    new_pos = F.when(size <= 3, "short").when(size <= 8, "long").otherwise("compound")
    cost = (size * 10).cast("bigint")
    old = words.select(F.lit("old").alias("version"), "surface", old_pos.alias("pos"), cost.alias("cost"))
    new = words.filter(F.col("uses") > 1).select(
        F.lit("new").alias("version"), "surface", new_pos.alias("pos"), cost.alias("cost")
    )
    return old.unionByName(new)


def lattice_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(surface, pos, cost, left_id, right_id)``: the benchmark's words, and their heads and tails, with
    costs by length. A surface may have several entries."""
    words = (
        spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        .select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
        .distinct()
    )
    parts = [
        # surface, part of speech, fixed cost, cost of a letter, contexts
        (F.col("w"), "word", 300, 30, 1, 1),
        (F.left("w", F.lit(3)), "head", 180, 20, 1, 2),
        (F.substring("w", 4, 1000), "tail", 90, 35, 2, 3),
        (F.right("w", F.lit(2)), "end", 120, 10, 3, 1),
    ]
    rows = [
        words.select(
            surface.alias("surface"),
            F.lit(pos).alias("pos"),
            (F.length(surface) * letter + fixed).cast("bigint").alias("cost"),
            F.lit(left).cast("bigint").alias("left_id"),
            F.lit(right).cast("bigint").alias("right_id"),
        )
        for surface, pos, fixed, letter, left, right in parts
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.filter("surface <> ''").distinct()


def lattice_connections(spark: SparkSession) -> DataFrame:
    """``(right_id, left_id, cost)`` of contexts 0 (edge) to 3."""
    ids = spark.range(16).select(F.expr("id div 4").alias("right_id"), F.expr("id % 4").alias("left_id"))
    return ids.withColumn("cost", (F.col("right_id") * 7 + F.col("left_id") * 5) % 4 * 60)
