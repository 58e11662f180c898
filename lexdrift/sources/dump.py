"""MediaWiki page dumps (plain, gzip or bzip2 XML).

Records are cut at the closing page tag by the text source, so a plain or bzip2
dump is read by as many tasks as it has splits; the XML of each page is then
parsed where it lies. The built-in XML source would read a whole file in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.functions.text import (
    ascii_trim,
    is_admin_title,
    normalize_text,
    split_annotation,
)
from lexdrift.sources.spread import spread

PAGE_TAG = "page"

# ``revision`` is an array because a page may carry several of them.
PAGE_SCHEMA = (
    "title STRING, id STRING, "
    "revision ARRAY<STRUCT<timestamp: STRING, text: STRING>>, "
    "_corrupt_record STRING"
)
XML_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    "ignoreSurroundingSpaces": "false",
    "ignoreNamespace": "true",
}

# Fixed value: revision time format.
REVISION_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# A comment, which may go on in the next chunk, or a CDATA section to be left as it is.
COMMENT = r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?(?:-->|\z)"

_ROW_BITS = (1 << 33) - 1


def read_pages(
    spark: SparkSession,
    path: str | list[str],
    strict: bool = False,
    admin_pages: bool = True,
    page_tag: str = PAGE_TAG,
    skip_broken_files: bool = False,
) -> DataFrame:
    """``(seq, page)`` with the XML of one page per row, the last one without its end.

    ``page_tag`` is the tag as written, with its prefix if the dump uses one.

    ``seq`` is the file, the offset of its split and the running number in the task;
    within a split the running number follows the file. A file that cannot be read to
    its end (truncated archive, failing store) stops the job; only with
    ``skip_broken_files``, and never if ``strict``, it yields what was readable before.
    End tags may hold blanks; comments outside CDATA are removed
    first (of several pages in one comment only the first one). Text with NUL
    characters is no XML in UTF-8 (another encoding, as a rule) and comes out as a page that
    cannot be parsed. ``admin_pages=False`` leaves out what :func:`drop_admin_pages` recognizes."""
    paths = [path] if isinstance(path, str) else path
    lines = (
        spark.read.option("lineSep", f"</{page_tag}>")
        .option("ignoreCorruptFiles", str(skip_broken_files and not strict).lower())
        .text(paths)
    )
    file = F.col("_metadata.file_path")
    gzip = F.endswith(file, F.lit(".gz"))
    packed, plain = (_cut_pages(lines.filter(kind), page_tag) for kind in (gzip, ~gzip))
    if not admin_pages:
        packed, plain = drop_admin_pages(packed, page_tag), drop_admin_pages(plain, page_tag)
    # One task reads a whole gzip file, however large, so these are spread by themselves.
    if not packed.rdd.getNumPartitions():
        return spread(plain)
    return spread(packed).unionAll(spread(plain)) if plain.rdd.getNumPartitions() else spread(packed)


def _chunks(lines: DataFrame, page_tag: str) -> DataFrame:
    """``(file, block, value)`` of lines that end at the closing page tag, without comments."""
    meta, value = F.col("_metadata"), F.col("value")
    bare = F.when(F.contains(value, F.lit("<!--")), F.regexp_replace(value, COMMENT, "$1")).otherwise(value)
    return lines.select(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("block"),
        # Most chunks hold one page; an end tag written with blanks leaves several together.
        F.explode(F.split(bare, rf"</{page_tag}\s+>")).alias("value"),
    )


def _pages(chunks: DataFrame, page_tag: str, idx) -> DataFrame:
    """``(seq, page)`` of the chunks that hold a page."""
    value = F.col("value")
    page = F.when(F.contains(value, F.lit("\0")), value).otherwise(
        F.regexp_extract(value, rf"(?s)<{page_tag}[\s>].*", 0)
    )
    return chunks.select(F.struct("file", "block", idx.alias("idx")).alias("seq"), page.alias("page")).filter(
        F.col("page") != ""
    )


def _cut_pages(lines: DataFrame, page_tag: str) -> DataFrame:
    """``(seq, page)`` of lines that end at the closing page tag."""
    idx = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    return _pages(_chunks(lines, page_tag), page_tag, idx)


def stream_pages(
    spark: SparkSession, path: str, page_tag: str = PAGE_TAG, files_per_trigger: int = 1000
) -> DataFrame:
    """``(seq, page)`` of the dump files that arrive in a folder; see :func:`read_pages`. A file must arrive whole.

    A stream has no running numbers, so every task counts the pieces of its splits as they pass."""
    lines = (
        spark.readStream.option("lineSep", f"</{page_tag}>")
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idx = None, 0
        for batch in batches:
            numbers = []
            for here in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, idx = (here, 0) if here != place else (place, idx + 1)
                numbers.append(idx)
            columns = [*batch.columns, pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "value", "idx"])

    # Values may be no UTF-8: they pass as bytes.
    chunks = _chunks(lines, page_tag).withColumn("value", F.col("value").cast("binary"))
    numbered = chunks.mapInArrow(number, "file string, block bigint, value binary, idx bigint")
    return _pages(numbered.withColumn("value", F.col("value").cast("string")), page_tag, F.col("idx"))


def drop_admin_pages(pages: DataFrame, page_tag: str = PAGE_TAG) -> DataFrame:
    """Drop pages with a colon in the raw title before their XML is parsed.

    Only a shortcut: the parsed title is tested again in :func:`to_articles`. Pages
    with comments or CDATA, where raw text may look like a title, are left to that."""
    page = F.col("page")
    plain = ~F.contains(page, F.lit("<![CDATA[")) & ~F.contains(page, F.lit("<!--"))
    prefix = page_tag.removesuffix(PAGE_TAG)
    raw_title = F.regexp_extract(page, rf"<{prefix}title[^>]*>([^<]*)", 1)
    return pages.filter(~(plain & F.contains(raw_title, F.lit(":"))))


def parse_pages(pages: DataFrame, page_tag: str = PAGE_TAG) -> DataFrame:
    """``(seq, title, id, timestamp, text, _corrupt_record)``, values as written.

    Elements are matched by local name. The last revision that has the element wins. ``inline`` keeps the XML parse a
    single step that later filters cannot duplicate."""
    xml = F.concat(F.col("page"), F.lit(f"</{page_tag}>"))
    options = {"rowTag": page_tag, **XML_OPTIONS}
    parsed = pages.select("seq", F.inline(F.array(F.from_xml(xml, PAGE_SCHEMA, options))))

    def last(field: str):
        values = F.filter(F.col(f"revision.{field}"), lambda v: v.isNotNull())
        return F.try_element_at(values, F.lit(-1)).alias(field)

    return parsed.select("seq", "title", "id", last("timestamp"), last("text"), "_corrupt_record")


def parse_revision_time(text, strict: bool = False):
    """UTC wall clock of a revision; NULL, or an error if ``strict``, when malformed."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    fmt = REVISION_TIME if strict else F.lit(REVISION_TIME)
    return parse(text, fmt).cast("timestamp_ntz")


def to_articles(parsed: DataFrame, strict: bool = False, keep_rejects: bool = False) -> DataFrame:
    """Cleaned articles; rejected XML and administrative pages are left out.

    With ``keep_rejects`` a rejected page stays as a row that has nothing but its place and
    the start of its XML in a further column ``reject``, which is NULL for articles. With ``strict`` a rejected page or a malformed time stops the job instead."""
    if strict:
        reject = F.raise_error(F.concat(F.lit("malformed page: "),
                                        F.left(F.col("_corrupt_record"), F.lit(200))))
        intact = F.when(F.col("_corrupt_record").isNull(), F.lit(True)).otherwise(
            reject.cast("boolean"))
    else:
        intact = F.col("_corrupt_record").isNull()
    reject = [F.left("_corrupt_record", F.lit(200)).alias("reject")] if keep_rejects else []
    rows = parsed if keep_rejects and not strict else parsed.filter(intact)
    kept = rows.select(
        "seq",
        *reject,
        ascii_trim(F.col("id")).alias("id"),
        ascii_trim(F.col("title")).alias("full_title"),
        normalize_text(F.col("text")).alias("text"),
        parse_revision_time(ascii_trim(F.col("timestamp")), strict).alias("last_modified"),
    )
    title, annotation = split_annotation(F.col("full_title"))
    article = ~is_admin_title(F.col("full_title"))
    if not keep_rejects:
        return kept.filter(article).select(
            "seq", "id", title.alias("title"), annotation.alias("title_annotation"), "text", "last_modified"
        )

    def intact_only(value):
        return F.when(F.col("reject").isNull(), value)

    return kept.filter(F.col("reject").isNotNull() | article).select(
        "seq",
        intact_only(F.col("id")).alias("id"),
        intact_only(title).alias("title"),
        intact_only(annotation).alias("title_annotation"),
        intact_only(F.col("text")).alias("text"),
        intact_only(F.col("last_modified")).alias("last_modified"),
        "reject",
    )


def rejected_pages(parsed: DataFrame) -> DataFrame:
    """``(seq, record)`` of pages whose XML could not be parsed."""
    return parsed.filter(F.col("_corrupt_record").isNotNull()).select(
        "seq", F.col("_corrupt_record").alias("record")
    )


def read_articles(
    spark: SparkSession,
    path: str | list[str],
    strict: bool = False,
    page_tag: str = PAGE_TAG,
    skip_broken_files: bool = False,
    keep_rejects: bool = False,
) -> DataFrame:
    """Articles of a dump, ready for analysis. Empty text is kept."""
    pages = read_pages(spark, path, strict, False, page_tag, skip_broken_files)
    return to_articles(parse_pages(pages, page_tag), strict, keep_rejects)


def articles_of_pages(
    pages: DataFrame, strict: bool = False, page_tag: str = PAGE_TAG, keep_rejects: bool = False
) -> DataFrame:
    """The same of pages that were read otherwise (:mod:`lexdrift.sources.survey`)."""
    return to_articles(parse_pages(drop_admin_pages(pages, page_tag), page_tag), strict, keep_rejects)
