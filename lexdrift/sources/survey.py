"""A survey of a dump: its ranges, how each begins, and what can be read of it.

A page is cut at its end tag, but an end tag in a comment or a CDATA section ends nothing, and whether a place lies
in one depends on everything before it. So each range tells what it would do with each of the three states
in which it may begin - outside, in a comment, in CDATA - and these functions are composed along the file. Then
every range knows its state and its number of pages, and all of them can be read by themselves, gzip files
from their restart points.

The survey is a table, one row for each range, that is stored beside the dump and read again by later runs. It
also says what could not be read: a range that breaks off has a reason, and the later ranges of its file are lost with it.

Ranges begin behind the first ``>`` at or after their nominal start, where no mark can be cut in two. A page belongs to
the range that holds the end tag before it, so a reader goes on behind its range until a page ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.plans.workspace import stored
from lexdrift.sources import inflate
from lexdrift.sources.inflate import BrokenStream, RestartPoint
from lexdrift.sources.ranges import Source, bzip2_pieces, gzip_pieces, kind_of, plain_pieces

SPAN = 32 << 20
OUTSIDE, COMMENT, CDATA = range(3)
#: End of each kind of section.
ENDS = {COMMENT: b"-->", CDATA: b"]]>"}
ROWS_OUT = 64
#: Ranges of a task, and tasks that look through gzip files.
RANGES, FILE_TASKS = 16, 100_000

RANGE = "file string, n bigint, kind string, start bigint, end bigint, at bigint, bits bigint, window binary"
FOUND = "states array<int>, counts array<bigint>, read_to bigint, size bigint, reason string"
_RANGE_NAMES = [c.split()[0] for c in RANGE.split(", ")]
_RANGE_TYPES = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary()]


@dataclass(frozen=True)
class Range:
    """A range of a file: places in the file, or in the output of a gzip file, which is read from a restart point."""

    file: str
    n: int
    kind: str
    start: int
    end: int
    at: int = 0
    bits: int = 0
    window: bytes | None = None

    def pieces(self, read: Source) -> Iterator[tuple[bytes, bool, int]]:
        if self.kind == "gzip":
            return gzip_pieces(read, RestartPoint(self.at, self.bits, self.start, self.window), self.end)
        return (bzip2_pieces if self.kind == "bzip2" else plain_pieces)(read, self.start, self.end)


def _aligned(pieces: Iterator[tuple[bytes, bool, int]], first: bool) -> Iterator[tuple[bytes, bool]]:
    """Pieces of a range that begins and ends behind a ``>``."""
    begun, ended = first, False
    for data, beyond, _ in pieces:
        if not begun:
            if beyond:
                return
            at = data.find(b">")
            if at < 0:
                continue
            begun, data = True, data[at + 1 :]
        if beyond and not ended:
            at = data.find(b">") + 1
            yield data[:at] if at else data, False
            ended, data = at > 0, data[at:] if at else b""
        if data:
            yield data, beyond


def _closed(pieces: Iterator[tuple[bytes, bool]]) -> Iterator[tuple[bytes, bool, bool]]:
    """The same text in parts that end behind a ``>``, and what is left at the end of the file: (text, beyond, last)."""
    held, was = b"", False
    for data, beyond in pieces:
        if beyond and not was:  # what is held ended behind a ``>``, or the range is empty
            was = True
        at = data.rfind(b">") + 1
        if not at:
            held += data
            continue
        yield held + data[:at], was, False
        held = data[at:]
    yield held, was, True


class Lexer:
    """Follows comments, CDATA and end tags."""

    def __init__(self, page_tag: str):
        self.event = re.compile(rb"</" + re.escape(page_tag.encode()) + rb"\s*>|<!--|<!\[CDATA\[")

    def spans(self, text: bytes, state: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, state within, state after): stretches of one state with the mark that ends each; the
        state after is -1 behind an end tag, and that of the text's end for the last stretch."""
        at = 0
        while True:
            if state == OUTSIDE:
                found = self.event.search(text, at)
                if not found:
                    break
                mark = found.group()
                if mark.startswith(b"</"):
                    yield at, found.end(), OUTSIDE, -1
                    at = found.end()
                else:
                    yield at, found.start(), OUTSIDE, OUTSIDE
                    at, state = found.start(), COMMENT if mark == b"<!--" else CDATA
                    # The section's own start is skipped when its end is looked for.
                    yield at, found.end(), state, state
                    at = found.end()
            else:
                end = text.find(ENDS[state], at)
                if end < 0:
                    break
                yield at, end + 3, state, OUTSIDE
                at, state = end + 3, OUTSIDE
        yield at, len(text), state, state

    def advance(self, text: bytes, state: int) -> tuple[int, int]:
        """The state after a text, and the end tags in it."""
        tags = 0
        for _, _, _, after in self.spans(text, state):
            tags += after == -1
            state = OUTSIDE if after == -1 else after
        return state, tags


def _ranges_of(batch: pa.RecordBatch) -> Iterator[Range]:
    for n in range(batch.num_rows):
        yield Range(*(batch.column(name)[n].as_py() for name in _RANGE_NAMES))


def _look(part: Range, lexer: Lexer) -> tuple:
    """What a range does with each state: the states after it and the end tags in it; up to which place of the
    file it was read, the file's size, and why it could not be read on."""
    states, counts, reason, size = [OUTSIDE, COMMENT, CDATA], [0, 0, 0], None, None
    read_to = part.at if part.kind == "gzip" else part.start
    try:
        with Source(part.file) as read:
            size = read.size

            def inside() -> Iterator[tuple[bytes, bool, int]]:
                nonlocal read_to
                for data, beyond, at in part.pieces(read):
                    if not beyond:
                        read_to = at
                    yield data, beyond, at

            for text, beyond, _ in _closed(_aligned(inside(), part.n == 0)):
                if beyond:
                    break
                for k in range(3):
                    states[k], tags = lexer.advance(text, states[k])
                    counts[k] += tags
    except (BrokenStream, OSError) as error:
        reason = f"{type(error).__name__}: {error}"
    return states, counts, read_to, size, reason


def look_at(ranges: DataFrame, page_tag: str) -> DataFrame:
    """``ranges`` with what each does by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(page_tag)
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for n, part in enumerate(_ranges_of(batch)):
                found = _look(part, lexer)
                columns = [*batch.slice(n, 1).columns, *(pa.array([v], k) for v, k in zip(found, kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=[*_RANGE_NAMES, *(c.split()[0] for c in FOUND.split(", "))])

    return _spread(ranges).mapInArrow(run, f"{RANGE}, {FOUND}")


def _spread(ranges: DataFrame) -> DataFrame:
    """Ranges dealt to tasks, each a unit of work of known size, so that a task has about ``RANGES`` of them at most."""
    n = ranges.count()
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism * 4, -(-n // RANGES))
    return ranges.repartitionByRange(tasks, "file", "n") if n > 1 else ranges


def compose(looked: DataFrame, begun: dict[str, int] | None = None) -> DataFrame:
    """The state in which each range begins, its pages, the pages before it in its file, and whether it is lost
    with a broken range before it. One group for each file, with one row for each range. ``begun``: states
    of files whose first ranges here are not their first."""
    begun = begun or {}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        now, before, lost = begun.get(table.column("file")[0].as_py(), OUTSIDE), 0, False
        rows = []
        for states, counts, reason in zip(*(table.column(c).to_pylist() for c in ("states", "counts", "reason"))):
            rows.append((now, 0 if lost else counts[now], before, lost))
            before += 0 if lost else counts[now]
            now, lost = states[now], lost or reason is not None
        for name, kind, values in zip(("state", "pages", "before", "lost"), (pa.int32(), pa.int64(), pa.int64(), pa.bool_()), zip(*rows)):
            table = table.append_column(name, pa.array(values, kind))
        return table

    schema = f"{RANGE}, {FOUND}, state int, pages bigint, before bigint, lost boolean"
    return looked.groupBy("file").applyInArrow(run, schema)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, size) of all files; nothing of them is read."""
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("size"))


def _cut(files: DataFrame, span: int) -> DataFrame:
    """Ranges of plain and bzip2 files."""
    starts = F.expr(f"sequence(0L, greatest(size - 1, 0), {span}L)")
    rows = files.select("file", "kind", "size", F.posexplode(starts).alias("n", "start"))
    return rows.select(
        "file",
        F.col("n").cast("bigint").alias("n"),
        "kind",
        "start",
        F.least(F.col("start") + span, F.col("size")).alias("end"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("at", "bits")],
        F.lit(None).cast("binary").alias("window"),
    )


def gzip_ranges(file: str, span: int, first: Range | None = None, most: int | None = None) -> Iterator[Range]:
    """Ranges of the output of a gzip file between restart points; the last one goes on to the end, or to
    where the file breaks off. With ``most`` so many at most and then, with the end -1, where to go on as ``first``."""
    last = RestartPoint(first.at, first.bits, first.start, first.window) if first else RestartPoint(0, 0, 0, None)
    n = first.n if first else 0
    size = 1 << 62
    if inflate.can_restart():
        with Source(file) as read:
            try:
                for found in inflate.restart_points(read, span, last):
                    if isinstance(found, int):
                        size = found
                    else:
                        yield Range(file, n, "gzip", last.out, found.out, last.at, last.bits, last.window)
                        last, n, most = found, n + 1, most and most - 1
                        if most == 0:
                            yield Range(file, n, "gzip", last.out, -1, last.at, last.bits, last.window)
                            return
            except (BrokenStream, OSError):
                pass  # told when the range is looked at
    yield Range(file, n, "gzip", last.out, size, last.at, last.bits, last.window)


def ranges_frame(ranges: Iterable[Range]) -> pa.RecordBatch:
    rows = [[getattr(r, name) for name in _RANGE_NAMES] for r in ranges]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _RANGE_TYPES)], names=_RANGE_NAMES)


def _gzip_files(files: DataFrame, span: int) -> DataFrame:
    """Ranges of gzip files: each is read once from end to end, by a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for found in gzip_ranges(file, span):
                    yield ranges_frame([found])

    # Rows are dealt one by one: by their hash, or as few bytes, several names would come to one task.
    names = files.select("file")
    n = min(names.count(), FILE_TASKS)
    return (names.repartitionByRange(n, "file") if n > 1 else names).mapInArrow(run, RANGE)


def survey_pages(
    spark: SparkSession, paths: str | list[str], page_tag: str = "page", span: int = SPAN, folder: str | None = None
) -> DataFrame:
    """The stored survey of a dump; ``folder`` keeps it for later runs (:func:`load_survey`)."""
    kind = F.when(F.endswith("file", F.lit(".bz2")), "bzip2").when(F.endswith("file", F.lit(".gz")), "gzip").otherwise("plain")
    files = stored(list_files(spark, paths).withColumn("kind", kind), "files")
    packed = F.col("kind") == "gzip"
    ranges = stored(_cut(files.filter(~packed), span).unionByName(_gzip_files(files.filter(packed), span)), "ranges")
    return stored(compose(look_at(ranges, page_tag)), "survey", folder)


def load_survey(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def broken_files(survey: DataFrame) -> DataFrame:
    """(file, bytes_read, bytes_there, reason) of the files that could not be read to their end."""
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("n", "reason")))["reason"]
    read = F.max(F.when(~F.col("lost"), F.col("read_to")))
    found = survey.groupBy("file").agg(read.alias("bytes_read"), F.max("size").alias("bytes_there"), first.alias("reason"))
    return found.filter("reason is not null")


def _pages(part: Range, state: int, lexer: Lexer, salvage: bool) -> Iterator[bytes]:
    """The pages of a range without their end tags, comments left out."""
    page: list[bytes] | None = [] if part.n == 0 else None  # None: before the range's first end tag
    try:
        with Source(part.file) as read:
            for text, beyond, last in _closed(_aligned(part.pieces(read), part.n == 0)):
                for start, end, within, after in lexer.spans(text, state):
                    if page is not None and within != COMMENT:
                        page.append(text[start:end])
                    if after == -1:
                        if page is not None:
                            page[-1] = page[-1][: page[-1].rindex(b"</")]
                            yield b"".join(page)
                        if beyond:
                            return
                        page, state = [], OUTSIDE
                    else:
                        state = after
                if beyond and page is None:
                    return
                if last and page is not None:
                    yield b"".join(page)
    except (BrokenStream, OSError):
        if not salvage:
            raise
        if page is not None:
            yield b"".join(page)


def read_surveyed(survey: DataFrame, page_tag: str = "page", skip_broken_files: bool = False) -> DataFrame:
    """(seq, page) of a surveyed dump, each range read by itself; see :func:`lexdrift.sources.dump.read_pages`. Files
    that break off stop the job, or give what was readable before."""
    pattern = re.compile(rb"<" + re.escape(page_tag.encode()) + rb"[\s>]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(page_tag)
        for batch in batches:
            states = batch.column("state").to_pylist()
            for part, state in zip(_ranges_of(batch), states):
                idx, pages = 0, []

                def out() -> pa.RecordBatch:
                    places = range(idx - len(pages), idx)
                    columns = [pa.array([part.file] * len(pages)), pa.array([part.start] * len(pages), pa.int64())]
                    columns += [pa.array(places, pa.int64()), pa.array(pages, pa.binary())]
                    return pa.RecordBatch.from_arrays(columns, names=["file", "block", "idx", "page"])

                for text in _pages(part, state, lexer, skip_broken_files):
                    # Text with NUL characters is no XML in UTF-8 and comes out whole.
                    start = pattern.search(text)
                    if b"\0" in text or start:
                        pages.append(text if b"\0" in text else text[start.start() :])
                        idx += 1
                    if len(pages) == ROWS_OUT:
                        yield out()
                        pages = []
                if pages:
                    yield out()

    chosen = _spread(survey.filter(~F.col("lost")).select(*_RANGE_NAMES, "state"))
    rows = chosen.mapInArrow(run, "file string, block bigint, idx bigint, page binary")
    # The bytes as a string, as the text source gives them.
    return rows.select(F.struct("file", "block", "idx").alias("seq"), F.col("page").cast("string").alias("page"))


def can_open(file: str) -> bool:
    """Whether Python can read files of this store by place."""
    try:
        with Source(file):
            return True
    except Exception:  # an unknown store, or one whose driver is missing
        return False


class _Runs:
    """Ranges of files in path order, handed out in runs of a wanted number."""

    def __init__(self, spark: SparkSession, files: list[tuple[str, int]], span: int):
        self.spark, self.files, self.span = spark, sorted(files), span
        self.open: list[Range] = []  # of the file at hand; a gzip file's last one is where to go on

    def _gzip(self, first: Range, most: int) -> list[Range]:
        """Found by a task of its own, for a gzip file is read in order."""
        span = self.span

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _ranges_of(batch):
                    yield ranges_frame(gzip_ranges(part.file, span, part, most))

        rows = frame_of(self.spark, [first]).mapInArrow(run, RANGE).collect()
        return [Range(**r.asDict()) for r in rows]

    def take(self, most: int) -> list[Range]:
        """The next ranges, of one gzip file or of several others; none at the end."""
        out: list[Range] = []
        while len(out) < most and (self.open or self.files):
            if not self.open:
                file, size = self.files[0]
                kind = kind_of(file)
                if kind == "gzip":
                    if out:
                        return out
                    self.open = [Range(file, 0, kind, 0, -1)]
                else:
                    starts = range(0, max(size, 1), self.span)
                    self.open = [Range(file, n, kind, at, min(at + self.span, size)) for n, at in enumerate(starts)]
                self.files = self.files[1:]
            if self.open[0].kind == "gzip":
                found = self._gzip(self.open[0], most)
                self.open = [r for r in found if r.end == -1]
                return [r for r in found if r.end != -1]
            n = most - len(out)
            out += self.open[:n]
            self.open = self.open[n:]
        return out

    def give_up(self, file: str) -> None:
        """Leave out the rest of a broken file."""
        if self.open and self.open[0].file == file:
            self.open = []


def frame_of(spark: SparkSession, ranges: list[Range]) -> DataFrame:
    rows = [tuple(bytearray(v) if isinstance(v, bytes) else v for v in (getattr(r, n) for n in _RANGE_NAMES)) for r in ranges]
    return spark.createDataFrame(rows, RANGE)


def leading_pages(
    spark: SparkSession,
    files: list[tuple[str, int]],
    wanted: int,
    finish: Callable[[DataFrame], DataFrame],
    counted: Column | None = None,
    page_tag: str = "page",
    span: int = SPAN,
    skip_broken_files: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """What ``finish`` makes of the pages of the first ranges that hold ``wanted`` records, and the survey of these
    ranges. ``files``: (file, size).

    Ranges are read in runs of 1, 2, 4, ... until there are enough records, so that at most about twice
    as many as needed are read. Each run is stored; the driver holds the ranges of one run."""
    runs, size, found, parts, seen, begun = _Runs(spark, files, span), 1, 0, [], [], {}
    while found < wanted and (ranges := runs.take(size)):
        survey = stored(compose(look_at(frame_of(spark, ranges), page_tag), begun), "survey")
        rows = stored(finish(read_surveyed(survey, page_tag, skip_broken_files)), "leading")
        found += (rows if counted is None else rows.filter(counted)).count()
        parts.append(rows)
        seen.append(survey)
        after = {}
        for r in survey.select("file", "n", "state", "states", "lost", "reason").orderBy("file", "n").collect():
            after[r["file"]] = r["states"][r["state"]]
            if r["lost"] or r["reason"] is not None:
                runs.give_up(r["file"])
        begun, size = after, size * 2
    if not parts:
        empty = frame_of(spark, [])
        survey = compose(look_at(empty, page_tag))
        return finish(read_surveyed(survey, page_tag)), survey
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, seen)
