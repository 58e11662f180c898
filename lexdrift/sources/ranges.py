"""Reading files by ranges: plain, bzip2 and gzip bytes from the middle of a file.

A reader gives a range as pieces of decompressed bytes, and then, for the record that the range leaves open, what
follows it. Ranges of plain and bzip2 files are places in the file; a bzip2 block belongs to the range in which
it begins, and is found by its mark, which may begin at any bit. Ranges of gzip files are places in their output, read
from restart points (:mod:`lexdrift.sources.inflate`).
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from lexdrift.sources import inflate
from lexdrift.sources.inflate import BrokenStream, RestartPoint

PIECE = 1 << 20
# Fixed values of the bzip2 format: marks of a block and of the end of a stream.
BLOCK_MARK, END_MARK = 0x314159265359, 0x177245385090
MARK_BITS = 48
STREAM_HEAD = b"BZh9"
#: A block is tried with up to so many of the marks after it, as a mark may occur in data by chance.
TRIES = 4


class Source:
    """Random access to a file."""

    def __init__(self, uri: str):
        parts = urlparse(uri)
        if parts.scheme in ("", "file"):
            path = uri.removeprefix("file:")
            self.file = open("/" + path.lstrip("/") if parts.scheme else path, "rb")  # noqa: SIM115
            self.size = self.file.seek(0, 2)
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            self.file = store.open_input_file(unquote(path))
            self.size = self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def kind_of(path: str) -> str:
    """By suffix, as Spark does."""
    return {"bz2": "bzip2", "gz": "gzip"}.get(path.rsplit(".", 1)[-1], "plain")


def plain_pieces(read: Source, start: int, end: int) -> Iterator[tuple[bytes, bool, int]]:
    """(bytes, whether they lie behind the range, place in the file after them)."""
    at = start
    while at < end:
        data = read(at, min(PIECE, end - at))
        if not data:
            return
        at += len(data)
        yield data, False, at
    while data := read(at, PIECE):
        at += len(data)
        yield data, True, at


def mark_places(data: bytes, mark: int) -> list[int]:
    """Bits at which a mark begins."""
    found = []
    for shift in range(8):
        # The whole bytes of the mark when it begins at this bit of a byte.
        inner = (mark >> (shift or 8)) & ((1 << 40) - 1)
        middle, skip = inner.to_bytes(5, "big"), 8 if not shift else 8 - shift
        if not shift:
            middle, skip = mark.to_bytes(6, "big"), 0
        at = data.find(middle)
        while at >= 0:
            bit = 8 * at - skip if shift else 8 * at
            if bit >= 0 and _bits(data, bit, MARK_BITS) == mark:
                found.append(bit)
            at = data.find(middle, at + 1)
    return sorted(found)


def _bits(data: bytes, start: int, n: int) -> int:
    """Bits of data as a number; missing ones are zero."""
    low, high = start >> 3, (start + n + 7) >> 3
    part = data[low:high]
    value = int.from_bytes(part + b"\0" * (high - low - len(part)), "big")
    return (value >> ((high << 3) - start - n)) & ((1 << n) - 1)


def _block(data: bytes, start: int, end: int) -> bytes:
    """The text of one block, as a stream of its own."""
    n = end - start
    checksum = _bits(data, start + MARK_BITS, 32)
    bits = n + MARK_BITS + 32
    whole = (_bits(data, start, n) << (MARK_BITS + 32)) | END_MARK << 32 | checksum
    pad = -bits % 8
    return bz2.decompress(STREAM_HEAD + (whole << pad).to_bytes((bits + pad) // 8, "big"))


def bzip2_pieces(read: Source, start: int, end: int) -> Iterator[tuple[bytes, bool, int]]:
    """Blocks whose mark begins in the range, then those behind it."""
    base, held, marks, at = start, b"", [], start
    searched = 0  # bytes of ``held`` in which marks were looked for
    whole_file = False
    while True:
        # Enough to see the block's end: the next mark, and some more if that one is not real.
        while len(marks) < 2 and not whole_file:
            data = read(at, 4 * PIECE)
            whole_file = not data
            at += len(data)
            held += data
            low = max(0, searched - 8)
            known = {m for m, _ in marks}
            for mark in (BLOCK_MARK, END_MARK):
                places = ((8 * low + m, mark) for m in mark_places(held[low:], mark))
                marks += [p for p in places if p[0] not in known and p[0] >= 8 * low]
            marks = sorted(set(marks))
            searched = len(held)
        if not marks:
            if start == 0 and read.size:
                raise BrokenStream("no bzip2 block")
            return
        place, mark = marks[0]
        beyond = 8 * base + place >= 8 * end
        if mark == END_MARK:
            marks.pop(0)
            if len(marks) == 0 and whole_file:
                return
            continue
        if len(marks) < 2:
            raise BrokenStream("the file ends inside a bzip2 block")
        for k in range(1, min(len(marks), 1 + TRIES)):
            try:
                text = _block(held, place, marks[k][0])
                break
            except (OSError, ValueError, EOFError):
                continue
        else:
            raise BrokenStream("a broken bzip2 block")
        after = marks[k][0]
        yield text, beyond, base + (after + 7) // 8
        drop = after >> 3
        held, base, searched = held[drop:], base + drop, searched - drop
        marks = [(m - 8 * drop, kind) for m, kind in marks[k:]]


def gzip_pieces(read: Source, point: RestartPoint, end: int) -> Iterator[tuple[bytes, bool, int]]:
    """Output from a restart point, parted at the place ``end`` of the output."""
    done = point.out
    restart = point.at > 0 or point.window is not None or inflate.can_restart()
    stream = inflate.read_from(read, point) if restart else inflate.without_restarts(read)
    for out, at, _ in stream:
        inside = out[: max(0, end - done)]
        if inside:
            yield inside, False, at
        if len(out) > len(inside):
            yield out[len(inside) :], True, at
        done += len(out)
