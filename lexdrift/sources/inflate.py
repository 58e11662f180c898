"""Reading gzip from within: restart points of a deflate stream.

A deflate stream can be read on from the start of any of its blocks by whoever knows the bit at which it begins
and the 32 kB of output before it. The zlib library stops at block starts and takes such a state back; it
is called directly, since Python's own module does neither. Without a zlib library there are no restart
points, and a gzip file is one piece.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

WINDOW = 32 << 10
INPUT = 256 << 10
OUTPUT = 1 << 20
# Fixed values of the zlib interface.
Z_NO_FLUSH, Z_BLOCK = 0, 5
Z_OK, Z_STREAM_END, Z_BUF_ERROR = 0, 1, -5
RAW, GZIP = -15, 31
AT_BLOCK, IN_LAST_BLOCK, UNUSED_BITS = 128, 64, 7
TRAILER = 8


class BrokenStream(Exception):
    """A compressed stream that cannot be read on."""


class _Stream(ctypes.Structure):
    _fields_ = [
        ("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong),
        ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong),
        ("msg", ctypes.c_char_p), ("state", ctypes.c_void_p),
        ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p), ("opaque", ctypes.c_void_p),
        ("data_type", ctypes.c_int), ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong),
    ]


@cache
def _library() -> ctypes.CDLL | None:
    for name in (ctypes.util.find_library("z"), "libz.so.1", "libz.dylib"):
        try:
            found = ctypes.CDLL(name) if name else None
        except OSError:
            continue
        if found is not None and hasattr(found, "inflatePrime"):
            found.zlibVersion.restype = ctypes.c_char_p
            return found
    return None


def can_restart() -> bool:
    return _library() is not None


@dataclass(frozen=True)
class RestartPoint:
    """Where to read on: byte of the file, bits of the byte before it that belong to the rest, place in the
    output, and the output before it. Without a window the point is the start of a gzip member."""

    at: int
    bits: int
    out: int
    window: bytes | None


class _Inflater:
    def __init__(self, mode: int):
        self.library, self.stream, self.open = _library(), _Stream(), True
        size = ctypes.c_int(ctypes.sizeof(_Stream))
        self._check(self.library.inflateInit2_(ctypes.byref(self.stream), ctypes.c_int(mode), self.library.zlibVersion(), size))
        self.out = ctypes.create_string_buffer(OUTPUT)

    def _check(self, code: int) -> int:
        if code not in (Z_OK, Z_STREAM_END, Z_BUF_ERROR):
            raise BrokenStream((self.stream.msg or b"broken deflate stream").decode())
        return code

    def restore(self, point: RestartPoint, before: int) -> None:
        s = ctypes.byref(self.stream)
        if point.bits:
            self._check(self.library.inflatePrime(s, ctypes.c_int(point.bits), ctypes.c_int(before >> (8 - point.bits))))
        if point.window:
            self._check(self.library.inflateSetDictionary(s, point.window, ctypes.c_uint(len(point.window))))

    def run(self, data: bytes, flush: int) -> tuple[bytes, int, bool]:
        """Output, how much of the input was taken, and whether the stream has ended."""
        held = ctypes.create_string_buffer(data, len(data))
        s = self.stream
        s.next_in, s.avail_in = ctypes.addressof(held), len(data)
        s.next_out, s.avail_out = ctypes.addressof(self.out), OUTPUT
        code = self._check(self.library.inflate(ctypes.byref(s), ctypes.c_int(flush)))
        return ctypes.string_at(self.out, OUTPUT - s.avail_out), len(data) - s.avail_in, code == Z_STREAM_END

    def close(self) -> None:
        if self.open:
            self.library.inflateEnd(ctypes.byref(self.stream))
            self.open = False


def read_from(
    read: Callable[[int, int], bytes], point: RestartPoint, flush: int = Z_NO_FLUSH
) -> Iterator[tuple[bytes, int, int | None]]:
    """Output from a restart point to the end of the file, member after member. ``read`` gives bytes by place
    and number. Each item has some output, the place in the file up to which it was read, and the unused bits there
    if a block starts (only with ``flush=Z_BLOCK``; -1 stands for the start of a member)."""
    at = point.at
    inflater = _Inflater(GZIP if point.window is None else RAW)
    raw = point.window is not None
    try:
        if raw:
            inflater.restore(point, read(at - 1, 1)[0] if point.bits else 0)
        data, used = read(at, INPUT), 0
        while True:
            if used == len(data):
                at, data, used = at + used, read(at + used, INPUT), 0
                if not data:
                    raise BrokenStream("the file ends inside a gzip stream")
            # What lies behind the output buffer comes with the next call.
            out, taken, ended = inflater.run(data[used : used + INPUT], flush)
            used += taken
            kind = inflater.stream.data_type
            start = kind & UNUSED_BITS if flush == Z_BLOCK and kind & AT_BLOCK and not kind & IN_LAST_BLOCK else None
            if not ended:
                yield out, at + used, start
                continue
            inflater.close()
            after = at + used + (TRAILER if raw else 0)
            if len(read(after - 1, 1)) < 1:
                raise BrokenStream("the file ends inside a gzip stream")
            data, used, at = read(after, INPUT), 0, after
            yield out, after, -1 if data[:2] == b"\x1f\x8b" else None
            if data[:2] != b"\x1f\x8b":
                if data.strip(b"\0"):
                    raise BrokenStream("no gzip member where one should begin")
                return
            inflater, raw = _Inflater(GZIP), False
    finally:
        inflater.close()


def restart_points(
    read: Callable[[int, int], bytes], span: int, first: RestartPoint = RestartPoint(0, 0, 0, None)
) -> Iterator[RestartPoint | int]:
    """Points behind the first one, at least ``span`` bytes of output apart, and at the end the size of the output.

    :class:`BrokenStream` leaves the points found so far to be used."""
    done = last = first.out
    window = first.window or b""
    for out, at, start in read_from(read, first, Z_BLOCK):
        done += len(out)
        window = (window + out)[-WINDOW:]
        if start is not None and done - last >= span:
            yield RestartPoint(at, max(start, 0), done, None if start < 0 else window)
            last = done
    yield done


def without_restarts(read: Callable[[int, int], bytes]) -> Iterator[tuple[bytes, int, None]]:
    """Output of a whole gzip file by Python's own module."""
    at, engine = 0, zlib.decompressobj(GZIP)
    while data := read(at, INPUT):
        at += len(data)
        while data:
            try:
                out = engine.decompress(data)
            except zlib.error as error:
                raise BrokenStream(str(error)) from None
            data = engine.unused_data
            yield out, at - len(data), None
            if engine.eof:
                if not data.strip(b"\0") and not read(at, 1):
                    return
                engine = zlib.decompressobj(GZIP)
    if not engine.eof:
        raise BrokenStream("the file ends inside a gzip stream")
