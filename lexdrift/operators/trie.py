"""Word tables that every task maps from one file.

A double-array trie finds all words of a table that begin at a place of a text: node ``n`` goes on
with letter ``c`` to node ``base[n] + c`` if that node's ``check`` is ``n``. The arrays lie in one file that Spark
ships to each machine once (``addFile``); the Python processes of a machine map it and share its pages, so
a table costs no Python objects and no copy for each process.

The file is made on the driver, as a broadcast would be, and its size is checked: ``TABLE_BYTES`` of
surfaces at most.
"""

from __future__ import annotations

import json
import mmap
import os
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from types import ModuleType
from uuid import uuid4

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Surfaces of a table, as UTF-8.
TABLE_BYTES = 64 << 20
ROOT = 1


def build(words: Sequence[str]) -> dict[str, np.ndarray]:
    """Arrays of the trie of distinct words in code-point order; a word's value is its place. An empty
    word is never found."""
    alphabet = sorted(set().union(*map(set, words))) if words else []
    code = {letter: n for n, letter in enumerate(alphabet, 1)}
    size = max(64, 2 * len(alphabet) + 2)
    base, check, value = (np.zeros(size, np.int32) for _ in range(3))
    value -= 1
    check[:2] = -1  # 0 is no node, 1 is the root
    free = 2
    work = [(ROOT, 0, len(words), 0)]  # node, its words, letters read
    while work:
        node, low, high, depth = work.pop()
        if low < high and len(words[low]) == depth:
            value[node] = low if depth else -1
            low += 1
        children, at = [], low
        while at < high:
            letter = words[at][depth]
            end = at + 1
            while end < high and words[end][depth] == letter:
                end += 1
            children.append((code[letter], at, end))
            at = end
        if not children:
            continue
        codes = np.array([c for c, _, _ in children])
        while free < len(check) and check[free]:
            free += 1
        start = max(1, free - int(codes[0]))
        while True:
            need = start + int(codes[-1]) + 1
            if need > len(check):
                more = max(need, 2 * len(check)) - len(check)
                base, check = (np.concatenate([a, np.zeros(more, np.int32)]) for a in (base, check))
                value = np.concatenate([value, np.full(more, -1, np.int32)])
            if not check[start + codes].any():
                break
            start += 1
        base[node] = start
        check[start + codes] = node
        work += [(start + c, a, b, depth + 1) for c, a, b in children]
    used = int(np.flatnonzero(check)[-1]) + 1
    letters = np.array([ord(a) for a in alphabet], np.int32)
    return {"base": base[:used], "check": check[:used], "value": value[:used], "letters": letters}


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """32-bit arrays one after the other, behind a line that names them."""
    head = json.dumps({name: len(a) for name, a in arrays.items()}).encode()
    with open(path, "wb") as out:
        out.write(len(head).to_bytes(4, "little") + head + b"\0" * (-len(head) % 4))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a, "<i4").tobytes())


def map_arrays(path: str) -> dict[str, memoryview]:
    """Views of the arrays; nothing is read before it is looked at."""
    with open(path, "rb") as file:
        view = memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    size = int.from_bytes(view[:4], "little")
    at = 4 + size + -size % 4
    out = {}
    for name, n in json.loads(bytes(view[4 : 4 + size])).items():
        out[name] = view[at : at + 4 * n].cast("i")
        at += 4 * n
    return out


class Trie:
    """Lookups in mapped arrays."""

    def __init__(self, arrays: dict[str, memoryview]):
        self.base, self.check, self.value = arrays["base"], arrays["check"], arrays["value"]
        self.code = {chr(letter): n for n, letter in enumerate(arrays["letters"], 1)}

    def codes(self, text: str) -> list[int]:
        """The letters of a text by their numbers; 0 for those that no word has."""
        return [self.code.get(c, 0) for c in text]

    def prefixes(self, codes: list[int], at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of all words that begin at a place, shortest first."""
        base, check, value, node = self.base, self.check, self.value, ROOT
        size = len(check)
        for end in range(at, len(codes)):
            code = codes[end]
            after = base[node] + code
            if not code or after >= size or check[after] != node:
                return
            node = after
            if value[node] >= 0:
                yield end + 1, value[node]

    def find(self, word: str) -> int:
        """The value of a word, -1 if there is none."""
        found = -1
        for end, value in self.prefixes(self.codes(word), 0):
            if end == len(word):
                found = value
        return found


@dataclass(frozen=True)
class SharedTable:
    """A table file that Spark has shipped to the machines."""

    name: str

    @staticmethod
    def share(spark: SparkSession, arrays: dict[str, np.ndarray], label: str) -> SharedTable:
        """Write the arrays to the driver's folder of shipped files and have them shipped."""
        name = f"lexdrift-{label}-{uuid4().hex}.table"
        folder = os.path.join(SparkFiles.getRootDirectory(), "tables")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, name)
        write_arrays(path, arrays)
        spark.sparkContext.addFile(path)
        return SharedTable(name)

    def arrays(self) -> dict[str, memoryview]:
        """The arrays as this process maps them, once."""
        held = sys.modules.setdefault("lexdrift tables", ModuleType("lexdrift tables")).__dict__
        if self.name not in held:
            held[self.name] = map_arrays(SparkFiles.get(self.name))
        return held[self.name]


def check_size(n_bytes: int, what: str) -> None:
    if n_bytes > TABLE_BYTES:
        raise ValueError(f"{what} has {n_bytes} bytes of surfaces; tables that tasks map hold {TABLE_BYTES}")


def packed_strings(values: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as 32-bit words of UTF-8 and the offsets of each."""
    raw = [v.encode() for v in values]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    if offsets[-1] >= 1 << 31:
        raise ValueError("strings of a table have more than 2 GB")
    data = b"".join(raw)
    return np.frombuffer(data + b"\0" * (-len(data) % 4), "<i4"), offsets.astype(np.int32)


def unpacked_strings(data: memoryview, offsets: memoryview) -> list[str]:
    raw = bytes(data)
    return [raw[a:b].decode() for a, b in zip(offsets, offsets[1:])]
