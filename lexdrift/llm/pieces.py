"""Token ids of pieces of text, each distinct piece tokenized once and the frequent ones kept."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a process keeps, and how many are tokenized at a time.
KEPT, CHUNK = 1 << 19, 1 << 13


class PieceIds:
    """Ids of pieces by ``encode``, which takes texts and gives a list of ids for each. Beyond ``kept``
    pieces the less used half is forgotten."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], kept: int = KEPT):
        self.encode, self.kept = encode, kept
        self.known = pa.array([], pa.large_binary())
        self.values, self.first, self.used = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int32)

    @staticmethod
    def of_process(key: str, make: Callable[[], PieceIds]) -> PieceIds:
        """What this worker process holds under a key; later tasks go on with it."""
        held = sys.modules.setdefault("lexdrift pieces", ModuleType("lexdrift pieces")).__dict__
        if key not in held:
            held[key] = make()
        return held[key]

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each (large_binary) piece; the ids of piece ``k`` are ``values[first[k]:first[k + 1]]``."""
        if len(self.known) > self.kept:
            self._forget()
        pieces = pieces.dictionary_encode()
        places = pc.index_in(pieces.dictionary, value_set=self.known)
        unknown = places.is_null().to_numpy(zero_copy_only=False)
        places = places.fill_null(0).to_numpy().astype(np.int64)
        if unknown.any():
            new = pieces.dictionary.filter(pa.array(unknown))
            places[unknown] = len(self.known) + np.arange(len(new))
            self._learn(new)
        self.used[places] += 1
        return places[pieces.indices.to_numpy()], self.values, self.first

    def _learn(self, new: pa.Array) -> None:
        values, sizes = [self.values], [np.diff(self.first)]
        for low in range(0, len(new), CHUNK):
            texts = [t.decode("utf-8", "replace") for t in new.slice(low, CHUNK).to_pylist()]
            lists = self.encode(texts)
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            values.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes[-1].sum())))
        self.known = pa.concat_arrays([self.known, new])
        self.values = np.concatenate(values)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])

    def _forget(self) -> None:
        stay = np.sort(np.argpartition(-self.used, self.kept // 2)[: self.kept // 2])
        sizes = np.diff(self.first)[stay]
        upto = np.cumsum(sizes)
        self.values = self.values[np.repeat(self.first[stay] - (upto - sizes), sizes) + np.arange(upto[-1])]
        self.first = np.concatenate([[0], upto])
        self.known, self.used = self.known.take(pa.array(stay)), self.used[stay] // 2


def joined(codes: np.ndarray, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces one after the other, and the end of each."""
    lengths = (first[1:] - first[:-1])[codes]
    upto = np.cumsum(lengths)
    shift = first[:-1][codes]
    shift -= upto
    shift += lengths
    at = np.repeat(shift, lengths)
    at += np.arange(len(at))
    return values[at], upto


def whole_tokenizer(path: str):
    """A tokenizer file as the tokenizers library reads it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters below it are composed and have lower-case forms that do not depend on their neighbours.
LATIN = "\u0130"
#: Pieces by which a shortcut is held against the whole tokenizer.
PROBES = ("Word", "word,", "ETRE.", "\u00eatre", "Stra\u00dfe,", "\u00c9t\u00e9s", "antidisestablishmentarianism.", "a", "\u00fe", "x,")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as
    the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(others)}


class Encode:
    """Ids of pieces by the whole tokenizer; a word of Latin letters, with a blank before it or not, is one
    pre-token and goes to the vocabulary's model at once, and so does it before a stop or comma. Held
    against the whole tokenizer with probes: a file for which this does not hold takes no shortcut."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.letters = _byte_letters()
        self.blank = chr(self.letters[32])
        self.stops = dict(zip(".,", self.whole([".", ","])))
        probes = [*PROBES, *(f" {p}" for p in PROBES)]
        self.keeps_case = [self.short(p, True) for p in probes] == self.whole(probes)
        self.usable = self.keeps_case or [self.short(p, False) for p in probes if p[0] != " "] == self.whole(list(PROBES))

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def short(self, text: str, keeps_case: bool) -> list[int] | None:
        """The ids of a word of Latin letters, None for other pieces."""
        stop = text[-1:] if text[-1:] in (".", ",") else ""
        core = text[:-1] if stop else text
        blank = ""
        if keeps_case and core[:1] == " ":
            core, blank = core[1:], self.blank
        if not core.isalpha():
            return None
        if not core.isascii():
            if max(core) >= LATIN:
                return None
            core = (core if keeps_case else core.lower()).encode().decode("latin-1").translate(self.letters)
        elif not keeps_case:
            core = core.lower()
        ids = [t.id for t in self.model.tokenize(blank + core)]
        return ids + self.stops[stop] if stop else ids

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if not self.usable:
            return self.whole(texts)
        keeps_case = self.keeps_case
        out = [self.short(text, keeps_case) for text in texts]
        rest = [n for n, ids in enumerate(out) if ids is None]
        for n, ids in zip(rest, self.whole([texts[n] for n in rest])):
            out[n] = ids
        return out
