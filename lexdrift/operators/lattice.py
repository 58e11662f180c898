"""Segmentation by a dictionary with path costs.

A text is parted at white space into runs. All dictionary words that begin at a place of a run, found by
one walk through a double-array trie, are nodes of a lattice; where none begins, the longest stretch of one
kind of character (letters, digits, or one other character) is an unknown word. The words of a run are
those on the cheapest path, where a path costs the sum of its word costs and of the connection costs
between the right context of each word and the left context of the next; context 0 is the edge of a run.

Ties are defined: of equally cheap paths the one of fewest words is taken, and among those the words are
compared from the last to the first, where the smaller start, then the earlier dictionary entry wins. A
word's cost in the result is its own and its connection to the word before, the last word's also the one to
the edge, so that the total cost of a field is the cost of its paths.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.operators.analyzers import PythonAnalyzer
from lexdrift.operators.trie import ROOT, SharedTable, Trie, build, check_size, packed_strings, unpacked_strings

#: Contexts of a connection table, and segmentations of runs that a process keeps.
CONTEXTS, KEPT_RUNS = 4096, 100_000
#: Letters of a run that is segmented together with others, and letters that are at work at once.
RUN_LETTERS, LETTERS = 1024, 1 << 18
#: Bits that hold the number of a context, and the largest cost of an unknown word that leaves room for them.
CONTEXT_BITS, LARGEST_UNKNOWN = 12, 1 << 38
ENTRY = ("surface", "pos", "cost", "left_id", "right_id")
#: Costs are kept in 32 bits, far from their ends.
LARGEST_COST = 1 << 30


@dataclass(frozen=True)
class UnknownWords:
    """What a word outside the dictionary costs, and how it connects."""

    pos: str = "unknown"
    cost: int = 10_000
    letter_cost: int = 0
    left_id: int = 0
    right_id: int = 0


def _kind(letter: str) -> str:
    kind = unicodedata.category(letter)[0]
    return kind if kind in "LN" else ""


class Segmenter:
    """The cheapest paths of runs, from mapped tables."""

    def __init__(self, arrays: dict[str, memoryview], unknown: UnknownWords):
        self.trie, self.unknown = Trie(arrays), unknown
        self.first, self.cost = arrays["first"], arrays["cost"]
        self.left, self.right, self.pos = arrays["left"], arrays["right"], arrays["pos"]
        self.connection, self.width = arrays["connection"], arrays["contexts"][0]
        self.names = unpacked_strings(arrays["pos_data"], arrays["pos_offsets"])
        self.kept: dict[str, list[tuple[str, str, int]]] = {}

    def __call__(self, text: str) -> Iterator[tuple[str, str, int]]:
        for run in text.split():
            found = self.kept.get(run)
            if found is None:
                found = self.segment(run)
                if len(run) < 64:
                    if len(self.kept) >= KEPT_RUNS:
                        self.kept.clear()
                    self.kept[run] = found
            yield from found

    def nodes(self, run: str, codes: list[int], at: int) -> list[tuple[int, int, int, int, int]]:
        """(end, entry, cost, left context, right context) of the words that may begin at a place; entry -1
        is the unknown word."""
        found = []
        for end, word in self.trie.prefixes(codes, at):
            for entry in range(self.first[word], self.first[word + 1]):
                found.append((end, entry, self.cost[entry], self.left[entry], self.right[entry]))
        if not found:
            end, kind = at + 1, _kind(run[at])
            while kind and end < len(run) and _kind(run[end]) == kind:
                end += 1
            u = self.unknown
            found.append((end, -1, u.cost + u.letter_cost * (end - at), u.left_id, u.right_id))
        return found

    def segment(self, run: str) -> list[tuple[str, str, int]]:
        codes, connection, width = self.trie.codes(run), self.connection, self.width
        # Paths that end at a place: (cost, words, start, entry, right context, path before).
        ending: list[list[tuple]] = [[] for _ in range(len(run) + 1)]
        ending[0].append((0, 0, 0, -1, 0, None))
        for at in range(len(run)):
            before = ending[at]
            if not before:
                continue
            # Only the best path of each right context can go on.
            best: dict[int, tuple] = {}
            for path in before:
                held = best.get(path[4])
                if held is None or path[:4] < held[:4]:
                    best[path[4]] = path
            paths = list(best.values())
            for end, entry, cost, left, right in self.nodes(run, codes, at):
                chosen = key = None
                for path in paths:
                    new = (path[0] + connection[path[4] * width + left], *path[1:4])
                    if key is None or new < key:
                        chosen, key = path, new
                ending[end].append((key[0] + cost, key[1] + 1, at, entry, right, chosen))
            ending[at] = []
        chosen = key = None
        for path in ending[len(run)]:
            new = (path[0] + connection[path[4] * width], *path[1:4])
            if key is None or new < key:
                chosen, key = path, new
        return self._words(run, chosen, key[0])

    def _words(self, run: str, path: tuple, upto: int) -> list[tuple[str, str, int]]:
        """Words of a path from its last one, whose cost with the edge is what ``upto`` leaves."""
        words, end = [], len(run)
        while path[5] is not None:
            before = path[5]
            pos = self.names[self.pos[path[3]]] if path[3] >= 0 else self.unknown.pos
            words.append((run[path[2] : end], pos, upto - before[0]))
            upto, end, path = before[0], path[2], before
        return words[::-1]


class BatchSegmenter(Segmenter):
    """The same paths for many texts at once: each distinct run of a batch is segmented once, and all runs go on
    letter by letter together, as arrays."""

    def __init__(self, arrays: dict[str, memoryview], unknown: UnknownWords):
        super().__init__(arrays, unknown)
        names = ("base", "check", "value", "first", "cost", "left", "right", "pos", "connection")
        self.tables = {name: np.frombuffer(arrays[name], "<i4") for name in names}
        self.pos_names = pa.array([*self.names, unknown.pos], pa.string())
        dearest = abs(unknown.cost) + RUN_LETTERS * abs(unknown.letter_cost)
        self.letters = RUN_LETTERS if dearest < LARGEST_UNKNOWN else 0

    def results(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Total cost, words and parts of speech of each text."""
        index: dict[str, int] = {}
        ids: list[int] = []
        upto = [0]
        for text in texts:
            ids += [index.setdefault(run, len(index)) for run in text.split()] if text else []
            upto.append(len(ids))
        start, count, cost, surfaces, pos = self.segment_all(list(index))
        which, bounds = np.array(ids, np.int64), np.array(upto)
        counts = count[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        words = np.repeat(start[which] - ends[:-1], counts) + np.arange(ends[-1])
        totals = np.concatenate([[0], np.cumsum(cost[which])])
        if int(np.abs(cost).max(initial=0)) * len(which) >= 1 << 62:
            raise OverflowError("a total cost may not fit 64 bits")
        offsets = pa.array(ends[bounds], pa.int32())
        terms = pa.ListArray.from_arrays(offsets, surfaces.take(pa.array(words)))
        tags = pa.ListArray.from_arrays(offsets, self.pos_names.take(pa.array(pos[words])))
        return pa.array(totals[bounds[1:]] - totals[bounds[:-1]]), terms, tags

    def segment_all(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of each run its first word, number of words and cost; the words, and their parts of speech by number."""
        start, count, cost = (np.zeros(len(runs), np.int64) for _ in range(3))
        surfaces, pos, done = [pa.array([], pa.string())], [np.zeros(0, np.int64)], 0
        number = {name: n for n, name in reversed(list(enumerate(self.names)))}
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        order = np.argsort(sizes, kind="stable")  # runs of like lengths go together
        short = order[sizes[order] <= self.letters]
        group = np.cumsum(sizes[short]) // LETTERS
        for some in np.split(short, np.flatnonzero(np.diff(group)) + 1) if len(short) else []:
            counts, costs, words, tags = self._together([runs[k] for k in some])
            count[some], cost[some] = counts, costs
            start[some] = done + np.cumsum(counts) - counts
            surfaces.append(words)
            pos.append(tags)
            done += len(tags)
        for k in order[sizes[order] > self.letters].tolist():
            found = self.segment(runs[k])
            start[k], count[k], cost[k] = done, len(found), sum(c for _, _, c in found)
            surfaces.append(pa.array([w for w, _, _ in found], pa.string()))
            pos.append(np.array([number.get(name, len(self.names)) for _, name, _ in found], np.int64))
            done += len(found)
        return start, count, cost, pa.concat_arrays(surfaces), np.concatenate(pos)

    def _edges(self, letters: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, entry, cost, left context, right context) of all words that may begin at any place."""
        t, unknown = self.tables, self.unknown
        used, which = np.unique(letters, return_inverse=True)
        codes = np.array([self.trie.code.get(chr(c), 0) for c in used.tolist()], np.int64)[which]
        kinds = np.array([("", "L", "N").index(_kind(chr(c))) for c in used.tolist()], np.int64)[which]
        at, node, depth, hits = np.arange(len(letters)), np.full(len(letters), ROOT, np.int64), 0, []
        while len(at):
            inside = at + depth < end_of[at]
            at, node = at[inside], node[inside]
            code = codes[at + depth]
            after = t["base"][node] + code
            known = (code > 0) & (after < len(t["check"]))
            known[known] = t["check"][after[known]] == node[known]
            at, node, depth = at[known], after[known], depth + 1
            words = t["value"][node].astype(np.int64)
            hit = words >= 0
            hits.append(np.stack([at[hit], at[hit] + depth, words[hit]]))
        start, end, word = np.concatenate(hits, axis=1)
        many = (t["first"][word + 1] - t["first"][word]).astype(np.int64)
        entry = np.repeat(t["first"][word] - np.cumsum(many) + many, many) + np.arange(many.sum())
        start, end = np.repeat(start, many), np.repeat(end, many)
        none = np.ones(len(letters), bool)
        none[start] = False
        none = np.flatnonzero(none)
        # The stretch of one kind of character from each place on.
        follows = np.arange(1, len(letters) + 1)
        last = (follows == end_of) | (kinds == 0) | (kinds != np.append(kinds[1:], 0))
        stretch = np.minimum.accumulate(np.where(last, follows, len(letters))[::-1])[::-1][none]
        price = unknown.cost + unknown.letter_cost * (stretch - none)
        parts = [
            (start, none), (end, stretch), (entry, np.full(len(none), -1)), (t["cost"][entry], price),
            (t["left"][entry], np.full(len(none), unknown.left_id)), (t["right"][entry], np.full(len(none), unknown.right_id)),
        ]
        return tuple(np.concatenate(part).astype(np.int64) for part in parts)

    def _together(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Number of words and cost of each run; words and numbers of parts of speech, run after run."""
        text = "".join(runs)
        letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        begins = np.cumsum(sizes) - sizes
        run_of = np.repeat(np.arange(len(runs)), sizes)
        start, end, entry, cost, left, right = self._edges(letters, (begins + sizes)[run_of])
        connection, width = self.tables["connection"].astype(np.int64), self.width
        run = run_of[start]
        # Edges by the place in their run at which they begin, and at which they end.
        steps = np.arange(int(sizes.max()) + 2)
        leaving = np.argsort(start - begins[run], kind="stable")
        leaves = np.searchsorted((start - begins[run])[leaving], steps)
        arriving = np.argsort(end - begins[run], kind="stable")
        arrives = np.searchsorted((end - begins[run])[arriving], steps)
        # Of the best path that ends with an edge: its cost, its words (0: there is none), the edge before.
        total, n_words, before = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.full(len(start), -1)
        final, final_cost = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)

        first = leaving[: leaves[1]]
        total[first], n_words[first] = connection[left[first]] + cost[first], 1
        for step in steps[1:-1]:
            states = arriving[arrives[step] : arrives[step + 1]]
            states = states[n_words[states] > 0]
            if not len(states):
                continue
            # Only the best path of each right context can go on. Among those the order of equal costs is a rank.
            by = np.lexsort((entry[states], start[states], n_words[states], total[states], right[states], run[states]))
            states = states[by]
            new = np.append(True, (np.diff(run[states]) != 0) | (np.diff(right[states]) != 0))
            states = states[new]
            states = states[np.lexsort((entry[states], start[states], n_words[states], run[states]))]
            low = np.searchsorted(run[states], np.arange(len(runs)))
            high = np.searchsorted(run[states], np.arange(len(runs)), side="right")
            edges = leaving[leaves[step] : leaves[step + 1]]
            edges = edges[high[run[edges]] > low[run[edges]]]
            ended = np.flatnonzero((sizes == step) & (high > low))
            for targets, at, context in ((edges, run[edges], left[edges]), (ended, ended, np.zeros(len(ended), np.int64))):
                if not len(targets):
                    continue
                many = high[at] - low[at]
                opens = np.cumsum(many) - many
                rank = np.arange(many.sum()) - np.repeat(opens, many)
                chosen = states[np.repeat(low[at], many) + rank]
                key = total[chosen] + connection[right[chosen] * width + np.repeat(context, many)]
                best = np.minimum.reduceat((key << CONTEXT_BITS) | rank, opens)
                key, chosen = best >> CONTEXT_BITS, states[low[at] + (best & ((1 << CONTEXT_BITS) - 1))]
                if targets is ended:
                    final[ended], final_cost[ended] = chosen, key
                else:
                    total[edges], n_words[edges], before[edges] = key + cost[edges], n_words[chosen] + 1, chosen

        path, now = [], final
        while len(now):
            path.append(now)
            now = before[now]
            now = now[now >= 0]
        words = np.concatenate(path)
        words = words[np.argsort(start[words])]  # the words of the runs lie side by side
        width_of = 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)
        places = np.concatenate([[0], np.cumsum(width_of)])
        offsets = np.append(places[start[words]], places[-1]).astype(np.int32)
        surfaces = pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.encode()))
        chosen = entry[words]
        tags = np.full(len(words), len(self.names), np.int64)
        tags[chosen >= 0] = self.tables["pos"][chosen[chosen >= 0]]
        return np.bincount(run[words], minlength=len(runs)), final_cost, surfaces, tags


def _entries(dictionary: DataFrame) -> list:
    """The rows of a dictionary of checked size, in the order that numbers its entries."""
    rows = dictionary.select(
        F.col("surface"), F.col("pos"), *[F.col(c).cast("bigint").alias(c) for c in ENTRY[2:]]
    ).filter(F.length("surface") > 0)
    size = rows.agg(F.sum(F.octet_length("surface") + F.coalesce(F.octet_length("pos"), F.lit(0))).alias("n")).head()["n"]
    check_size(size or 0, "the dictionary")
    found = [tuple(r) for r in rows.distinct().collect()]
    return sorted(found, key=lambda r: (r[0], r[2], r[3], r[4], r[1] or ""))


def lattice_arrays(dictionary: DataFrame, connections: DataFrame) -> dict[str, np.ndarray]:
    """The tables of a segmenter. ``dictionary``: (surface, pos, cost, left_id, right_id), repeated rows count
    once; ``connections``: (right_id, left_id, cost), from the right context of a word to the left
    context of the next. A pair that is not listed costs nothing; of a pair listed twice the cheapest counts."""
    entries = _entries(dictionary)
    surfaces = sorted({r[0] for r in entries})
    place = {s: n for n, s in enumerate(surfaces)}
    first = np.zeros(len(surfaces) + 1, np.int64)
    np.add.at(first, [place[r[0]] + 1 for r in entries], 1)
    names = sorted({r[1] or "" for r in entries})
    number = {name: n for n, name in enumerate(names)}
    ids = connections.agg(F.max(F.greatest("right_id", "left_id")).alias("n"), F.min(F.least("right_id", "left_id")).alias("low")).head()
    used = [ids["n"] or 0, *(max(r[3], r[4]) for r in entries)]
    if min(ids["low"] or 0, *(min(r[3], r[4]) for r in entries), 0) < 0 or max(used) >= CONTEXTS:
        raise ValueError(f"contexts are numbers from 0 to {CONTEXTS - 1}")
    width = max(used) + 1
    connection = np.zeros((width, width), np.int64)
    pairs = connections.groupBy("right_id", "left_id").agg(F.min(F.col("cost").cast("bigint")).alias("cost"))
    for r in pairs.collect():  # a row for each pair of contexts at most
        connection[r["right_id"], r["left_id"]] = r["cost"]
    cost = np.array([r[2] for r in entries], np.int64)
    if max(np.abs(cost).max(initial=0), np.abs(connection).max(initial=0)) >= LARGEST_COST:
        raise ValueError(f"costs of a dictionary lie within {LARGEST_COST}")
    data, offsets = packed_strings(names)
    return {
        **build(surfaces),
        "first": np.cumsum(first),
        "cost": cost,
        "left": np.array([r[3] for r in entries]),
        "right": np.array([r[4] for r in entries]),
        "pos": np.array([number[r[1] or ""] for r in entries]),
        "pos_data": data,
        "pos_offsets": offsets,
        "connection": connection.ravel(),
        "contexts": np.array([width]),
    }


def lattice_analyzer(
    name: str,
    dictionary: DataFrame,
    connections: DataFrame,
    unknown: UnknownWords | None = None,
    components: tuple[str, ...] = (),
) -> PythonAnalyzer:
    """An analyzer that segments by a dictionary; its tables are compiled and shipped now, and mapped by
    the tasks. Works wherever a Python analyzer does, in streams too."""
    unknown = unknown or UnknownWords()
    arrays = lattice_arrays(dictionary, connections)
    if not 0 <= min(unknown.left_id, unknown.right_id) <= max(unknown.left_id, unknown.right_id) < arrays["contexts"][0]:
        raise ValueError("the contexts of unknown words are not in the connection table")
    table = SharedTable.share(dictionary.sparkSession, arrays, "lattice")

    def factory() -> Callable[[str], Iterator[tuple[str, str, int]]]:
        return BatchSegmenter(table.arrays(), unknown)

    return PythonAnalyzer(name, factory, components)
