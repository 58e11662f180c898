"""Dictionary lookup inside the row.

A dictionary of checked size is compiled into a table that tasks map (:mod:`lexdrift.operators.trie`). Token
arrays then get parts of speech and costs where they are: there is no token row, no join, no shuffle and no
state, so the lookup costs what a Python analyzer costs, and works in streams. Each distinct token of a
slice of an Arrow batch is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.operators.analyzers import SLOTS, LexiconAnalyzer
from lexdrift.operators.trie import TABLE_BYTES, SharedTable, Trie, build, packed_strings, unpacked_strings

FIELDS = tuple(f"{slot}_{part}" for slot in SLOTS for part in ("cost", "pos"))
RESULT = ", ".join(f"{f}: {'bigint' if f.endswith('cost') else 'array<string>'}" for f in FIELDS)
#: Sums of that many bits are added up in 64 bits without looking.
SAFE = 1 << 62
#: Tokens that are looked up at once.
SLICE_TOKENS = 1 << 18


def surface_bytes(analyzers: list[LexiconAnalyzer]) -> int:
    """Bytes of all surfaces and parts of speech that the versions list, from one pass over their rows."""
    total = 0
    for a in analyzers:
        size = F.coalesce(F.octet_length("surface"), F.lit(0)) + F.coalesce(F.octet_length("pos"), F.lit(0))
        total += a.lexicon.filter(F.col("version") == a.version).agg(F.sum(size).alias("n")).head()["n"] or 0
    return total


def fits_rows(analyzers: list[LexiconAnalyzer]) -> bool:
    return surface_bytes(analyzers) <= TABLE_BYTES


def share_lexicon(spark: SparkSession, words: DataFrame, analyzers: list[LexiconAnalyzer]) -> SharedTable:
    """Ship a dictionary of checked size. ``words``: surface and an entry ``e{n}`` (cost, pos) or NULL for each
    analyzer, without repeated surfaces."""
    rows = sorted(words.filter("surface is not null").collect(), key=lambda r: r["surface"])
    arrays = build([r["surface"] for r in rows])
    for n, analyzer in enumerate(analyzers):
        entries = [r[f"e{n}"] for r in rows]
        names = sorted({analyzer.unknown_pos, *(e["pos"] for e in entries if e and e["pos"] is not None)})
        number = {name: k for k, name in enumerate(names)}
        # The last entry is that of unknown words.
        costs = [analyzer.unknown_cost if e is None or e["cost"] is None else e["cost"] for e in entries]
        pos = [analyzer.unknown_pos if e is None or e["pos"] is None else e["pos"] for e in entries]
        arrays[f"cost{n}"] = np.array([*costs, analyzer.unknown_cost], "<i8").view("<i4")
        arrays[f"pos{n}"] = np.array([number[p] for p in [*pos, analyzer.unknown_pos]])
        arrays[f"names{n}"], arrays[f"offsets{n}"] = packed_strings(names)
    return SharedTable.share(spark, arrays, "lexicon")


def _row_sums(costs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of each row, and whether it fits 64 bits."""
    longest = int(np.diff(offsets).max(initial=0))
    largest = max(-int(costs.min(initial=0)), int(costs.max(initial=0)))
    if largest * longest < SAFE:
        upto = np.concatenate([[0], np.cumsum(costs)])  # differences are right even where the running sum wraps
        return upto[offsets[1:]] - upto[offsets[:-1]], np.ones(len(offsets) - 1, bool)
    sums = [sum(costs[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    fits = np.array([-(1 << 63) <= s < 1 << 63 for s in sums], bool)
    return np.array([s if ok else 0 for s, ok in zip(sums, fits)], np.int64), fits


def _slices(columns: tuple[pa.Array, ...]) -> Iterator[list[pa.Array]]:
    """The rows of token arrays in slices of about ``SLICE_TOKENS`` tokens, one row at least; a batch without rows is one."""
    counts = sum(pc.fill_null(c.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    group = np.cumsum(counts) // SLICE_TOKENS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
    for low, high in zip(cuts, cuts[1:]):
        yield [c.slice(low, high - low) for c in columns]


def looked_up_slices(
    arrays: dict[str, memoryview], chosen: dict[str, int], batches: Iterator[tuple[pa.Array, ...]]
) -> Iterator[pa.Array]:
    """Results of the rows of all batches, slice by slice: what is held at once depends on the tokens of a slice,
    not on those of a batch."""
    trie = Trie(arrays)
    costs = {n: np.frombuffer(arrays[f"cost{n}"], "<i8") for n in chosen.values()}
    pos = {n: np.frombuffer(arrays[f"pos{n}"], "<i4") for n in chosen.values()}
    names = {n: pa.array(unpacked_strings(arrays[f"names{n}"], arrays[f"offsets{n}"])) for n in chosen.values()}
    unknown = {n: len(costs[n]) - 1 for n in chosen.values()}
    for batch in batches:
        for columns in _slices(batch):
            fields: dict[str, list[pa.Array]] = {name: [] for name in chosen}
            for tokens in columns:
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(tokens.value_lengths(), 0).to_numpy())])
                found = tokens.flatten().dictionary_encode()
                places = np.fromiter(map(trie.find, found.dictionary.to_pylist()), np.int64, len(found.dictionary))
                places = places[found.indices.to_numpy()]
                bounds = pa.array(offsets, pa.int32())
                for name, n in chosen.items():
                    at = np.where(places < 0, unknown[n], places)
                    sums, fits = _row_sums(costs[n][at], offsets)
                    fields[name].append(pa.array(sums, mask=~fits))
                    fields[name].append(pa.ListArray.from_arrays(bounds, names[n].take(pa.array(pos[n][at]))))
            parts = [pa.StructArray.from_arrays(f, FIELDS) for f in fields.values()]
            yield pa.StructArray.from_arrays(parts, list(chosen))
            del fields, parts, found, places
            # Freed memory goes back to the system, as the process lives on and others work beside it.
            pa.default_memory_pool().release_unused()


def row_lookup(table: SharedTable, chosen: dict[str, int], tokens: list[Column]) -> Column:
    """Results of some analyzers, given as name -> number in the table, for the same ``tokens`` of both fields:
    STRUCT<name: STRUCT<costs and parts of speech>>. A cost that does not fit 64 bits is NULL."""
    schema = ", ".join(f"{name} struct<{RESULT}>" for name in chosen)

    def looked_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from looked_up_slices(table.arrays(), chosen, batches)

    looked_up.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    # Nondeterministic: evaluated once, and never copied into a filter.
    return F.arrow_udf(looked_up, schema).asNondeterministic()(*tokens)
