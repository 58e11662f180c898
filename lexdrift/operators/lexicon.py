"""Dictionary lookup for token streams, by shuffle.

For dictionaries too large to be looked up in the row (:mod:`lexdrift.operators.row_lexicon`): articles are dealt to
blocks of ``BLOCK_BYTES`` at most on average, every word of a block is a row that is joined with the dictionary, and the entries found
meet their block again, where each token takes its own. Words that occur often are one row in a block, and a
surface has as many rows as blocks at most. Where that is still too large a share of all rows, it
gets salts: no join key then holds more than ``1 / SLICES`` of the rows, and the dictionary grows by at most
``2 * SLICES`` rows. The list of salted surfaces has at most ``SLICES`` rows whatever the input. Texts are
shuffled to their blocks and once more to meet their results.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexdrift.operators.analyzers import (
    SLOTS,
    LexiconAnalyzer,
    tokenize,
)

#: No join key holds more than about this share of the tokens, or this many of them.
SLICES = 1_000
SLICE_ROWS = 50_000_000
# More positions than any text has.
FIELD_SPAN = 1 << 40
#: Titles and texts, in bytes, of a block of articles.
BLOCK_BYTES = 16 << 20
#: Sums of that many bits are added up in 64 bits without looking.
SAFE = 1 << 62


def dictionary(analyzers: list[LexiconAnalyzer]) -> DataFrame:
    """One row per surface, with an entry ``e{n}`` for each analyzer; the cheapest entry
    wins when a version lists a surface twice."""
    parts = [
        a.lexicon.filter(F.col("version") == a.version).select(
            F.lit(n).alias("n"), "surface", F.col("cost").cast("bigint").alias("cost"), "pos"
        )
        for n, a in enumerate(analyzers)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("surface").agg(
        *[
            F.min(F.when(F.col("n") == n, F.struct("cost", "pos"))).alias(f"e{n}")
            for n in range(len(analyzers))
        ]
    )


def _field(g: int, slot: int) -> int:
    """Number of a field: slot ``slot`` cut by pattern ``g``."""
    return g * len(SLOTS) + slot


def _token_rows(articles: DataFrame, key: str, patterns: list[str]) -> DataFrame:
    """``(key, at, surface)``: one row per token of every pattern in every slot; ``at`` is
    the field number followed by the position, as one sortable number.

    An article without tokens keeps one row with a NULL surface."""
    def numbered(g: int, s: int, slot: str) -> Column:
        start = F.lit(_field(g, s) * FIELD_SPAN).cast("bigint")
        return F.transform(
            tokenize(F.col(slot), patterns[g]),
            lambda t, i: F.struct((start + i).alias("at"), t.alias("surface")),
        )

    arrays = [
        numbered(g, s, slot) for g in range(len(patterns)) for s, slot in enumerate(SLOTS)
    ]
    return articles.select(key, F.explode_outer(F.concat(*arrays)).alias("t")).select(key, "t.*")


def _salted_sides(
    tokens: DataFrame, words: DataFrame, key: str, slices: int
) -> tuple[DataFrame, DataFrame]:
    """Tokens and dictionary with a ``salt`` column that bounds every join key."""
    counts = tokens.groupBy("surface").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    limit = F.least(total / slices, F.lit(float(SLICE_ROWS)))
    # Fewer than total / limit surfaces can each hold more than the limit: 1,000 below 5 * 10^10
    # tokens, 200,000 (some 12 MB) at 10^13.
    salted = F.broadcast(
        counts.filter(F.col("surface").isNotNull() & (F.col("n") > limit)).select(
            "surface", F.ceil(F.col("n") / limit).alias("salts")
        )
    )
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    # Articles without tokens match no word: they are spread over as many keys as a word could be.
    places = F.when(F.col("surface").isNull(), F.lit(slices).cast("bigint")).otherwise(salts)
    spread = F.pmod(F.xxhash64(F.col(key), F.col("at")), places)
    left = tokens.join(salted, "surface", "left").withColumn("salt", spread).drop("salts")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))
    right = words.join(salted, "surface", "left").withColumn("salt", copies).drop("salts")
    return left, right


def _salted_lookup(tokens: DataFrame, words: DataFrame, key: str, slices: int) -> DataFrame:
    left, right = _salted_sides(tokens, words, key, slices)
    return left.join(right, ["surface", "salt"], "left").drop("salt")


def lexicon_results(
    articles: DataFrame,
    analyzers: list[tuple[str, LexiconAnalyzer]],
    key: str = "seq",
    slices: int = SLICES,
) -> DataFrame:
    """``(key, <name>: STRUCT<title, text>, ...)``, one column per analyzer.

    ``key`` must be unique. Analyzers with the same pattern share their token rows."""
    models = [a for _, a in analyzers]
    patterns = list(dict.fromkeys(a.pattern for a in models))
    size = sum(F.coalesce(F.octet_length(slot), F.lit(0)) for slot in SLOTS)
    cores = articles.sparkSession.sparkContext.defaultParallelism
    # A task has about four blocks; few bytes are still dealt to all cores.
    blocks = max(8 * cores, -(-(articles.agg(F.sum(size)).head()[0] or 0) // BLOCK_BYTES))
    kept = articles.select(key, *SLOTS).withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    parted = kept.repartition(blocks // 4, "block")

    # Every word once for each block in which it occurs, not once for each time it occurs.
    words = _token_rows(parted, "block", patterns).select("block", "surface").where("surface is not null").distinct()
    words = words.withColumn("at", F.lit(0).cast("bigint"))
    entries = [f"e{n}" for n in range(len(models))]
    known = reduce(Column.__or__, [F.col(e).isNotNull() for e in entries])
    found = _salted_lookup(words, dictionary(models), "block", slices).where(known).select(
        F.col("block").alias("part"),
        "surface",
        *[c for n, m in enumerate(models) for c in (
            F.coalesce(F.col(f"e{n}.cost"), F.lit(m.unknown_cost).cast("bigint")).alias(f"cost{n}"),
            F.coalesce(F.col(f"e{n}.pos"), F.lit(m.unknown_pos)).alias(f"pos{n}"),
        )],
    )

    fields = {_field(g, s): tokenize(F.col(slot), p) for g, p in enumerate(patterns) for s, slot in enumerate(SLOTS)}
    texts = parted.select("block", key, *[tokens.alias(f"tokens_{f}") for f, tokens in fields.items()])
    results = [(n, s, _field(patterns.index(m.pattern), s)) for n, m in enumerate(models) for s in range(len(SLOTS))]
    run = _block_lookup(key, list(fields), results, [(m.unknown_cost, m.unknown_pos) for m in models])
    kinds = [articles.schema[key], *[T.StructField(f"tokens_{f}", T.ArrayType(T.StringType())) for f in fields]]
    for n, s, _ in results:
        kinds += [T.StructField(f"cost_{n}_{s}", T.LongType()), T.StructField(f"pos_{n}_{s}", T.ArrayType(T.StringType()))]
    looked = texts.groupBy("block").cogroup(found.groupBy("part")).applyInArrow(run, T.StructType(kinds))

    def result(n: int, s: int, field: int) -> Column:
        return F.struct(
            F.col(f"cost_{n}_{s}").alias("total_cost"), F.col(f"tokens_{field}").alias("terms"), F.col(f"pos_{n}_{s}").alias("pos")
        )

    return looked.select(
        key,
        *[
            F.struct(*[result(n, s, f).alias(SLOTS[s]) for m, s, f in results if m == n]).alias(name)
            for n, (name, _) in enumerate(analyzers)
        ],
    )


def _row_totals(costs: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Sum of each row; NULL where adding up leaves 64 bits."""
    longest = int(np.diff(offsets).max(initial=0))
    if max(-int(costs.min(initial=0)), int(costs.max(initial=0))) * longest < SAFE:
        upto = np.concatenate([[0], np.cumsum(costs)])  # differences are right even where the running sum wraps
        return pa.array(upto[offsets[1:]] - upto[offsets[:-1]])
    rows = [list(accumulate(costs[a:b].tolist(), initial=0)) for a, b in zip(offsets, offsets[1:])]
    return pa.array([r[-1] if all(-(1 << 63) <= x < 1 << 63 for x in r) else None for r in rows], pa.int64())


def _block_lookup(key: str, fields: list[int], results: list[tuple[int, int, int]], unknown: list[tuple[int, str]]):
    """The results of a block of articles from their tokens and the entries of the block's words. ``results``: number of
    the analyzer, slot and field."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        surfaces = words.column("surface").combine_chunks()
        out, places = {key: texts.column(key)}, {}
        for f in fields:
            tokens = out[f"tokens_{f}"] = texts.column(f"tokens_{f}").combine_chunks()
            offsets = np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            # Unknown words have the place behind the last one.
            found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=surfaces), len(surfaces))
            places[f] = offsets, found.to_numpy(zero_copy_only=False)
        for n, s, f in results:
            offsets, found = places[f]
            cost, pos = unknown[n]
            costs = np.append(words.column(f"cost{n}").to_numpy(), cost).astype(np.int64)
            tags = pa.concat_arrays([words.column(f"pos{n}").combine_chunks(), pa.array([pos], pa.string())])
            out[f"cost_{n}_{s}"] = _row_totals(costs[found], offsets)
            out[f"pos_{n}_{s}"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tags.take(pa.array(found)))
        return pa.table(out)

    run.__annotations__ = {"texts": pa.Table, "words": pa.Table, "return": pa.Table}
    return run


def attach_lexicon_results(
    articles: DataFrame,
    analyzers: list[tuple[str, LexiconAnalyzer]],
    key: str = "seq",
    slices: int = SLICES,
) -> DataFrame:
    """``articles`` with one result column per analyzer."""
    return articles.join(lexicon_results(articles, analyzers, key, slices), key)
