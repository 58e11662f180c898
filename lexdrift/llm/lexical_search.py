"""Ranked lexical search: the best documents of each item of a query set, exactly.

Documents are searched in shards. A shard cuts the posting list of every term into blocks of documents
that resemble each other, and stores for each block the largest impact of every coordinate that can matter
(the terms of the items that hold the list's term). The inner product of an item with that summary bounds
the scores of the block's documents, so blocks are visited by falling bound, and the first bound below the
item's current last place ends the search. Documents of visited blocks get their exact score. A task goes
from shard to shard with the best documents so far, so later shards skip nearly all blocks, and tasks emit
only those.

A document's vector holds its terms of the query set. Impacts, weights and scores are integers; the largest
possible score is checked to fit, so that nothing is rounded. Items are searched in groups of about
``GROUP_TERMS`` terms: what is broadcast and a shard's matrix are bounded whatever the number of items.

Defined cases: null and empty texts have no terms, are no documents and get no results; null document
ids follow the others among equal scores; rows with a repeated document id are documents of their own; rows
of one item id are items of their own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.llm.arrow import byte_slices
from lexdrift.plans.workspace import stored

BEST = 10
GROUP_TERMS = 1 << 14
#: Documents of a block, and numbers of a shard's matrix.
BLOCK, MATRIX = 32, 1 << 23
#: Directions onto which vectors are projected to compare them.
SKETCH = 16
#: Blocks that are scored at a time.
STEP = 8
TEXT_BYTES = 32 << 20
#: Documents that a task searches.
TASK_DOCUMENTS = 8192

#: Bytes of text: letters and digits stay, A-Z as a-z, all of UTF-8 above ASCII stays, others part terms.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, one after the other, and the row of each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    data = (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes().translate(FOLD)
    folded = pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(data), None, 0, texts.offset)
    lists = pc.ascii_split_whitespace(folded)
    terms, rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    held = pc.not_equal(terms, "").to_numpy(zero_copy_only=False)
    return terms.filter(pa.array(held)), rows[held]


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times): ``item`` tells rows apart."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, rows = terms_of(batch.column(2))
            found = pa.table({"row": rows, "term": terms.cast(pa.string())})
            found = found.group_by(["row", "term"]).aggregate([([], "count_all")]).combine_chunks()
            for part in found.to_batches():
                of = part.column("row")
                columns = [batch.column(0).take(of), batch.column(1).take(of), part.column("term"), part.column("count_all")]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint"), "text")
    return rows.mapInArrow(counted, "item bigint, item_id bigint, term string, times bigint")


def term_vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: how many terms it has, places in the vocabulary
    and occurrences of those found there. ``vocabulary`` has no repeats and travels with the job."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(vocabulary, pa.large_string()), max(1, len(vocabulary))
        for batch in batches:
            for some in byte_slices(batch, 1, TEXT_BYTES):
                terms, rows = terms_of(some.column(1))
                n = np.bincount(rows, minlength=some.num_rows)
                found = pc.index_in(terms, value_set=known)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                keys = rows[hit] * size + found.drop_null().to_numpy()
                keys, tfs = np.unique(keys, return_counts=True)
                offsets = np.searchsorted(keys, np.arange(some.num_rows + 1) * size)
                offsets = pa.array(offsets, pa.int32())
                columns = [
                    some.column(0),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys % size, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
                ]
                made = pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])
                yield made.filter(pc.greater(made.column("n"), 0))

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(vectors, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


@dataclass
class Queries:
    """Items as integer vectors over a vocabulary: places and weights of each."""

    places: list[np.ndarray]
    weights: list[np.ndarray]
    vocabulary: int

    def __post_init__(self):
        self.holders: list[list[int]] = [[] for _ in range(self.vocabulary)]
        for item, places in enumerate(self.places):
            for term in places.tolist():
                self.holders[term].append(item)

    def coordinates(self, term: int) -> np.ndarray:
        """Terms of the items that hold a term."""
        return np.unique(np.concatenate([self.places[item] for item in self.holders[term]]))


class Best:
    """The best documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.nulls = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a score must reach to count."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        enough = scores >= self.least
        if enough.any():
            scores = np.concatenate([self.scores, scores[enough]])
            ids, nulls = np.concatenate([self.ids, ids[enough]]), np.concatenate([self.nulls, nulls[enough]])
            order = np.lexsort([ids, nulls, -scores])[: self.k]
            self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


class Shard:
    """Documents as rows of a matrix of impacts, with blocked posting lists."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, queries: Queries):
        self.ids, self.nulls, self.queries = ids, nulls, queries
        rows = np.repeat(np.arange(len(ids)), np.diff(offsets))
        self.matrix = np.zeros((len(ids), queries.vocabulary), np.int32)
        self.matrix[rows, terms] = impacts
        # Near documents have near projections, whatever their lengths.
        directions = np.random.default_rng(queries.vocabulary).standard_normal((queries.vocabulary, SKETCH), np.float32)
        sketches = np.zeros((len(ids), SKETCH), np.float32)
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            sketches[filled] = np.add.reduceat(directions[terms] * impacts[:, None].astype(np.float32), offsets[filled])
        self.sketches = sketches / np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1e-9)
        by_term = np.argsort(terms, kind="stable")
        self.postings = rows[by_term]
        self.bounds = np.searchsorted(terms[by_term], np.arange(queries.vocabulary + 1))

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a posting list, ordered by block, and where blocks begin."""
        docs = self.postings[self.bounds[term] : self.bounds[term + 1]]
        if len(docs) <= BLOCK:
            return docs, np.zeros(1, np.int64)
        centres = docs[:: BLOCK // 2]
        nearest = np.argmax(self.sketches[docs] @ self.sketches[centres].T, axis=1)
        order = np.argsort(nearest, kind="stable")
        nearest = nearest[order]
        first = np.concatenate([[True], nearest[1:] != nearest[:-1]])
        starts = np.flatnonzero(first)
        inside = np.arange(len(docs)) - np.repeat(starts, np.diff(starts, append=len(docs)))
        return docs[order], np.flatnonzero(inside % (2 * BLOCK) == 0)

    def summaries(self, docs: np.ndarray, starts: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
        """The largest impact of each coordinate in each block."""
        return np.maximum.reduceat(self.matrix[docs[:, None], coordinates], starts, axis=0)

    def search(self, best: list[Best]) -> int:
        """Add to each item's best documents; returns how many blocks were scored."""
        blocks: list[tuple[np.ndarray, np.ndarray]] = []
        bounds: list[list[np.ndarray]] = [[] for _ in best]
        of_term: list[list[int]] = [[] for _ in best]
        for term, holders in enumerate(self.queries.holders):
            if not holders or self.bounds[term] == self.bounds[term + 1]:
                continue
            docs, starts = self.blocks(term)
            coordinates = self.queries.coordinates(term)
            largest = self.summaries(docs, starts, coordinates).astype(np.int64)
            for item in holders:
                at = np.searchsorted(coordinates, self.queries.places[item])
                bound = largest[:, at] @ self.queries.weights[item]
                if bound.max() >= best[item].least:
                    bounds[item].append(bound)
                    of_term[item].append(len(blocks))
            blocks.append((docs, np.append(starts, len(docs))))
        scored = 0
        for item, found in enumerate(best):
            if bounds[item]:
                scored += self._visit(item, found, [blocks[k] for k in of_term[item]], bounds[item])
        return scored

    def _visit(self, item: int, best: Best, lists: list[tuple[np.ndarray, np.ndarray]], bounds: list[np.ndarray]) -> int:
        of_list = np.repeat(np.arange(len(bounds)), [len(b) for b in bounds])
        place = np.concatenate([np.arange(len(b)) for b in bounds])
        bound = np.concatenate(bounds)
        order = np.argsort(-bound, kind="stable")
        places, weights = self.queries.places[item], self.queries.weights[item]
        seen = np.zeros(len(self.ids), bool)
        scored = 0
        for low in range(0, len(order), STEP):
            step = order[low : low + STEP]
            step = step[bound[step] >= best.least]
            if not len(step):
                break
            parts = []
            for k in step.tolist():
                docs, starts = lists[of_list[k]]
                parts.append(docs[starts[place[k]] : starts[place[k] + 1]])
            scored += len(parts)
            docs = np.unique(np.concatenate(parts))
            docs = docs[~seen[docs]]
            seen[docs] = True
            scores = self.matrix[docs[:, None], places].astype(np.int64) @ weights
            best.add(scores, self.ids[docs], self.nulls[docs])
        return scored


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What an occurrence count weighs in a document of ``n`` terms; 64-bit integers."""
    length = 100 - 75 + 75 * n * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * length)


def _searched(vectors: DataFrame, queries: Queries, documents: int, total: int, k: int) -> DataFrame:
    """(place, doc_id, score): the best of each task for each item."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)
    limit = max(BLOCK, MATRIX // max(1, queries.vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = [Best(k) for _ in queries.places]
        for batch in batches:
            for low in range(0, batch.num_rows, limit):
                part = batch.slice(low, limit)
                ids = part.column(0)
                offsets = np.concatenate([[0], np.cumsum(part.column(2).value_lengths().to_numpy())])
                n = np.repeat(part.column(1).to_numpy(), np.diff(offsets))
                values = impacts(part.column(3).flatten().to_numpy(), n, documents, total)
                terms = part.column(2).flatten().to_numpy().astype(np.int64)
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                Shard(ids.fill_null(0).to_numpy(), nulls, offsets, terms, values, queries).search(best)
        for place, found in enumerate(best):
            if len(found.scores):
                columns = [np.full(len(found.scores), place), pa.array(found.ids, mask=found.nulls), found.scores]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "doc_id", "score"])

    return vectors.mapInArrow(run, "place bigint, doc_id bigint, score bigint")


def _group(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """Results for the items of one group, given as rows of `item_terms`."""
    spark = docs.sparkSession
    vocabulary = sorted({r["term"] for r in rows})
    vectors = stored(term_vectors(docs, vocabulary), "vectors")
    size = vectors.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    documents, total = size["documents"], size["total"]
    held = {r["term"]: r["count"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(vocabulary))]
    place = {term: k for k, term in enumerate(vocabulary)}
    items: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["item"], r["term"])):
        items.setdefault(r["item"], []).append(r)
    for of_item in items.values():
        if sum(r["times"] * weight[place[r["term"]]] for r in of_item) >= (1 << 63) // 1_000_000:
            raise ValueError(f"scores of item {of_item[0]['item_id']} may not fit 64 bits")
    queries = Queries(
        [np.array([place[r["term"]] for r in of_item]) for of_item in items.values()],
        [np.array([r["times"] * weight[place[r["term"]]] for r in of_item]) for of_item in items.values()],
        len(vocabulary),
    )
    names = spark.createDataFrame(
        [(n, item, of_item[0]["item_id"]) for n, (item, of_item) in enumerate(items.items())], "place bigint, item bigint, item_id bigint"
    )
    # Vectors are small beside their texts: a few files may hold many documents.
    spread = vectors.repartition(max(1, documents // TASK_DOCUMENTS))
    found = _searched(spread, queries, documents, total, k)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score", "item")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score, item) of the ``k`` best documents of each row of ``items`` (item_id, text)."""
    terms = stored(item_terms(items), "items")
    n_groups = max(1, -(-terms.count() // group_terms))
    group = F.pmod(F.xxhash64("item"), F.lit(n_groups))
    out = None
    for number in range(n_groups):
        rows = terms.filter(group == number).collect()  # about group_terms rows
        if rows:
            found = _group(docs, rows, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return terms.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint, item bigint")
    return out
