"""Analyzers: text -> ``STRUCT<total_cost BIGINT, terms ARRAY, pos ARRAY>``.

Three kinds, all named in one registry and interchangeable as the old or the new
version of a run:

* :class:`PatternAnalyzer` - a token pattern with part of speech and cost as column
  expressions; stays in the JVM and needs no shuffle;
* :class:`LexiconAnalyzer` - a token pattern with part of speech and cost looked up in
  a table (see :mod:`lexdrift.operators.lexicon`);
* :class:`PythonAnalyzer` - any Python tokenizer, run over Arrow batches, with errors
  captured per record.

``components`` names what a version is made of; jobs list it in the run's metadata.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_ARRAY = "array<string>"
SLOTS = ("title", "text")


@dataclass(frozen=True)
class PatternAnalyzer:
    """Tokens by regular expression; ``pos`` and ``cost`` map one token column.

    A rule that cannot tell gives NULL (``try_cast``, ``try_element_at``, ...), which fails the record;
    an error that a rule raises would end the job. ``never_fails`` says that no rule gives NULL and no sum
    leaves 64 bits: records that both versions cut alike then need no rules at all."""

    name: str
    pattern: str
    pos: Callable[[Column], Column]
    cost: Callable[[Column], Column]
    components: tuple[str, ...] = ()
    never_fails: bool = False


@dataclass(frozen=True)
class LexiconAnalyzer:
    """Tokens by regular expression; part of speech and cost from ``lexicon``
    (``version, surface, pos, cost``), with defaults for unknown words."""

    name: str
    pattern: str
    lexicon: DataFrame = field(compare=False)
    version: str
    unknown_pos: str = "unknown"
    unknown_cost: int = 0
    components: tuple[str, ...] = ()


@dataclass(frozen=True)
class PythonAnalyzer:
    """Any tokenizer: ``factory()`` runs once per task and returns a function from
    text to ``(surface, part of speech, cost)`` triples. One that also has a method ``results``, from a list of
    texts to Arrow arrays of total costs, terms and parts of speech, is given many texts at once."""

    name: str
    factory: Callable[[], Callable[[str], Iterable[tuple[str, str, int]]]]
    components: tuple[str, ...] = ()


Analyzer = PatternAnalyzer | LexiconAnalyzer | PythonAnalyzer

_REGISTRY: dict[str, Analyzer] = {}


def register(analyzer: Analyzer) -> Analyzer:
    """Make an analyzer available by name; a later one of the same name replaces it."""
    _REGISTRY[analyzer.name] = analyzer
    return analyzer


def resolve(analyzer: Analyzer | str) -> Analyzer:
    if not isinstance(analyzer, str):
        return analyzer
    if analyzer not in _REGISTRY:
        raise ValueError(f"unknown analyzer {analyzer!r}; registered: {sorted(_REGISTRY)}")
    return _REGISTRY[analyzer]


def tokenize(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` in order; no tokens for NULL text."""
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(tokens, F.array().cast(TOKEN_ARRAY))


def fold_tokens(tokens: Column, analyzer: PatternAnalyzer) -> Column:
    """Total cost, ordered terms and ordered parts of speech of a token array."""
    total = F.aggregate(
        tokens, F.lit(0).cast("bigint"), lambda acc, t: F.try_add(acc, analyzer.cost(t).cast("bigint"))
    )
    return F.struct(
        total.alias("total_cost"),
        tokens.alias("terms"),
        F.transform(tokens, analyzer.pos).alias("pos"),
    )


def fold_entries(entries: Column, pos: str = "pos", cost: str = "cost") -> Column:
    """The same from an ordered array of structs with ``surface`` and the named fields."""
    total = F.aggregate(entries[cost], F.lit(0).cast("bigint"), lambda acc, c: F.try_add(acc, c))
    return F.struct(
        total.alias("total_cost"),
        entries["surface"].alias("terms"),
        entries[pos].alias("pos"),
    )


PYTHON_FIELDS = (*[f"{slot}_{part}" for slot in SLOTS for part in ("cost", "terms", "pos")], "error")
PYTHON_TYPES = {"cost": pa.int64(), "terms": pa.list_(pa.string()), "pos": pa.list_(pa.string()), "error": pa.string()}
PYTHON_RESULT = ", ".join(
    f"{f}: {'bigint' if f.endswith('cost') else 'string' if f == 'error' else 'array<string>'}" for f in PYTHON_FIELDS
)
PYTHON_ROWS = 256
#: Text, in bytes, that an analyzer of many texts is given at once.
PYTHON_BYTES = 4 << 20


def _field_result(analyze: Callable[[str], Iterable[tuple[str, str, int]]], text: str | None) -> tuple:
    tokens = list(analyze(text)) if text else []
    total = sum(int(cost) for _, _, cost in tokens)
    if not -(1 << 63) <= total < 1 << 63:
        raise OverflowError("the total cost does not fit 64 bits")
    terms, pos = [str(t[0]) for t in tokens], [str(t[1]) for t in tokens]
    for value in (*terms, *pos):
        value.encode("utf-8")  # a lone surrogate is no text
    return total, terms, pos


def python_results(analyzers: dict[str, PythonAnalyzer]) -> Column:
    """STRUCT<version: STRUCT<flat results of both fields, or the error of the record>>: one Arrow pass for
    all versions.

    Declared nondeterministic so that Spark evaluates it once and never copies it into
    a filter."""
    factories, rows_out, bytes_out = {v: a.factory for v, a in analyzers.items()}, PYTHON_ROWS, PYTHON_BYTES

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        made = {v: factory() for v, factory in factories.items()}

        def record(analyze, title, text) -> tuple:
            try:
                return (*_field_result(analyze, title), *_field_result(analyze, text), None)
            except Exception as error:  # the record fails, the run goes on
                return (None,) * 6 + (f"{type(error).__name__}: {error}".encode("utf-8", "replace").decode(),)

        def flat(analyze, titles: list, texts: list) -> pa.StructArray:
            if hasattr(analyze, "results"):
                try:
                    arrays = [*analyze.results(titles), *analyze.results(texts), pa.nulls(len(titles), pa.string())]
                    return pa.StructArray.from_arrays(arrays, PYTHON_FIELDS)
                except Exception:  # noqa: S110 - some record fails: they are tried one by one
                    pass
            columns = zip(*[record(analyze, *pair) for pair in zip(titles, texts)])
            arrays = [pa.array(c, PYTHON_TYPES[f.split("_")[-1]]) for c, f in zip(columns, PYTHON_FIELDS)]
            return pa.StructArray.from_arrays(arrays, PYTHON_FIELDS)

        def cuts(titles: pa.Array, texts: pa.Array) -> list[int]:
            if not all(hasattr(a, "results") for a in made.values()):
                return [*range(0, len(titles), rows_out), len(titles)]
            sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64) for c in (titles, texts))
            group = np.cumsum(sizes) // bytes_out
            return [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(titles)]

        for titles, texts in batches:
            # Tokens take far more room as Python objects than as text: they are turned to Arrow
            # a few rows at a time, whatever the size of the incoming batch.
            at = cuts(titles, texts)
            for low, high in zip(at, at[1:]):
                some = titles.slice(low, high - low).to_pylist(), texts.slice(low, high - low).to_pylist()
                if some[0]:
                    yield pa.StructArray.from_arrays([flat(a, *some) for a in made.values()], list(made))
            pa.default_memory_pool().release_unused()

    # Types are declared here because annotations are strings in this module.
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    schema = ", ".join(f"{v} struct<{PYTHON_RESULT}>" for v in analyzers)
    udf = F.arrow_udf(run, schema).asNondeterministic()
    return udf(F.col("title"), F.col("text"))


# Two built-in versions that differ where letters and digits touch.
_SYMBOL = r"[^\s\p{L}\p{N}]"


def _basic_pos(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^\p{L}+$"), "word")
        .when(token.rlike(r"^\p{N}+$"), "number")
        .when(token.rlike(r"^[\p{L}\p{N}]"), "mixed")
        .otherwise("symbol")
    )


def _basic_cost(token: Column) -> Column:
    return F.lit(100) + F.length(token) * 10


BASIC_1 = register(
    PatternAnalyzer("basic-1", rf"[\p{{L}}\p{{N}}]+|{_SYMBOL}", _basic_pos, _basic_cost, never_fails=True)
)
BASIC_2 = register(
    PatternAnalyzer("basic-2", rf"\p{{L}}+|\p{{N}}+|{_SYMBOL}", _basic_pos, _basic_cost, never_fails=True)
)
