"""Run two analyzer versions over each article and compare the results.

With pattern analyzers the whole comparison is one narrow stage: tokens, results,
facets and flags are computed in the row, with no join, shuffle or Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexdrift.functions.text import is_blank
from lexdrift.operators.analyzers import (
    SLOTS,
    Analyzer,
    LexiconAnalyzer,
    PatternAnalyzer,
    PythonAnalyzer,
    fold_tokens,
    python_results,
    resolve,
    tokenize,
)
from lexdrift.operators.lexicon import attach_lexicon_results, dictionary
from lexdrift.operators.row_lexicon import fits_rows, row_lookup, share_lexicon

VERSIONS = ("old", "new")
# Why a record fails without an error having been raised.
NO_COST = "a token without a cost, or a total cost that does not fit 64 bits"
NO_POS = "a token without a part of speech"
FACETS = ("cost", "term", "pos")
_FACET_FIELD = {"cost": "total_cost", "term": "terms", "pos": "pos"}


def analyze(
    articles: DataFrame,
    old: Analyzer | str,
    new: Analyzer | str,
    key: str = "seq",
    all_results: bool = True,
) -> DataFrame:
    """Add ``old`` and ``new`` (``STRUCT<title, text>`` of results) and ``error``.

    ``articles`` needs ``title`` and ``text``; ``key`` only for lexicons too large to be looked up in the row.
    A rule that gives NULL for a token, or a total cost beyond 64 bits, fails its record.

    Without ``all_results`` a record may have NULL results when both versions are known
    to agree on it: two pattern analyzers with the same cost and part-of-speech rules
    that cut a record into the same tokens. The rules are then not evaluated for it."""
    models = dict(zip(VERSIONS, (resolve(old), resolve(new))))
    kept = articles.columns
    df = articles

    lexicons = [(v, m) for v, m in models.items() if isinstance(m, LexiconAnalyzer)]
    in_rows = lexicons if lexicons and fits_rows([m for _, m in lexicons]) else []
    if lexicons and not in_rows:
        df = attach_lexicon_results(df, lexicons, key)

    pythons = {v: m for v, m in models.items() if isinstance(m, PythonAnalyzer)}
    if pythons:
        df = df.select("*", python_results(pythons).alias("_py"))

    # Token arrays first, one per distinct pattern, so that versions can share them.
    cutting = [m for m in models.values() if isinstance(m, PatternAnalyzer)] + [m for _, m in in_rows]
    patterns = list(dict.fromkeys(m.pattern for m in cutting))
    df = df.select(
        "*",
        *[
            tokenize(F.col(slot), p).alias(f"_{slot}_{n}")
            for n, p in enumerate(patterns)
            for slot in SLOTS
        ],
    )

    if in_rows:
        table = share_lexicon(articles.sparkSession, dictionary([m for _, m in in_rows]), [m for _, m in in_rows])
        lookups = []
        for n, p in enumerate(patterns):
            chosen = {v: k for k, (v, m) in enumerate(in_rows) if m.pattern == p}
            if chosen:
                lookups.append(row_lookup(table, chosen, [F.col(f"_{slot}_{n}") for slot in SLOTS]).alias(f"_words_{n}"))
        df = df.select("*", *lookups)

    needed = None
    if not all_results and _same_rules(models["old"], models["new"]):
        n, m = (patterns.index(model.pattern) for model in models.values())
        agree = [F.col(f"_{slot}_{n}").eqNullSafe(F.col(f"_{slot}_{m}")) for slot in SLOTS]
        df = df.select("*", (~(agree[0] & agree[1])).alias("_needed"))
        needed = F.col("_needed")

    def parts(found: dict[str, tuple[Column, Column, Column]]) -> Column:
        """Both fields' results from their cost, terms and parts of speech."""
        names = ("total_cost", "terms", "pos")
        return F.struct(
            *[F.struct(*[c.alias(n) for c, n in zip(columns, names)]).alias(slot) for slot, columns in found.items()]
        )

    def result(version: str) -> Column:
        model = models[version]
        if isinstance(model, PythonAnalyzer):
            flat = F.col(f"_py.{version}")
            whole = parts({s: (flat[f"{s}_cost"], flat[f"{s}_terms"], flat[f"{s}_pos"]) for s in SLOTS})
            return F.when(flat["error"].isNull(), whole)
        if isinstance(model, LexiconAnalyzer):
            if not in_rows:
                return F.col(version)
            n = patterns.index(model.pattern)
            found = F.col(f"_words_{n}.{version}")
            return parts({s: (found[f"{s}_cost"], F.col(f"_{s}_{n}"), found[f"{s}_pos"]) for s in SLOTS})
        n = patterns.index(model.pattern)
        whole = F.struct(
            *[fold_tokens(F.col(f"_{slot}_{n}"), model).alias(slot) for slot in SLOTS]
        )
        return whole if needed is None else F.when(needed, whole)

    def failure(version: str) -> Column:
        """Why a version has no result for a record. Columns cannot catch an error, so rules and sums give NULL."""
        if version in pythons:
            return F.col(f"_error_{version}")
        model, found = models[version], F.col(f"_{version}")
        no_cost = found["title"]["total_cost"].isNull() | found["text"]["total_cost"].isNull()
        no_pos = F.exists(found["title"]["pos"], F.isnull) | F.exists(found["text"]["pos"], F.isnull)
        if isinstance(model, LexiconAnalyzer):
            no_pos = F.lit(False)
        reason = F.when(no_cost, NO_COST).when(no_pos, NO_POS)
        return F.when(found.isNotNull() & (no_cost | no_pos), F.concat(F.lit(f"{model.name}: "), reason))

    # ``inline`` fixes the results as a row of their own: a later filter on a comparison
    # uses them instead of repeating the analysis inside its condition.
    row = F.struct(
        *[result(v).alias(f"_{v}") for v in VERSIONS],
        *[F.col(f"_py.{v}.error").alias(f"_error_{v}") for v in pythons],
    )
    df = df.select(*kept, F.inline(F.array(row)))
    safe = [v for v, m in models.items() if isinstance(m, PatternAnalyzer) and m.never_fails]
    errors = {v: failure(v) for v in VERSIONS if v not in safe}
    return df.select(
        *kept,
        *[(F.when(errors[v].isNull(), F.col(f"_{v}")) if v in errors else F.col(f"_{v}")).alias(v) for v in VERSIONS],
        F.coalesce(*errors.values(), F.lit(None)).cast("string").alias("error"),
    )


def _same_rules(old: Analyzer, new: Analyzer) -> bool:
    return (
        isinstance(old, PatternAnalyzer)
        and isinstance(new, PatternAnalyzer)
        and old.never_fails
        and new.never_fails
        and old.pos is new.pos
        and old.cost is new.cost
    )


def differs(slot: str, facet: str, old: str = "old", new: str = "new") -> Column:
    """True when one facet of one slot differs; lists are compared in order."""
    name = _FACET_FIELD[facet]
    same = F.col(f"{old}.{slot}.{name}").eqNullSafe(F.col(f"{new}.{slot}.{name}"))
    return ~same


def facet_differences() -> dict[str, Column]:
    """The six tests, named ``<slot>_<facet>``."""
    return {f"{slot}_{facet}": differs(slot, facet) for slot in SLOTS for facet in FACETS}


def has_difference() -> Column:
    """Any facet of any slot differs; false for a failed record."""
    tests = list(facet_differences().values())
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return F.col("error").isNull() & result


def difference_types(distinct: bool = False) -> Column:
    """Facets that differ, in order of first appearance.

    ``cost`` is listed once per slot, ``term`` and ``pos`` once per record; ``distinct``
    lists ``cost`` once as well."""
    f = facet_differences()
    found = F.array_compact(
        F.array(
            F.when(f["title_cost"], "cost"),
            F.when(f["title_term"], "term"),
            F.when(f["title_pos"], "pos"),
            F.when(f["text_cost"], "cost"),
            F.when(f["text_term"] & ~f["title_term"], "term"),
            F.when(f["text_pos"] & ~f["title_pos"], "pos"),
        )
    )
    return F.array_distinct(found) if distinct else found


def skipped_flag() -> Column:
    """1 when title and text are both NULL or empty."""
    return (is_blank(F.col("title")) & is_blank(F.col("text"))).cast("int")


def compare(
    articles: DataFrame,
    old: Analyzer | str,
    new: Analyzer | str,
    distinct_types: bool = False,
    key: str = "seq",
    all_results: bool = True,
) -> DataFrame:
    """One row per article with both results, the error and the comparison.

    ``all_results=False`` is for consumers that look at the results of differing records
    only; see :func:`analyze`. The comparison is the same either way."""
    results = analyze(articles, old, new, key, all_results)
    if "reject" in results.columns:
        # A page that could not be read is no record: it is neither compared nor processed.
        rejected = F.concat(F.lit("malformed page: "), F.col("reject"))
        results = results.withColumn("error", F.coalesce(rejected, "error"))
    ok = F.col("error").isNull()
    return results.select(
        "*",
        F.when(ok, skipped_flag()).otherwise(0).alias("skipped"),
        has_difference().alias("has_difference"),
        F.when(ok, difference_types(distinct_types))
        .otherwise(F.array().cast("array<string>"))
        .alias("diff_types"),
    )


def differing(compared: DataFrame) -> DataFrame:
    """Only the records that reports show."""
    return compared.filter("has_difference")


def failed(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("error").isNotNull())


def preview(compared: DataFrame, max_records: int, seq: str = "seq") -> DataFrame:
    """Title, text and both title results of a small run (1 to 10 records)."""
    if not 1 <= max_records <= 10:
        raise ValueError("a preview shows between 1 and 10 records")
    return (
        compared.filter(F.col("error").isNull())
        .orderBy(seq)
        .limit(max_records)
        .select(
            seq,
            "title",
            "text",
            *[
                F.col(f"{v}.title.{f}").alias(f"{v}_{f}")
                for v in VERSIONS
                for f in ("terms", "pos", "total_cost")
            ],
        )
    )
