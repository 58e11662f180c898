"""Regression diff of text analysis over article corpora, on Spark."""

from lexdrift.operators import (
    BASIC_1,
    BASIC_2,
    LexiconAnalyzer,
    PatternAnalyzer,
    PythonAnalyzer,
    RunInfo,
    UnknownWords,
    compare,
    lattice_analyzer,
    register,
    run_summary,
)
from lexdrift.plans import (
    ArticleSource,
    CompareOptions,
    CompareResult,
    Report,
    compare_dump,
    compare_parquet,
    compare_source,
)

__all__ = [
    "ArticleSource",
    "BASIC_1",
    "BASIC_2",
    "CompareOptions",
    "CompareResult",
    "LexiconAnalyzer",
    "PatternAnalyzer",
    "PythonAnalyzer",
    "Report",
    "RunInfo",
    "UnknownWords",
    "compare",
    "compare_dump",
    "compare_parquet",
    "compare_source",
    "lattice_analyzer",
    "register",
    "run_summary",
]
