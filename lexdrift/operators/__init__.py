from lexdrift.operators.analyzers import (
    BASIC_1,
    BASIC_2,
    LexiconAnalyzer,
    PatternAnalyzer,
    PythonAnalyzer,
    register,
    resolve,
)
from lexdrift.operators.compare import analyze, compare, differing, failed, preview
from lexdrift.operators.lattice import UnknownWords, lattice_analyzer
from lexdrift.operators.sequence import in_input_order, limit_records, with_ordinal
from lexdrift.operators.summary import RunInfo, run_summary

__all__ = [
    "BASIC_1",
    "BASIC_2",
    "LexiconAnalyzer",
    "PatternAnalyzer",
    "PythonAnalyzer",
    "RunInfo",
    "UnknownWords",
    "analyze",
    "compare",
    "differing",
    "failed",
    "in_input_order",
    "lattice_analyzer",
    "limit_records",
    "preview",
    "register",
    "resolve",
    "run_summary",
    "with_ordinal",
]
