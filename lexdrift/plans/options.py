"""Options of a compare job."""

from __future__ import annotations

from dataclasses import dataclass

from lexdrift.operators.analyzers import Analyzer, resolve

REPORT_FORMATS = ("text", "html", "both")
PREVIEW_LIMIT = 10


@dataclass(frozen=True)
class CompareOptions:
    old: Analyzer | str
    new: Analyzer | str
    input_path: str
    output_path: str
    max_records: int = -1
    report_format: str = "both"
    strict: bool = False
    distinct_types: bool = False
    keep_results: str = "differing"

    def __post_init__(self):
        for name in ("old", "new", "input_path", "output_path"):
            if not getattr(self, name):
                raise ValueError(f"{name} is required")
        if self.max_records < -1 or self.max_records == 0:
            raise ValueError("max_records must be -1 (no limit) or positive")
        if self.report_format not in REPORT_FORMATS:
            raise ValueError(f"report_format must be one of {', '.join(REPORT_FORMATS)}")
        if self.keep_results not in ("differing", "all"):
            raise ValueError("keep_results must be differing or all")
        resolve(self.old)
        resolve(self.new)

    @property
    def previews(self) -> bool:
        """Small runs show every record, in a table of their own."""
        return 1 <= self.max_records <= PREVIEW_LIMIT

    def wants(self, report: str) -> bool:
        return self.report_format in (report, "both")
