"""The files that hold the first records of an input."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame

# Names with other characters would be escaped in the listing or read as patterns.
PLAIN_NAME = re.compile(r"[\w./:=@+-]*", re.ASCII)


def leading_files(
    read: Callable[[list[str]], DataFrame], files: list[str], wanted: int, counted: Column | None = None
) -> list[str]:
    """The shortest run of leading files, in path order, known to hold ``wanted`` records.

    ``read`` is called with 1, 2, 4, ... of the files in turn, and the records of each group
    are counted, until there are enough: the later files are never opened, and at most about
    twice as many files as needed are. Empty, for no such run, if there are fewer
    records or if a name is not plain (``PLAIN_NAME``)."""
    files = sorted(files)
    if not all(PLAIN_NAME.fullmatch(f) for f in files):
        return []
    found, start, group = 0, 0, 1
    while start < len(files) and found < wanted:
        rows = read(files[start : start + group])
        found += (rows if counted is None else rows.filter(counted)).count()
        start, group = start + group, group * 2
    return files[:start] if found >= wanted else []
