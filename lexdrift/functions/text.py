"""Text cleaning rules as ``Column -> Column`` functions.

Everything here is a composition of built-in JVM expressions: no UDF, no
shuffle, and every regular expression is linear in the length of the text
(possessive quantifiers, one attempt per run), so a very long or degenerate
article cannot stall its task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two whitespace classes and the sentence boundary marks.
TRIM_CHARS = "".join(chr(c) for c in range(0x00, 0x21))
STRIP_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a"
    "\u2028\u2029\u205f\u3000"
)
BOUNDARY_MARKS = "。．.!?！？"

# Marker lines of the Wiki-40B text layout.
ARTICLE_MARKER = "_START_ARTICLE_"
SECTION_MARKER = "_START_SECTION_"
PARAGRAPH_MARKER = "_START_PARAGRAPH_"
TITLE_LIMIT = 100

_GAP = r"[ \t\f]"
_WIDE_GAP = r"[\p{javaWhitespace}&&[^\n \t\f]]"
# A break that follows a boundary mark, or that follows such a break directly
# (\G), with the blanks around it. Other whitespace before the break is kept.
_BREAK_AFTER_BOUNDARY = (
    rf"((?:[{BOUNDARY_MARKS}]|\G(?!\A))(?:{_GAP}*+{_WIDE_GAP})*+){_GAP}*+\n++{_GAP}*+"
)
_OTHER_BREAK = rf"\n++{_GAP}*+"

_LINE_GAP = r"[\x00-\x20&&[^\n]]"
_MARKER_LINES = (
    rf"(?:[\x00-\x20]*+(?:{ARTICLE_MARKER}{_LINE_GAP}*+(?=\n|\z)"
    rf"|{SECTION_MARKER}[^\n]*+|{PARAGRAPH_MARKER}[^\n]*+))*+"
)
# Marker lines at the start are passed over if anything but blanks follows them.
_TITLE_LINE = (
    rf"\A(?:{_MARKER_LINES}(?=[\x00-\x20]*+[^\x00-\x20]))?[\x00-\x20]*+([^\n]*+)"
)


def ascii_trim(text: Column) -> Column:
    """Drop characters up to U+0020 from both ends."""
    return F.btrim(text, F.lit(TRIM_CHARS))


def unicode_strip(text: Column) -> Column:
    """Drop Unicode whitespace (no-break spaces excluded) from both ends."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def unify_breaks(text: Column) -> Column:
    """Turn CR LF and CR into LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def ends_at_boundary(text: Column) -> Column:
    """True when the last character that is not whitespace ends a sentence."""
    last = F.right(F.rtrim(text, F.lit(STRIP_CHARS)), F.lit(1))
    return last.isin(*BOUNDARY_MARKS)


def normalize_text(text: Column) -> Column:
    """Article text ready for analysis: breaks inside a sentence are kept as one
    LF per run, breaks after a sentence boundary disappear."""
    plain = unicode_strip(unify_breaks(text))
    joined = F.regexp_replace(plain, _BREAK_AFTER_BOUNDARY, "$1")
    return unicode_strip(F.regexp_replace(joined, _OTHER_BREAK, "\n"))


def split_annotation(title: Column) -> tuple[Column, Column]:
    """``A (B) C`` -> (``A``, ``B``); a title without such a pair -> (title, NULL)."""
    start = F.position(F.lit(" ("), title)
    end = F.position(F.lit(")"), title, F.greatest(start, F.lit(1)))
    found = (start > 0) & (end > 0)
    name = F.when(found, F.substr(title, F.lit(1), start - 1)).otherwise(title)
    note = F.when(found, F.substr(title, start + 2, end - start - 2))
    return name, note


def derive_title(text: Column) -> Column:
    """First line with content, cut to 100 characters; NULL for NULL or empty text.

    Marker lines are passed over unless the text has nothing else."""
    line = ascii_trim(F.regexp_extract(text, _TITLE_LINE, 1))
    return F.when(text != "", F.left(line, F.lit(TITLE_LIMIT)))


def decode_utf8(raw: Column) -> Column:
    """Bytes or string to valid UTF-8, malformed bytes replaced by U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def is_admin_title(title: Column) -> Column:
    """Titles with an ASCII colon belong to administrative pages; NULL does not."""
    return F.coalesce(F.contains(title, F.lit(":")), F.lit(False))


def is_blank(text: Column) -> Column:
    """NULL or empty."""
    return F.coalesce(text == "", F.lit(True))
