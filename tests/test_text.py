from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from lexdrift.functions import (
    ascii_trim,
    decode_utf8,
    derive_title,
    duration_text,
    ends_at_boundary,
    excerpt,
    html_escape,
    is_admin_title,
    list_text,
    normalize_text,
    percent_text,
    split_annotation,
    unicode_strip,
    unify_breaks,
)
from lexdrift.functions.text import BOUNDARY_MARKS, STRIP_CHARS

NO_BREAK = "\u00a0\u2007\u202f\u0085\u200b"


def test_ascii_trim(column):
    values = ["  Test Page  ", "\t\x00\x1fa b\r\n", "\u3000a\u3000", "", None, " \n "]
    assert column(ascii_trim, values) == ["Test Page", "a b", "\u3000a\u3000", "", None, ""]


def test_unicode_strip(column):
    assert len(STRIP_CHARS) == 25
    values = [STRIP_CHARS + "a" + STRIP_CHARS, *[f" {c}a{c} " for c in NO_BREAK]]
    assert column(unicode_strip, values) == ["a", *[f"{c}a{c}" for c in NO_BREAK]]


def test_strip_set_is_the_java_whitespace_class(spark):
    """Every character that the JVM calls whitespace, and no other."""
    rows = spark.range(1, 0x10000).filter("id < 55296 or id > 57343")
    found = rows.filter(
        F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").rlike(r"\A\p{javaWhitespace}\z")
    )
    assert {chr(r["id"]) for r in found.collect()} == set(STRIP_CHARS)


def test_unify_breaks(column):
    assert column(unify_breaks, ["a\r\nb\rc\nd", "\r\r\n"]) == ["a\nb\nc\nd", "\n\n"]


def test_ends_at_boundary(column):
    values = [*[f"a{m}" for m in BOUNDARY_MARKS], "a. \n\u3000", "a", "a,", "", "a.\u00a0", "\n", None]
    expected = [*[True] * len(BOUNDARY_MARKS), True, False, False, False, False, False, None]
    assert column(ends_at_boundary, values) == expected


NORMALIZED = {
    "朝。\n夜": "朝。夜",
    "朝\n夜": "朝\n夜",
    "\n\n  朝。\n夜\n\n      ": "朝。夜",
    "a\n  \nb": "a\n\nb",
    "a\n\n\nb": "a\nb",
    "文。\u3000\n文": "文。\u3000文",
    "文。\u3000 \n文": "文。\u3000文",
    "a\r\nb\rc": "a\nb\nc",
    "a! \t\n \f\n  b": "a!b",
    "a. \n \u3000\n b": "a.\u3000b",
    "a  \n  b": "a  \nb",
    "": "",
    " \n ": "",
    "。\n": "。",
}


def test_normalize_text(column):
    assert column(normalize_text, list(NORMALIZED)) == list(NORMALIZED.values())
    assert column(normalize_text, [None]) == [None]


def restated(text: str) -> str:
    """The line-break rule over the pieces between breaks."""
    out = ""
    for piece in re.split(r"(\n+[ \t\f]*)", text.replace("\r\n", "\n").replace("\r", "\n").strip(STRIP_CHARS)):
        if not piece.startswith("\n"):
            out += piece
        elif out.rstrip(STRIP_CHARS)[-1:] in tuple(BOUNDARY_MARKS):
            out = out.rstrip(" \t\f")
        else:
            out += "\n"
    return out.strip(STRIP_CHARS)


def test_normalize_text_against_restatement(column):
    rng = random.Random(7)
    alphabet = "ab。.!?！ \t\f\n\n\n\r\u3000\u2028\u00a0\x0b"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(30_000)]
    got = column(normalize_text, texts)
    wrong = [(t, g, restated(t)) for t, g in zip(texts, got) if g != restated(t)]
    assert wrong == []


def test_long_runs_take_linear_time(column):
    n = 300_000
    texts = [
        "." + " " * n + "x",
        "." + "\u3000" * n + "x",
        "." + " \u3000" * n + "\nx",
        "x" + "\n" * n + "y",
        "." + "\n " * n + "y",
        "a" + " " * n,
        "_START_SECTION_\n" * (n // 10) + "t",
    ]
    start = time.time()
    for function in (normalize_text, derive_title, ends_at_boundary):
        column(function, texts)
    assert time.time() - start < 30


def test_split_annotation(column):
    cases = {
        "A (B) C": ("A", "B"),
        "Q (x": ("Q (x", None),
        "plain": ("plain", None),
        "a) b (c)": ("a) b", "c"),
        "a (b (c))": ("a", "b (c"),
        "a(b)": ("a(b)", None),
        " (b)": ("", "b"),
        "東京 (曖昧さ回避)": ("東京", "曖昧さ回避"),
        "x ()": ("x", ""),
        "": ("", None),
        None: (None, None),
    }
    titles = column(lambda c: split_annotation(c)[0], list(cases))
    notes = column(lambda c: split_annotation(c)[1], list(cases))
    assert list(zip(titles, notes)) == list(cases.values())


def test_admin_title(column):
    assert column(is_admin_title, ["Help:X", "Ａ：Ｂ", "", None, ":"]) == [True, False, False, False, True]


TITLES = {
    "川の名前\n山から海へ流れる。": "川の名前",
    "う" * 130 + "\n続き": "う" * 100,
    "": None,
    "\n_START_ARTICLE_\n T \n_START_PARAGRAPH_\nbody": "T",
    "_START_ARTICLE_\n_START_SECTION_": "_START_ARTICLE_",
    "_START_ARTICLE_x\nb": "_START_ARTICLE_x",
    "_START_SECTION_x\n_START_PARAGRAPH_ y\n  title  \nz": "title",
    " \n\t\n": "",
    "\n \n_START_SECTION_ only": "_START_SECTION_ only",
    "a _START_SECTION_\nb": "a _START_SECTION_",
    "\x01\x02 t\x1f\r\nb": "t",
    "\u3000t\nb": "\u3000t",
    "_START_ARTICLE_\r\nT": "T",
    "one": "one",
}


def test_derive_title(column):
    assert column(derive_title, list(TITLES)) == list(TITLES.values())
    assert column(derive_title, [None]) == [None]


def restated_title(text: str) -> str | None:
    if not text:
        return None
    blanks = "".join(map(chr, range(33)))
    lines = [line.strip(blanks) for line in text.split("\n")]
    lines = [line for line in lines if line]
    markers = ("_START_SECTION_", "_START_PARAGRAPH_")
    content = [x for x in lines if x != "_START_ARTICLE_" and not x.startswith(markers)]
    return (content + lines + [""])[0][:100]


def test_derive_title_against_restatement(column):
    rng = random.Random(11)
    parts = ["\n", " ", "\r", "_START_ARTICLE_", "_START_SECTION_", "_START_PARAGRAPH_", "a", "\x01", "\u3000"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(20_000)]
    assert column(derive_title, texts) == [restated_title(t) for t in texts]


def test_decode_utf8(column):
    raw = [b"\xe3\x81\x82\xff", "あ".encode(), b"a\xe3\x81", b"\xc3\x28", b"\xf0\x9f\x98", None]
    got = column(decode_utf8, [None if r is None else bytearray(r) for r in raw], "binary")
    assert got == ["あ\ufffd", "あ", "a\ufffd", "\ufffd(", "\ufffd", None]


def test_html_escape(column):
    values = ["<a href='x'>\"&amp;\"</a>", None, ""]
    assert column(html_escape, values) == [
        "&lt;a href=&#39;x&#39;&gt;&quot;&amp;amp;&quot;&lt;/a&gt;", "", "",
    ]


def test_excerpt(column):
    assert column(excerpt, ["a" * 500, "あ" * 501]) == ["a" * 500, "あ" * 500 + "...(省略)"]


def test_duration_text(column):
    got = column(duration_text, [1500, 61000, 3661000, 0, 59999], "bigint")
    assert got == [
        "1秒 (1500 ms)", "1分1秒 (61000 ms)", "1時間1分1秒 (3661000 ms)", "0秒 (0 ms)", "59秒 (59999 ms)",
    ]


def test_percent_text(column):
    assert column(percent_text, [30.0, 0.0, 12.125], "double") == ["30.00%", "0.00%", "12.13%"]


def test_list_text(column):
    assert column(list_text, [["a", "b"], []], "array<string>") == ["[a, b]", "[]"]
