from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexdrift.operators import (
    BASIC_1,
    BASIC_2,
    LexiconAnalyzer,
    PatternAnalyzer,
    PythonAnalyzer,
    analyze,
    compare,
    register,
    resolve,
)
from lexdrift.operators import lexicon as lexicon_module
from lexdrift.operators.compare import NO_COST, NO_POS
from lexdrift.operators.lexicon import attach_lexicon_results

ARTICLE = "n bigint, title string, text string"


def articles(spark, rows):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], ARTICLE)
    return df.select(F.struct(F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"),
                              F.col("n").alias("idx")).alias("seq"), "*").repartition(4)


def by_n(df):
    return sorted(df.collect(), key=lambda r: r["n"])


def plain(result):
    return result["total_cost"], list(result["terms"]), list(result["pos"])


def test_pattern_analyzers(spark):
    (row,) = by_n(analyze(articles(spark, [("abc1", "12 a,b2")]), BASIC_1, BASIC_2))
    assert plain(row["old"]["title"]) == (140, ["abc1"], ["mixed"])
    assert plain(row["new"]["title"]) == (240, ["abc", "1"], ["word", "number"])
    assert plain(row["old"]["text"]) == (
        120 + 110 + 110 + 120, ["12", "a", ",", "b2"], ["number", "word", "symbol", "mixed"],
    )
    assert row["new"]["text"]["terms"] == ["12", "a", ",", "b", "2"]
    assert row["error"] is None


def test_empty_fields_give_empty_results(spark):
    rows = by_n(analyze(articles(spark, [(None, ""), ("", None)]), BASIC_1, "basic-2"))
    for row in rows:
        for version in ("old", "new"):
            for slot in ("title", "text"):
                assert plain(row[version][slot]) == (0, [], [])


def test_skipping_agreeing_records_changes_no_comparison(spark):
    rng = random.Random(4)
    rows = [tuple("".join(rng.choices("ab1 ,", k=rng.randint(0, 6))) for _ in range(2)) for _ in range(400)]
    rows += [(None, None), (None, "a1"), ("a1", None)]
    df = articles(spark, rows)
    full = by_n(compare(df, BASIC_1, BASIC_2))
    short = by_n(compare(df, BASIC_1, BASIC_2, all_results=False))
    for a, b in zip(full, short):
        assert (a["skipped"], a["has_difference"], a["diff_types"], a["error"]) == (
            b["skipped"], b["has_difference"], b["diff_types"], b["error"])
        if a["has_difference"]:
            assert (a["old"], a["new"]) == (b["old"], b["new"])
        else:
            assert b["old"] is None and b["new"] is None
    assert 0 < sum(r["has_difference"] for r in full) < len(rows)


def test_other_rules_are_always_evaluated(spark):
    dearer = PatternAnalyzer("dearer", BASIC_1.pattern, BASIC_1.pos, lambda t: F.length(t) + 1)
    (row,) = by_n(compare(articles(spark, [("a", "b")]), BASIC_1, dearer, all_results=False))
    assert row["has_difference"] and row["diff_types"] == ["cost", "cost"]


def test_registry():
    assert resolve("basic-1") is BASIC_1
    mine = register(PatternAnalyzer("mine", r"\w", lambda t: t, lambda t: F.lit(1)))
    assert resolve("mine") is mine
    with pytest.raises(ValueError, match="unknown analyzer"):
        resolve("nobody")


def test_pattern_comparison_is_one_stage_without_python(spark):
    plan = compare(articles(spark, [("a", "b")]), BASIC_1, BASIC_2).filter("has_difference")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "Python" not in text
    assert text.count("regexp_extract_all") == 4


# Lexicon


def brute_force(rows, entries, pattern, unknown):
    def result(text):
        terms = re.findall(pattern, text or "")
        found = [entries.get(t, unknown) for t in terms]
        return sum(c for _, c in found), terms, [p for p, _ in found]

    return [(result(title), result(text)) for title, text in rows]


@pytest.fixture(scope="module")
def corpus(spark):
    """A third and more of all words is one word; some articles are empty, one is long."""
    rng = random.Random(2)
    words = [f"w{n}" for n in range(60)]

    def text(k):
        return " ".join("the" if rng.random() < 0.4 else rng.choice(words) for _ in range(k))

    rows = [(text(rng.randint(0, 4)), text(rng.randint(0, 40))) for _ in range(300)]
    rows += [(None, None), ("", "the"), ("the", ""), ("  ", ","), ("t", text(20_000))]
    entries = {
        "old": {w: ("noun", 7 + n) for n, w in enumerate(words) if n % 2},
        "new": {w: ("noun" if n % 3 else "verb", 7 + n) for n, w in enumerate(words) if n % 4},
    }
    entries["old"]["the"] = ("article", 1)
    flat = [(v, w, p, c) for v, table in entries.items() for w, (p, c) in table.items()]
    flat.append(("old", "the", "zzz", 99))  # a second, dearer entry loses
    lexicon = spark.createDataFrame(flat, "version string, surface string, pos string, cost bigint").cache()
    return rows, entries, lexicon


@pytest.mark.parametrize("slices", [1000, 3, 1])
@pytest.mark.parametrize("new_pattern", [r"\w+", r"\w"])
def test_lexicon_against_brute_force(spark, corpus, slices, new_pattern):
    rows, entries, lexicon = corpus
    old = LexiconAnalyzer("o", r"\w+", lexicon, "old", "unk", 50)
    new = LexiconAnalyzer("n", new_pattern, lexicon, "new", "???", 3)
    df = attach_lexicon_results(
        articles(spark, rows), [("old", old), ("new", new)], slices=slices
    )
    got = by_n(df)
    want_old = brute_force(rows, entries["old"], r"\w+", ("unk", 50))
    want_new = brute_force(rows, entries["new"], new_pattern, ("???", 3))
    assert len(got) == len(rows)
    for row, old_want, new_want in zip(got, want_old, want_new):
        assert (plain(row["old"]["title"]), plain(row["old"]["text"])) == old_want
        assert (plain(row["new"]["title"]), plain(row["new"]["text"])) == new_want
        assert row["text"] == rows[row["n"]][1]


def test_salts_bound_the_share_of_a_join_key(spark, corpus):
    rows, _, lexicon = corpus
    tokens = lexicon_module._token_rows(articles(spark, rows), "seq", [r"\w+"])
    words = lexicon_module.dictionary([LexiconAnalyzer("o", r"\w+", lexicon, "old")])
    slices = 10
    left, right = lexicon_module._salted_sides(tokens, words, "seq", slices)
    shares = Counter((r["surface"], r["salt"]) for r in left.select("surface", "salt").collect())
    total = sum(shares.values())
    assert max(shares.values()) < 2 * total / slices
    assert right.count() <= words.count() + 2 * slices


@pytest.mark.parametrize("new_pattern", [r"\w+", r"\w"])
def test_lexicon_in_the_row_against_brute_force(spark, corpus, new_pattern):
    rows, entries, lexicon = corpus
    old = LexiconAnalyzer("o", r"\w+", lexicon, "old", "unk", 50)
    new = LexiconAnalyzer("n", new_pattern, lexicon, "new", "???", 3)
    df = compare(articles(spark, rows), old, new)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The one exchange is that of the test's own articles; a pattern is a pass.
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.count("ArrowEvalPython") == len({r"\w+", new_pattern})
    got = by_n(df)
    want_old = brute_force(rows, entries["old"], r"\w+", ("unk", 50))
    want_new = brute_force(rows, entries["new"], new_pattern, ("???", 3))
    assert len(got) == len(rows)
    for row, old_want, new_want in zip(got, want_old, want_new):
        assert (plain(row["old"]["title"]), plain(row["old"]["text"])) == old_want
        assert (plain(row["new"]["title"]), plain(row["new"]["text"])) == new_want


def test_lexicon_with_an_empty_version_and_null_entries(spark):
    rows = [(None, "a b a"), ("b", "")]
    flat = [("old", "a", None, 4), ("old", None, "x", 1), ("old", "", "x", 1)]
    lexicon = spark.createDataFrame(flat, "version string, surface string, pos string, cost bigint")
    old = LexiconAnalyzer("o", r"\w", lexicon, "old", "unk", 50)
    got = by_n(compare(articles(spark, rows), old, LexiconAnalyzer("n", r"\w", lexicon, "none", "?", 1)))
    assert plain(got[0]["old"]["text"]) == (58, ["a", "b", "a"], ["unk"] * 3)
    assert plain(got[0]["new"]["text"]) == (3, ["a", "b", "a"], ["?"] * 3)
    assert plain(got[1]["old"]["title"]) == (50, ["b"], ["unk"])


def test_costs_beyond_64_bits_fail_their_record(spark):
    rows = [("a", "a b"), ("a a a", ""), ("", "b")]
    half = 1 << 62
    lexicon = spark.createDataFrame([("old", "a", "x", half)], "version string, surface string, pos string, cost bigint")
    old = LexiconAnalyzer("o", r"\w", lexicon, "old", "unk", 1)
    got = by_n(compare(articles(spark, rows), old, BASIC_2))
    assert [r["error"] for r in got] == [None, f"o: {NO_COST}", None]
    assert got[1]["old"] is None and got[1]["new"] is not None
    assert got[0]["old"]["text"]["total_cost"] == half + 1


def test_rules_that_cannot_tell_fail_their_record(spark):
    rows = [("7", "8 9"), ("7", "x"), ("", "!"), (None, None)]

    def pos(token):
        return F.when(token != "!", "number")

    picky = PatternAnalyzer("numbers", r"\S", pos, lambda t: F.when(t == "!", 1).otherwise(t.try_cast("bigint")))
    huge = PatternAnalyzer("huge", r"\S", lambda t: F.lit("x"), lambda t: F.lit((1 << 63) - 1))
    got = by_n(compare(articles(spark, rows), picky, BASIC_1, all_results=False))
    reasons = [None, f"numbers: {NO_COST}", f"numbers: {NO_POS}", None]
    assert [r["error"] for r in got] == reasons
    assert [r["old"] is None for r in got] == [False, True, True, False]
    got = by_n(compare(articles(spark, rows), BASIC_1, huge))
    assert [r["error"] is None for r in got] == [False, True, True, True]
    # Versions that cut alike need no rules, unless a rule may fail.
    assert [r["error"] for r in by_n(compare(articles(spark, rows), picky, picky, all_results=False))] == reasons


def test_lexicon_mixed_with_pattern(spark, corpus):
    rows, entries, lexicon = corpus
    old = LexiconAnalyzer("o", r"\w+", lexicon, "old", "unk", 50)
    got = by_n(compare(articles(spark, rows[:20]), old, BASIC_2))
    want = brute_force(rows[:20], entries["old"], r"\w+", ("unk", 50))
    assert [(plain(r["old"]["title"]), plain(r["old"]["text"])) for r in got] == want


# Python


def failing_on(word):
    def factory():
        def run(text):
            if word in text:
                raise KeyError(word)
            return [(t, "x", 2) for t in text.split()]

        return run

    return factory


def test_python_analyzer_captures_errors_per_record(spark):
    rows = [("a b", "c"), ("bad", "c"), ("a", "bad"), (None, ""), ("x y", "z")]
    picky = PythonAnalyzer("picky", failing_on("bad"))
    easy = PythonAnalyzer("easy", failing_on("nothing"))
    got = by_n(compare(articles(spark, rows), easy, picky))
    assert [r["error"] for r in got] == [None, "KeyError: 'bad'", "KeyError: 'bad'", None, None]
    assert plain(got[0]["new"]["title"]) == (4, ["a", "b"], ["x", "x"])
    assert plain(got[3]["new"]["title"]) == (0, [], [])
    assert [r["has_difference"] for r in got] == [False] * 5
    assert [r["skipped"] for r in got] == [0, 0, 0, 1, 0]
    assert got[1]["new"] is None and got[1]["diff_types"] == []


def test_two_python_analyzers_are_one_pass(spark):
    df = compare(articles(spark, [("a", "b")] * 9), PythonAnalyzer("p", failing_on("zz")), PythonAnalyzer("q", failing_on("a")))
    plan = df.filter("has_difference")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r["error"] for r in df.collect()} == {"KeyError: 'a'"}


def test_python_analyzer_runs_once_per_record(spark):
    rows = [("a b", "c")] * 20
    df = compare(articles(spark, rows), BASIC_1, PythonAnalyzer("p", failing_on("zz")))
    plan = df.filter("has_difference and skipped = 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_python_analyzer_on_more_rows_than_one_frame(spark):
    rows = [(f"t{n}", f"a{n} bad" if n % 50 == 0 else f"a{n} b") for n in range(3000)]
    got = by_n(compare(articles(spark, rows), BASIC_1, PythonAnalyzer("p", failing_on("bad"))))
    assert [r["error"] is not None for r in got] == [n % 50 == 0 for n in range(3000)]
    assert all(r["new"]["text"]["terms"] == [f"a{n}", "b"] for n, r in enumerate(got) if n % 50)


def test_lookup_holds_a_slice_of_a_batch(spark, monkeypatch):
    """A batch of many tokens is looked up, and given out, slice by slice."""
    import numpy as np
    import pyarrow as pa

    from lexdrift.operators import row_lexicon
    from lexdrift.operators.trie import build, packed_strings

    monkeypatch.setattr(row_lexicon, "SLICE_TOKENS", 1000)
    data, offsets = packed_strings(["known", "unknown"])
    arrays = {**build(["a", "b"]), "cost0": np.array([1, 2, 9], "<i8").view("<i4"), "pos0": np.array([0, 0, 1], np.int32)}
    arrays |= {"names0": data, "offsets0": offsets}
    arrays = {k: memoryview(np.ascontiguousarray(v, "<i4").tobytes()).cast("i") for k, v in arrays.items()}
    titles = [None, ["a"], []] * 20
    texts = [["a", "b", "c"] * (n * 10) for n in range(60)]
    batch = pa.array(titles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))
    got = list(row_lexicon.looked_up_slices(arrays, {"old": 0}, iter([batch])))
    rows = [r["old"] for part in got for r in part.to_pylist()]
    assert [r["text_cost"] for r in rows] == [12 * n * 10 for n in range(60)]
    assert [r["title_cost"] for r in rows] == [0, 1, 0] * 20
    assert rows[1]["text_pos"] == ["known", "known", "unknown"] * 10
    assert len(got) > 20 and max(sum(len(r["old"]["text_pos"]) for r in part.to_pylist()) for part in got) <= 1000 + 3 * 590


def test_words_are_looked_up_once_for_a_block(spark, corpus, monkeypatch):
    """Rows that meet the dictionary: the words of each block, however often they occur; blocks change no result."""
    rows, entries, lexicon = corpus
    old = LexiconAnalyzer("o", r"\w+", lexicon, "old", "unk", 50)
    met, lookup = [], lexicon_module._salted_lookup
    monkeypatch.setattr(lexicon_module, "_salted_lookup", lambda tokens, *a: met.append(tokens.count()) or lookup(tokens, *a))
    want = brute_force(rows, entries["old"], r"\w+", ("unk", 50))
    for block in (1 << 20, 500):
        monkeypatch.setattr(lexicon_module, "BLOCK_BYTES", block)
        got = by_n(attach_lexicon_results(articles(spark, rows), [("old", old)]))
        assert [(plain(r["old"]["title"]), plain(r["old"]["text"])) for r in got] == want
        assert met.pop() < sum(len(re.findall(r"\w+", t or "")) for pair in rows for t in pair) / 2


def test_shuffled_costs_beyond_64_bits_are_null(spark):
    flat = [("old", "a", "x", 1 << 62), ("old", "b", "x", -(1 << 62))]
    lexicon = spark.createDataFrame(flat, "version string, surface string, pos string, cost bigint")
    old = LexiconAnalyzer("o", r"\w", lexicon, "old", "unk", 1)
    got = by_n(attach_lexicon_results(articles(spark, [("a b a", "a a b"), ("a", "c")]), [("old", old)]))
    assert [(r["old"]["title"]["total_cost"], r["old"]["text"]["total_cost"]) for r in got] == [(1 << 62, None), (1 << 62, 1)]
