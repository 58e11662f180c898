"""Segmentation by a dictionary with path costs, against all segmentations; the trie on its own."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexdrift.operators import BASIC_1, UnknownWords, compare, lattice_analyzer, register, resolve
from lexdrift.operators import trie as trie_module
from lexdrift.operators.lattice import BatchSegmenter, Segmenter, lattice_arrays
from lexdrift.operators.trie import Trie, build, map_arrays, write_arrays

from test_analyzers import articles, by_n, plain


def mapped(arrays, folder):
    path = str(folder / "table")
    write_arrays(path, arrays)
    return map_arrays(path)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abcé中\U0001f600", min_size=0, max_size=6), max_size=40), st.text("abcé中x", max_size=12))
def test_trie_finds_all_words_at_every_place(tmp_path_factory, words, text):
    ordered = sorted(words)
    trie = Trie(mapped(build(ordered), tmp_path_factory.mktemp("trie")))
    codes = trie.codes(text)
    for at in range(len(text)):
        want = [(e, ordered.index(text[at:e])) for e in range(at + 1, len(text) + 1) if text[at:e] in words]
        assert list(trie.prefixes(codes, at)) == want
    for word in [*ordered, text]:
        assert trie.find(word) == (ordered.index(word) if word and word in words else -1)


def test_trie_of_many_words(tmp_path):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(20_000)})
    trie = Trie(mapped(build(words), tmp_path))
    assert [trie.find(w) for w in words] == list(range(len(words)))
    assert trie.find("zz") == trie.find("") == -1


ENTRIES = [
    ("a", "x", 5, 1, 1), ("a", "y", 5, 2, 1), ("ab", "x", 9, 1, 2), ("b", "x", 4, 2, 2), ("abc", "z", 14, 1, 1),
    ("bc", "x", 9, 2, 1), ("c", "x", 5, 1, 1), ("c", "x", 5, 1, 1), ("é", None, -3, 2, 2), ("ca", "z", 10, 1, 2),
]
LINKS = [(0, 1, 1), (0, 2, 1), (1, 1, 2), (1, 2, 0), (2, 1, 1), (2, 2, 2), (1, 0, 1), (2, 0, 1), (2, 0, 7)]
UNKNOWN = UnknownWords("?", 6, 1, 2, 1)


@pytest.fixture(scope="module")
def tables(spark):
    dictionary = spark.createDataFrame(ENTRIES, "surface string, pos string, cost int, left_id int, right_id int")
    return dictionary, spark.createDataFrame(LINKS, "right_id int, left_id int, cost int")


@pytest.fixture(scope="module")
def segmenter(tables, tmp_path_factory):
    return Segmenter(mapped(lattice_arrays(*tables), tmp_path_factory.mktemp("lattice")), UNKNOWN)


def every_path(run):
    """All paths as (key, words): the key is cost, number of words, then the words from the last on."""
    entries = sorted(set(ENTRIES), key=lambda r: (r[0], r[2], r[3], r[4], r[1] or ""))
    links = {}
    for right, left, cost in LINKS:
        links[right, left] = min(cost, links.get((right, left), cost))

    def kind(c):
        return "L" if c.isalpha() else "N" if c.isnumeric() else ""

    def after(at, right):
        if at == len(run):
            yield links.get((right, 0), 0), []
            return
        found = [(n, e) for n, e in enumerate(entries) if run.startswith(e[0], at)]
        if not found:
            end = at + 1
            while kind(run[at]) and end < len(run) and kind(run[end]) == kind(run[at]):
                end += 1
            found = [(-1, (run[at:end], UNKNOWN.pos, UNKNOWN.cost + UNKNOWN.letter_cost * (end - at), 2, 1))]
        for n, (surface, pos, cost, left, r) in found:
            for rest, words in after(at + len(surface), r):
                step = links.get((right, left), 0) + cost
                yield step + rest, [(at, n, surface, pos or "", step), *words]

    for cost, words in after(0, 0):
        yield (cost, len(words), [w[:2] for w in reversed(words)]), words


@settings(max_examples=400, deadline=None)
@given(st.text("abcéx12.", min_size=1, max_size=9))
def test_cheapest_path_equals_brute_force(segmenter, run):
    (cost, _, _), words = min(every_path(run), key=lambda p: p[0])
    found = segmenter.segment(run)
    assert [(s, p) for s, p, _ in found] == [w[2:4] for w in words]
    assert sum(c for _, _, c in found) == cost
    assert [c for _, _, c in found[:-1]] == [w[4] for w in words[:-1]]


def test_long_runs_and_white_space(segmenter):
    found = list(segmenter(" abc\n　x9 " + "abc" * 20_000))
    assert "".join(s for s, _, _ in found) == "abcx9" + "abc" * 20_000
    assert list(segmenter("")) == list(segmenter(" \n")) == []


def test_registered_analyzer_in_a_comparison(spark, tables, segmenter):
    register(lattice_analyzer("cheapest", *tables, UNKNOWN))
    rows = [("ab c", "abcé x1"), (None, ""), ("", "." * 30)] * 5
    got = by_n(compare(articles(spark, rows), BASIC_1, resolve("cheapest")))
    for row, (title, text) in zip(got, rows):
        for slot, value in (("title", title), ("text", text)):
            words = list(segmenter(value or ""))
            want = sum(w[2] for w in words), [w[0] for w in words], [w[1] for w in words]
            assert plain(row["new"][slot]) == want
    assert all(r["error"] is None for r in got)


def test_empty_dictionary_leaves_unknown_words(spark, tables):
    dictionary, links = tables
    analyzer = lattice_analyzer("none", dictionary.limit(0), links.limit(0), UnknownWords(cost=3))
    (row,) = by_n(compare(articles(spark, [("ab12", "a-b")]), BASIC_1, analyzer))
    assert plain(row["new"]["title"]) == (6, ["ab", "12"], ["unknown"] * 2)
    assert plain(row["new"]["text"]) == (9, ["a", "-", "b"], ["unknown"] * 3)


def test_tables_out_of_bounds_are_refused(spark, tables, monkeypatch):
    dictionary, links = tables
    with pytest.raises(ValueError, match="contexts"):
        lattice_analyzer("far", dictionary, links, UnknownWords(left_id=99))
    bad = spark.createDataFrame([("a", "x", 1, -1, 0)], dictionary.schema)
    with pytest.raises(ValueError, match="contexts"):
        lattice_analyzer("negative", bad, links)
    dear = spark.createDataFrame([("a", "x", 1 << 30, 0, 0)], dictionary.schema)
    with pytest.raises(ValueError, match="costs"):
        lattice_analyzer("dear", dear, links)
    monkeypatch.setattr(trie_module, "TABLE_BYTES", 5)
    with pytest.raises(ValueError, match="bytes"):
        lattice_analyzer("large", dictionary, links)


@pytest.mark.parametrize("letters", [1024, 5])
@pytest.mark.parametrize("unknown", [UNKNOWN, UnknownWords("z", -4, -2, 0, 2), UnknownWords("?", 1 << 40, 1 << 30, 1, 1)])
def test_runs_segmented_together_equal_single_ones(tables, tmp_path, monkeypatch, unknown, letters):
    """Texts of a batch share their runs, which are segmented as arrays; costs, words and ties are those of each alone."""
    monkeypatch.setattr("lexdrift.operators.lattice.RUN_LETTERS", letters)
    monkeypatch.setattr("lexdrift.operators.lattice.LETTERS", 300)
    arrays = mapped(lattice_arrays(*tables), tmp_path)
    one, many = Segmenter(arrays, unknown), BatchSegmenter(arrays, unknown)
    rng = random.Random(4)
    runs = ["".join(rng.choice("abcabcé中\U0001f600x12.") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts = [" ".join(rng.choice(runs) for _ in range(rng.randrange(30))) for _ in range(80)] + [None, "", " \n", "ab" * 900]
    many.segment, alone, calls = lambda run: calls.append(run) or alone(run), many.segment, []
    cost, terms, pos = (column.to_pylist() for column in many.results(texts))
    for k, text in enumerate(texts):
        words = list(one(text or ""))
        assert (cost[k], terms[k], pos[k]) == (sum(w[2] for w in words), [w[0] for w in words], [w[1] for w in words])
    if letters == 1024 and unknown.cost < 1 << 40:
        assert calls == ["ab" * 900]  # nothing else goes letter by letter in Python


def test_a_record_beyond_64_bits_fails_alone(spark, tables):
    analyzer = lattice_analyzer("huge", *tables, UnknownWords(cost=1 << 62))
    got = by_n(compare(articles(spark, [("a", "zq zq"), ("a", "zq"), ("", "ab")]), BASIC_1, analyzer))
    assert [r["error"] is None for r in got] == [False, True, True]
