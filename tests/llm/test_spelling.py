"""Spelling groups against brute force over all pairs, and the filters on their own."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexdrift.llm import queries, spelling

from .conftest import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def counts_of(docs):
    out = Counter()
    for r in docs:
        for run in RUN.findall(r["text"] or ""):
            word = run.translate(LOWER)
            doc_id = "" if r["doc_id"] is None else r["doc_id"]
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def groups_of(counts):
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    near_words = {w: [v for d in (-1, 0, 1) for v in by_length.get(len(w) + d, []) if near(w, v)] for w in counts}
    form = {}
    for w, found in near_words.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near_words[w]), counts.get(form[w])))
    return rows


def as_set(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark, sf_dir):
    got = as_set(queries.QUERIES["op13_spelling"](spark, sf_dir))
    assert got == groups_of(counts_of(table(sf_dir, "documents")))


@pytest.fixture(scope="module")
def variants_dir(tmp_path_factory):
    """Families of words with misspellings, chains of forms, double letters and accents."""
    rng = random.Random(11)
    letters = "abcdeéÿÀz"
    lines = []
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(6, 10)))
        n = rng.choice([5, 30, 200])
        lines += [word] * n
        for _ in range(3):
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", rng.choice(letters), word[at] * 2]) + word[at + 1 :]
            lines += [word] * max(5, n // rng.choice([5, 6, 25]))
    lines += ["Chained"] * 4000 + ["chaineds"] * 800 + ["chainedss"] * 160 + ["xchainedss"] * 32 + ["xchainedsss"] * 6
    lines += ["w" * 3000 + "x"] * 40 + ["w" * 3000 + "xx"] * 8 + ["longer" * 20] * 6 + ["longer" * 20 + "a"] * 30
    rng.shuffle(lines)
    docs = [", ".join(lines[k : k + 40]) for k in range(0, len(lines), 40)]
    docs += [None, "", "1 2 3", "Ā×÷abŸabcdefg中abcdefg\U0001f600"]
    path = str(tmp_path_factory.mktemp("variants"))
    ids = [*range(len(docs) - 1), None]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": docs, "word": ["clash"] * len(docs), "n": docs}), f"{path}/documents.parquet")
    return path


def test_variants_equal_brute_force(spark, variants_dir):
    want = groups_of(counts_of(table(variants_dir, "documents")))
    assert sum(w[1] is not None for w in want) > 25 and max(len(w[0]) for w in want) > 3000
    assert as_set(queries.QUERIES["op13_spelling"](spark, variants_dir)) == want


def test_filters_that_are_too_small_lose_nothing(spark, variants_dir, monkeypatch):
    monkeypatch.setattr(spelling, "FILTER_BYTES", 64)
    monkeypatch.setattr(spelling, "EDITS", 100)
    want = groups_of(counts_of(table(variants_dir, "documents")))
    assert as_set(queries.QUERIES["op13_spelling"](spark, variants_dir)) == want


def test_filters_hold_every_word_and_few_others(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(4000)})
    vocabulary = spark.createDataFrame([(w, 1, 8) for w in words], "word string, n bigint, length bigint")
    filters = spelling.BloomShards.build(vocabulary)
    assert len(filters.probe(8, spelling.word_hash(spelling._letters(words)))) == len(words)
    others = ["".join(rng.choice("klmnopqrst") for _ in range(8)) for _ in range(20000)]
    assert len(filters.probe(8, spelling.word_hash(spelling._letters(others)))) < 200
    assert len(filters.probe(9, np.zeros(3, np.uint64))) == 0


def test_edits_have_the_hash_of_their_word():
    class All:
        """Lets every hash through and keeps it."""

        def __init__(self):
            self.seen = {}

        def probe(self, length, h):
            self.seen.setdefault(length, []).extend(h.tolist())
            return np.arange(len(h))

    alphabet = np.array(sorted(map(ord, "abcdéÿ")), np.uint64)
    words = ["aabbcd", "éÿabca", "dddddd"]
    every = All()
    edits = [e for _, e in spelling.positive_edits(words, alphabet, every)]
    for length, hashes in every.seen.items():
        own = [e for e in edits if len(e) == length]
        assert spelling.word_hash(spelling._letters(own)).tolist() == hashes
    deletions = {w[:k] + w[k + 1 :] for w in words for k in range(len(w))}
    later = [w[:k] + chr(c) + w[k + 1 :] for w in words for k in range(len(w)) for c in alphabet if c > ord(w[k])]
    assert sorted(edits) == sorted([*deletions, *later])


def test_damage_can_be_left_out(spark):
    docs = spark.createDataFrame([(n, "Straße straße STRASSE") for n in range(400)], "doc_id bigint, text string")
    rows = {r["word"]: r["n"] for r in spelling.word_counts(docs, damage=0).collect()}
    assert rows == {"straße": 800, "strasse": 400}
