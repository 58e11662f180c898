from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest

from lexdrift.llm import katz, queries

from .test_contracts import documents, words_of


def tokens_of(text):
    return words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


class Brute:
    def __init__(self, docs):
        self.one, self.two, self.starts = Counter(), defaultdict(Counter), 0
        for doc_id, text, _ in docs:
            if not held(doc_id):
                before = "<"
                self.starts += 1
                for w in tokens_of(text):
                    self.one[w] += 1
                    self.two[("h", before)][w] += 1
                    before = w
        self.n, self.v = sum(self.one.values()), len(self.one)
        counts = Counter(c for ws in self.two.values() for c in ws.values())
        self.d = katz.discounts([counts[r] for r in range(1, katz.K + 2)])

    def single(self, w):
        return (self.one[w] + 1) / (self.n + self.v + 1)

    def lowered(self, c):
        return self.d[c] * c if c <= katz.K else c - 0.5

    def p(self, w, h):
        total = self.starts if h == "<" else self.one[h]
        if not total:
            return self.single(w)
        after = self.two[("h", h)]
        if after[w]:
            return self.lowered(after[w]) / total
        mass = sum(self.lowered(c) for c in after.values() if c) / total
        return (1 - mass) / (1 - sum(self.single(x) for x, c in after.items() if c)) * self.single(w)

    def score(self, tokens):
        return sum(math.log10(self.p(w, h)) for w, h in zip(tokens, ["<", *tokens]))


@pytest.mark.parametrize("block", [800_000, 500])
def test_against_brute_force(spark, sf_dir, block, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK", block)
    docs = documents(sf_dir)
    model = Brute(docs)
    want = defaultdict(list)
    for doc_id, text, _ in docs:
        t = tokens_of(text)
        known = sum(model.one[w] > 0 for w in t)
        want[doc_id].append((held(doc_id), len(t), known, model.n, sum(math.log10(model.single(w)) for w in t), model.score(t)))
    rows = queries.op9_katz(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert any(tuple(r)[1:5] == w[:4] and r[5] == pytest.approx(w[4]) and r[6] == pytest.approx(w[5]) for w in want[r[0]])


def test_histories_sum_to_one(sf_dir):
    """The unknown word included; over the most and the least frequent histories."""
    model = Brute(documents(sf_dir))
    frequent = [w for w, _ in model.one.most_common(4)] + [w for n in (1, 2, 5) for w, c in model.one.items() if c == n][::7][:9]
    for h in ["<", *frequent]:
        if h is not None:
            assert sum(model.p(w, h) for w in [*model.one, "never seen anywhere"]) == pytest.approx(1)


def test_texts_without_blanks_fill_blocks_too(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(katz, "BLOCK", 1000)
    rows = [(n, "\u65e5\u672c" * 2500) for n in range(30)] + [(n, "\t".join(["w"] * 500)) for n in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    sizes = [len(r["sizes"]) // 8 for r in katz.blocks(docs).collect()]
    assert max(sizes) <= 2 and sum(sizes) == 60


def test_discounts():
    assert all(0 < x < 1 for x in katz.discounts([1000, 300, 120, 60, 30, 20])[1:])
    assert katz.discounts([0] * 6)[1] == 0.5
