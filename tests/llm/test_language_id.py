from __future__ import annotations

import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexdrift.llm import language_id, queries

from .conftest import table


def test_priors_against_brute_force(spark, sf_dir):
    """The fusion, computed again in Python from the evidence of each page."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "pages"))
    langs, model = language_id.fit(docs)
    rows = language_id.evidence(pages, langs, model).collect()
    share = [np.exp(r["said"]) / np.exp(r["said"]).sum() for r in rows]

    def smoothed(members, parent):
        return (sum(members) + 5 * parent) / (len(members) + 5)

    every = smoothed(share, np.full(len(langs), 1 / len(langs)))
    groups = {n: defaultdict(list) for n in ("suffix", "host")}
    for r, s in zip(rows, share):
        groups["suffix"][r["suffix"]].append(s)
        groups["host"][r["host"]].append(s)
    want = Counter()
    for r in rows:
        prior = smoothed(groups["host"][r["host"]], smoothed(groups["suffix"][r["suffix"]], every))
        fused = np.array(r["said"]) + np.log(prior)
        p = np.exp(fused - fused.max())
        want[(r["page_id"], langs[int(p.argmax())], round(float(p.max() / p.sum()), 6))] += 1
    got = queries.op2_language_id(spark, sf_dir).collect()
    assert Counter((r["page_id"], r["lang"], round(r["probability"], 6)) for r in got) == want
    assert Counter(r["page_id"] for r in got) == Counter(p["page_id"] for p in table(sf_dir, "pages"))


def test_language_without_declaration(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = docs.where("length(text) > 200").selectExpr("doc_id AS page_id", "CAST(NULL AS STRING) AS url", "text AS html", "lang AS truth")
    found = {r["page_id"]: r["lang"] for r in language_id.identify(pages, docs).collect()}
    truth = {r["page_id"]: r["truth"] for r in pages.collect()}
    assert sum(found[k] == v for k, v in truth.items()) / len(truth) > 0.95


def test_hidden_markup():
    assert language_id.visible(b"<p>a</p><script>var t='</p>'</script >b<!-- c -->").split() == [b"a", b"b"]


@pytest.mark.parametrize(
    "html, want",
    [
        (b"a<!-- x --><b>c</b>", b"a c"), (b"a<!-- never ends <p>b", b"a"), (b"a<style>x{}</style>b", b"a b"),
        (b"a<script >never ends <p>b</p>", b"a"), (b"a<scripted>b</scripted>", b"a b"), (b"1 < 2 and b", b"1 < 2 and b"),
        (b"a<!-->b-->c", b"a c"), (b"<STYLE>x</Style\n>y", b"y"),
    ],
)
def test_visible(html, want):
    assert language_id.visible(html).split() == want.split()


def test_declared_language():
    assert language_id.declared_language(b"<HTML class=x LANG='De-at'>") == "de"
    assert language_id.declared_language(b"<html><html lang=fr>") == "fr"
    assert language_id.declared_language(b"<html><p lang=fr>") is None
    assert language_id.declared_language(b"<html lang=en") == "en"


@pytest.mark.parametrize("part", [b"<!--", b"<script ", b"<", b"<html ", b"</script ", b"<style>"])
def test_long_pages_take_linear_time(part):
    html = part * (4_000_000 // len(part))
    start = time.perf_counter()
    language_id.visible(html)
    language_id.declared_language(html)
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("text", [b"", b" ", b"a"])
def test_short_texts(text):
    assert math.isfinite(language_id.trigrams(text).sum())
