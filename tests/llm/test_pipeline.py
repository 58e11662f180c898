from __future__ import annotations

import random

import corpus_pipeline as cp
import pytest

from lexdrift.llm import secret_scan, simhash

from .conftest import table
from .test_contracts import documents, words_of


def test_stages(spark, sf_dir):
    """Each stage on the documents that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = documents(sf_dir)
    kept = docs
    for (name, stage), check in zip(cp.STAGES, (None, check_classes, check_secrets, check_mix, None)):
        before = [r.asDict() for r in kept.select(*cp.COLUMNS).collect()]
        kept = cp.stored(stage(spark, kept, sf_dir), name)
        if name != "packing":
            assert kept.columns == cp.COLUMNS
        if check:
            check(before, kept.collect())
    assert len(given) == docs.count() and kept.count() > 0


def shingle_sets(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts):
    """Classes of texts by links of 0.8 of their shingles."""
    texts = list(dict.fromkeys(texts))
    sets = [shingle_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    return {t: find(i) for i, t in enumerate(texts)}


def check_classes(before, rows):
    """No class is lost, nothing goes without a near copy that stays, and few classes keep two."""
    classes = brute_classes([d["text"] or "" for d in before])
    kept = [classes[r["text"] or ""] for r in rows]
    assert set(kept) == set(classes.values())
    assert len(kept) <= 1.05 * len(set(kept)) + 1
    smallest = {}
    for d in before:
        if d["doc_id"] is not None:
            c = classes[d["text"] or ""]
            smallest[c] = min(d["doc_id"], smallest.get(c, d["doc_id"]))
    ids = {r["doc_id"] for r in rows}
    assert all(doc_id in ids for doc_id in smallest.values())


def check_secrets(before, rows):
    assert sorted(str(d["doc_id"]) for d in before) == sorted(str(r["doc_id"]) for r in rows)
    for r in rows:
        assert not any(len(m) >= 24 for m in secret_scan_hex(r["text"] or ""))


def secret_scan_hex(text):
    import re

    return re.findall(secret_scan.BASE_RULES[2].pattern, text)


def check_mix(before, rows):
    own = {d["doc_id"]: words_of(d["text"]) for d in before}
    for r in rows:
        assert set(words_of(r["text"])) <= set(own[r["doc_id"]])


def test_empty(spark, empty_dir):
    assert cp.run(spark, empty_dir).collect() == []


@pytest.mark.parametrize("text, spans, want", [("abc secret", [(4, 10)], "abc [SECRET]"), ("a b", [], "a b"), ("xxyyzz", [(0, 3), (2, 4)], "[SECRET]zz")])
def test_redact(spark, text, spans, want):
    frame = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start: bigint, end: bigint>>")
    from pyspark.sql import functions as F

    assert frame.select(secret_scan.redact(F.col("text"), F.col("spans"))).first()[0] == want


def test_nameless_class_keeps_one(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d"), (None, "a b c d"), (3, "x y z q w"), (2, "x y z q w"), (2, "x y z q w"), (9, ""), (8, None), (7, " \n")],
        "doc_id bigint, text string",
    )
    assert sorted(map(str, simhash.representatives(docs).collect())) == sorted(
        ["Row(doc_id=None, text='a b c d')", "Row(doc_id=2, text='x y z q w')", "Row(doc_id=7, text=' \\n')"]
    )


@pytest.mark.parametrize("turn", [1, -1])
def test_a_repeated_id_loses_no_class(spark, turn):
    """Rows are chosen, not ids: B keeps its class though its id's other row goes."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a), (5, b), (1, a), (7, b), (None, "alone here"), (None, "and here too"), (None, "alone here")][::turn]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = sorted(map(tuple, simhash.representatives(docs).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (None, "alone here"), (None, "and here too")], key=str)


@pytest.mark.parametrize("share, least", [(0.8, 0.85), (0.9, 0.95), (0.95, 0.97)])
def test_recall_of_near_copies(spark, share, least):
    """Copies of real texts with some words exchanged, by the similarity that is left."""
    rng = random.Random(3)
    texts = [d["text"] for d in table("/root/testdata/sf0.01", "documents") if 60 <= len((d["text"] or "").split()) <= 400]
    pool = [w for t in texts for w in t.split()]
    pairs = []
    for _ in range(4000):
        words = rng.choice(texts).split()
        copy = list(words)
        for _ in range(max(1, round(len(words) * rng.choice([0.005, 0.01, 0.02, 0.03])))):
            copy[rng.randrange(len(copy))] = rng.choice(pool)
        a, b = shingle_sets(" ".join(words)), shingle_sets(" ".join(copy))
        if share <= len(a & b) / len(a | b) < share + 0.05:
            pairs.append((" ".join(words), " ".join(copy)))
    pairs = pairs[:150]
    found = 0
    for one, other in pairs:
        a, b = (simhash.word_set_fingerprints(t.encode()) for t in (one, other))
        found += any((x ^ y).bit_count() <= simhash.DISTANCE for x, y in zip(a, b))
    assert len(pairs) > 40 and found / len(pairs) >= least


def test_links_that_no_fingerprint_shows(spark):
    """Copies at 0.8 and more whose fingerprints all differ in more bits, and copies that meet only one that is not alike."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows, pairs = [], 0
    while pairs < 6:
        one = [rng.choice(words) for _ in range(rng.randrange(40, 120))]
        other = list(one)
        for at in rng.sample(range(len(one)), max(1, len(one) // 50)):
            other[at] = rng.choice(words)
        texts = " ".join(one), " ".join(other)
        a, b = map(shingle_sets, texts)
        x, y = (simhash.word_set_fingerprints(t.encode()) for t in texts)
        if len(a & b) >= 0.8 * len(a | b) and all((p ^ q).bit_count() > simhash.DISTANCE for p, q in zip(x, y)):
            rows += [(2 * pairs, texts[0]), (2 * pairs + 1, texts[1])]
            pairs += 1
    rows += [(100, " ".join(words[:30])), (101, "  ".join(words[:30])), (102, " \n"), (103, "")]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(0, 2 * pairs, 2), 100, 102]


def copies_of_one(n, rng):
    """A text and ``n`` copies with words exchanged: most are alike with the text, few with each other, some with none."""
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, n + 1):
        other = list(base)
        for at in rng.sample(range(len(base)), rng.randrange(1, 5)):
            other[at] = rng.choice(words)
        rows.append((k, " ".join(other)))
    return rows


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_pairs_of_many_copies(spark, monkeypatch, block):
    """The pairs to verify grow with the copies, not with their square, and no class is lost."""
    rows, verified, pairs = copies_of_one(300, random.Random(11)), simhash._verified, []

    def counted(found, *given):
        pairs.append(found.count())
        return verified(found, *given)

    monkeypatch.setattr(simhash, "_verified", counted)
    monkeypatch.setattr(simhash, "BLOCK", block)
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    classes = brute_classes([text for _, text in rows])
    first = {}
    for doc_id, text in rows:
        first.setdefault(classes[text], doc_id)
    assert sorted(r["doc_id"] for r in got) == sorted(first.values()) and 1 < len(got) < 150
    # The first count is that of the fingerprints' pairs.
    assert sum(pairs[1:]) < 10 * len(rows)


@pytest.fixture
def small_broadcasts(spark):
    """As with a small driver: a table that is broadcast may have 32 MB in memory, be it sized lower by the planner or not."""
    name = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(name, "32m")
    yield
    spark.conf.unset(name)


def test_exploded_blocks_are_not_broadcast(spark, small_broadcasts):
    """Each fingerprint has a row for each of 16 blocks: 0.5 MB of files become 80 MB in memory."""
    rng = random.Random(13)
    ones = [rng.getrandbits(64) for _ in range(15_000)]
    rows = [(simhash._signed(f ^ change),) for f in ones for change in (0, 1 << rng.randrange(64))]
    frame = cp.stored(spark.createDataFrame(rows, "fp bigint"), "fingerprints")
    found = {frozenset(r) for r in simhash.links(frame).collect()}
    assert found == {frozenset([a, b]) for (a,), (b,) in zip(rows[::2], rows[1::2])}


def test_only_measured_tables_are_broadcast(spark, monkeypatch):
    """Rows exploded or unpacked from files are merged, small or not: only ids behind a shuffle, which counts them, and
    one row of each group of equal sets may be broadcast."""
    stored, plans = simhash.stored, []

    def recorded(df, *given):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, *given)

    monkeypatch.setattr(simhash, "stored", recorded)
    rows = copies_of_one(80, random.Random(11)) + [(100, "a b c"), (101, "A b c")]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string"))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line or "NestedLoop" in line]
    assert [j for j in joins if "LeftSemi" not in j and "[whole#" not in j] == []
    assert sum("SortMergeJoin" in plan for plan in plans) > 10 and {100, 101} & {r["doc_id"] for r in got.collect()} == {100}
