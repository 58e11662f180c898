"""Contract queries against brute force, on the given and on the edge tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from lexdrift.llm import mixing, packing, queries, simhash

from .conftest import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(sf_dir):
    return [(r["doc_id"], r["text"], r["source"]) for r in table(sf_dir, "documents")]


def words_of(text):
    return WORD.findall(text or "")


def run(spark, name, sf_dir):
    return queries.QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, name, empty_dir):
    assert run(spark, name, empty_dir) == []


def test_mix(spark, sf_dir):
    rows = run(spark, "op3_mix", sf_dir)
    docs = documents(sf_dir)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, len(words_of(t))) for d, t, _ in docs)
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(words_of(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(sizes.values())
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = {}
    while True:
        rest, weight = total - sum(capped.values()), sum(w for s, w in weights.items() if s not in capped)
        want = {s: capped.get(s, rest * w / weight) for s, w in weights.items()}
        above = [s for s in order if s not in capped and want[s] > 3 * sizes[s]]
        if not above:
            break
        capped |= {s: 3 * sizes[s] for s in above}
    got, known = defaultdict(int), {}
    for r in rows:
        got[r["source"]] += r["taken"]
        known[r["source"]] = (r["source_size"], r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in order:
        assert known[s][0] == sizes[s] and known[s][1] == pytest.approx(want[s])
        assert abs(got[s] - want[s]) <= 2 * mixing.BLOCK
    assert Counter(rows) == Counter(run(spark, "op3_mix", sf_dir))


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_shards_add_up_to_the_quota():
    quota = [1000, 0, 17, 5003]
    parts = [mixing.shard_counts(quota, 512, 3, n) for n in range(12)]
    assert sum(c for c, _ in parts).tolist() == quota
    for (count, before), (_, after) in zip(parts, parts[1:]):
        assert (before + count).tolist() == after.tolist()


def test_draws_beyond_the_generators_limit(monkeypatch):
    """The same mean and variance on both sides of the limit; sums and bounds hold."""
    n = 9 * 10**8
    cases = [(4 * n // 9, 5 * n // 9, n // 2), (30, n, n // 3), (n, 30, n // 3), (n // 2, n // 3, 50), (n // 3, n // 2, 5 * n // 6 - 50), (10, n, n + 10), (7, 0, 3)]
    for count, rest, taken in cases:
        found = []
        for limit in (10**9, 1):
            monkeypatch.setattr(mixing, "DRAW_LIMIT", limit)
            rng = np.random.default_rng(7)
            found.append(np.array([mixing._drawn(count, rest, taken, rng) for _ in range(4000)]))
            assert found[-1].min() >= max(0, taken - rest) and found[-1].max() <= min(count, taken)
        exact, other = found
        assert abs(exact.mean() - other.mean()) <= 0.1 * exact.std() + 1e-9
        assert other.std() == pytest.approx(exact.std(), rel=0.1, abs=0.05)
    monkeypatch.setattr(mixing, "DRAW_LIMIT", 10**9)
    quota = [5 * 10**12, 3, 10**12, 0]
    shards = -(-sum(quota) // 4096)
    for number in (0, 1, shards // 2, shards - 1):
        counts, before = mixing.shard_counts(quota, 4096, 1, number)
        assert counts.sum() == min(4096, sum(quota) - number * 4096) and before.sum() == number * 4096
        assert (before + counts <= quota).all()


def test_documents_without_an_id_are_spread(spark):
    rows = [(None, "s", n % 700) for n in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    placed = mixing.numbered(docs, 100_000).orderBy("at").collect()
    upto = 0
    for r in placed:
        assert r["at"] == upto
        upto += r["size"]


def test_mixed_words_stay_as_written():
    body = b"  one\ttwo\n\nthree  four five \n"
    assert mixing.cut_words(body, [(0, 3), (3, 2)]) == b"one\ttwo\n\nthree  four five"
    assert mixing.cut_words(body, [(1, 2), (4, 1)]) == b"two\n\nthree  \nfive"
    assert mixing.cut_words(body, []) == b""


def test_mixed_rows_are_parts_of_their_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mixing.mix(docs.withColumn("size", mixing.word_count(docs["text"])))
    rows = mixing.mixed_texts(mixed).collect()
    assert sum(len(words_of(r["text"])) for r in rows) == sum(r["taken"] for r in mixing.taken(mixed).collect())
    texts = defaultdict(list)
    for doc_id, text, _ in documents(sf_dir):
        texts[doc_id].append(text or "")
    for r in rows:
        assert any(all(part.strip() in t for part in re.split(r"\n", r["text"])) for t in texts[r["doc_id"]])


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf_dir):
    rows = run(spark, "op6_simhash", sf_dir)
    docs = documents(sf_dir)
    prints = [brute_fingerprint(t) for _, t, _ in docs]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter(
        (d, f"{f:016x}") for (d, _, _), f in zip(docs, prints)
    )
    classes = brute_components({f: f for f in prints})
    least = {}
    for (d, _, _), f in zip(docs, prints):
        if d is not None:
            least[classes[f]] = min(d, least.get(classes[f], d))
    assert all(r["component_id"] == least.get(classes[int(r["fingerprint"], 16)]) for r in rows)


@pytest.mark.parametrize("block", [512, 8])
def test_links_of_a_crowd(spark, monkeypatch, block):
    """Chains and balls of fingerprints; small blocks are cut again and meet in chunks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(3):
        centre = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(150):
            bits = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in bits))
    chain = 5
    for b in range(0, 60, 3):
        chain ^= 7 << b
        fps.add(chain)
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(frame)).collect()}
    want = brute_components({f: f for f in fps})
    got = defaultdict(set)
    for f in fps:
        got[found.get(simhash._signed(f), simhash._signed(f))].add(f)
    groups = defaultdict(set)
    for f, c in want.items():
        groups[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return spans + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_secrets(spark, sf_dir):
    rows = run(spark, "op8_secrets", sf_dir)
    want = Counter()
    for doc_id, text, _ in documents(sf_dir):
        spans = sorted(brute_spans(text or ""))
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        counts = Counter(s[3] for s in spans)
        want[(doc_id, counts["assign"], counts["access"], counts["hex"], hashlib.sha256(line.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == want
    assert any(r["spans"] for r in rows) == any(brute_spans(t or "") for _, t, _ in documents(sf_dir))


def test_packing(spark, sf_dir):
    rows = run(spark, "op10_pack", sf_dir)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(sf_dir)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in docs]
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(list)
    for (d, _, _), i in zip(docs, ids):
        want[d].append(i)
    assert set(by_doc) == set(want)
    for d, (first, *more) in want.items():
        if not more:
            upto = 0
            for r in sorted(by_doc[d], key=lambda r: r["start"]):
                piece = first[upto : upto + r["length"]]
                assert r["start"] == upto and r["doc_tokens"] == len(first)
                assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
                upto += r["length"]
            assert upto == len(first)
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for pieces in windows.values():
        upto = 0
        for offset, length in sorted(pieces):
            assert offset == upto
            upto += length
        assert upto <= 4096
        padding += 0 if upto & (upto - 1) == 0 else 4096 - upto
    assert padding <= 4096 * 9 + 0.02 * sum(map(len, ids))


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(40):
        places = np.unique(np.append(rng.integers(1, 60, 12), 60))
        places = np.unique(np.concatenate([places, np.arange(10, 60, 10)]))
        penalties = rng.integers(0, 30, len(places))

        def price(a, b, penalties=penalties, places=places):
            n = b - a
            free = n & (n - 1) == 0 and n >= 1
            return (0 if free else 32 - n) + penalties[list(places).index(b)] + packing.WINDOW

        best = {0: 0}
        for b in places:
            best[b] = min(best[a] + price(a, b) for a in best if b - a <= 32)
        ends = packing.cuts(places, penalties, 32)
        assert sum(price(a, b) for a, b in zip([0, *ends], ends)) == best[60]
