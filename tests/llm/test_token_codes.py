"""Directly addressable codes: round trips, single ids by address, and the query against whole texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexdrift.llm import queries, token_codes
from lexdrift.llm.pieces import Encode, whole_tokenizer

from .conftest import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def pieces():
    return token_codes.PieceTokenizer(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_round_trip_and_single_ids(ids):
    codes = token_codes.Codes(token_codes.encode_ids(np.array(ids, np.uint32)))
    assert len(codes) == len(ids)
    assert codes.decode().tolist() == ids
    assert [codes[k] for k in range(len(ids))] == ids


def test_long_sequences_and_foreign_bytes():
    rng = np.random.default_rng(1)
    ids = (rng.integers(0, 2**32, 50_000, np.uint64) >> rng.integers(0, 32, 50_000).astype(np.uint64)).astype(np.uint32)
    codes = token_codes.Codes(token_codes.encode_ids(ids))
    assert np.array_equal(codes.decode(), ids)
    assert all(codes[k] == ids[k] for k in range(0, 50_000, 7))
    with pytest.raises(ValueError):
        token_codes.Codes(b"PAR1" + b"\0" * 40)


PARTS = ["a", "b's", "é", "ﬀ", " ", "  ", "\n", "\t", " ", "\u0085", "　", " ", " ", " ", " ",
         " ", "\x1c", "\x00", "12", ".", "!!", "'ll", "…", "“", "中文", "\U0001f600", "<|endoftext|>", "́", "​"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(tokenizer, pieces, texts):
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [token_codes.END] for t in texts]
    ids, sizes = pieces(pa.array(texts, pa.string()))
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_pieces_of_sliced_and_null_texts(pieces):
    texts = pa.array(["first one", None, "", "two  words", " x"])
    ids, sizes = pieces(texts.slice(1, 3))
    alone, _ = pieces(pa.array(["two  words"]))
    assert ids.tolist() == [2, 2, *alone.tolist()] and sizes.tolist() == [1, 1, len(alone)]


def test_a_tokenizer_that_cannot_be_cut_is_refused():
    with pytest.raises(ValueError):
        token_codes.PieceTokenizer(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_shortcut_gives_the_ids_of_the_whole_tokenizer(name):
    encode = Encode(whole_tokenizer(public_tokenizers.path(name)))
    assert encode.usable and encode.keeps_case == name.startswith("byte")
    letters = [chr(c) for c in range(33, 0x250) if chr(c).isalpha()]
    rng = random.Random(5)
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(3000)]
    words += [*letters, "", " ", ".", ",", " .", "..", "I'll", "a.b", "x1", "\u0130", "\u03a3", "\ufb01", "e\u0301", "\u00aa", "\u00b5"]
    pieces = [(" " if name.startswith("byte") and rng.random() < 0.7 else "") + w + rng.choice(["", "", ".", ",", "!"]) for w in words]
    assert encode(pieces) == encode.whole(pieces)


def test_query_equals_whole_texts(spark, sf_dir, tokenizer):
    rows = queries.QUERIES["op12_token_codes"](spark, sf_dir).collect()
    docs = [(r["doc_id"], r["text"] or "") for r in table(sf_dir, "documents")]
    want = {}
    for doc_id, text in docs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert len(rows) == len(docs)
    upto = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == upto
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        upto += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is None, d or 0))


def test_ids_by_address(spark, edge_dir, tmp_path, tokenizer, monkeypatch):
    monkeypatch.setattr(token_codes, "SEGMENT", 500)
    folder = str(tmp_path / "tokens")
    token_codes.write(spark.read.parquet(f"{edge_dir}/documents.parquet"), PATH, folder)
    assert spark.read.parquet(folder).count() > 8
    docs = {r["doc_id"]: r["text"] or "" for r in table(edge_dir, "documents") if r["doc_id"] not in (None, 31)}
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [2] for d, t in docs.items()}
    asked = [(d, k) for d, found in ids.items() for k in {0, len(found) // 2, len(found) - 1, len(found), -1}]
    wanted = spark.createDataFrame([*asked, asked[0], (None, 0), (10**6, 0), (3, None)], "doc_id bigint, at bigint")
    rows = token_codes.tokens_at(spark, folder, wanted).collect()
    assert sorted((r["doc_id"], r["at"], r["id"]) for r in rows) == sorted(
        (d, k, ids[d][k]) for d, k in asked if 0 <= k < len(ids[d])
    )
