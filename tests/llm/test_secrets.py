"""The ledger of scanned blobs, and rules beyond the base ones."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexdrift.llm import secret_scan
from lexdrift.llm.secret_scan import BASE_RULES, RULES, BlobLedger, Rule, find_secrets, redact

KEY = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(["Ab3+/" * 12] * 3) + "\nxyz==\n-----END RSA PRIVATE KEY-----"


@pytest.fixture
def ledger(spark, tmp_path):
    return BlobLedger.create(spark, str(tmp_path / "ledger"))


def texts(spark, *values):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], "doc_id int, text string")


def spans(df):
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in df.collect()}


def test_second_update_scans_nothing_and_a_new_version_its_rule(spark, ledger, monkeypatch):
    scanned = []
    real = secret_scan.scan

    def counting(blobs, rules=RULES):
        scanned.append(sorted((r["blob"][:6], *r["todo"]) for r in blobs.select("blob", "todo").collect()))
        return real(blobs, rules)

    monkeypatch.setattr(secret_scan, "scan", counting)
    docs = texts(spark, "token=abcdefgh", "nothing", "token=abcdefgh", None, "")
    first = spans(find_secrets(docs, ledger, BASE_RULES))
    assert first == {0: [("assign", 0, 14)], 1: [], 2: [("assign", 0, 14)], 3: [], 4: []}
    assert len(scanned[0]) == 3 and all(len(row) == 1 + len(BASE_RULES) for row in scanned[0])
    assert spans(find_secrets(docs, ledger, BASE_RULES)) == first and scanned[1] == []
    # One more document: only it is scanned.
    assert spans(find_secrets(texts(spark, "AKIA" + "A" * 16, "nothing"), ledger, BASE_RULES))[0] == [("access", 0, 20)]
    assert len(scanned[2]) == 1
    newer = (replace(BASE_RULES[0], pattern=r"(token)=(b[a-z]+)", version=2), *BASE_RULES[1:])
    assert spans(find_secrets(docs, ledger, newer)) == {n: [] for n in range(5)}
    assert len(scanned[3]) == 3 and all(row[1:] == ("assign@2",) for row in scanned[3])
    # The findings of the old version are still there for whoever asks for them.
    assert spans(find_secrets(docs, ledger, BASE_RULES)) == first and scanned[4] == []


def test_an_update_that_broke_off_is_repeated_without_harm(spark, ledger):
    docs = texts(spark, "token=abcdefgh", "x")
    blobs = docs.select(secret_scan.blob_of(F.col("text")).alias("blob"), "text", F.array(F.lit("assign@1")).alias("todo"))
    # Findings were written, marks were not.
    secret_scan.scan(blobs, BASE_RULES[:1]).write.mode("append").parquet(f"{ledger.path}/findings")
    assert ledger.scanned().count() == 0
    assert spans(find_secrets(docs, ledger, BASE_RULES)) == {0: [("assign", 0, 14)], 1: []}
    assert ledger.scanned().count() == 2 * len(BASE_RULES)


@pytest.mark.parametrize(
    "text, rest",
    [
        (f"a {KEY} b", "a [SECRET] b"),
        (KEY.replace("\n", " "), "[SECRET]"),
        (KEY.split("-----END")[0] + "and then words", "[SECRET]\nxyz==\nand then words"),
        ("-----BEGIN PRIVATE KEY----- is how a key begins", "[SECRET] is how a key begins"),
        ("-----BEGIN PUBLIC KEY-----", "-----BEGIN PUBLIC KEY-----"),
        (f"{KEY}\n{KEY}", "[SECRET]\n[SECRET]"),
    ],
)
def test_private_keys_go_whole(spark, ledger, text, rest):
    found = find_secrets(texts(spark, text), ledger, RULES[-1:])
    assert found.select(redact(F.col("text"), F.col("spans"))).first()[0] == rest


def test_many_key_starts_take_linear_time(spark, ledger):
    text = "-----BEGIN PRIVATE KEY-----\n" * 20_000
    assert len(spans(find_secrets(texts(spark, text), ledger, RULES[-1:]))[0]) == 20_000


def test_rule_without_matches_of_full_length(spark, ledger):
    rule = Rule("short", "a+", 0, 3)
    assert spans(find_secrets(texts(spark, "a aaa aa aaaa"), ledger, (rule,))) == {0: [("short", 2, 5), ("short", 9, 13)]}
