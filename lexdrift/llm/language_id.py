"""Language of web pages by fused evidence.

Log evidence adds up: the likelihood of the visible text under each language's byte trigrams
(tempered, since neighbouring trigrams are not independent), how often a declared markup language
is right, and the prior of the page's host. Host priors come from the pages themselves by grouped
sums of what text and declaration say: a host's shares are smoothed towards those of its address
suffix, and these towards those of all pages.

The trigram model is fitted on at most ``SAMPLE`` documents of each language, the first by a hash of their
id. Pages are read whole. Group sums are aggregated before they are shuffled; a hot host's rows meet its one
row of priors in a join that the engine splits.

Defined cases: null or empty html has no text and no declaration and gets its host's prior; a null or
unusual url has host and suffix ''; unknown declared languages say nothing; null ids and repeated rows
are pages like others; ties go to the smaller language code; without labelled documents the language is null and
the probability 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdrift.llm.arrow import per_batch, texts_of
from lexdrift.plans.workspace import stored

SAMPLE = 400
BUCKETS = 1 << 14
TEMPER = 0.1
#: Share of declarations that are right.
TRUST = 0.9
#: Pages that a parent's shares count for.
STRENGTH = 5.0
_SCRIPT = re.compile(rb"(?i)<(script|style)\b")
_SCRIPT_ENDS = {name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (b"script", b"style")}
_ROOT = re.compile(rb"(?i)<html\b")
_LANG = re.compile(rb"""(?i)\blang\s*=\s*["']?([A-Za-z]{2,3})""")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def trigrams(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams, ASCII letters in lower case, runs of blanks as one."""
    codes = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(BUCKETS)
    grams = (codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(2654435761)
    return np.bincount(grams >> np.uint32(18), minlength=BUCKETS).astype(np.float64)


def visible(html: bytes) -> bytes:
    """Text outside tags, scripts, styles and comments; one that does not end hides the rest, a tag that does not
    end is text. Each byte is looked at once or twice."""
    out, at = [], 0
    while (start := html.find(b"<", at)) >= 0:
        out.append(html[at:start])
        script = _SCRIPT.match(html, start)
        if html.startswith(b"<!--", start):
            end = html.find(b"-->", start + 4) + 3
            at = end if end > 2 else len(html)
        elif script:
            end = _SCRIPT_ENDS[script[1].lower()].search(html, script.end())
            at = end.end() if end else len(html)
        else:
            at = html.find(b">", start) + 1
            if not at:
                at = start
                break
    out.append(html[at:])
    return b" ".join(out)


def declared_language(html: bytes) -> str | None:
    """The language that the first root tag with one declares."""
    at = 0
    while root := _ROOT.search(html, at):
        end = html.find(b">", root.end())
        found = _LANG.search(html, root.end(), end if end >= 0 else len(html))
        if found:
            return found[1].decode().lower()
        if end < 0:
            return None
        at = end
    return None


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of trigrams by language."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = labelled.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE)
    # SAMPLE rows of a language at most: a proven bound for a broadcast.
    picked = F.broadcast(picked.select("doc_id", F.col("lang").alias("label")).distinct())

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [trigrams(text) for text in texts_of(batch.column(1))]
        buckets = [np.flatnonzero(c) for c in found]
        sizes = [len(b) for b in buckets]
        columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))]
        columns += [pa.array(np.concatenate(buckets)), pa.array(np.concatenate([c[b] for c, b in zip(found, buckets)]))]
        return pa.RecordBatch.from_arrays(columns, names=["label", "bucket", "n"])

    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("label", "text")
    found = per_batch(rows, counted, "label string, bucket bigint, n double").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    # BUCKETS rows of a language at most.
    sums = found.toArrow()
    labels = sums["label"].to_pylist()
    langs = sorted(set(labels))
    table = np.full((len(langs), BUCKETS), 0.5)
    place = {x: k for k, x in enumerate(langs)}
    np.add.at(table, (np.array([place[x] for x in labels], np.int64), sums["bucket"].to_numpy()), sums["n"].to_numpy())
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(page_id, host, suffix, declared, said): log evidence of text and declaration by language."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        said, declared = [], []
        for html in texts_of(batch.column(2)):
            own = declared_language(html)
            score = TEMPER * (table @ trigrams(visible(html)))
            if own in langs and len(langs) > 1:
                right = np.array([x == own for x in langs])
                score = score + np.log(np.where(right, TRUST, (1 - TRUST) / (len(langs) - 1)))
            said.append(score - score.max())
            declared.append(own)
        columns = [batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array(said, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "declared", "said"])

    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
    rows = pages.select("page_id", host.alias("host"), "html")
    found = per_batch(rows, run, "page_id bigint, host string, declared string, said array<double>")
    return found.withColumn("suffix", F.regexp_extract("host", r"\.([a-z][a-z0-9-]*)$", 1))


def _shares(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def _smoothed(sums: Column, n: Column, parent: Column) -> Column:
    return F.zip_with(sums, parent, lambda s, p: (s + F.lit(STRENGTH) * p) / (n + STRENGTH))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, probability, declared, host, suffix) of every page."""
    langs, table = fit(docs)
    if not langs:
        host = F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
        none = F.lit(None).cast("string")
        return pages.select(
            "page_id", none.alias("lang"), F.lit(0.0).alias("probability"), none.alias("declared"), host.alias("host"),
            F.regexp_extract(host, r"\.([a-z][a-z0-9-]*)$", 1).alias("suffix"),
        )
    rows = stored(evidence(pages, langs, table).withColumn("share", _shares(F.col("said"))), "evidence")
    places = range(len(langs))

    def sums(by: list[str]) -> DataFrame:
        added = [F.sum(F.col("share")[k]).alias(f"s{k}") for k in places]
        found = rows.groupBy(*by).agg(F.count("*").alias("pages"), *added)
        return found.select(*by, "pages", F.array(*[F.col(f"s{k}") for k in places]).alias("sums"))

    even = F.array(*[F.lit(1.0 / len(langs))] * len(langs))
    every = sums([]).select(_smoothed(F.coalesce("sums", even), F.col("pages"), even).alias("p")).first()["p"]
    every = F.array(*[F.lit(x if x is not None else 1.0 / len(langs)) for x in every])
    suffixes = sums(["suffix"]).select("suffix", _smoothed(F.col("sums"), F.col("pages"), every).alias("parent"))
    hosts = sums(["host", "suffix"]).join(suffixes, "suffix")
    hosts = hosts.select("host", _smoothed(F.col("sums"), F.col("pages"), F.col("parent")).alias("prior"))
    fused = F.zip_with("said", "prior", lambda s, p: s + F.ln(p))
    found = rows.join(hosts, "host").withColumn("share", _shares(fused))
    best = F.array_max("share")
    names = F.array(*[F.lit(x) for x in langs])
    return found.select(
        "page_id",
        F.element_at(names, F.array_position("share", best).cast("int")).alias("lang"),
        best.alias("probability"),
        "declared",
        "host",
        "suffix",
    )
