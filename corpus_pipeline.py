"""The corpus pipeline: documents in, packed token sequences out.

Toxic documents go, one document of each near-duplicate class stays, secrets are blanked out,
sources are mixed to their weights, and what is left is packed. Each stage's result is written
as Parquet to the shared folder and read again as the next one's documents, so a lost
executor never costs more than the stage at work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.llm import mixing, packing, secret_scan, simhash, toxicity
from lexdrift.plans.workspace import new_folder, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go. The labels of ``sf_dir`` teach the model."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs.select(*COLUMNS), labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest id stays."""
    return simhash.representatives(docs.select(*COLUMNS))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that a rule finds is replaced by a mark."""
    ledger = secret_scan.BlobLedger.create(spark, new_folder(spark, "ledger"))
    found = secret_scan.find_secrets(docs.select(*COLUMNS), ledger)
    text = secret_scan.redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document, with the words that the mix takes in it."""
    sized = docs.select(*COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    mixed = mixing.mixed_texts(mixing.mix(sized))
    return mixed.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", blank_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages use a trained model and a random draw, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


PIPELINE_QUERIES = {"pipeline": run}
