"""Documents to token files in five stages; each works on all that the one before kept.

1. language id: documents without a letter, or unlike every learned profile, go
2. near-duplicates: one document of each class stays
3. decontamination: benchmark passages are cut out; documents that are mostly such passages go
4. mixing: the words that the mix takes, a row for each pass over a document
5. token files: the rows, encoded and bit-packed, as read back from the files

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneweave.llm import decontaminate, language_id, mixing, order_minhash, token_files
from laneweave.llm.common import free_name, held_out, read_table, small_batches, staged

#: Closeness to the nearest language profile below which a document is in no known language.
LEAST_SCORE = 0.05


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    profiles = language_id.learn_profiles(docs.filter(~held_out("doc_id", 4, 2)))
    name = free_name(docs, "language")
    told = language_id.identify(docs, profiles, "text", name)
    known = F.col(f"{name}.lang") != language_id.UNDETERMINED
    return told.filter(known & (F.col(f"{name}.score") >= LEAST_SCORE)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return order_minhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cleaned = decontaminate.clean(docs, decontaminate.automata(read_table(spark, sf_dir, "benchmark")))
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_files.encode_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language id", identify),
    ("near-duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("mixing", mix),
    ("token files", tokens),
]

#: The stages' models and hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{i + 1}")
    return docs
