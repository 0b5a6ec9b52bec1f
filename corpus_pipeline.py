"""Stages that make a training corpus of ``documents``.

Each stage takes all rows that the one before it kept. Toxic documents go, one
document of each near-duplicate group stays, secrets are masked in the texts,
sources are mixed to their target weights (a document may then come up to three
times), and the texts are encoded as token ids, which decode again exactly as
the tokenizer's own decoding. No stage can be said in SQL, so ``ORACLE_SQL`` is
None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlquery.llm import bpe, common, mixing, secret_lexing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject, as they are.

    A null or empty text has the prior's probability and stays; very long texts
    are scored whole; a probability equal to the threshold is toxic; repeated rows
    fare alike; without documents or labels nothing is rejected; extra columns
    stay, whatever their names."""
    return toxicity.reject(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, as it is: the one with the
    smallest id.

    Null and empty texts are one group; very long texts are read whole; of rows
    with one id one stays; a group without an id keeps one of its rows; an empty
    table gives none; extra columns stay, whatever their names."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by ``<secret>``.

    A null text stays null, ``n_chars`` is that of the new text (null for a null
    one); very long texts are read whole; of spans that overlap the union goes;
    repeated rows give repeated results; an empty table gives none; extra columns
    stay, whatever their names."""
    masked = secret_lexing.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the leaves of the mixing tree take it, shard
    after shard and in the shards' own orders.

    A text without words, null ones included, is taken in whole passes alone; a
    null source is one of its own; very long texts are taken whole or not; rows
    whose hashes tie are ordered by id; repeated rows are taken alike; an empty
    table gives none; extra columns stay, whatever their names."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``token_ids`` in place of the text, ``n_tokens``, and ``decoded_sha256``.

    A null or empty text has no ids; very long texts are encoded whole; repeated
    rows give repeated results; an empty table gives none; extra columns stay,
    ones named like outputs are replaced."""
    return bpe.tokenized(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table, each written and read again. What
    a stage wrote on its way goes when its result is there."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scratch() as made:
            before, docs = docs, common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(docs)
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
