"""From raw documents to token ids, stage by stage.

Every stage works on all rows that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultry.llm import bpe, mixing, rules, secrets, simhash
from vaultry.llm.shared import documents, stored

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    # neutral names: a column may be called like a measure
    names = tuple(c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns))
    judged = rules.verdicts(rules.ledger(docs.toDF(*names), carry=names))
    return judged.where("kept").select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash group, that of the smallest ``doc_id``; rows without a ``doc_id`` stay."""
    return simhash.survivors(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.masked(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` and digests of every row."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(TOKENIZER), keep_text=False)
    return coded.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: The stages after the first have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
