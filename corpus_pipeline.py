"""Corpus pipeline over ``documents``: quality, toxicity, near duplicates, mixing, encoding.

Each stage takes what the stage before kept. All but the last return the columns of their input
unchanged (other columns, whatever their names, are carried along); the last returns one row a
document with the digests of its ids. Classifiers and mixing decide on each row where it is; only the
near-duplicate stage joins documents with decisions by id.

Defined results
* quality and toxicity drop documents that the classifiers reject and keep the rest, null and
  empty texts included if their score allows;
* of near duplicates the document with the smallest id stays (among texts under that id, the one
  whose hash is smallest; of rows that repeat id and text one), other texts under that id go; a document without words
  or near duplicates stays;
* mixing repeats documents up to twice (as further rows) and leaves out what targets do not need;
* encoding returns doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from blockatlas.llm import bpe, jaccard, mixing, quality, toxicity
from blockatlas.llm.arrow import id_crc
from blockatlas.llm.store import Scratch, released
from blockatlas.llm.tables import table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    return quality.accepted(docs, table(spark, sf_dir, "labels"), train=~held_out)


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = id_crc(F.col("doc_id")) % 5 == 0
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"), train=~held_out)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One merge join by id and text hash at every size: what is dropped grows with the corpus, so it is never broadcast."""
    decided = jaccard.jaccard_join(docs).groupBy("doc_id", "key").agg(F.max("chosen").alias("chosen"), F.count(F.lit(1)).alias("n"))
    decided = Scratch(spark, "pipeline").save(decided.filter("n > 1 OR NOT chosen"), "duplicates")
    own = decided.select(F.struct("doc_id", "key", "chosen").alias("_" * (1 + max(map(len, docs.columns)))))
    p = own.columns[0]  # a name that no column of docs has
    same_row = (F.xxhash64(docs["text"]) == own[p]["key"]) & docs["doc_id"].eqNullSafe(own[p]["doc_id"])
    found = docs.join(own.hint("merge"), same_row, "left").filter(own[p].isNull() | own[p]["chosen"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = found.filter(own[p].isNull()).select(*columns)
    # Of rows that repeat an id and its text one stays: the first by all their columns, written out.
    again = found.filter(own[p].isNotNull()).select(*columns)
    first = again.groupBy("doc_id", "text").agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias(p)).select(f"{p}.*")
    return single.unionByName(first)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [
    ("quality classifier", stage_quality),
    ("toxicity", stage_toxicity),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("mixing sources to target weights", stage_mix),
    ("byte-level BPE encoding", stage_encode),
]

#: Classifiers and near duplicates are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    scratch = Scratch(spark, "run")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with released():
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
