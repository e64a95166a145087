"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality rules drop what they reject; near duplicates (five-word shingles, 0.8 and more) leave one
document of each group; repeated 20-word windows are cut from later documents; sources are mixed to
target weights, a document being repeated as often as the mix takes it; the rest is encoded and decoded.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of
documents, but for the last, which returns doc_id, source, n_tokens, ids and decoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodic.llm import bpe, lsh_forest, mixing, quality, suffix_tree
from episodic.llm.common import shared_folder, table
from episodic.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts fail the base rules and go; null ids, langs and sources are judged like others, repeated rows each."""
    return quality.quality_filter(docs).where("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows equal in id and text one stays, too; null ids and texts without words stay, as nothing links them; one id may have several texts."""
    key, kept = "text_hash", lsh_forest.near_duplicates(docs, n=5, threshold=80).where("kept AND doc_id IS NOT NULL").select("doc_id", "text_hash").distinct()
    known = docs.select(*COLUMNS).where("doc_id IS NOT NULL").withColumn(key, F.xxhash64("text"))
    known = known.join(kept, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return known.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts keep their layout where nothing is removed; documents of which nothing is left go; null and empty texts, null ids and repeated rows stay."""
    done = suffix_tree.removed_words(docs.select(*COLUMNS), layout=True)
    return done.where("n_words > n_removed OR n_words = 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it; null sources are one source, null ids are mixed like others, texts without words are never taken."""
    return mixing.repeated(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, decoded of every row; null texts are empty, nulls elsewhere and repeated rows stay."""
    return bpe.encode_decode(docs.select("doc_id", "source", "text"), tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: No SQL: the encoding stage can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
