"""From raw documents to token ids: five stages, each one of the library's operators.

``run(spark, sf_dir)`` applies ``STAGES`` to the table ``documents``. Each stage works on
what its predecessor kept and was written in between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.llm import chunked_bpe, decontaminate, lines, near_duplicates, toxicity
from packsift.llm.tables import fresh, settle, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; a null score does not occur."""
    (score,) = fresh(docs, "toxicity")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), score_column=score)
    return scored.where(~toxicity.is_toxic(F.col(score))).select(*docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go; every document stays, with its length anew."""
    cleaned = lines.remove_shared_lines(docs, counts=None).select(*docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents joined by five-word shingles at a similarity of 0.8 one
    stays, that of the smallest id (of equal ids, the smallest hash of the text). Rows with
    equal id and text are one document. Empty documents are no copies of each other."""
    return near_duplicates.keep_one_of_each(docs, shingle_words=5, percent=80)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the hash of what they decode to."""
    coded = chunked_bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxic_documents),
    ("line dedup", shared_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_items),
    ("BPE encoding and decoding", token_ids),
]

#: Scores of a trained classifier and edit distances are beyond SQL; the tests compare the
#: stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
