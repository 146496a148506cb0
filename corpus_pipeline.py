"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir). All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, ship, table, with_size_checked
from tessera.llm.packing import pack_documents
from tessera.llm.privacy import sanitise
from tessera.llm.quality import filter_quality
from tessera.llm.shingles import near_duplicate_classes
from tessera.llm.substrings import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the classifier rejects go."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each class of near-duplicates the document of the smallest id stays; null ids stay."""
    ship(spark)
    classes = near_duplicate_classes(docs)
    gone = materialize(classes.where("doc_id != class_id").select("doc_id"), "near-duplicates")
    return docs.join(with_size_checked(gone), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages that an earlier document has are cut; documents of which nothing is left go."""
    return without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: personal data is marked, disclosing terms are generalised or removed."""
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of documents in sequences of 2048 tokens."""
    ship(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("personal_data", personal_data), ("packing", packing)]

#: MinHash, suffix order, classifiers and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
