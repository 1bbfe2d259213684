"""A corpus pipeline out of the operators of ``stylograin.llm``: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograin.llm import decontaminate, near_dup, pieces, quality, secrets
from stylograin.llm.common import stored
from stylograin.llm.queries import tokenizer_path


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a stage that changes texts."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go. Columns and texts stay as they are."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8, the smallest ``doc_id``."""
    return near_dup.without_near_duplicates(docs, size=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words or more are cut; documents of which they make up over half go."""
    cut = decontaminate.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_coverage=0.5)
    return _measured(cut.select(docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; their formats are learned from the documents that are left."""
    return _measured(secrets.redacted(docs, secrets.learned(docs)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, their number, and whether they decode to the text."""
    model = tokenizer_path("piece_bpe_32k.model")
    found = pieces.decoded(pieces.encoded(docs.select("doc_id", "lang", "source", "text"), model), model)
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"),
                        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", one_of_near_duplicates),
          ("benchmark decontamination", decontaminated), ("secret scans", without_secrets),
          ("piece encoding", encoded)]

#: The quality rules and the secret formats are fitted, and SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs, f"stage{k}"), sf_dir)
    return docs
