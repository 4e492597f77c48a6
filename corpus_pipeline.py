"""From raw documents to packed token sequences, in stages that are each written as Parquet.

Quality rules, then the quality classifier, let documents go; of near copies one stays; what is
left is packed. Every stage but the last returns the columns of ``documents`` with their values, whatever
their names are. Null, empty and short texts fail the base of the rules. Rows without a doc_id are
compared with all others; repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.catalog import table
from rowtide.llm.jaccard_join import one_of_each
from rowtide.llm.packing import pack, token_pieces
from rowtide.llm.quality_classifier import document_scores
from rowtide.llm.quality_rules import judged, text_statistics
from rowtide.llm.words import CHAINED_SLICE, CHAINED_WORDS
from rowtide.session import written

LEAST_SCORE = 0.3


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its other columns under names that no operator adds, and the way back."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"document_column_{i}" for i, c in enumerate(others)}
    back = [F.col(names.get(c, c)).alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(names), lambda kept: kept.select(*back)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the weighed votes keep. Statistics are written with their
    documents, as the estimate and the verdict both read them."""
    docs, back = aside(docs)
    known = written(text_statistics(docs), "statistics")
    return back(judged(known).filter("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a sufficient score. What to learn from comes from all labelled documents,
    as few bad ones are left here."""
    docs, back = aside(docs)
    taught = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return back(document_scores(docs, taught, labels).filter(F.col("score") >= LEAST_SCORE))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    docs, back = aside(docs)
    return back(one_of_each(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in token sequences."""
    import public_tokenizers

    texts, tokenizer = docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")
    pieces = token_pieces(texts, tokenizer, end_id=1, kept=CHAINED_WORDS, characters=CHAINED_SLICE)
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(pieces, tiebreak=("doc_id", "piece", "ids_crc32"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", packing),
]

# Expectation-maximisation, learned vectors and best-fit packing are not SQL's to state; tests
# compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
