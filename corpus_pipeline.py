"""From documents to packed training sequences: five stages, each a whole-table operator.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each result as
Parquet and reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import Scratch, fresh
from gapwise.llm.exact_dedup import without_copies
from gapwise.llm.language_id import fit, identify
from gapwise.llm.minhash import near_duplicates
from gapwise.llm.packing import pack_documents
from gapwise.llm.pii import sanitised
from gapwise.llm.queries import tokenizer_file

#: A document is rejected if the mean of its words' largest posteriors, each for the word's own best language, is lower.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose words' languages can be told, mixed ones too; with no model, all that have letters.

    Null and empty texts go. Nulls in other columns, ties and repeated rows change nothing. Long texts are judged
    whole. Empty table: no rows.
    """
    model, others = fit(docs), tuple(c for c in docs.columns if c != "doc_id")
    lang, score, words, certainty = fresh(docs, "lang", "score", "words", "certainty")
    kept = identify(docs, model, keep=others).toDF("doc_id", *others, lang, score, words, certainty).filter(F.col(words) > 0)
    return (kept if model is None else kept.filter(F.col(certainty) >= LEAST_SCORE)).select(*(f"`{c}`" for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for the case of A-Z: that with the largest doc_id.

    Null texts are one group with empty ones. Null ids rank below any; of rows that repeat the id and the text, one
    stays. Long texts are compared whole. Empty table: no rows.
    """
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity 0.8 or more): that with the
    smallest doc_id.

    Documents without words stay. Null ids rank above any; of rows that repeat an id, one that comes first. Long
    texts count whole. Empty table: no rows.
    """
    row, best, component = fresh(docs, "row", "best", "component")
    rows = Scratch(spark, "near").save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(row, "text"), width=5, percent=80, id_col=row).select(row, F.col("component_id").alias(component))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias(best))
    kept = found.join(rows.select(row, "doc_id"), row).groupBy(component).agg(F.min(order)[best].alias(row))
    return rows.join(kept.select(row), row, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are masked; n_chars follows the text. All rows stay.

    Null texts stay null. Null ids, ties and repeated rows change nothing but that each row counts as a document.
    Long texts are searched whole. Empty table: no rows.
    """
    return sanitised(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids, as pack_documents() returns them.

    Null and empty texts give their end id. Null and repeated ids: each row is a document. Long texts are cut where
    a sequence ends. Empty table: no rows.
    """
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]

#: No SQL has the language model, the components or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
