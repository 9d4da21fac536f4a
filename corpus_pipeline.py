"""From raw documents to packed sequences, in stages of the operators in quarry.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that run() writes as
Parquet and reads again. All but the last return the columns of documents, with the values that they had (line dedup changes text and
n_chars).

Defined cases. Null or empty text, or one without a letter, has no language and goes in the first stage. Every row is judged by its
own text, so rows that share a doc_id, and rows without one, stay or go each for itself; labels are found by doc_id. Rows with a null
doc_id take no part in line dedup and near copies and stay. Of repeated rows (same id and text) one stays. A document of which all
lines go stays with an empty text, and of all empty ones one stays. An empty table gives no pieces. Columns beside those of
documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, langid, line_dedup, near_duplicates, packing, toxicity
from quarry.llm.queries import TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (und: without a letter) go. The machines know no class for other languages, so texts in these stay."""
    return langid.known(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go."""
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; n_chars follows the text. Documents stay, even if their text is empty."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return near_duplicates.one_of_each(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs, TOKENIZER, with_ids=False).drop("ids")


STAGES = [("language_id", language), ("toxicity", toxic), ("line_dedup", lines), ("jaccard_join", near_copies), ("packing", pack)]

#: SQL can express neither the machines, nor the lexicon, nor the ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
