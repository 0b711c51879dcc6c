"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, packing.

Each stage works on all that its predecessor kept, written as Parquet in the shared folder and read again. All stages but
the last return the columns of documents.

Defined results, of every stage: an empty table gives an empty one. Columns beyond doc_id and text pass as they are, whatever their names, nulls included;
n_chars, if there, follows a text that is changed. Texts of any length are read whole. Nulls and empty texts: quality rules reject them, as they
reject all under 50 words; the other stages keep them, as they hold no n-gram, item or personal data, and packing makes one piece of them. Repeated rows: quality
rules judge each alike, the Jaccard join keeps one row of wholly equal ones (all, if they have no words), decontamination and personal data treat
each alike, packing packs each on its own. Ties: of a class of near duplicates the least doc_id stays, of one doc_id the text of the least hash; a null
doc_id comes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import decontamination, neardup, packing, pii, quality
from stemma.llm.common import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the share of content lines reject go."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least doc_id."""
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; all documents stay."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: SQL can't decode the conditional random field of the first stage; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
