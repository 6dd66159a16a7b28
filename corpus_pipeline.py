"""A corpus pipeline: five stages over the documents, each an operator of the library.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again
as the next one's documents. All but the last return the columns of the documents.

An empty table gives no rows at any stage. A null or empty text fails the quality rules, so later stages do not meet one from there; given one all the same, they
keep it, and it is packed as its end id alone. Rows that repeat an id and a text share their fate up to the mix, which takes words of each by itself. A
null id counts as the smallest and stays null. Texts of any length are handled whole; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapshelf.llm import line_crf, minhash, mixing, packing, substring
from mapshelf.llm.common import stored


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the line labels reject go."""
    return line_crf.keep_good(docs, line_crf.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the smallest id stays."""
    return minhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier are cut out; documents without one keep their text as it is."""
    return _counted(substring.without_repeats(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words are taken from the sources by their weights; a document that is taken twice gives two rows."""
    return _counted(mixing.mixed_texts(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all rows, packed into sequences of 2,048."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: line labels, shuffled blocks and token counts are not expressible; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
