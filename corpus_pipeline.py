"""The corpus pipeline: documents through five operators, each stage written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawgraph.llm.common import settle, table
from drawgraph.llm.decontaminate import decontaminate
from drawgraph.llm.mixing import mix_sources
from drawgraph.llm.simhash import drop_near_duplicates
from drawgraph.llm.suffix_dedup import remove_repeats
from drawgraph.llm.toxicity import drop_toxic


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars after texts were cut."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that count as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity of 0.8). Texts without words, null ones among them, have equal sets of shingles and are such a group."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that an earlier place holds are cut from the texts."""
    return _measured(remove_repeats(docs))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut from the texts; documents that mostly consist of them go."""
    return _measured(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its text and how many words of it the mix of sources takes: none, once or twice its size."""
    return mix_sources(docs, keep_text=True)


STAGES = [("toxicity", toxicity), ("near-duplicates", near_duplicates), ("repeated passages", repeated_passages), ("benchmark items", benchmark_items), ("mix", mix)]
#: Training a classifier, links of links and suffix order have no SQL form; tests hold run() against plain loops over its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
