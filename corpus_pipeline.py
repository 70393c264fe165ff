"""Documents to training sequences, in five stages.

Toxic documents go; boilerplate lines that stand on many sites are cut; of each group of
near-duplicates (five-word shingles, similarity 0.8) one document stays; documents with
benchmark passages go; what is left is packed into sequences.  Each stage but the last
returns the columns of ``documents``.  Null text becomes empty text in the second stage;
an empty table gives empty results; extra columns pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilquery.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from veilquery.llm._common import durable


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(docs).drop("_ld_lines", "_ld_removed")
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_group(docs, size=5, share=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("packing", packed),
]
#: A fitted model and a randomised packing have no SQL; tests/llm holds a whole run, with these settings, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))  # each stage reads its input several times
    return STAGES[-1][1](spark, docs, sf_dir)
