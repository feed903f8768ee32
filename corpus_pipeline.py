"""From documents to packed sequences, stage by stage; each stage is written and read again by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.chosen_path import near_duplicates
from gaugeframe.llm.common import dropped, row_key, written
from gaugeframe.llm.decontaminate import find_passages, remove_passages
from gaugeframe.llm.packing import cut_documents, pack, widen_ids
from gaugeframe.llm.quality import score_quality, train
from gaugeframe.llm.queries import tokenizer_file
from gaugeframe.llm.suffix_dedup import remove_repeats
from gaugeframe.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship_package(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, carry=("text", "lang", "source", "n_chars")).where("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id; of equal rows one."""
    ship_package(spark)
    classes = near_duplicates(docs, size=5, threshold=0.8)
    first = classes.where(F.struct("k1", "k2") == F.col("root")).select("k1", "k2").distinct()
    keyed = docs.select(*COLUMNS, *row_key("doc_id", "text"))
    return keyed.join(first, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes and the passages of 51 words that stand elsewhere too; texts of nothing else go."""
    ship_package(spark)
    cut = remove_repeats(docs, length=400, words=51, carry=("lang", "source"))
    left = cut.where((F.col("n_removed") == 0) | (F.length(F.trim("kept")) > 0))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    ship_package(spark)
    found = find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, carry=("lang", "source"))
    return remove_passages(found, max_coverage=0.5).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, in sequences of 2048 tokens."""
    ship_package(spark)
    return widen_ids(pack(cut_documents(docs, tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=1, keep_ids=True, narrow=True)))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: Learned scores and token ids cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
