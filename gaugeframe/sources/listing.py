"""File listings: image inventories, experiment trees and content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.status import parse_image_name
from gaugeframe.functions.text import basename

IMAGE_SUFFIX = r"(?i)\.(png|jpg|jpeg)$"


def list_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Paths (and, on request, SHA-256 of the bytes) of one folder, without recursion."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return df.select("path", *([F.sha2("content", 256).alias("sha256")] if content else []))


def image_inventory(paths: DataFrame) -> DataFrame:
    """Images with a valid name; other files are skipped."""
    named = paths.withColumn("filename", basename(F.col("path")))
    cols = [c.alias(n) for n, c in parse_image_name(F.col("filename")).items()]
    return named.select("path", "filename", *cols).where("name_valid = 1").drop("name_valid", "image_id")


def experiment_tree(paths: DataFrame, root_depth: int) -> DataFrame:
    """``task/condition/participant/image`` below the root; only ``img*`` image files count."""
    part = F.split("path", "/")
    at = lambda i: F.get(part, F.lit(root_depth + i))
    t = paths.select(at(0).alias("task"), at(1).alias("condition"), at(2).alias("participant"), at(3).alias("image"), F.size(part).alias("__n"))
    return t.where((F.col("__n") == root_depth + 4) & F.col("image").startswith("img") & F.col("image").rlike(IMAGE_SUFFIX)).drop("__n")
