"""Reading and writing tables: CSV, result folders, optional inputs, errors, manifests, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

BOM = "﻿"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder; local only in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs and lost executors read it again."""
    path = f"{scratch_folder(df.sparkSession)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv_bom(spark: SparkSession, path: str) -> DataFrame:
    """All-string CSV with a header; a byte-order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=False, quote='"', escape='"')
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def read_required(spark: SparkSession, folder: str, required: list[str], optional: dict[str, str]) -> dict[str, DataFrame]:
    """Required tables must exist; an absent optional one is an empty frame of its schema."""
    out = {n: spark.read.parquet(f"{folder}/{n}") for n in required}
    for name, ddl in optional.items():
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            out[name] = spark.createDataFrame([], T.StructType.fromDDL(ddl))
    return out


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder per grain; CSV export writes NULL as blank."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).option("nullValue", "").csv(f"{folder}/{name}")
        else:
            w.parquet(f"{folder}/{name}")


def split_errors(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and failed rows with ``error_type`` and ``error_message``."""
    tagged = df.withColumn("__e", error)
    good = tagged.where("__e is null").drop("__e")
    bad = tagged.where("__e is not null").withColumns({"error_type": F.substring_index("__e", ":", 1), "error_message": F.col("__e")}).drop("__e")
    return good, bad


def run_summary(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One aggregation, reported as ``metric, value`` rows."""
    row = df.agg(*[c.cast("double").alias(n) for n, c in measures.items()])
    return row.selectExpr(f"stack({len(measures)}, " + ", ".join(f"'{n}', `{n}`" for n in measures) + ") as (metric, value)")


def manifest(spark: SparkSession, entries: dict[str, object]) -> DataFrame:
    """Configuration, thresholds and hashes of a run as ``key, value`` rows next to the result."""
    pairs = F.create_map(*[F.lit(x) for k, v in entries.items() for x in (k, str(v))])
    return spark.range(1).select(F.explode(pairs).alias("key", "value"))


def emit_by_hash(new: DataFrame, existing: DataFrame, key: str, content: str, overwrite: bool) -> DataFrame:
    """What writing ``new`` over ``existing`` does: CREATED, UNCHANGED, OVERWRITTEN or CONFLICT."""
    h = new.select(key, F.sha2(F.col(content), 256).alias("sha256"))
    old = existing.select(key, F.sha2(F.col(content), 256).alias("__old"))
    action = (
        F.when(F.col("__old").isNull(), "CREATED")
        .when(F.col("__old") == F.col("sha256"), "UNCHANGED")
        .otherwise("OVERWRITTEN" if overwrite else "CONFLICT")
    )
    return h.join(old, key, "left").select(key, "sha256", action.alias("action"))


def hash_check(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """``OK``, ``MISMATCH``, ``MISSING`` or ``UNEXPECTED`` per file."""
    e, a = expected.select(key, F.col("sha256").alias("__e")), actual.select(key, F.col("sha256").alias("__a"))
    word = (
        F.when(F.col("__a").isNull(), "MISSING")
        .when(F.col("__e").isNull(), "UNEXPECTED")
        .when(F.col("__a") == F.col("__e"), "OK")
        .otherwise("MISMATCH")
    )
    return e.join(a, key, "full").select(key, word.alias("result"))
