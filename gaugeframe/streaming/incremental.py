"""Resumable and incremental processing: remaining work, last attempts, gates, repairs, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.operators.sampling import best_per_key


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose parent row is not written yet."""
    return todo.join(done.select(key), key, "left_anti")


def append_batch(children: DataFrame, parents: DataFrame, folder: str, batch: str) -> None:
    """Children first, parents last: a parent row means its children are complete.

    Both are written below the batch's own name and replace what an earlier, broken attempt left there,
    so a batch may be written again at any time. Readers find the name in the column ``batch``.
    """
    children.write.mode("overwrite").parquet(f"{folder}/children/batch={batch}")
    parents.write.mode("overwrite").parquet(f"{folder}/parents/batch={batch}")


def last_attempts(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Latest row per key (one aggregate, no sort)."""
    return best_per_key(log, [key], F.col(seq))


def open_errors(errors: DataFrame, successes: DataFrame, key: str) -> DataFrame:
    """Failed keys that never succeeded later."""
    return errors.select(key).distinct().join(successes.select(key), key, "left_anti")


def publication_gate(universe: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """Counts that decide whether a result may be published; ``done`` has one row per key."""

    def side(df: DataFrame, *flags: int) -> DataFrame:
        return df.select(*[F.lit(f).cast("bigint").alias(n) for f, n in zip(flags, ("n_expected", "n_done", "n_failed"))])

    rows = side(universe, 1, 0, 0).unionByName(side(done, 0, 1, 0)).unionByName(side(failed, 0, 0, 1))
    row = rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in rows.columns])
    return row.withColumn("publish", (F.col("n_expected") == F.col("n_done")) & (F.col("n_failed") == 0))


def needs_repair(rows: DataFrame, stored: str, derived: Column) -> DataFrame:
    """Rows whose stored unit differs from the one in their file name (NULL counts as different)."""
    return rows.where(~F.col(stored).eqNullSafe(derived))


def merge_repaired(current: DataFrame, repaired: DataFrame, key: str) -> DataFrame:
    """Repaired rows win; columns are aligned by name."""
    both = current.withColumn("__p", F.lit(0)).unionByName(repaired.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return best_per_key(both, [key], F.col("__p")).drop("__p")


def stream_new_files(spark: SparkSession, source: str, schema, checkpoint: str, key: str, sink, processed=None, files: int = 1000):
    """File source that hands every new, not yet processed key to ``sink(batch, batch_id)`` once.

    ``source`` is a folder that receives parquet files; offsets live in ``checkpoint``, so a lost
    executor or driver resumes where it stopped. ``processed(batch_id)`` gives the keys that other
    batches have handed over (None before the first); keys that return later are dropped. A batch takes
    at most ``files`` files; the rest follow in further batches.
    """

    def once(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates([key])
        done = processed(batch_id) if processed else None
        sink(new if done is None else new.join(done.select(key), key, "left_anti"), batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
