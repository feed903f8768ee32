"""Token counts behind a digest cache.

Contents are identified by a SHA-256 digest and the tokenizer by the digest of its file and the
library's version. Counts found in the cache are joined; of the other contents one row each is encoded
and appended to the cache, which is a Parquet table ``(version, digest, n_tokens)``.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import blocks, encoder, file_digest, row_key, written

SCHEMA = "version string, digest binary, n_tokens long"
_PIECES: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and version of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    return f"{file_digest(path)}/{lib.__name__}-{lib.__version__}"


def counter(path: str):
    """Function from texts to token counts, by the library that the file's suffix names."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        if path not in _PIECES:
            _PIECES[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in _PIECES[path].encode(texts, num_threads=1)]
    return lambda texts: [len(x) // 4 for x in encoder(path)(texts)]


def _encode(path: str, version: str):
    def run(batches):
        count = counter(path)
        for b in blocks(batches, 4 << 20, path):
            n = count(["" if t is None else t for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * b.num_rows, pa.string()), b.column("digest").cast(pa.binary()), pa.array(n, pa.int64())], ["version", "digest", "n_tokens"]
            )

    return run


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def misses(wanted: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``digest, text`` of one row for each wanted ``digest, k``; rows that agree in id and text are one."""
    texts = docs.select(*row_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["k1", "k2"])
    return wanted.select("digest", "k.k1", "k.k2").join(texts, ["k1", "k2"]).select("digest", "text")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    A null text counts as empty. The content that a digest stands for is the text itself with null made
    empty: any stronger normalisation could change a count. Rows with a null or repeated id are kept and
    counted one by one; equal texts are encoded once; other columns are ignored. An empty table gives no
    rows. ``cache`` is a folder in shared storage, which may be missing, empty, or filled by earlier
    calls; two writers at once may store a digest twice, which a later read takes as one. ``docs`` is read
    twice and must give the same rows both times.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *row_key(doc_id, text), F.octet_length(body).cast("long").alias("n_bytes"), F.unhex(F.sha2(body, 256)).alias("digest"))
    wanted = rows.groupBy("digest").agg(F.min(F.struct("k1", "k2")).alias("k"))
    if _exists(spark, cache):
        stored = spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == version)
        wanted = wanted.join(stored.select("digest"), "digest", "left_anti")
    misses(wanted, docs, doc_id, text).mapInArrow(_encode(tokenizer, version), SCHEMA).write.mode("append").option("compression", "zstd").parquet(cache)
    stored = spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == version)
    # written first: the join below then sees a plain table, so that a content with many copies is split
    counts = written(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    out = rows.drop("k1", "k2").join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
