"""Shards of equal row counts cut from a Hilbert curve over metadata.

Source, language, size and id are quantised, the curve index orders the rows, and the order is cut into
runs. Rows close in all dimensions share a shard, so a reader that filters on several of them can skip
most files by their minima and maxima.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm.common import written

BITS = 6


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (one column a dimension, ``bits`` bits each)."""
    x, n = cells.astype(np.int64).copy(), cells.shape[1]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(n):
            turned = (x[:, d] >> level) & 1 == 1
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            if d:
                x[:, d] ^= swap
    for d in range(1, n):
        x[:, d] ^= x[:, d - 1]
    flips = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[:, n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flips[:, None]
    index = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            index = (index << 1) | ((x[:, d] >> level) & 1)
    return index


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve`` and the columns in ``carry``.

    The law is ``rows``: shard counts are at most one apart, and slots are gapless from 0. A null text
    has no bytes (size 8); nulls of the other columns are values of their own; rows with equal ids or
    equal texts are placed one by one, equal texts next to each other within a cell of the curve. Other
    columns are ignored. An empty table gives no rows; with fewer rows than shards the last stay empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        (F.xxhash64(F.col(source)).bitwiseAND(63)).alias("_source"),
        (F.xxhash64(F.col(lang)).bitwiseAND(63)).alias("_lang"),
        *(F.col(c) for c in carry),
    )
    low, high = docs.agg(F.min(F.col(doc_id).cast("long")), F.max(F.col(doc_id).cast("long"))).first()
    span = max(1, (high or 0) - (low or 0))
    cells = rows.withColumns({
        "_size": F.least(F.floor(F.log2("size") * 2), F.lit(63)),
        "_id": F.coalesce(F.least(F.floor((F.col("doc_id") - F.lit(low or 0)).cast("double") / span * 64), F.lit(63)), F.lit(0)),
    })
    kept = [f for f in cells.schema if not f.name.startswith("_")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = [f.name for f in kept]

    def place(batches):
        for b in batches:
            grid = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("_source", "_lang", "_size", "_id")], 1)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(curve_index(grid))], [*names, "curve"])

    def number(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part)), pa.array(np.arange(seen, seen + n))], [*b.schema.names, "_part", "_place"])
            seen += n

    order = ["curve", "text_crc32", "doc_id"]
    ordered = cells.mapInArrow(place, schema + ", curve long").repartitionByRange(*order).sortWithinPartitions(*order)
    # written, so that ranks cannot change between the count of a part and its use
    table = written(ordered.mapInArrow(number, schema + ", curve long, _part long, _place long"), "curve")
    counts = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank, least, more = F.col("_before") + F.col("_place"), total // shards, total % shards
    early = more * (least + 1)
    shard = F.when(rank < early, F.floor(rank / (least + 1))).otherwise(more + F.floor((rank - early) / max(1, least))).cast("int")
    out = table.join(before, "_part").withColumns({"shard": shard, "_rank": rank})
    begin = F.when(F.col("shard") < more, F.col("shard").cast("long") * (least + 1)).otherwise(early + (F.col("shard").cast("long") - more) * least)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *carry
    )


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One folder a shard, its rows in the order of their slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
