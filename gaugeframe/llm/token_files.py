"""Token ids of documents in Arrow IPC files of equal-length sequences.

A file holds record batches with two fixed-size-list columns, ``ids`` and ``mask``. Documents follow one
another in ascending order of their id, each closed by an end id, across sequence borders; the last
sequence of a file is filled up, and its filling is masked out. The files of a write, in order of
``part``, are one stream. A table of documents says where each begins in its file.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm.common import blocks, encoder, written

INDEX = "part long, path string, doc_id long, first long, n_tokens long"
BATCH = 256


def schema_of(length: int, vocabulary: int) -> pa.Schema:
    """Ids take two bytes where the vocabulary allows."""
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes full batches of them."""

    def __init__(self, sink, schema: pa.Schema):
        self.schema, self.length = schema, schema.field("ids").type.list_size
        self.dtype = schema.field("ids").type.value_type.to_pandas_dtype()
        self.file, self.kept, self.held, self.total = pa.ipc.new_file(sink, schema), [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.kept.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BATCH * self.length:
            self._put(self.held // (BATCH * self.length) * BATCH * self.length)

    def _put(self, n: int) -> None:
        flat = np.concatenate(self.kept)
        now, rest = flat[:n], flat[n:]
        self.kept, self.held = [rest], len(rest)
        for i in range(0, n, BATCH * self.length):
            self._batch(now[i : i + BATCH * self.length])

    def _batch(self, ids: np.ndarray) -> None:
        fill = -len(ids) % self.length
        mask = np.ones(len(ids) + fill, bool)
        mask[len(ids) :] = False
        ids = np.pad(ids, (0, fill))
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.file.write_batch(pa.record_batch([c.cast(f.type) for c, f in zip(columns, self.schema)], schema=self.schema))

    def close(self) -> None:
        if self.held:  # less than a full batch
            self._batch(np.concatenate(self.kept))
        self.file.close()


def _write(tokenizer: str, folder: str, length: int, end_id: int):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        schema = schema_of(length, encode.tokenizer.get_vocab_size())
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        # an attempt has a file of its own: only the attempt whose rows Spark keeps is ever read
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        writer, end = None, np.array([end_id], "<u4").tobytes()
        for b in blocks(batches, 4 << 20, tokenizer):
            if writer is None:
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = SequenceWriter(sink, schema)
            first, n = [], []
            for raw in encode(["" if t is None else t for t in b.column("text").to_pylist()]):
                ids = np.frombuffer(raw + end, "<u4")
                first.append(writer.total)
                n.append(len(ids))
                writer.add(ids)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * k, pa.int64()), pa.array([f"{folder}/{name}"] * k, pa.string()), b.column("doc_id"), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                ["part", "path", "doc_id", "first", "n_tokens"],
            )
        if writer is not None:
            writer.close()
            sink.close()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, length: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files below ``folder`` (a URI in shared storage) and returns the table of documents.

    Columns: ``part, path, doc_id, first`` (ids before it in its file), ``start`` (ids before it in the
    whole stream), ``n_tokens`` (with the end id). A null text is empty and gives the end id alone. Rows
    with a null id come first; rows that share an id follow one another in the order of a hash of their
    texts; other columns are ignored; an empty table gives no file and no rows. The files are written when this
    is called; a task that is repeated writes a file of its own and leaves the other unread.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.crc32("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("text"), "text")
    index = written(placed.mapInArrow(_write(tokenizer, folder, length, end_id), INDEX), "token-index")
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return index.join(before, "part").select("part", "path", "doc_id", "first", (F.col("before") + F.col("first")).alias("start"), "n_tokens")


class TokenFile:
    """Random access to a file: local files are mapped, and a slice of them copies nothing."""

    def __init__(self, path: str):
        fs, base = pafs.FileSystem.from_uri(path)
        self.source = pa.memory_map(base) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(base)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a sequence."""
        batch, at = self.file.get_batch(i // BATCH), i % BATCH
        mask = batch.column("mask").slice(at, 1).flatten().to_numpy(zero_copy_only=False)
        return batch.column("ids").slice(at, 1).flatten().to_numpy(), mask

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from place ``first`` of the file on."""
        span, found = BATCH * self.length, []
        while n > 0:
            flat = self.file.get_batch(first // span).column("ids").flatten().to_numpy()
            found.append(flat[first % span : first % span + n])
            if not len(found[-1]):
                raise EOFError(f"no id at place {first}")
            first, n = first + len(found[-1]), n - len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.source.close()


def read_digests(index: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, with the ids taken from the files."""

    def run(batches):
        path, file = None, None
        for b in batches:
            crcs = []
            for p, first, n in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), b.column("n_tokens").to_pylist()):
                if p != path:
                    if file:
                        file.close()
                    path, file = p, TokenFile(p)
                crcs.append(zlib.crc32(file.ids(first, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # index rows are small: one task for each file, whatever their size
    files = max(1, index.select("path").distinct().count())
    return index.repartition(files, "path").sortWithinPartitions("path", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
