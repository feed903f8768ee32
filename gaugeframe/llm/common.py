"""Helpers shared by the operators: the shared folder, written tables and tokenizer encoding."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    A session that names none gets a temporary folder if it runs in one JVM, and an error otherwise.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs and lost executors read it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that only served for other tables, which are written by now."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(folder))
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: components, with some more for each row, of the blocks of either side that meet in one task
MEET = 1 << 23


def groups_of(blocks: DataFrame, weight: Column, most: int) -> tuple[int, int]:
    """Number of blocks, and of groups of them that weigh about ``most`` each."""
    n, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    return n, max(1, -(-total // most))


def meeting(files: DataFrame, asked: DataFrame, groups: int, askers: int, *by: str):
    """Each of ``groups`` groups of files with each of ``askers`` groups of queries of its ``dim``, in one task each.

    Groups are dealt by a hash of the columns ``by``. The two sides are grouped together and not joined: a join
    may broadcast one side by its size before it was repeated for the groups of the other.
    """

    def dealt(df: DataFrame, own: str, n: int, other: str, n_other: int):
        df = df.withColumn(own, F.pmod(F.xxhash64(*by), F.lit(n)).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        return df.repartition(groups * askers, "group", "asker", "dim").groupBy("group", "asker", "dim")

    return dealt(files, "group", groups, "asker", askers).cogroup(dealt(asked, "asker", askers, "group", groups))


def row_key(doc_id: str, text: str) -> list[Column]:
    """``(k1, k2)``: rows that agree in both have the same id and text and are interchangeable."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(doc_id).isNull()).alias("k2"),
    ]


def file_digest(path: str) -> str:
    """Hex digest of a tokenizer file: its version."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


class PieceEncoder:
    """Whole-text encoding with the ``tokenizers`` library, each distinct piece of text once.

    Byte-level BPE never merges over a space or line break that visible characters surround, and the
    lower-casing word BPE drops white space and never merges a letter with a mark after it, so the ids of
    a text are those of its pieces. A text where that does not hold (other white space around a space, an
    added token's string) goes to the library as a whole. ``__call__`` gives each text's ids as
    little-endian unsigned 32-bit integers. Up to ``most`` pieces are remembered from one call to the
    next; others are encoded again, so the bound never changes a result.
    """

    SPACES = re.compile(r"[ \n]\s|\s $")
    #: letters that neither lower-casing nor NFC turns into a letter and a combining mark
    MARK = re.compile("([0-9A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f])([,.])(?=\\s|$)")

    def __init__(self, path: str, most: int = 800_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.known = most, {}
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        steps = [s.get("type") for s in pre.get("pretokenizers", [])]
        self.words = steps == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.added = [t["content"][:2].lower() for t in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab()
        #: ids that begin a piece after a space, or end a word
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("Ġ") if self.byte_level else token.endswith("</w>")
        self.line = np.zeros_like(self.edge)
        self.line[vocabulary.get("Ċ", 0)] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _pieces(self, text: str) -> list[str] | None:
        if any(a in text for a in self.added):
            return None
        if self.words:
            return self.MARK.sub(r"\1 \2", text.replace("\n", " ")).split(" ")
        if not self.byte_level or self.SPACES.search(text):
            return None
        return text.replace("\n", " \n").split(" ")

    def _spelled(self, piece: str) -> str:
        return piece if self.words or piece[:1] == "\n" else " " + piece

    def _learn(self, pieces) -> None:
        """Encodes many pieces as one text and cuts the ids where the pieces meet.

        A token with a leading space, or a line break, begins a byte-level piece; a word's last token ends
        a piece of letters. Other pieces, and blocks where the counts differ, are encoded one by one.
        """
        groups: tuple[list[str], list[str], list[str]] = ([], [], [])
        for p in pieces:
            if self.words:
                groups[0 if p.isalpha() else 2].append(p)
            elif p[:1] == "\n":
                groups[1 if len(p) > 1 and not p[1:2].isspace() else 2].append(p)
            else:
                groups[2 if not p or p[:1].isspace() or p[-1:].isspace() else 0].append(p)
        odd = groups[2]
        # the library's results of few pieces are in memory at a time
        some = lambda group: (group[i : i + 8000] for i in range(0, len(group), 8000))
        for group, edge in ((part, edge) for group, edge in zip(groups, (self.edge, self.line)) for part in some(group)):
            cut = [group[i : i + 400] for i in range(0, len(group), 400)]
            joined = [" ".join(b) if self.words else "".join(map(self._spelled, b)) for b in cut]
            for block, enc in zip(cut, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                raw = np.array(enc.ids, dtype="<u4")
                at = np.flatnonzero(edge[raw])
                if len(at) != len(block):
                    odd += block
                    continue
                ends = np.append(0, at + 1) if self.words else np.append(at, len(raw))
                raw, ends = raw.tobytes(), (ends * 4).tolist()
                for p, a, b in zip(block, ends, ends[1:]):
                    self.known[p] = raw[a:b]
        for part in some(odd):
            for p, enc in zip(part, self.tokenizer.encode_batch_fast(list(map(self._spelled, part)), add_special_tokens=False)):
                self.known[p] = np.array(enc.ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self._pieces(t) for t in texts]
        firsts = []
        if self.byte_level:  # a text's first piece has no space before it
            firsts = [self._ids(p[0]).tobytes() if p and p[0] else b"" for p in split]
            split = [p and p[1:] for p in split]
        new = set().union(*filter(None, split)).difference(self.known)
        self._learn(new)
        get = self.known.__getitem__
        out = [self._ids(t).tobytes() if p is None else b"".join(map(get, p)) for t, p in zip(texts, split)]
        if firsts:
            out = [a + b for a, b in zip(firsts, out)]
        if len(self.known) > self.most:
            for p in new:
                del self.known[p]
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def blocks(batches, most: int = 1 << 20, keep: str | None = None):
    """Arrow batches cut so that the string columns of each hold about ``most`` bytes.

    Encoders of other tokenizers than ``keep`` are let go: the worker process may have served another operator before.
    """
    for path in set(_ENCODERS) - {keep}:
        del _ENCODERS[path]
    for b in batches:
        rows = b.num_rows
        step = max(1, rows * most // max(b.nbytes, 1)) if rows else 1
        for i in range(0, rows, step):
            yield b.slice(i, step)
        pa.default_memory_pool().release_unused()
