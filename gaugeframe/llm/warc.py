"""Web archives, index first.

Writing gives one row a record: the file, where the record lies in it, its URL and digest. Reading starts
from that index: records are selected there, their byte ranges sorted and, where they lie close together,
read as one. Each record is a gzip member of its own, so any range of records can be read alone. Payloads
that repeat are stored once: the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import blocks, written
from gaugeframe.operators.scan import spread_join

INDEX = "path string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string"
RECORDS = "path string, offset long, record_id string, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long"

# --- fixed values: names that the archive format defines -----------------------------------------
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ------------------------------------------------------------------------------------------------


def _uri(url: str | None) -> str:
    """A URL as a header value: bytes that could end it, or that are not ASCII, are percent-encoded."""
    if not url:
        return "urn:none"
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def _id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def record(kind: str, record_id: str, date: str, url: str | None, digest: str, size: int, payload: bytes, page_id: int | None, target: tuple | None = None) -> bytes:
    """One record. ``digest`` (hex) and ``size`` are those of the full payload, also where it is not stored.

    ``target`` is id and URL of the page a revisit refers to. Page ids stand in fields of their own.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if target is not None:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {_id(target[0], digest)}", f"WARC-Refers-To-Target-URI: {_uri(target[1])}"]
        if target[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {target[0]}")
    return "\r\n".join([*head, "", ""]).encode() + http + payload + b"\r\n\r\n"


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def _fields(block: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode() for k, v in _FIELD.findall(block)}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields, HTTP fields and payload of a record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = _fields(head.split(b"\r\n", 1)[1])
    body = rest[: int(fields["content-length"])]
    if not head.startswith(b"WARC/") or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("not one whole record")
    http, payload = body.split(b"\r\n\r\n", 1)
    return fields, _fields(http.split(b"\r\n", 1)[1]), payload


def _write(folder: str, date: str, most: int):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, sink, name, at = TaskContext.get().partitionId(), None, "", 0
        for b in blocks(batches, 4 << 20):
            out = []
            for page, url, payload, digest, size, kind, top, top_url in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "size", "kind", "top_id", "top_url"))):
                if sink is None or at >= most:
                    if sink is not None:
                        sink.close()
                    # an attempt has files of its own: only those of the attempt whose rows Spark keeps are ever read
                    name, at = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                stored = kind == "response"
                # a response that others refer to is named by its page and payload, every other record by its place
                own = _id(page, digest) if stored and top is not None else _id(name, at)
                data = record(kind, own, date, url, digest, size, payload or b"" if stored else b"", page, None if stored else (top[0], top_url))
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(data) + deflate.flush()
                sink.write(member)
                out.append((f"{folder}/{name}", at, len(member), page, url, digest, size, kind))
                at += len(member)
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in INDEX.split(", ")])
        if sink is not None:
            sink.close()

    return run


def write_archives(
    pages: DataFrame, folder: str, least: int = 1000, date: str = "2000-01-01T00:00:00Z", most: int = 1 << 30,
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Writes the pages below ``folder`` (a URI in shared storage) and returns the index, one row a record.

    Columns: ``path, offset, length, page_id, url, payload_digest`` (hex SHA-1), ``payload_bytes, record_type``.
    Of pages with equal payloads of at least ``least`` bytes that with the largest id (then URL) is a
    response and the others are revisits; all smaller ones are responses. A null page is empty, a null id
    is the smallest and stays null, a null URL becomes ``urn:none`` in the record. Of rows that repeat all
    three, one is the response and the others revisit it. No pages give no file and no rows; other columns are
    ignored. ``most`` bounds a file. The files are written when this is called.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    counted = rows.where(F.col("size") >= least).groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("top_size"))
    groups = counted.groupBy("digest").agg(F.max(F.struct("page_id", "url", "c")).alias("top"), F.max("top_size").alias("top_size"), F.sum("c").alias("n")).where("n > 1")
    groups = written(groups, "equal-payloads")

    # small pages never meet a group, so their key only has to be spread
    key = F.when(F.col("size") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    known = groups.select(F.col("digest").alias("group"), "top", "n")
    joined = spread_join(rows.withColumn("group", key), known, ["group"], "n", "left")
    is_top = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    several = F.col("top").isNotNull() & is_top & (F.col("top.c") > 1)
    kind = F.when(F.col("top").isNull() | is_top, "response").otherwise("revisit")
    target = [F.when(F.col("top").isNotNull(), F.array("top.page_id")).alias("top_id"), F.col("top.url").alias("top_url")]
    plain = joined.where(~several).select("page_id", "url", F.when(kind == "response", F.col("payload")).alias("payload"), "digest", "size", kind.alias("kind"), *target)
    repeated = groups.where("top.c > 1")
    if not repeated.isEmpty():
        # rows that repeat in full are counted: one payload is written, the rest are made from the count
        one = joined.where(several).groupBy("digest").agg(F.any_value("payload").alias("payload"))
        head = repeated.select("digest", "top.page_id", "top.url", F.col("top_size").alias("size"), "top", (F.col("top.c") - 1).alias("more"))
        first = head.join(one, "digest").withColumn("kind", F.lit("response"))
        piece = head.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("more") - 1) / 1000)))).repartition("digest", "at")
        rest = piece.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000).cast("long"), F.col("more") - F.col("at") * 1000)))).withColumns({"kind": F.lit("revisit"), "payload": F.lit(None).cast("binary")})
        columns = ["page_id", "url", "payload", "digest", "size", "kind", *target]
        plain = plain.unionByName(first.select(*columns)).unionByName(rest.select(*columns))
    return written(plain.mapInArrow(_write(folder, date, most), INDEX), "archive-index")


def ranges(paths: list[str], offsets: np.ndarray, lengths: np.ndarray, gap: int, most: int) -> list[tuple[int, int]]:
    """Runs of sorted records to be read at once: first and one past the last.

    A run stays in one file, has no hole of more than ``gap`` bytes and spans at most ``most``, or one record.
    """
    out, begin = [], 0
    for i in range(1, len(paths) + 1):
        if i == len(paths) or paths[i] != paths[begin] or offsets[i] - offsets[i - 1] - lengths[i - 1] > gap or offsets[i] + lengths[i] - offsets[begin] > most:
            out.append((begin, i))
            begin = i
    return out


def read_records(index: DataFrame, payload: bool = True, gap: int = 64 << 10, most: int = 8 << 20, task: int = 8 << 20) -> DataFrame:
    """The records that ``index`` (``path, offset, length``) selects, from the archives, about ``task`` bytes of them in a task.

    Columns as in ``RECORDS``, and ``payload`` (null for revisits) unless it is declined. Size and digest
    are those of the full payload: a response's are computed from what was read and must equal its
    header's, a revisit's are taken from its headers. Index rows that repeat give a record for each.
    """

    def run(batches):
        path, source = None, None
        for b in batches:
            paths, offsets, lengths = b.column("path").to_pylist(), *(b.column(c).to_numpy() for c in ("offset", "length"))
            for first, end in ranges(paths, offsets, lengths, gap, most):
                if paths[first] != path:
                    if source is not None:
                        source.close()
                    path = paths[first]
                    fs, base = pafs.FileSystem.from_uri(path)
                    source = fs.open_input_file(base)
                span = source.read_at(int(offsets[end - 1] + lengths[end - 1] - offsets[first]), int(offsets[first]))
                out = []
                for i in range(first, end):
                    at = int(offsets[i] - offsets[first])
                    fields, http, body = parse(zlib.decompress(span[at : at + int(lengths[i])], 31))
                    size, digest = int(http["content-length"]), base64.b32decode(fields["warc-payload-digest"].split(":")[1]).hex()
                    response = fields["warc-type"] == "response"
                    if response and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    number = lambda c: int(fields[c]) if c in fields else None
                    row = [path, int(offsets[i]), fields["warc-record-id"], fields["warc-type"], number("x-page-id"), fields["warc-target-uri"], size, digest, number("x-refers-to-page-id")]
                    out.append((*row, body if response else None) if payload else row)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        if source is not None:
            source.close()

    schema = RECORDS + ", payload binary" * payload
    names = [c.split()[0] for c in schema.split(", ")]
    wanted = index.select("path", "offset", "length")
    # index rows are small: the number of tasks follows the bytes that they point to
    parts = max(1, -(-(wanted.agg(F.sum("length")).first()[0] or 0) // task))
    return wanted.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(run, schema)
