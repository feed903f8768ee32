"""Repeated byte strings, by suffix sorting around content-defined anchors.

Every string of ``length`` bytes holds an anchor: the place in it whose ``gram`` following bytes have the
least hash. Equal strings hold their anchor at the same place, so strings can only be equal where anchors
with equal grams meet. Anchors with a gram of their own are left out; of those with equal surroundings one
stands for all. The surroundings of the others are sorted to both sides of the gram, deep-shallow: a
multikey quicksort to a shallow depth, then blind tries for the groups that still agree. Neighbours'
common prefixes say which anchors share a whole string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import blocks, dropped, row_key, written
from gaugeframe.llm.words import INVERSE, mix, powers, prefix_sums, range_hash, raw_bytes, words_of

#: eight-byte words that the quicksort compares before tries take over
SHALLOW = 4
TOP = np.uint64(2**64 - 1)
SPAN = "array<struct<first: long, last: long>>"
#: bytes of a word's code
CODE = 6


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``raw_bytes``, of texts in which every word is ``CODE`` bytes of its hash and nothing else stands.

    Strings of ``n * CODE`` bytes are equal where ``n`` words are: a string that begins inside a word needs
    ``CODE`` further bytes of other words to agree by chance.
    """
    w = words_of(column)
    return np.ascontiguousarray(w.hashes().view(np.uint8).reshape(-1, 8)[:, :CODE]).ravel(), w.first * CODE


# anchors -------------------------------------------------------------------------------------------


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, from running ones within blocks."""
    best, n = (np.minimum if least else np.maximum), len(x)
    if n < width:
        return x[:0]
    fill = np.full(-n % width, TOP if least else 0, np.uint64)
    grid = np.concatenate([x, fill]).reshape(-1, width)
    ahead = best.accumulate(grid, 1).ravel()
    behind = best.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def _tails(begins: np.ndarray, size: int, n: int) -> np.ndarray:
    """Places where ``size`` bytes do not fit into their text any more."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(begins[:-1], begins[1:] - size + 1), 1)
    np.add.at(edge, begins[1:], -1)
    return np.cumsum(edge[:-1]) > 0


def anchors(data: np.ndarray, begins: np.ndarray, sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors and the hashes of their grams."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = mix((sums[gram:] - sums[:-gram]) * powers(INVERSE, n - gram + 1))
    x = np.minimum(x, TOP - np.uint64(1))
    x[_tails(begins, gram, n)[: len(x)]] = TOP
    low = sliding(x, width, True)
    low[_tails(begins, length, n)[: len(low)]] = 0
    reach = sliding(np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(len(x) - len(low), np.uint64)]), width, False)
    at = np.flatnonzero((reach == x) & (x != TOP))
    return at, x[at]


ANCHOR = "core long, around long, k1 long, k2 long, at long, left int, right int, on int, times long"


def _anchor_rows(length: int, gram: int, view):
    """Anchor rows of documents: gram hash, hash of the surroundings, place, bytes there on each side.

    Anchors of a text that are equal in gram and surroundings share their strings. Where they follow each
    other so closely that their grams overlap by two words, as in a run of one word, these strings cover one
    span whatever their reach: they are one row, with the way ``on`` to the last and their number.
    """
    room, near = length - gram, gram - 2 * CODE

    def run(batches):
        for b in blocks(batches, 1 << 20):
            data, begins = view(b.column("text"))
            sums = prefix_sums(data)
            at, core = anchors(data, begins, sums, length, gram)
            text = np.searchsorted(begins, at, side="right") - 1
            left, right = np.minimum(at - begins[text], room), np.minimum(begins[text + 1] - at - gram, room)
            around = mix(range_hash(sums, at - left, at + gram + right) + (left * 65536 + right).astype(np.uint64))
            order = np.lexsort((around, core, text))  # stable: places ascend among equal ones
            x, y = order[1:], order[:-1]
            apart = (text[x] != text[y]) | (core[x] != core[y]) | (around[x] != around[y]) | (at[x] - at[y] > near)
            first = np.flatnonzero(np.concatenate([[True], apart]))[: len(at)]
            times = np.diff(np.append(first, len(at)))
            one, last = order[first], order[first + times - 1]
            own = [b.column(c).take(pa.array(text[one])) for c in ("k1", "k2")]
            cols = [
                pa.array(core[one].view(np.int64)), pa.array(around[one].view(np.int64)), *own, pa.array(at[one] - begins[text[one]]),
                pa.array(left[one].astype(np.int32)), pa.array(right[one].astype(np.int32)), pa.array((at[last] - at[one]).astype(np.int32)), pa.array(times),
            ]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in ANCHOR.split(", ")])

    return run


# deep-shallow sorting ------------------------------------------------------------------------------


class BlindTrie:
    """Order of strings that agree for long: inner nodes keep a depth and one byte a child.

    A string goes down by the bytes at the nodes' depths alone, is compared once with a leaf it reaches,
    and is hung in where the two first differ.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.numbers = strings, [int.from_bytes(s, "big") for s in strings]
        self.size = len(strings[0])
        # a leaf is a list of equal strings, an inner node (depth, children by byte)
        self.root: list | tuple = [0]
        for i in range(1, len(strings)):
            self._insert(i)

    @staticmethod
    def _leaf(node) -> int:
        while type(node) is tuple:
            node = next(iter(node[1].values()))
        return node[0]

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while type(node) is tuple:
            below = node[1].get(s[node[0]])
            if below is None:
                break
            node = below
        differ = self.numbers[i] ^ self.numbers[self._leaf(node)]
        depth = self.size - (differ.bit_length() + 7) // 8
        over, node = None, self.root
        while type(node) is tuple and node[0] < depth:
            over, node = node, node[1][s[node[0]]]
        if depth == self.size:
            node.append(i)
        elif type(node) is tuple and node[0] == depth:
            node[1][s[depth]] = [i]
        else:
            new = (depth, {self.strings[self._leaf(node)][depth]: node, s[depth]: [i]})
            if over is None:
                self.root = new
            else:
                over[1][s[over[0]]] = new

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if type(node) is tuple:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows within their groups, and common prefixes of neighbours in that order.

    ``rows`` are filled up with zeros to one width, a multiple of eight; ``sizes`` are their true lengths;
    ``group`` is ascending. The prefix of the first row of a group is 0. All groups go through each step
    of the quicksort together: words are compared with the pivot of their segment, and the equal part
    moves on by a word.
    """
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, segment, depth = np.arange(n), group.astype(np.int64).copy(), np.zeros(n, np.int64)
    while n:
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        count = np.diff(np.append(first, n))
        busy = np.repeat((count > 1) & (depth[first] < min(SHALLOW, words.shape[1])), count)
        if not busy.any():
            break
        at = np.flatnonzero(busy)
        pivot_at = np.repeat(first + count // 2, count)[at]
        own, pivot = words[order[at], depth[at]], words[order[pivot_at], depth[at]]
        side = (own > pivot).astype(np.int8) - (own < pivot).astype(np.int8)
        to = np.lexsort((side, segment[at]))
        order[at], side = order[at][to], side[to]
        full_side = np.zeros(n, np.int8)
        full_side[at] = side
        depth[at] += side == 0
        cut = np.concatenate([[True], (segment[1:] != segment[:-1]) | (full_side[1:] != full_side[:-1])])
        segment = np.cumsum(cut)
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.zeros(0, np.int64)
    for a, b in zip(first, np.append(first[1:], n)):
        if b - a > 1:
            own = order[a:b]
            own = own[np.argsort(sizes[own], kind="stable")]  # a prefix goes first
            order[a:b] = own[BlindTrie([rows[i].tobytes() for i in own]).order()]
    prefix = np.zeros(n, np.int64)
    for a in range(1, n, 8192):
        x, y = order[a : a + 8192], order[a - 1 : min(a + 8192, n) - 1]
        differ = rows[x] != rows[y]
        shared = np.where(differ.any(1), differ.argmax(1), width)
        prefix[a : a + 8192] = np.where(group[x] == group[y], np.minimum(shared, np.minimum(sizes[x], sizes[y])), 0)
    return order, prefix


def shared_reach(group: np.ndarray, left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how far to the left and to the right strings reach that another of its group shares.

    ``left`` runs away from the gram. A shared string takes ``d`` bytes on the left and ``room - d`` on the
    right; (0, -1) marks rows that share none.
    """
    n = len(group)
    found_left, found_right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    (a, p), (b, q) = (deep_shallow(x, s, group) for x, s in ((left, left_sizes), (right, right_sizes)))
    near = []
    for order, prefix in ((a, p), (b, q)):
        best = np.zeros(n, np.int64)
        best[order] = np.maximum(prefix, np.append(prefix[1:], 0))
        near.append(best)
    edge = group[1:] != group[:-1]  # the orders keep groups apart
    starts = np.concatenate([[True], edge]) if n else np.zeros(0, bool)
    side = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(room + 1):
        able = np.flatnonzero((near[0] >= d) & (near[1] >= room - d) & (left_sizes >= d) & (right_sizes >= room - d))
        if len(able) < 2:
            continue
        side[0][a] = np.cumsum((p < d) | starts)
        side[1][b] = np.cumsum((q < room - d) | starts)
        code = side[0][able] * (n + 1) + side[1][able]
        _, number, often = np.unique(code, return_inverse=True, return_counts=True)
        twice = able[often[number] > 1]
        found_left[twice] = d
        new = twice[found_right[twice] < 0]
        found_right[new] = room - d
    return np.where(found_left < 0, 0, found_left), found_right


def _compared(room: int, most: int = 16_384):
    """Batches sorted by gram in, reaches of every surroundings out; whole groups at a time."""
    width = -(-max(room, 1) // 8) * 8

    def matrix(column) -> tuple[np.ndarray, np.ndarray]:
        values = column.to_pylist()
        return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width), np.array([len(v) for v in values], np.int64)

    def reach(part: pa.RecordBatch) -> pa.RecordBatch:
        core = part.column("core").to_numpy()
        group = np.cumsum(np.concatenate([[0], core[1:] != core[:-1]]))
        lo, hi = shared_reach(group, *matrix(part.column("before")), *matrix(part.column("after")), room)
        keep = hi >= 0
        return pa.RecordBatch.from_arrays([*(part.column(c).filter(pa.array(keep)) for c in ("core", "around")), pa.array(lo[keep]), pa.array(hi[keep])], ["core", "around", "lo", "hi"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < most:
                continue
            core = b.column("core").to_numpy()
            cut = int(np.searchsorted(core, core[-1], side="left"))  # the last group may go on
            if cut == 0 and (len(held) == 1 or held[-2].column("core")[-1].as_py() == core[0]):
                continue
            done = pa.concat_batches([*held[:-1], b.slice(0, cut)])
            yield reach(done)
            held, rows = [b.slice(cut)], b.num_rows - cut
        if held:
            yield reach(pa.concat_batches(held))

    return run


# jobs ----------------------------------------------------------------------------------------------


def _surroundings(length: int, gram: int, view):
    """Bytes before (outward) and after the gram of each wanted anchor; of hot grams, hashes of strings."""
    room = length - gram

    def run(batches):
        for b in blocks(batches, 1 << 20):
            data, begins = view(b.column("text"))
            sums, out = None, [[] for _ in range(6)]
            for i, wanted in enumerate(b.column("wanted").to_pylist()):
                text = data[begins[i] : begins[i + 1]]
                for w in wanted:
                    at, left, right = w["at"], w["left"], w["right"]
                    hashes, first = None, None
                    before = after = b""
                    if w["hot"]:
                        sums = prefix_sums(data) if sums is None else sums
                        first = max(0, room - right)
                        start = begins[i] + at - np.arange(first, left + 1)
                        hashes = range_hash(sums, start, start + length).view(np.int64)
                    else:
                        before, after = text[at - left : at][::-1].tobytes(), text[at + gram : at + gram + right].tobytes()
                    for column, x in zip(out, (w["core"], w["around"], before, after, first, hashes)):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["core", "around", "before", "after", "first", "hashes"])

    return run, "core long, around long, before binary, after binary, first long, hashes array<long>"


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 200, doc_id: str = "doc_id", text: str = "text", hot: int = 20_000, view=raw_bytes) -> DataFrame:
    """``k1, k2, spans``: places in each document that a string of ``length`` bytes covers which also
    starts elsewhere; spans may overlap, and documents without any are left out.

    A gram with more than ``hot`` different surroundings is not compared in one task: hashes of all
    strings around it are counted instead, which gives the same spans. ``view`` gives the bytes of texts
    that lengths and places refer to.
    """
    room = length - gram
    rows = docs.select(*row_key(doc_id, text), F.col(text).alias("text"))
    found = written(rows.mapInArrow(_anchor_rows(length, gram, view), ANCHOR), "anchors")
    twice = written(found.groupBy("core").agg(F.sum("times").alias("n")).where("n > 1").select("core"), "repeated-grams")
    met = written(found.join(twice, "core"), "repeated-anchors")
    dropped(found, twice)
    kinds = written(met.groupBy("core", "around").agg(F.sum("times").alias("n"), F.min(F.struct("k1", "k2", "at", "left", "right")).alias("one")), "surroundings")
    # surroundings that occur twice are covered whole and only serve as partners for others
    whole = kinds.where("n > 1").select("core", "around", F.col("one.left").cast("long").alias("lo"), F.col("one.right").cast("long").alias("hi"))
    mixed = written(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("core", (F.col("m") > hot).alias("hot")), "mixed-grams")
    wanted = kinds.join(mixed, "core").select("one.k1", "one.k2", F.struct("core", "around", "one.at", "one.left", "one.right", "hot").alias("w"))
    scan, schema = _surroundings(length, gram, view)
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    found = written(rows.join(asked, ["k1", "k2"]).select("text", "wanted").mapInArrow(scan, schema), "sides")
    # of equal rows each brings the surroundings that stand for both
    sides = found.dropDuplicates(["core", "around"])
    plain = sides.where("hashes IS NULL").select("core", "around", "before", "after")
    reached = plain.repartition("core").sortWithinPartitions("core").mapInArrow(_compared(room), "core long, around long, lo long, hi long")
    # equal strings hold a gram at the same distance, and one anchor's strings have one each
    strings = sides.where("hashes IS NOT NULL").select("core", "around", "first", F.posexplode("hashes").alias("i", "h"))
    strings = strings.select("core", "around", (F.col("first") + F.col("i")).alias("d"), "h")
    often = written(strings.groupBy("core", "d", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "hot-strings")
    counted = strings.join(often, ["core", "d", "h"]).groupBy("core", "around").agg(F.max("d").alias("lo"), (F.lit(room) - F.min("d")).alias("hi"))
    reach = written(whole.unionByName(reached).unionByName(counted).groupBy("core", "around").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")), "reach")
    dropped(kinds, mixed, found, often)
    spans = met.join(reach, ["core", "around"]).select("k1", "k2", F.struct((F.col("at") - F.col("lo")).alias("first"), (F.col("at") + F.col("on") + gram + F.col("hi")).alias("last")).alias("s"))
    return spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _places(text: str, passages: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bytes of the words in runs of words."""
    w = words_of(pa.array([text]))
    return [(int(w.start[a]), int(w.end[b - 1])) for a, b in passages]


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 200, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), hot: int = 20_000, words: int = 0, cut_passages: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept, n_passages`` and the columns in ``carry``.

    Every byte is removed that a string of ``length`` bytes covers which also starts anywhere else, in
    the same or another row; strings never cross rows and are judged on the input. With ``words``, so are
    passages of that many words (those of ``words_of``: case and what stands between words do not count)
    that also start anywhere else, however few bytes they have; without ``cut_passages`` these stay in the text.
    ``n_passages`` counts their maximal runs (0 without ``words``). ``kept`` is the text
    without the spans, from which characters that a span cuts are left in whole. A null text is empty.
    Rows with null or repeated ids are judged one by one; of rows with equal id and text each is the
    other's copy. Other columns are ignored; an empty table gives no rows. ``docs`` is read three times
    (five with ``words``) and must give the same rows each time.
    """
    found = repeated_spans(docs, length, gram, doc_id, text, hot)
    if words:
        passages = repeated_spans(docs, words * CODE, max(1, words // 3) * CODE, doc_id, text, hot, word_codes)
        found = found.join(passages.withColumnRenamed("spans", "passages"), ["k1", "k2"], "full")
    else:
        found = found.withColumn("passages", F.lit(None).cast(SPAN))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *row_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(c).alias(f"_carry_{c}") for c in carry))
    names = ["doc_id", *(f"_carry_{c}" for c in carry)]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def run(batches):
        for b in blocks(batches):
            out = [[] for _ in range(7)]
            for t, spans, passages in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "passages"))):
                raw = t.encode()
                word_runs = [(-(-s["first"] // CODE), s["last"] // CODE) for s in passages or ()]
                runs = merged([(s["first"], s["last"]) for s in spans or ()] + (_places(t, word_runs) if word_runs and cut_passages else []))
                rest, safe, at, safe_at = [], [], 0, 0
                for x, y in runs:
                    rest.append(raw[at:x])
                    at = y
                    while x < y and raw[x] & 0xC0 == 0x80:
                        x += 1
                    while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
                        y -= 1
                    safe.append(raw[safe_at:x])
                    safe_at = y
                rest.append(raw[at:])
                safe.append(raw[safe_at:])
                removed = sum(y - x for x, y in runs)
                spans = [{"first": x, "last": y} for x, y in runs]
                for column, x in zip(out, (len(raw), removed, len(runs), hashlib.sha256(b"".join(rest)).hexdigest(), spans, b"".join(safe).decode(), len(merged(word_runs)))):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *columns], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "n_passages"])

    schema = f"{kept}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {SPAN}, kept string, n_passages long"
    done = rows.join(found, ["k1", "k2"], "left").select(*names, "text", "spans", "passages").mapInArrow(run, schema)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "n_passages", *(F.col(f"_carry_{c}").alias(c) for c in carry))
