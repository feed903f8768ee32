"""Benchmark passages in documents, found by a generalised suffix automaton of the benchmark's items.

The automaton knows every run of words of every item. The words of a document are streamed through it;
at each word its state holds the longest run ending there that some item contains. A window is
``window`` consecutive words of an item, or the whole of a shorter item; the words of every occurring
window are hit. Before streaming, runs of words whose short n-grams all stand in items are picked out
with numpy: no window can lie elsewhere.

A benchmark of one part is sent to every task. A larger one stays in Spark: its items are dealt into parts,
a document meets the parts with which it shares an anchor of a window, and the task that holds a part
builds its automaton.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import blocks, row_key, written
from gaugeframe.llm.words import mix, words_of

SPANS = "array<struct<first_word: long, last_word: long, start_byte: long, end_byte: long>>"
ARROW_SPAN = pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start_byte", "end_byte")])


@dataclass
class Automaton:
    """States are runs of words that end at the same places of the items."""

    window: int
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: of states at least a window long: the items that contain them
    owners: dict[int, set[str]] = field(default_factory=dict)
    #: of states that are a whole item shorter than a window: its length and the items
    short: dict[int, list[tuple[int, set[str]]]] = field(default_factory=dict)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A state of its own for the part of ``target`` that ``state`` plus ``word`` reaches."""
        part = self._new(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = part
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, state = self._new(self.length[last] + 1, {}, 0), last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.step[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def build(self, items: list[tuple[str, list[int]]]) -> Automaton:
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for name, words in items:
            state = 0
            for w in words:
                state = self.step[state][w]
                if self.length[state] >= self.window:
                    self.owners.setdefault(state, set()).add(name)
            if 0 < len(words) < self.window:
                found = self.short.setdefault(state, [])
                at = next((s for n, s in found if n == len(words)), None)
                if at is None:
                    found.append((len(words), {name}))
                else:
                    at.add(name)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            up = self.link[state]
            if state in self.owners and up > 0 and self.length[up] >= self.window:
                self.owners.setdefault(up, set()).update(self.owners[state])
        return self

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first and last, merged) and the items whose windows occur; -1 is a word of no item."""
        state, length, runs, items = 0, 0, [], set()
        step, link, limit = self.step, self.link, self.length
        for j, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                length = limit[state]
            if w in step[state]:
                state, length = step[state][w], length + 1
            if not state:
                continue
            most, at = 0, state
            if length >= self.window:
                most = length
                while limit[link[at]] >= self.window:
                    at = link[at]
                items |= self.owners[at]
            if self.short:
                at = state
                while at > 0:
                    for n, names in self.short.get(at, ()):
                        if n <= length:
                            most = max(most, n)
                            items |= names
                    at = link[at]
            if most:
                first = j - most + 1
                while runs and runs[-1][1] >= first - 1:
                    first = min(first, runs.pop()[0])
                runs.append((first, j))
        return runs, items


class Matcher:
    """An automaton with the vocabulary and the n-grams that pick out the runs worth streaming."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        w = words_of(pa.array([t for _, t in items], pa.string()))
        spelled = [w.text(i) for i in range(len(w.start))]
        self.ids: dict[bytes, int] = {}
        for s in spelled:
            self.ids.setdefault(s, len(self.ids))
        numbers = [self.ids[s] for s in spelled]
        listed = [(name, numbers[a:b]) for (name, _), a, b in zip(items, w.first, w.first[1:]) if b > a]
        self.least = min([window, *(len(x) for _, x in listed)])
        self.gram = min(3, self.least)
        self.automaton = Automaton(window).build(listed)
        hashes, at = np.unique(w.hashes(), return_index=True)
        self.hashes, self.number = hashes, np.array(numbers, np.int64)[at]
        self.base = len(self.ids) + 1
        grams = [self._gram(np.array(x, np.int64)) for _, x in listed]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)

    def _gram(self, numbers: np.ndarray) -> np.ndarray:
        n = max(0, len(numbers) - self.gram + 1)
        code = np.zeros(n, np.int64)
        for k in range(self.gram):
            code = code * self.base + numbers[k : k + n]
        return code

    def find(self, column: pa.Array):
        """For each text: number of words, hit runs as ``SPANS`` and the items."""
        w = words_of(column)
        counts, out = np.diff(w.first), [([], set()) for _ in range(len(column))]
        if len(self.hashes) and len(w.start):
            h = w.hashes()
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            numbers = np.where(self.hashes[at] == h, self.number[at], -1)
            text = np.repeat(np.arange(len(column)), counts)
            code, g = self._gram(np.maximum(numbers, 0)), self.gram
            good = np.zeros(len(numbers) + 1, bool)
            n = len(code)
            if n:
                inside = text[:n] == text[g - 1 :]
                for k in range(g):
                    inside &= numbers[k : k + n] >= 0
                near = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
                good[:n] = inside & (self.grams[near] == code)
            # a run of grams never leaves its text: the last words of a text begin none
            edges = np.flatnonzero(np.diff(np.concatenate([[False], good]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                for a, b in self._within(text, a, b):
                    if b - a + g - 1 < self.least:
                        continue
                    # spelled out here, so that equal hashes of different words cannot matter
                    run = [self.ids.get(w.text(i), -1) for i in range(a, b + g - 1)]
                    runs, items = self.automaton.stream(run)
                    spans, names = out[text[a]]
                    names |= items
                    first, begin = int(w.first[text[a]]), int(w.begins[text[a]])
                    spans += [(x + a - first, y + a - first, int(w.start[x + a]) - begin, int(w.end[y + a]) - begin) for x, y in runs]
        return counts, [(_merged(spans), names) for spans, names in out]

    @staticmethod
    def _within(text: np.ndarray, a: int, b: int):
        """The parts of a run that lie in one text each."""
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(text[a:b]))).tolist(), b]
        return zip(cuts, cuts[1:])


def _merged(spans):
    out = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), out[-1][2], max(out[-1][3], s[3]))
        else:
            out.append(tuple(s))
    return out


def _anchors(parts: bool, window: int, sizes: list[int]):
    """Distinct ``(size, gram)`` of each text: the least-hashed gram of every run of ``size`` words.

    Equal runs have equal ones. Of an item only the size of its own windows counts, which is ``window`` or
    the length of a shorter item; of a document all ``sizes`` do.
    """

    def run(batches):
        for b in blocks(batches, 1 << 20):
            w = words_of(b.column("text"))
            h, out, rows = w.hashes(), [], []
            for i, (x, y) in enumerate(zip(w.first, w.first[1:])):
                n = int(y - x)
                for size in ([min(window, n)] if n else []) if parts else sizes:
                    if size > n:
                        continue
                    g = (size + 1) // 2
                    code = np.zeros(n - g + 1, np.uint64)
                    for k in range(g):
                        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + h[x + k : y - g + 1 + k])
                    least = np.unique(np.lib.stride_tricks.sliding_window_view(code, size - g + 1).min(1))
                    out += [(size, v) for v in least.view(np.int64).tolist()]
                    rows += [i] * len(least)
            keep = [c for c in b.schema.names if c != "text"]
            own = [b.column(c).take(pa.array(rows, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array([s for s, _ in out], pa.int32()), pa.array([v for _, v in out], pa.int64())], [*keep, "size", "gram"])

    return run


def _scan_parts(window: int):
    """Items (without ``k1``) and then documents of each part and slice in; spans and items of documents out."""

    def run(batches):
        part, items, matcher = None, [], None
        for b in blocks(batches, 1 << 20):
            key = list(zip(b.column("part").to_pylist(), b.column("slice").to_pylist()))
            known = b.column("k1").is_valid().to_pylist()
            at = 0
            while at < len(key):
                end = at
                while end < len(key) and key[end] == key[at] and known[end] == known[at]:
                    end += 1
                piece = b.slice(at, end - at)
                if key[at] != part:
                    part, items, matcher = key[at], [], None
                at = end
                if piece.column("k1")[0].as_py() is None:
                    items += zip(piece.column("name").to_pylist(), piece.column("text").to_pylist())
                    continue
                if matcher is None:
                    matcher, items = Matcher(items, window), []
                _, hits = matcher.find(piece.column("text"))
                some = [i for i, (spans, _) in enumerate(hits) if spans]
                spans = [[dict(zip(("first_word", "last_word", "start_byte", "end_byte"), x)) for x in hits[i][0]] for i in some]
                own = [piece.column(c).take(pa.array(some, pa.int64())) for c in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(spans, pa.list_(ARROW_SPAN)), pa.array([sorted(hits[i][1]) for i in some], pa.list_(pa.string()))], ["k1", "k2", "spans", "items"])

    return run


def _found_in_parts(rows: DataFrame, listed: DataFrame, parts: int, window: int, slice_bytes: int) -> DataFrame:
    """``k1, k2, spans, items`` of the keyed ``rows`` that hold windows; lists of one entry for each part."""
    dealt = written(listed.select(F.pmod(F.xxhash64("name", "text"), F.lit(parts)).cast("int").alias("part"), "name", "text"), "benchmark")
    asked = written(dealt.select("part", "text").mapInArrow(_anchors(True, window, []), "part int, size int, gram long").distinct(), "item-anchors")
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # at most ``window``
    texts = rows.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    offered = rows.select("k1", "k2", "text").mapInArrow(_anchors(False, window, sizes), "k1 long, k2 long, size int, gram long")
    met = written(offered.join(asked, ["size", "gram"]).select("k1", "k2", "part").distinct(), "candidates")
    sized = written(met.join(texts.select("k1", "k2", F.octet_length("text").cast("long").alias("_n")), ["k1", "k2"]), "sized-candidates")
    slices = sized.groupBy("part").agg(F.ceil((F.sum("_n") + 1) / slice_bytes).cast("int").alias("slices"))
    items = dealt.join(slices, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), "name", "text")
    docs = sized.join(slices, "part").select("part", F.pmod(F.xxhash64("k1", "k2"), F.col("slices")).cast("int").alias("slice"), "k1", "k2")
    docs = docs.join(texts, ["k1", "k2"]).select("part", "slice", "k1", "k2", F.lit(None).cast("string").alias("name"), "text")
    both = items.unionByName(docs).repartition("part", "slice").sortWithinPartitions("part", "slice", F.col("k1").asc_nulls_first())
    found = written(both.mapInArrow(_scan_parts(window), f"k1 long, k2 long, spans {SPANS}, items array<string>"), "part-hits")
    return found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    carry: tuple[str, ...] = (), part_words: int = 1_000_000, most_words: int | None = None, slice_bytes: int = 64 << 20,
) -> DataFrame:
    """``doc_id, text, n_words, n_hit, spans, items`` and the columns named in ``carry``, for every row.

    ``spans`` are the maximal runs of hit words (numbers of the first and last word from 0, and bytes of
    the text); ``items`` are the ids, as distinct strings, of the items with an occurring window. A null
    text or item has no words, a null item id is the empty string, items with equal ids count once,
    rows with a null or repeated document id are treated one by one, and an empty benchmark hits nothing.
    An empty table gives no rows. A benchmark of up to ``part_words`` words goes to every task in one
    automaton. A larger one is dealt into parts of about that size by a hash of its items; each task
    holds one part at a time and about ``slice_bytes`` of the documents that may hold its windows, and
    ``docs`` is read several times and must give the same rows each time. No size is refused unless
    ``most_words`` names one.
    """
    own = [f for f in docs.select(*carry).schema] if carry else []
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in own)
    schema = f"doc_id long, text string, n_words long, spans {SPANS}, items array<string>{extra}"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c) for c in carry))
    listed = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    n_words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    # long words weigh more, so that a part is bounded in bytes too
    weight, total = listed.select(F.sum(F.greatest(n_words + 1, F.octet_length("text") / 16)), F.sum(n_words + 1)).first()
    if most_words is not None and (total or 0) > most_words:
        raise ValueError(f"the benchmark has more than {most_words} words; split it into several calls")
    parts = max(1, math.ceil((weight or 0) / part_words))
    none = f"cast(array() AS {SPANS}) AS spans", "cast(array() AS array<string>) AS items"
    names = [f"`{f.name}`" for f in own]
    if parts == 1:
        items = [tuple(r) for r in listed.collect()]  # at most ``part_words`` words
        found = rows.selectExpr("doc_id", "text", "0L AS n_words", *none, *names)
    else:
        keyed = docs.select(*row_key(doc_id, text), F.col(text).cast("string").alias("text"))
        hits = _found_in_parts(keyed, listed, parts, window, slice_bytes)
        whole = docs.select(F.struct(*row_key(doc_id, text)).alias("_key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c) for c in carry))
        hits = hits.select(F.struct("k1", "k2").alias("_key"), F.col("spans").alias("_spans"), F.col("items").alias("_items"))
        items = []
        found = whole.join(hits, "_key", "left").selectExpr("doc_id", "text", "0L AS n_words", none[0].replace("cast(", "coalesce(_spans, cast(", 1).replace(" AS spans", ") AS spans"), none[1].replace("cast(", "coalesce(_items, cast(", 1).replace(" AS items", ") AS items"), *names)

    def scan(items):
        def run(batches):
            matcher = Matcher(items, window)
            for b in blocks(batches, 1 << 20):
                counts, hits = matcher.find(b.column("text"))
                spans, names = [], []
                for (s, n), old, had in zip(hits, b.column("spans").to_pylist(), b.column("items").to_pylist()):
                    spans.append([dict(zip(("first_word", "last_word", "start_byte", "end_byte"), x)) for x in _merged(s + [tuple(o.values()) for o in old])])
                    names.append(sorted(n.union(had)))
                new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(ARROW_SPAN)), pa.array(names, pa.list_(pa.string()))]
                head = [b.column("doc_id"), b.column("text"), *new, *(b.column(f.name) for f in own)]
                yield pa.RecordBatch.from_arrays(head, ["doc_id", "text", "n_words", "spans", "items", *(f.name for f in own)])

        return run

    found = found.mapInArrow(scan(items), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.last_word - s.first_word + 1)
    return found.select("doc_id", "text", "n_words", hit.alias("n_hit"), "spans", "items", *(F.col(f"`{f.name}`") for f in own))


def remove_passages(found: DataFrame, max_coverage: float = 0.5) -> DataFrame:
    """``found`` without the hit spans: documents with a larger share of hit words go whole.

    From the others each span is cut, from the first byte of its first word to the last of its last.
    """

    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s.end_byte))
    starts = F.concat(F.transform("spans", lambda s: s.start_byte), F.array(F.octet_length(raw).cast("long")))
    parts = F.zip_with(ends, starts, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")))
    kept = F.decode(F.aggregate(parts, F.encode(F.lit(""), "UTF-8"), lambda x, y: F.concat(x, y)), "UTF-8")
    return found.where(F.col("n_hit") <= F.col("n_words") * max_coverage).withColumn("text", F.when(F.size("spans") > 0, kept).otherwise(F.col("text")))
