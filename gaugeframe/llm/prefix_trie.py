"""The trie of conversation prefixes, by whole-sequence collapse.

Identical conversations become one weighted sequence with a list of ends. Only the sequences are unfolded
into prefixes; those that are proper prefixes of another are dropped by an anti-join, which leaves the
leaves, and every node is an aggregate of the weighted prefixes through it. A turn is two 64-bit hashes and
a size from the first step on, and a prefix the exclusive-or of its turns' hashes, salted by depth, so texts
are neither shuffled nor held together.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import written
from gaugeframe.operators.scan import changes, running, spread_join

KEY = ["depth", "x1", "x2"]


def digest_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, h1, h2, size``: a turn without its text. Null role and text are empty; rows without an id go."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    hashes = [F.xxhash64(F.lit(seed), *words).alias(f"h{seed}") for seed in (1, 2)]
    return conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *hashes, F.length(words[1]).cast("long").alias("size"))


def graft(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another, and the table of all conversations.

    Conversation c takes the first h turns of ``c - c % every`` (all if fewer, none if absent), h being
    ``crc32(c) % most``, and goes on with its own turns after its first h. Turns that tie are in the order of
    their hashes. Rows of the first are ``conv_id, depth, h1, h2, size``, depth from 1.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    turn = F.struct("turn", "h1", "h2", "size")
    lead = turns.where((F.col("conv_id") % every == 0)).withColumn("_n", F.row_number().over(_in_order())).where(F.col("_n") < most)
    leads = lead.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("lead"))  # fewer than ``most`` each
    ids = turns.select("conv_id").distinct()
    convs = written(ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(leads, "base", "left").select("conv_id", F.slice(F.coalesce("lead", F.array()), F.lit(1), h("conv_id").cast("int")).alias("lead")), "conversations")
    taken = convs.select("conv_id", F.posexplode("lead").alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "t.h1", "t.h2", "t.size")
    # a row before a conversation's turns brings the number taken to all of them, however many they are
    marks = convs.select("conv_id", F.lit(0).alias("own"), F.size("lead").cast("long").alias("n_taken"))
    rows = marks.unionByName(turns.withColumns({"own": F.lit(1), "n_taken": F.lit(0).cast("long")}), allowMissingColumns=True)
    placed = running(rows, ["conv_id"], ["own", "turn", "h1", "h2"], sums=["n_taken"])
    place = F.col("_place") - 1
    own = placed.where((F.col("own") == 1) & (place > h("conv_id"))).select("conv_id", (place - h("conv_id") + F.col("n_taken")).alias("depth"), "h1", "h2", "size")
    return taken.unionByName(own), convs.select("conv_id")


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the conversations that end at each.

    ``turns``: conv_id, depth (1, 2, … without gaps), h1, h2, size; ``conversations``: distinct conv_ids, with
    or without turns. Nodes: ``depth, x1, x2`` (the prefix), ``conv_id`` (the smallest member),
    ``parent_conv_id``, ``n_convs, n_children, n_leaves, saved_tokens``, as op12 defines them. Ends: the
    prefix, and ``conv_id``. Every conversation is a member of the root, also one without turns; no
    conversations give no nodes. Extra columns are ignored.
    """
    salted = [F.xxhash64("depth", h).alias(x) for h, x in (("h1", "x1"), ("h2", "x2"))]
    zero = F.lit(0).cast("long")
    root = conversations.select("conv_id", *(zero.alias(c) for c in ("depth", "x1", "x2", "size", "own1", "own2")))
    rows = turns.select("conv_id", "depth", *salted, "size").withColumns({"own1": F.col("x1"), "own2": F.col("x2")})
    rows = root.unionByName(rows).withColumn("until", F.col("size"))
    path = running(rows, ["conv_id"], ["depth"], sums=["until"], xors=["x1", "x2"]).drop("_place")

    # whole sequences, weighted; the end list of each is kept as rows
    ends = written(path.groupBy("conv_id").agg(F.max(F.struct(*KEY, F.col("until").alias("total"))).alias("e")).select("conv_id", "e.*"), "trie-ends")
    sequences = written(ends.groupBy(*KEY).agg(F.count(F.lit(1)).alias("w"), F.min("conv_id").alias("conv_id"), F.max("total").alias("total")).withColumn("n_rows", F.col("depth") + 1), "trie-sequences")

    # prefixes of the sequences only, with their weights
    chosen = sequences.select("conv_id", "w", "total", F.col("depth").alias("last"), "n_rows")
    prefixes = written(spread_join(path, chosen, ["conv_id"], "n_rows"), "trie-prefixes")
    inner = prefixes.where("depth < last").select(*KEY).distinct()
    leaves = sequences.join(inner, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    parent = [F.max(c).alias(n) for c, n in ((F.col("x1").bitwiseXOR(F.col("own1")), "p1"), (F.col("x2").bitwiseXOR(F.col("own2")), "p2"))]
    first = written(prefixes.groupBy(*KEY).agg(F.sum("w").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), *parent), "trie-first")

    # a node belongs to the sequence of its smallest member, and a sequence's own nodes are the deepest of its path
    owned = first.groupBy("conv_id").agg(F.min("depth").alias("from_depth"), F.sum("size").alias("owned"))
    facts = sequences.select("conv_id", "n_rows").join(leaves, "conv_id", "left").join(owned, "conv_id", "left")
    below = F.col("total") - F.col("until") + F.col("size")
    once = F.when(F.col("depth") >= F.col("from_depth"), below).otherwise(F.coalesce("owned", zero))
    later = spread_join(prefixes, written(facts, "trie-facts"), ["conv_id"], "n_rows", "left")
    sums = later.groupBy(*KEY).agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), (F.sum(F.col("w") * below) - F.sum(once)).alias("saved_tokens"))

    up = [F.lit(-1).cast("long") + F.col("depth"), F.col("p1"), F.col("p2")]
    children = first.where("depth > 0").groupBy(*(c.alias(k) for c, k in zip(up, KEY))).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = first.join(sums, KEY).join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = written(nodes, "trie-nodes")
    parents = nodes.where("n_children > 0").select(*(F.col(k).alias(f"up_{k}") for k in KEY), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_rows"))
    full = spread_join(nodes.withColumns({f"up_{k}": c for k, c in zip(KEY, up)}), parents, [f"up_{k}" for k in KEY], "n_rows", "left")
    return full.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends.select(*KEY, "conv_id")


def list_digests(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """SHA-256 of the ascending values of each key, comma-joined. A long list is sorted by many tasks and hashed in pieces."""
    kinds = rows.select(*keys, value).schema
    piece = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", piece string"

    def join(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at = [*changes([b.column(k) for k in keys]).nonzero()[0].tolist(), b.num_rows]
            texts = list(map(str, b.column(value).to_pylist()))
            at = [0, *at]
            pieces = [",".join(texts[i:j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array(at[:-1])) for n in (*keys, value)), pa.array(pieces, pa.string())], [*keys, value, "piece"])

    def digest(batches):
        now, state, rows = None, None, []

        def flush():
            columns = list(zip(*rows))
            arrays = [pa.array(c, t) for c, t in zip(columns, [*kinds_of, pa.string()])]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, [*keys, out])

        kinds_of = []
        for b in batches:
            kinds_of = [b.column(k).type for k in keys]
            for *k, text in zip(*(b.column(c).to_pylist() for c in (*keys, "piece"))):
                if k != now:
                    if state is not None:
                        rows.append((*now, state.hexdigest()))
                    now, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if rows:
                yield flush()
        if state is not None:
            rows.append((*now, state.hexdigest()))
            yield flush()

    order = [*keys, value]
    pieces = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, piece)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds if f.name != value) + f", `{out}` string"
    return pieces.repartition(*keys).sortWithinPartitions(*order).mapInArrow(digest, schema)
