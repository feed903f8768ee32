"""One query a dealt operator, over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.chat import digests, format_conversations
from gaugeframe.llm.chosen_path import near_duplicates
from gaugeframe.llm.common import shared_folder
from gaugeframe.llm.decontaminate import find_passages
from gaugeframe.llm.hard_negatives import mine_negatives
from gaugeframe.llm.hilbert import shard_documents
from gaugeframe.llm.packing import cut_documents, pack, widen_ids
from gaugeframe.llm.prefix_trie import KEY, digest_turns, graft, list_digests, prefix_trie
from gaugeframe.llm.quality import score_quality, train
from gaugeframe.llm.suffix_dedup import remove_repeats
from gaugeframe.llm.token_counts import count_tokens
from gaugeframe.llm.token_files import read_digests, write_token_files
from gaugeframe.llm.topk import top_k
from gaugeframe.llm.warc import read_records, write_archives
from gaugeframe.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts through a cache that begins empty with each call, so that every distinct text is encoded."""
    return count_tokens(table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"), shared_folder(spark, "token-cache"), 4096)


@query()
def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    index = write_token_files(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), shared_folder(spark, "token-files"), length=2048, end_id=0)
    return read_digests(index)


@query()
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """The ids are packed; their digest is taken from the packed rows."""
    pieces = cut_documents(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=1, keep_ids=True, narrow=True)
    return widen_ids(pack(pieces.drop("ids_crc32"))).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, grams.n, i, item FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
counted AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = find_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=10)
    names = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@query(r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
""")
def op4_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


@query()
def op6_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(table(spark, sf, "documents"), shards=24)


@query(r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(regexp_replace(regexp_replace(text, '<([/\\])', '<\\\1', 'g'), '\[([I/\\])', '[\\\1', 'g'))
  + length(regexp_replace(regexp_replace(role, '<([/\\])', '<\\\1', 'g'), '\[([I/\\])', '[\\\1', 'g')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + 19) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""")
def op10_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marked), (-1, 1, "assistant", marked)], turns.schema)
    return digests(format_conversations(turns.unionByName(extra)))


@query()
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return score_quality(docs, train(docs, table(spark, sf, "labels")))


@query(f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
near AS (SELECT x, y, c, p.n AS nx, q.n AS ny FROM links JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c * 10 >= 8 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, n.y FROM reach r JOIN near n ON n.x = r.y),
classes AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x)
SELECT doc_id, class_id, (SELECT count(*) FROM near WHERE x = doc_id) AS n_links,
  (SELECT least(doc_id, coalesce(min(y), doc_id)) FROM near WHERE x = doc_id AND c = nx AND c = ny) AS set_id,
  1 + (SELECT count(*) FROM near WHERE x = doc_id AND c = nx AND c = ny) AS n_copies
FROM documents JOIN classes ON x = doc_id
""".replace("WITH d", "WITH RECURSIVE d"))
def op8_chosen_path_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), size=5, threshold=0.8).select("doc_id", "class_id", "n_links", "set_id", "n_copies")


@query()
def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    # passages of over 50 words are only counted: what is removed are strings of 400 bytes
    cut = remove_repeats(table(spark, sf, "documents"), length=400, words=51, cut_passages=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"), "n_passages")


@query("""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
top AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM top
""")
def op11_warc(spark: SparkSession, sf: str) -> DataFrame:
    index = write_archives(table(spark, sf, "pages"), shared_folder(spark, "archives"), least=1000)
    return read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: CRC-32 of a text of ASCII characters, bit by bit
CRC32 = """xor(list_reduce(list_transform(range(1, length(c) + 1), lambda i: CAST(ascii(c[i:i]) AS BIGINT)), lambda crc, byte:
  list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)), 4294967295), 4294967295)"""


@query(f"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, {CRC32} % 6 AS h FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS c FROM ids)),
own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t FROM conversations GROUP BY conv_id),
rebuilt AS (SELECT h.conv_id, coalesce(b.t[1:h.h], []) || coalesce(own.t[h.h + 1:], []) AS t
            FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100 LEFT JOIN own ON own.conv_id = h.conv_id),
prefixes AS (SELECT conv_id, d, t[1:d] AS p, len(t) = d AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS names
          FROM prefixes GROUP BY d, p),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.p[1:n.d] = n.p) AS n_children, CASE WHEN d = 0 THEN 0 ELSE length(p[d].text) END AS size FROM nodes n),
sums AS (SELECT n.d, n.p, count(*) FILTER (m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.size) AS BIGINT) AS saved
         FROM counted n JOIN counted m ON m.d >= n.d AND m.p[1:n.d] = n.p GROUP BY n.d, n.p)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved AS saved_tokens, sha256(n.names) AS ends_sha256
FROM counted n JOIN sums s ON s.d = n.d AND s.p = n.p LEFT JOIN counted u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1] AND n.d > 0
""")
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    nodes, ends = prefix_trie(*graft(digest_turns(table(spark, sf, "conversations"))))
    digests_of = list_digests(ends, KEY, "conv_id", "ends_sha256")
    ended = nodes.join(digests_of, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query(r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""")
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """One label in seven is first replaced by the next, as mislabelled rows would be."""
    vectors = table(spark, sf, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.withColumn("label", noisy), every=100, k_positives=5, k_negatives=5)
