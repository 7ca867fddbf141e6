"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm import align, ann, bpe, chat, mih, mixing, ppm, shards, simhash, suffix, toxicity, tries, urls
from lendlens.llm.common import importable, table
from lendlens.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SHARDS = 40

URL_RULES = [
    urls.Rule("allow", "com/"),
    urls.Rule("block", "example.com/en/"),
    urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"),
    urls.Rule("block", "net/fr/"),
]


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = lambda spark, folder: function(importable(tune(spark)), folder)
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_binary_topk", """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0 AND isfinite(x)) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id,
    CAST(len(list_filter(range(1, greatest(len(q.bits), len(r.bits)) + 1), lambda i: coalesce(q.bits[i], false) <> coalesce(r.bits[i], false))) AS INTEGER) AS distance
  FROM codes q, codes r WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM pairs
)
SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").where("embedding IS NOT NULL")
    codes = vectors.select(F.col("vec_id").alias("id"), mih.sign_code(F.col("embedding")).alias("code"))
    asked = codes.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return mih.top_k(codes, asked, k=10)


@register("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op3_bpe")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    done = bpe.encode(table(spark, folder, "documents"), tokenizer_path(), decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op4_shards")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    placed = shards.shard_rows(docs, [F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("text_hash")], SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@register("op5_chat")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id int, turn int, role string, text string")
    added = added.select(*[F.col(c).cast(kind).alias(c) for c, kind in turns.dtypes])
    done = chat.read_back(chat.format_conversations(turns.union(added)))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@register("op6_mixing", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
), c AS (
  SELECT source, source_size, [3, 1, 2][CAST((r - 1) % 3 AS INTEGER) + 1] AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM t
), s AS (
  SELECT *, cap / weight AS ratio FROM c
), steps AS (
  SELECT ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - 2.0::DOUBLE * (SELECT coalesce(sum(source_size), 0) FROM s x WHERE x.ratio < s.ratio))
    / ((SELECT sum(weight) FROM s) - (SELECT coalesce(sum(weight), 0) FROM s x WHERE x.ratio < s.ratio)) AS level
  FROM s
), l AS (
  SELECT arg_min(level, ratio) AS level FROM steps WHERE level <= ratio
), targets AS (
  SELECT source, source_size, CASE WHEN l.level IS NULL THEN cap ELSE least(weight * l.level, cap) END AS target,
    CAST('0x' || substr(md5('17:' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start
  FROM s, l
), placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.start,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS i
  FROM d JOIN targets g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(floor(i * rate + start) - floor((i - 1) * rate + start) AS BIGINT) * size AS taken
FROM placed
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


@register("op7_ann")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return ann.nearest(vectors, asked, k=20)


@register("op8_url_rules", """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS place FROM pages
), r AS (
  SELECT page_id, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM r
), p AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM h
), f AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM f
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@register("op9_suffix_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@register("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@register("op11_prefix_trie", """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS seq FROM turns GROUP BY conv_id
), heads AS (
  -- the bytes of the decimal number go through the bitwise CRC-32
  SELECT conv_id, seq, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
      lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h
  FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.seq[1:a.h], []), a.seq[a.h + 1:]) AS seq
  FROM heads a LEFT JOIN heads b ON b.conv_id = a.conv_id - a.conv_id % 5
), prefixes AS (
  SELECT conv_id, len(seq) AS total, seq[1:d] AS seq, d AS depth FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, seq, min(conv_id) AS conv_id, count(*) AS n_convs, max(total) AS deepest,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE total = depth), '') AS ends
  FROM prefixes GROUP BY depth, seq
), weights AS (
  SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(seq[depth].text)) ELSE 0 END AS saved FROM nodes
), below AS (
  SELECT a.depth, a.conv_id, sum(CASE WHEN b.deepest = b.depth THEN 1 ELSE 0 END) AS n_leaves, sum(b.saved) AS saved_tokens,
    sum(CASE WHEN b.depth = a.depth + 1 THEN 1 ELSE 0 END) AS n_children
  FROM weights a JOIN weights b ON b.depth >= a.depth AND b.seq[1:a.depth] = a.seq GROUP BY a.depth, a.conv_id
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below USING (depth, conv_id) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.seq = n.seq[1:n.depth - 1]
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return tries.prefix_trie(
        table(spark, folder, "conversations"), base=lambda c: c - c % 5, head=lambda c: F.crc32(c.cast("string")) % 9, most=8
    )


@register("op12_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    documents, _ = align.align(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return documents


@register("op13_language")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = ppm.train(docs.where(~ppm.held_out(F.col("doc_id"))))
    found = ppm.predict(docs, model)
    return found.select("doc_id", ppm.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
