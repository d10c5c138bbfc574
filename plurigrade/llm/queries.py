"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plurigrade.llm import additive_model, bpe, decontamination, grammar, pii, quality_rules, sharding, simhash, token_counts, warc
from plurigrade.llm.common import shared_dir


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_grammar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-shards")
    grammar.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path)
    return grammar.document_digests(spark, path)


def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op7_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return additive_model.scored(docs, additive_model.train(docs, table(spark, sf_dir, "labels")))


def op8_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_merge_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The ten operators' queries and the pipeline."""
    import corpus_pipeline

    own = (op1_slot_sharding, op2_skip_chain_pii, op3_warc_transactions, op4_benchmark_decontamination, op5_grammar_shards, op6_forced_boundary_bpe, op7_additive_quality, op8_anchor_simhash, op9_merge_token_counts, op10_quality_rules)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def _crc_table() -> str:
    """The 256 values of the reflected CRC-32 polynomial, as an SQL list."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return f"CAST({out} AS BIGINT[])"


def _op1(shards: int = 8) -> str:
    loads = f"CAST({[0] * shards} AS BIGINT[])"
    return f"""
WITH RECURSIVE h AS (
  SELECT doc_id, CAST(strlen(COALESCE(text, '')) + 1 AS BIGINT) AS size, md5(COALESCE(text, '')) AS digest, hex(encode(COALESCE(text, ''))) AS x FROM documents
), c AS (
  SELECT doc_id, size, digest, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(size - 1), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, ({_crc_table()})[(xor(a, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM h
), u AS (
  SELECT doc_id, size, digest, text_crc32, COUNT(*) AS copies FROM c GROUP BY ALL
), cap AS (
  SELECT CAST(ceil(SUM(size * copies) / CAST({sharding.HOT * shards} AS DOUBLE)) AS BIGINT) AS most FROM u
), hot AS (
  SELECT digest, CAST(ceil(SUM(size * copies) * {sharding.HOT} / CAST(MAX(most) AS DOUBLE)) AS BIGINT) AS parts, CAST(GREATEST(floor(MAX(most) / CAST({sharding.FINE} AS DOUBLE) / MAX(size)), 1) AS BIGINT) AS each
  FROM u, cap GROUP BY digest HAVING SUM(size * copies) > MAX(most)
), cut AS (
  SELECT doc_id, size, digest, text_crc32, copies, parts, each, UNNEST(range(COALESCE((copies - 1) // each, 0) + 1)) AS piece FROM u LEFT JOIN hot USING (digest)
), named AS (
  SELECT doc_id, size, digest, text_crc32, piece, COALESCE(LEAST(each, copies - piece * each), copies) AS copies, COALESCE(CAST(doc_id AS VARCHAR), 'null') || ':' || piece AS own, parts FROM cut
), r AS (
  SELECT doc_id, size, digest, text_crc32, piece, copies, CAST('0x' || substr(md5(own || ':' || digest), 1, 8) AS BIGINT) % {sharding.LANES} AS lane,
    CAST('0x' || substr(CASE WHEN parts IS NULL THEN digest ELSE md5(digest || ':' || CAST('0x' || substr(md5(own), 1, 8) AS BIGINT) % parts) END, 1, 8) AS BIGINT) % {sharding.SLOTS} AS virtual_slot FROM named
), sizes AS (
  SELECT v.range AS virtual_slot, CAST(COALESCE(SUM(size * copies), 0) AS BIGINT) AS bytes, COALESCE(SUM(copies), 0) AS n FROM range({sharding.SLOTS}) v LEFT JOIN r ON r.virtual_slot = v.range GROUP BY 1
), line AS MATERIALIZED (
  SELECT *, virtual_slot % {shards} AS home, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS k, CAST(ceil(SUM(bytes) OVER () / CAST({shards} AS DOUBLE)) AS BIGINT) AS share FROM sizes
), fold AS (
  SELECT CAST(0 AS BIGINT) AS k, {loads} AS loads, CAST(-1 AS BIGINT) AS shard
  UNION ALL
  SELECT z.k, list_transform(range({shards}), lambda i: z.loads[i + 1] + CASE WHEN i = z.shard THEN z.bytes ELSE 0 END), z.shard
  FROM (SELECT line.k, line.bytes, fold.loads, CASE WHEN bytes = 0 OR fold.loads[home + 1] + bytes <= share THEN home ELSE list_position(fold.loads, list_min(fold.loads)) - 1 END AS shard FROM fold JOIN line ON line.k = fold.k + 1) z
), placed AS (
  SELECT virtual_slot, CAST(shard AS INTEGER) AS shard, SUM(n) OVER (PARTITION BY shard ORDER BY virtual_slot) - n AS offset_ FROM line JOIN fold USING (k)
), numbered AS (
  SELECT *, CAST(offset_ + SUM(copies) OVER (PARTITION BY virtual_slot ORDER BY lane, doc_id NULLS LAST, digest, piece) - copies AS BIGINT) AS before FROM r JOIN placed USING (virtual_slot)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, UNNEST(range(before, before + CAST(copies AS BIGINT))) AS slot, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot, 1 AS map_version FROM numbered
"""


_OP3 = """
WITH p AS (
  SELECT page_id, COALESCE(url, '') AS url, sha256(COALESCE(html, '')) AS digest, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS n FROM pages
), f AS (
  SELECT digest, MIN(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest HAVING COUNT(*) > 1
)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to,
  p.url AS target_uri, p.url AS request_target
FROM p LEFT JOIN f USING (digest)
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_OP4 = f"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, list_slice(w, i, i + 7) AS win FROM (SELECT item, w, UNNEST(range(1, GREATEST(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), sizes AS (
  SELECT DISTINCT len(win) AS n FROM bw
), dw AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT doc_id, w, n, UNNEST(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (
  SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw USING (win)
), hit AS (
  SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, UNNEST(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), items AS (
  SELECT doc_id, COUNT(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op10() -> str:
    white = r"[\x20\x09-\x0D]+"
    stops = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS.split())))

    def holds(r: quality_rules.Rule) -> str:
        ratio = f"COALESCE(CAST({r.numerator} AS DOUBLE) / NULLIF({r.denominator}, 0), 0)"
        return f"{ratio} >= {r.low}" + (f" AND {ratio} <= {r.high}" if r.high < float("inf") else "")

    return f"""
WITH s AS (
  SELECT doc_id, COALESCE(text, '') AS t, list_filter(regexp_split_to_array(COALESCE(text, ''), '{white}'), lambda w: w <> '') AS w,
    list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
), win AS (
  SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 3)
), again AS (
  SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING COUNT(*) > 1
), covered AS (
  SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, UNNEST(range(i, i + 3)) AS p FROM win JOIN again USING (doc_id, g)) GROUP BY doc_id
), m AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(COALESCE(covered.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
    length(t) - length(translate(t, '!', '')) AS n_exclamations, len(l) AS n_lines
  FROM s LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(map(holds, quality_rules.RULES))} AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""
    import corpus_pipeline

    own = {"op1_slot_sharding": _op1(), "op3_warc_transactions": _OP3, "op4_benchmark_decontamination": _OP4, "op10_quality_rules": _op10()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
