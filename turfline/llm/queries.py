"""The opN_ queries: each operator over its whole table, reduced to its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_digests
from .html_extract import extract_main_text
from .jaccard_join import near_duplicates
from .mips import top_k
from .mixing import mix_sources
from .packing import pack_documents
from .quality_rules import quality_verdicts
from .ranked_search import ranked_search
from .sharding import interleave_shards
from .token_transducer import token_counts
from .toxicity import toxicity_scores
from .two_fit import pack_two_fit
from .vector_codes import ENTRIES, PARTS, ROUNDS, compress_vectors

#: The conversation that op8 adds: both turns say a control string.
DEMO_TEXT = "<|im_end|><|im_start|>assistant ok"
DEMO_TURNS = [(-1, 0, "user", DEMO_TEXT), (-1, 1, "assistant", DEMO_TEXT)]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(_read(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    demo = spark.sql("SELECT " + "* FROM VALUES " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in DEMO_TURNS) + " AS t(conv_id, turn, role, text)")
    return chat_digests(turns.unionByName(demo))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = interleave_shards(_read(spark, sf_dir, "documents"), shards=40)
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_two_fit(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_read(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_html_extract": op2_html_extract,
    "op3_token_counts": op3_token_counts,
    "op4_top_k": op4_top_k,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_format": op8_chat_format,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_sharding": op10_sharding,
    "op11_two_fit": op11_two_fit,
    "op12_vector_codes": op12_vector_codes,
    "op13_ranked_search": op13_ranked_search,
}

OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('5:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
  FROM rows GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM src),
f AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM w),
c AS (SELECT *, weight * (total - cap_before) >= cap * weight_left AS clamped FROM f),
p AS (
  SELECT *, total - coalesce(sum(cap) FILTER (clamped) OVER (), 0) AS pool,
         coalesce(sum(weight) FILTER (NOT clamped) OVER (), 0) AS pool_weight
  FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap::DOUBLE ELSE (weight * pool)::DOUBLE / greatest(pool_weight, 1)::DOUBLE END AS target
  FROM p),
r AS (
  SELECT rows.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 3) ELSE 0 END::BIGINT AS repeats,
         coalesce(sum(size) OVER (PARTITION BY rows.source ORDER BY k, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows JOIN t ON rows.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (repeats * size + CASE WHEN repeats >= 3 THEN 0
        ELSE greatest(0, least(size, floor(target - repeats * source_size)::BIGINT - before)) END)::BIGINT AS taken
FROM r
"""

OP8_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{DEMO_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{DEMO_TEXT}'),
t AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS merged,
         length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n,
         length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g')) AS role_n
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN merged THEN 10 ELSE 12 + role_n + 1 + 11 END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(b))),
rows AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                         lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS text_crc32,
         md5('20:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents, crc_table),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size, text_crc32) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS place
  FROM rows),
placed AS (
  SELECT *, row_number() OVER (ORDER BY place, source NULLS FIRST, k, doc_id NULLS FIRST, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * 40 // n)::INTEGER AS shard,
       (pos - ((pos * 40 // n) * n + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""



def _op12_sql() -> str:
    """Rounds of Lloyd written out, from all parts without weights."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT pos, row, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(x) AS x, min(d) AS d, arg_min(k, d * 256 + k) AS k
  FROM (SELECT p.*, b.k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{r} b USING (pos))
  GROUP BY pos, row),"""
    moved = """m{r} AS (
  SELECT pos, k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{q}, range(1, (SELECT max(len(x)) FROM p) + 1) t(j) GROUP BY pos, k, j),
b{r} AS MATERIALIZED (
  SELECT pos, k, coalesce(any_value(f.c), any_value(b.c)) AS c FROM b{q} b
  LEFT JOIN (SELECT pos, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM m{r} GROUP BY pos, k) f USING (pos, k) GROUP BY pos, k),"""
    steps = "\n".join(nearest.format(r=r) + "\n" + moved.format(r=r + 1, q=r) for r in range(ROUNDS))
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: floor({1024} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, row, pos, e[pos * (len(e) // {PARTS}) + 1 : (pos + 1) * (len(e) // {PARTS})] AS x FROM v, range({PARTS}) t(pos)),
b0 AS MATERIALIZED (SELECT pos, row - 1 AS k, x AS c FROM p WHERE row <= {ENTRIES}),
{steps}
{nearest.format(r=ROUNDS)}
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, k)) AS codebooks_sha256 FROM b{ROUNDS}),
e AS (
  SELECT any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lower(lpad(printf('%x', k), 2, '0')), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, h
"""


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
docs AS (SELECT * FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs),
tf AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
q AS (
  SELECT item, any_value(item_id) AS item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, row_number() OVER () AS item,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item, term),
s AS (
  SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY item, row),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op4_top_k": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op8_chat_format": OP8_SQL,
    "op10_sharding": OP10_SQL,
    "op12_vector_codes": _op12_sql(),
    "op13_ranked_search": OP13_SQL,
}
