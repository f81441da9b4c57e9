"""The package's queries by name. Each reads whole tables and shows an operator's result in digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runpulse.llm import (
    alignment, collocations, language_id, licenses, mixing, packing, quality, sharding, simhash, token_orc, topk_search,
    toxicity, url_filter,
)
from runpulse.llm.common import pick, store, table
from runpulse.session import scratch_path

#: The id that ends a document in both token queries.
END_ID = 2
#: Rules of the URL filter, fixed values.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, tokenizer, END_ID)
    return token_orc.token_digests(token_orc.read_token_orc(spark, path))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tokenizer = scratch_path(spark, "sequences"), public_tokenizers.path("byte_bpe_50k.json")
    made = packing.write_sequences(table(spark, sf_dir, "documents"), path, tokenizer, END_ID)
    return packing.piece_digests(made, packing.id_bytes(tokenizer))


def held_out() -> Column:
    """Every fifth document by checksum: never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs, ~held_out())
    return language_id.identify(docs, profiles).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    vectors = rows.select("vec_id", topk_search.quantized(F.col("embedding")).alias("vector"))
    return topk_search.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return shards.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    measured = quality.with_quality(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)
    return quality.judged(store(measured, "measured")).drop("lang")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.to_json("notices")).drop("notices")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.with_toxicity(docs, machine, keep_text=False)
    is_held_out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return scored.select("doc_id", is_held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(table(spark, sf_dir, "pages"), "page_id", "url")
    judged = url_filter.with_verdicts(pages, URL_RULES, url_filter.learn(pages, URL_RULES))
    return judged.drop("url")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment(table(spark, sf_dir, "documents"), a_path, b_path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_topk_search": op2_topk_search,
    "op3_token_orc": op3_token_orc,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_url_filter": op12_url_filter,
    "op13_alignment": op13_alignment,
}

ORACLE: dict[str, str] = {
    "op2_topk_search": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored QUALIFY rank <= 20
    """,
    "op6_sharding": """
        WITH bytes AS (
            SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                          lambda h: CAST('0x' || h AS BIGINT)) AS bytes
            FROM documents
        ), sized AS (
            SELECT doc_id, CAST(len(bytes) + 8 AS BIGINT) AS size,
                   xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda crc, byte:
                       list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                   lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS text_crc32
            FROM bytes
        ), summed AS (
            SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS to_here,
                   sum(size) OVER () AS total
            FROM sized
        ), dealt AS (
            SELECT *, CAST((2 * to_here - size) * 24 // (2 * total) AS INTEGER) AS shard FROM summed
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(NULL AS INTEGER) AS grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
        FROM dealt
    """,
    "op7_mixing": """
        WITH sized AS (
            SELECT doc_id, source, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM sized GROUP BY source
        ), lined AS (
            SELECT *, (1.5 * sum(source_size) OVER ()::DOUBLE
                       - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS FIRST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS FIRST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
            FROM sources
        ), aimed AS (
            SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target FROM lined
        ), placed AS (
            SELECT s.*, a.source_size, a.target, CAST(round(a.target) AS BIGINT) AS budget,
                   coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
                    + greatest(0, least(budget - budget // source_size * source_size - before, size)) END AS BIGINT) AS taken
        FROM placed
    """,
    "op11_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), listed AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), totals AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang
        ), placed AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed
        ), counted AS (
            SELECT lang, 1 AS size, w[i] AS phrase, count(*) AS f FROM placed GROUP BY ALL HAVING f >= 30
            UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1], count(*) AS f
            FROM placed WHERE i < len(w) GROUP BY ALL HAVING f >= 30
            UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], count(*) AS f
            FROM placed WHERE i + 1 < len(w) GROUP BY ALL HAVING f >= 30
            UNION ALL SELECT lang, 4, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3], count(*) AS f
            FROM placed WHERE i + 2 < len(w) GROUP BY ALL HAVING f >= 30
        ), parted AS (
            SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM counted
        ), scored AS (
            SELECT p.lang, p.size, p.phrase, p.words, p.f AS a, p.k, l.f AS l, r.f AS r,
                   CAST(2000000 AS HUGEINT) * p.f // (CAST(l.f AS HUGEINT) + r.f) AS score
            FROM parted p JOIN counted l ON l.lang = p.lang AND l.phrase = array_to_string(p.words[1 : k], ' ')
            JOIN counted r ON r.lang = p.lang AND r.phrase = array_to_string(p.words[k + 1 :], ' ')
            QUALIFY row_number() OVER (PARTITION BY p.lang, p.phrase ORDER BY score, k) = 1
        ), sides AS (
            SELECT lang, array_to_string(words[2 :], ' ') AS phrase, f AS lefts, 0 AS rights FROM parted WHERE size > 2 AND k = 1
            UNION ALL SELECT lang, array_to_string(words[: size - 1], ' '), 0, f FROM parted WHERE size > 2 AND k = 1
        ), longer AS (
            SELECT lang, phrase, CAST(max(lefts) AS BIGINT) AS left_most, CAST(max(rights) AS BIGINT) AS right_most
            FROM sides GROUP BY ALL
        ), kept AS (
            SELECT s.lang, s.phrase, a, l, r, CAST(score AS BIGINT) AS score,
                   coalesce(left_most, 0) AS left_most, coalesce(right_most, 0) AS right_most
            FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
            WHERE 100 * greatest(coalesce(left_most, 0), coalesce(right_most, 0)) < 80 * a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score, left_most, right_most
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
}
