"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shoebox.llm import alignment, collocations, decontaminate, hamming_topk, language_id, line_dedup, mixing, packing, sharding, simhash_dedup, substring_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_md5")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk.top_k_vectors(_table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.page_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_substring_dedup,
    op2_token_counts,
    op3_decontaminate,
    op4_mixing,
    op5_toxicity,
    op6_sharding,
    op7_hamming_topk,
    op8_line_dedup,
    op9_simhash_dedup,
    op10_language_id,
    op11_alignment,
    op12_packing,
    op13_collocations,
)}
ORACLES: dict[str, str] = {
    "op8_line_dedup": """
        WITH line AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
        ), sets AS (
          SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'))) AS s FROM line
        ), numbered AS (
          SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS pos FROM sets
        ), firsts AS (
          SELECT s, min(pos) AS pos, len(s) AS n FROM numbered WHERE len(s) > 0 GROUP BY s
        ), tokens AS (
          SELECT pos, n, unnest(s) AS token FROM firsts
        ), rare AS (
          SELECT token, count(*) AS df FROM tokens GROUP BY token
        ), prefix AS (
          SELECT pos, n, token FROM tokens JOIN rare USING (token)
          QUALIFY row_number() OVER (PARTITION BY pos ORDER BY df, token) <= n - ceil(n * 4 / 5.0) + 1
        ), pairs AS (
          SELECT DISTINCT a.pos AS earlier, b.pos AS later FROM prefix a JOIN prefix b ON a.token = b.token AND a.pos < b.pos AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
        ), near AS (
          SELECT DISTINCT later AS pos FROM pairs JOIN firsts a ON a.pos = earlier JOIN firsts b ON b.pos = later
          WHERE len(list_intersect(a.s, b.s)) * 9 >= (a.n + b.n) * 4
        )
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (WHERE numbered.pos <> firsts.pos) AS n_exact,
               count(*) FILTER (WHERE numbered.pos = firsts.pos AND near.pos IS NOT NULL) AS n_near,
               coalesce(list_sort(list(line_no::INTEGER) FILTER (WHERE numbered.pos <> firsts.pos OR near.pos IS NOT NULL)), []) AS removed
        FROM numbered LEFT JOIN firsts ON numbered.s = firsts.s AND len(numbered.s) > 0 LEFT JOIN near ON firsts.pos = near.pos
        GROUP BY doc_id""",

    "op13_collocations": """
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
        ), words AS (
          SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
        ), places AS (
          SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k
        ), grams AS (
          SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL
        ), total AS (
          SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
        ), often AS (
          SELECT * FROM grams WHERE f >= 100
        ), longer AS (
          SELECT lang, f, ' ' || phrase || ' ' AS held, k FROM often WHERE k > 2
        ), candidates AS (
          SELECT * FROM often c WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM longer y WHERE y.lang = c.lang AND y.f = c.f AND y.k > c.k AND contains(y.held, ' ' || c.phrase || ' '))
        ), cuts AS (
          SELECT lang, phrase, f AS a, k, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM candidates
        ), scored AS (
          SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
          FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ') JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 : len(c.w)], ' ') JOIN total t ON t.lang = c.lang
          QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM scored
        QUALIFY rank <= 2000""",

    "op7_hamming_topk": """
        WITH bits AS (
          SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)::INTEGER) ELSE 0 END))::UBIGINT AS code
          FROM embeddings
        ), ranked AS (
          SELECT q.vec_id AS query_id, d.vec_id AS neighbor_id, bit_count(xor(q.code, d.code))::INTEGER AS distance,
                 row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, d.code)), d.vec_id)::INTEGER AS rank
          FROM bits q JOIN bits d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
        )
        SELECT query_id, neighbor_id, distance, rank FROM ranked WHERE rank <= 10""",
}
