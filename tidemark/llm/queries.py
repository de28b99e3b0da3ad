"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, cotrain, licenses, manifest, mixing, packing, sharding, simhash, substring, tokens, topk, toxicity, whitening
from tidemark.llm.common import table
from tidemark.llm.vectors import usable


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), shingle=5, containment=0.8)


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, mixing.token_count(F.col("text")), target_entropy=0.97, max_epochs=4.0, tie_by=["doc_id"])
    return mixed.select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_weight", "mix_position")


def op3_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Before they are quantised: of repeated ids the greatest vector as given stands.
    finite = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero_too=True)
    vectors = finite.select(F.col("id").alias("vec_id"), topk.quantise(F.col("v"), 1024).alias("embedding"))
    return topk.search(vectors, F.col("id") % 100 == 0, k=10)


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, with_ids=False)
    return packing.pack(pieces, max_tokens=4096)


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    # What is left keeps its white space; the digest has one space between words.
    spaced = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(spaced, 256).alias("kept_sha256"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, seed=42, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=32, scale=64)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered=tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_temperature_mixing": op2_temperature_mixing,
    "op3_bounded_ring": op3_bounded_ring,
    "op4_toxicity": op4_toxicity,
    "op5_exact_topk": op5_exact_topk,
    "op6_sum_of_squares_packing": op6_sum_of_squares_packing,
    "op7_fm_index": op7_fm_index,
    "op8_cotraining": op8_cotraining,
    "op9_simhash": op9_simhash,
    "op10_kmeans_tree": op10_kmeans_tree,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op7_fm_index": """
        WITH words AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13),
        windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS x FROM places),
        first AS (SELECT x, min(doc_id) AS d FROM windows GROUP BY x),
        gone AS (
          SELECT DISTINCT windows.doc_id, unnest(range(i, i + 13)) AS i
          FROM windows JOIN first USING (x) WHERE first.d < windows.doc_id),
        per_doc AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
        SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
          sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
            ELSE coalesce(array_to_string(list_filter(w, lambda x, k: NOT list_contains(gone, k)), ' '), '') END) AS kept_sha256
        FROM words LEFT JOIN per_doc ON words.doc_id = per_doc.doc_id
    """,
    "op5_exact_topk": """
        WITH kept AS (
          SELECT vec_id AS id, max(embedding) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          GROUP BY vec_id),
        whole AS (SELECT id, list_transform(v, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM kept),
        scored AS (
          SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM whole q JOIN whole c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE rows AS (
          SELECT doc_id, source, text,
            concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
            xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 1 + strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
              lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS crc
          FROM documents),
        hashed AS (
          SELECT doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
            CASE WHEN crc % 5 = 0 THEN sha256(concat(head, coalesce(strlen(lowered) || ':' || lowered, '-'))) END AS changed
          FROM rows),
        leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM hashed),
        nodes AS (
          SELECT 0 AS level, source, idx, n, leaf AS h FROM leaves
          UNION ALL SELECT level + 1, source, idx // 16, CAST(ceil(n / 16.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, source, idx // 16, n),
        tops AS MATERIALIZED (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
        upper AS (
          SELECT 0 AS level, idx, n, h FROM tops
          UNION ALL SELECT level + 1, idx // 16, CAST(ceil(n / 16.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, idx // 16, n),
        steps AS (
          SELECT level, source, idx, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS s
          FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY level, source, idx // 16 ORDER BY idx)),
        upper_steps AS (
          SELECT level, idx, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS s
          FROM upper WHERE n > 1 WINDOW w AS (PARTITION BY level, idx // 16 ORDER BY idx)),
        own AS (
          SELECT l.source, l.idx, list(s ORDER BY level) AS steps
          FROM leaves l JOIN steps ON steps.source IS NOT DISTINCT FROM l.source AND steps.idx = l.idx >> (4 * level) GROUP BY l.source, l.idx),
        above AS (
          SELECT t.source, list(s ORDER BY level) AS steps FROM tops t JOIN upper_steps u ON u.idx = t.idx >> (4 * level) GROUP BY t.source),
        whole AS (
          SELECT l.doc_id, l.leaf, coalesce(l.changed, l.leaf) AS start, t.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root,
            list_concat(coalesce(own.steps, CAST([] AS VARCHAR[])), coalesce(above.steps, CAST([] AS VARCHAR[]))) AS steps
          FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source
          LEFT JOIN own ON own.source IS NOT DISTINCT FROM l.source AND own.idx = l.idx LEFT JOIN above ON above.source IS NOT DISTINCT FROM l.source),
        folded AS (
          SELECT *, list_reduce(list_prepend(start, steps), lambda a, s: sha256(concat(split_part(s, '|', 1), a, split_part(s, '|', 2)))) AS folded_root,
            sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256 FROM whole)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
    """,
}
