"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimark.llm._common import shared_folder, table
from sedimark.llm.dual_tree import clustered
from sedimark.llm.exact_dedup import exact_groups
from sedimark.llm.language import predicted
from sedimark.llm.language import train as train_languages
from sedimark.llm.max_score import embedding_top_k
from sedimark.llm.merkle import tampered_proofs
from sedimark.llm.near_dedup import NearRules, near_components
from sedimark.llm.packing import pack
from sedimark.llm.piece_dropout import PIECE_BPE, round_trip
from sedimark.llm.quality import score_documents, train
from sedimark.llm.secret_scan import scan
from sedimark.llm.sharding import shard_rows
from sedimark.llm.token_store import read_tokens, write_tokens
from sedimark.llm.word_tokens import tokenizer_path
from sedimark.llm.zip_archives import archive


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), shared_folder(spark), tokenizer_path(), end_id=2))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_top_k(table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op7_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), NearRules(shingle=3, percent=85, bands=32, rows=8))


def op10_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, train_languages(docs))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_proofs(table(spark, sf_dir, "documents"))


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_token_store, op3_exact_dedup, op4_top_k_search, op5_sharding, op6_packing, op7_piece_dropout, op8_quality, op9_near_dedup, op10_zip_archives, op11_language, op12_merkle, op13_dual_tree)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256)""",
        "op4_top_k_search": """
            WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS codes
                       FROM embeddings
                       WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                         AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
            pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
                             CAST(list_inner_product(CAST(q.codes AS DOUBLE[]), CAST(c.codes AS DOUBLE[])) AS BIGINT) AS score
                      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs)
            SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5""",
        "op10_zip_archives": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
            n AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
            FROM n""",
        "op12_merkle": """
            WITH RECURSIVE crc_table AS (
                SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
            d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS id, doc_id, source, lang, n_chars, text,
                         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
                                         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc
                  FROM documents, crc_table),
            parts AS (SELECT id, doc_id, source,
                             coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                             coalesce(strlen(text) || ':' || text, '-') AS body,
                             CASE WHEN crc % 5 = 0 THEN coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')
                                  ELSE coalesce(strlen(text) || ':' || text, '-') END AS tampered FROM d),
            leaves AS (SELECT id, doc_id, coalesce('=' || source, '') AS grp, sha256(head || body) AS leaf, sha256(head || tampered) AS bad,
                              row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS pos,
                              count(*) OVER (PARTITION BY source) AS n FROM parts),
            tree AS (SELECT grp, 0 AS lv, pos, n, leaf AS digest FROM leaves
                     UNION ALL
                     SELECT grp, lv + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, lv, pos // 16, n),
            subroots AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
            crown AS (SELECT 0 AS lv, pos, n, subroot AS digest FROM subroots
                      UNION ALL
                      SELECT lv + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY lv, pos // 16, n),
            sides AS (SELECT a.grp, a.lv, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
                             coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
                      FROM tree a JOIN tree b ON a.grp = b.grp AND a.lv = b.lv AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.grp, a.lv, a.pos),
            crown_sides AS (SELECT a.lv, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
                                   coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
                            FROM crown a JOIN crown b ON a.lv = b.lv AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.lv, a.pos),
            steps AS (SELECT v.id, s.lv, s.l, s.r FROM leaves v JOIN sides s ON s.grp = v.grp AND s.pos = v.pos // CAST(16 ** s.lv AS BIGINT)
                      UNION ALL
                      SELECT v.id, 100 + s.lv, s.l, s.r FROM leaves v JOIN subroots g ON g.grp = v.grp JOIN crown_sides s ON s.pos = g.pos // CAST(16 ** s.lv AS BIGINT)),
            proofs AS (SELECT id, string_agg(l || r, '' ORDER BY lv) AS proof, list({'l': l, 'r': r} ORDER BY lv) AS path FROM steps GROUP BY id),
            climb AS (SELECT v.id, 0 AS k, v.bad AS digest, coalesce(p.path, []) AS path FROM leaves v LEFT JOIN proofs p ON p.id = v.id
                      UNION ALL
                      SELECT id, k + 1, sha256(path[k + 1].l || digest || path[k + 1].r), path FROM climb WHERE k < len(path)),
            top AS (SELECT digest AS root FROM crown WHERE n = 1)
            SELECT v.doc_id, v.leaf, g.subroot, top.root, sha256(coalesce(p.proof, '')) AS proof_sha256, c.digest AS folded_root, c.digest = top.root AS verified
            FROM leaves v JOIN subroots g ON g.grp = v.grp LEFT JOIN proofs p ON p.id = v.id JOIN climb c ON c.id = v.id AND c.k = len(c.path), top""",
        "op13_dual_tree": _lloyd_sql(16, 3, 64),
    }


def _lloyd_sql(k: int, rounds: int, width: int) -> str:
    """Lloyd's rounds by all pairs of vectors and centroids, of integers that a double holds."""
    dot = lambda a, b: f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    parts = [f"""
            WITH v AS (SELECT row_number() OVER () AS row, vec_id, [CAST(floor({width} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS codes FROM embeddings
                       WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
            c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), codes) - 1 AS cluster, codes FROM v QUALIFY cluster < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
            a{r} AS (SELECT v.row, v.vec_id, v.codes, c.cluster, CAST({dot("v.codes", "v.codes")} - 2 * {dot("v.codes", "c.codes")} + {dot("c.codes", "c.codes")} AS BIGINT) AS distance
                     FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY distance, c.cluster) = 1)""")
        if r < rounds:
            parts.append(f"""
            m{r} AS (SELECT cluster, d, CAST(floor(CAST(sum(codes[d]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{r}, range(1, {width + 1}) t(d) GROUP BY cluster, d),
            n{r} AS (SELECT cluster, list(x ORDER BY d) AS codes FROM m{r} GROUP BY cluster),
            c{r + 1} AS (SELECT c.cluster, coalesce(n.codes, c.codes) AS codes FROM c{r} c LEFT JOIN n{r} n ON n.cluster = c.cluster)""")
    return ",".join(parts) + f"""
            SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
                   CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.codes, ',')) AS centroid_sha256
            FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""
