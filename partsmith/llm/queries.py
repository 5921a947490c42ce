"""The registered corpus queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from partsmith.llm import (anchor_tree, byte_bpe, decontamination, html_templates, kd_shards, line_chunks, minhash, pitman_yor, secrets_crf, token_files,
                           toxicity, va_clusters, voronoi_knn)
from partsmith.session import stage

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.labelled_rows(docs, _read(spark, sf_dir, "labels")))
    return toxicity.score(docs.withColumn("held_out", toxicity.held_out()), model).selectExpr(
        "doc_id", "held_out", "toxic_score score", "toxic_predicted predicted")


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voronoi_knn.floored(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = stage(rows, "floored")
    return voronoi_knn.top_k(rows.filter("vec_id % 20 = 0"), rows, 20)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"), WORD_BPE)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_read(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), 2).select("doc_id", "n_shingles", "component_id", "kept")


def op6_secrets_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets_crf.report(secrets_crf.find(docs, secrets_crf.train(docs)))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score(docs, pitman_yor.fit(docs))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(_read(spark, sf_dir, "documents"))


def op11_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract(_read(spark, sf_dir, "pages"))


def op12_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = va_clusters.whole_numbers(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 64)
    return va_clusters.cluster(rows, 64, 16, 3)


def op13_anchor_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anchor_tree.whole_rows(_read(spark, sf_dir, "embeddings"), 256)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return anchor_tree.mine(rows.withColumn("label", label), 100, 5, 10, 30, 90)


def _lloyd_sql(rounds: int) -> str:
    """DuckDB SQL of the clustering: assignment a0, centroids c1, assignment a1 and so on."""
    near = """(SELECT vec_id, c, distance FROM (SELECT v.vec_id, v.z, c.c,
        CAST(list_dot_product(v.z, v.z) - 2 * list_dot_product(v.z, c.z) + list_dot_product(c.z, c.z) AS BIGINT) AS distance,
        row_number() OVER (PARTITION BY v.vec_id ORDER BY list_dot_product(c.z, c.z) - 2 * list_dot_product(v.z, c.z), c.c) AS r
        FROM v CROSS JOIN c{i} c) WHERE r = 1)"""
    steps = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS z FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS c, z
            FROM v ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) LIMIT 16)"""]
    for i in range(rounds):
        steps += [f"a{i} AS MATERIALIZED {near.format(i=i)}",
                  f"""m{i} AS (SELECT c, list(x ORDER BY d) AS z FROM (SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS DOUBLE) AS x FROM (
            SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                SELECT a.c, unnest(v.z) AS x, generate_subscripts(v.z, 1) AS d FROM v JOIN a{i} a USING (vec_id)) GROUP BY c, d)) GROUP BY c)""",
                  f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.z, c.z) AS z FROM c{i} c LEFT JOIN m{i} m USING (c))"]
    steps.append(f"a{rounds} AS MATERIALIZED {near.format(i=rounds)}")
    return f"""WITH {", ".join(steps)}
        SELECT a.vec_id, a.c AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(c.z, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c USING (c)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_voronoi_knn": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS z FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.z, d.z) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
    "op5_minhash": f"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
            ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS g FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS MATERIALIZED (SELECT u, v FROM shared JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v
            WHERE 100 * c >= 80 * (nu.n + nv.n - c)),
        e AS MATERIALIZED (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
        reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.v FROM reach r JOIN e ON r.b = e.u),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
        FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id""",
    "op12_va_clusters": _lloyd_sql(3),
    "op13_anchor_tree": """
        WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, CAST(list_dot_product(a.z, d.z) AS BIGINT) AS score
            FROM r a JOIN r d ON a.vec_id % 100 = 0 AND a.vec_id <> d.vec_id),
        p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k
            FROM s WHERE same) WHERE k <= 5),
        n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS k
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_voronoi_knn, op3_token_files, op4_byte_bpe, op5_minhash, op6_secrets_crf, op7_pitman_yor, op8_line_chunks, op9_decontamination, op10_kd_shards,
                                   op11_html_templates, op12_va_clusters, op13_anchor_tree)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
