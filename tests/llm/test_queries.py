"""The registered queries: columns and types of each, over a whole small folder."""

import pytest

from partsmith.llm import queries

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_voronoi_knn": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op3_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_secrets_crf": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_pitman_yor": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_line_chunks": "doc_id bigint, text string, n_removed bigint, removed_bytes bigint",
    "op9_decontamination": "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint",
    "op10_kd_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11_html_templates": "page_id bigint, url string, text string, n_chars bigint",
    "op12_va_clusters": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13_anchor_tree": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    found = queries.queries()[name](spark, SF)
    types = dict(found.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert types[c] == kind, (c, types[c])
    n = found.count()
    table = {"op11_html_templates": "pages", "op12_va_clusters": "embeddings"}.get(name, "documents")
    if name not in ("op2_voronoi_knn", "op9_decontamination", "op13_anchor_tree"):
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        assert n > 0
