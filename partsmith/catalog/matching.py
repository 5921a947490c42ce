"""Queries over the matcher's stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.tables import Tables
from partsmith.operators import ingest, matcher as M


def parts(t: Tables) -> M.MatchParts:
    if "match_parts" not in t._made:
        signals = ingest.match_signals(ingest.parsed_rows(t["raw_rows"], t["raw_header"]))
        t._made["match_parts"] = M.match_parts(signals, t["taxonomy"], t["synonyms"])
    return t._made["match_parts"]


def outcome(t: Tables):
    return t.keep("outcome", lambda: parts(t).outcome)


def per_row(t: Tables, df):
    """Signature-level results shown per row."""
    return parts(t).rows.select("row_id", "sig_id").join(df, "sig_id").drop("sig_id")


@query("mt_descendants", "SELECT ancestor_id, l3_id, hops FROM closure")
def _(t):
    return M.descendants(t["taxonomy"]).select("ancestor_id", "l3_id", "hops")


@query("mt_synonym", "SELECT s.row_id, n.category_id, 'SYNONYM' AS source, 0.95::DOUBLE AS confidence FROM sig s JOIN syn_name n USING (name_norm)")
def _(t):
    p = parts(t)
    return p.prepared.join(p.synonym, "name_norm").select(
        "row_id", "category_id", F.lit("SYNONYM").alias("source"), F.lit(M.SYNONYM_CONFIDENCE).alias("confidence"))


@query("mt_ancestors", "SELECT s.row_id, a.ancestor_id, a.score FROM sig s JOIN anc_score a ON a.name_norm IS NOT DISTINCT FROM s.name_norm AND a.code_norm IS NOT DISTINCT FROM s.code_norm")
def _(t):
    p = parts(t)
    rows = p.prepared.select("row_id", "name_norm", "code_norm")
    hits = rows.join(p.name_anc, "name_norm").select("row_id", "ancestor_id", "score").unionByName(
        rows.join(p.code_anc, "code_norm").select("row_id", "ancestor_id", "score"))
    return hits.groupBy("row_id", "ancestor_id").agg(F.max("score").alias("score"))


@query("mt_boost", "SELECT name_norm, code_norm, category_id, boost FROM boost")
def _(t):
    p = parts(t)
    keys = p.prepared.select("name_norm", "code_norm").distinct()
    hits = keys.join(p.name_boost, "name_norm").select("name_norm", "code_norm", "category_id", "boost").unionByName(
        keys.join(p.code_boost, "code_norm").select("name_norm", "code_norm", "category_id", "boost"))
    return hits.groupBy("name_norm", "code_norm", "category_id").agg(F.max("boost").alias("boost"))


@query("mt_text_score", "SELECT row_id, category_id, score, source FROM text_score")
def _(t):
    return per_row(t, parts(t).text)


@query("mt_code_score", "SELECT row_id, category_id, score, source FROM code_score")
def _(t):
    return per_row(t, parts(t).code)


@query("join_match", "SELECT row_id, category_id, score, source FROM text_score UNION ALL SELECT * FROM code_score")
def _(t):
    return per_row(t, parts(t).text.unionByName(parts(t).code))


@query("mt_rank", "SELECT row_id, category_id, source, score, rank_score, confidence FROM ranked")
def _(t):
    return per_row(t, parts(t).ranked)


# The candidates that the matcher opens: all that share the top rank of their row, and no others.
@query("mt_top", "SELECT row_id, category_id, source, score, rank_score, confidence FROM ranked QUALIFY rank() OVER (PARTITION BY row_id ORDER BY rank_score DESC) = 1")
def _(t):
    return per_row(t, parts(t).top)


@query("mt_tiebreak", "SELECT row_id, category_id, source, rank_score FROM best")
def _(t):
    return per_row(t, parts(t).best).select("row_id", "category_id", "source", "rank_score")


@query("win_best_match", "SELECT row_id, category_id, rank_score, tie_count FROM best")
def _(t):
    return per_row(t, parts(t).best).select("row_id", "category_id", "rank_score", "tie_count")


@query("mt_ambiguous", "SELECT row_id, category_id, source, confidence FROM settled")
def _(t):
    return per_row(t, M.settle_ambiguous(parts(t).best)).select("row_id", "category_id", "source", "confidence")


@query("mt_threshold", "SELECT row_id, category_id, source, confidence FROM outcome")
def _(t):
    return outcome(t)


@query("udf_matcher", "SELECT row_id, category_id, source, confidence FROM outcome")
def _(t):
    matcher: M.CategoryMatcher = M.match
    return matcher(ingest.match_signals(ingest.parsed_rows(t["raw_rows"], t["raw_header"])), t["taxonomy"], t["synonyms"])


_gram = "len(list_intersect({g1}, {g2}))"


@query("join_prefix", "SELECT c.code, t.id AS category_id FROM (SELECT DISTINCT code_norm AS code FROM sig WHERE code_norm IS NOT NULL) c JOIN taxonomy t ON starts_with(t.category_code, c.code)")
def _(t):
    signals = ingest.match_signals(ingest.parsed_rows(t["raw_rows"], t["raw_header"]))  # codes need no pairs of texts
    codes = M.prepare(signals).where("code_norm is not null").select(F.col("code_norm").alias("code")).distinct()
    return codes.join(M.code_prefixes(t["taxonomy"]), F.col("code") == F.col("prefix")).select(
        "code", F.col("node_id").alias("category_id"))


@query("cl_name_pairs", "SELECT norm, cn AS cat_norm, rel, sim FROM textpair")
def _(t):
    return parts(t).pairs
