"""Hierarchical category matcher.

A row carries a category name, a category code, the values parsed out of its
description and a material name.  Every level-3 category is a possible answer.
Comparing each row with each category would be rows x categories x signals, so
the work is arranged differently, without losing a pair:

* texts are compared once per *distinct* normalised text, not per row;
* text pairs come from equi-joins on bigrams (see :func:`name_pairs`);
* rows are reduced to distinct *signatures* (name, code, material name and only
  those description values that hit some category), matched once, and joined
  back by signature;
* candidates are scored per posting list (a name, a code, a prefix) and ranked
  by the best boost any category of the list can get; only the lists of highest
  rank are opened (see :func:`top_candidates`);
* code candidates are looked up only for signatures without a text candidate,
  since any text candidate outranks every code candidate.
"""

from __future__ import annotations

from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.functions import text as T
from partsmith.operators.similarity import Strategy
from partsmith.session import stage

# Scores, thresholds and sources of the matcher.
SYNONYM_CONFIDENCE = 0.95
ANCESTOR_MIN = 0.7
BOOST_FACTOR = 0.2
NAME_BAND = 0.5
MIN_CONFIDENCE = 0.5
NAME_SIM_MIN = 0.7
VALUE_SIM_MIN = 0.55
FUZZY_SOURCES = ("NAME_FUZZY", "EXTRA_NAME", "SEMANTIC", "MATERIAL_NAME")

EQ, IN, SIM = 0, 1, 2


class CategoryMatcher(Protocol):
    """Anything that turns signals into one outcome per row."""

    def __call__(self, signals: DataFrame, taxonomy: DataFrame, synonyms: DataFrame) -> DataFrame: ...


def scaled(sim: Column) -> Column:
    return F.lit(0.6) + F.lit(0.3) * sim


def prefixes(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))


# ---------------------------------------------------------------- taxonomy side

def descendants(taxonomy: DataFrame) -> DataFrame:
    """``(ancestor_id, l3_id, hops, via_id)``: level-3 nodes below every level-1/2 node.

    Climbs from the level-3 nodes until no parent is left; links that run in a
    circle end where they meet a node again.  A level-1/2 node that owns none
    through its links falls back to the level-3 codes that start with its own
    code.
    """
    nodes = taxonomy.select("id", "parent_id", "level", "category_code")
    upper = nodes.where("level <> 3").select(
        F.col("id").alias("ancestor_id"), F.col("parent_id").alias("next_id"))
    step = nodes.where("level = 3").select(
        F.col("id").alias("l3_id"), F.col("parent_id").alias("via_id"), F.col("parent_id").alias("at_id"))
    linked, hop = None, 1
    while True:
        reached = step.join(upper, step["at_id"] == upper["ancestor_id"]).select(
            "ancestor_id", "l3_id", F.lit(hop).alias("hops"), "via_id", "next_id")
        if linked is not None:
            reached = reached.join(linked.select("ancestor_id", "l3_id"), ["ancestor_id", "l3_id"], "left_anti")
        reached = stage(reached, "climb")
        if linked is not None and reached.isEmpty():
            break
        linked = reached if linked is None else linked.unionByName(reached)
        step = reached.where("next_id is not null").select("l3_id", "via_id", F.col("next_id").alias("at_id"))
        hop += 1
    linked = linked.drop("next_id")
    childless = upper.join(linked, "ancestor_id", "left_anti").join(
        nodes.select(F.col("id").alias("ancestor_id"), "category_code"), "ancestor_id")
    by_code = childless.where(~T.is_blank(F.col("category_code"))).join(
        code_prefixes(taxonomy.where("level = 3")),
        F.col("category_code") == F.col("prefix"),
    ).select("ancestor_id", F.col("node_id").alias("l3_id"), F.lit(9).alias("hops"),
             F.lit(None).cast("long").alias("via_id"))
    return linked.unionByName(by_code)


def code_prefixes(nodes: DataFrame) -> DataFrame:
    """``(prefix, node_id, node_code)``: turns "code starts with" into an equi-join."""
    return nodes.where(F.col("category_code").isNotNull()).select(
        F.explode(prefixes(F.col("category_code"))).alias("prefix"),
        F.col("id").alias("node_id"), F.col("category_code").alias("node_code"))


def _named(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.withColumn("cat_norm", T.norm_name(F.col("category_name")))


# ---------------------------------------------------------------- text pairs

def _ranked_grams(texts: DataFrame, key: str, freq: DataFrame) -> DataFrame:
    """``(key, ranked)``: the bigrams of each text, rarest among category names first.

    A text is gathered from its own bigrams only, so no group exceeds one text.
    Bigrams unknown to every category name have frequency 0 and come first.
    """
    return (
        texts.select(key, F.explode(T.bigrams(F.col(key))).alias("gram"))
        .join(freq, "gram", "left")
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "gram"))).alias("ranked"))
    )


def _prefix_len(n: Column) -> Column:
    """How many of the rarest bigrams two texts of similarity >= t cannot both miss."""
    return n - F.ceil(n * VALUE_SIM_MIN - 1e-9) + 1


def name_pairs(norms: DataFrame, taxonomy: DataFrame, similarity: Strategy | None = None) -> DataFrame:
    """``(norm, cat_norm, rel, sim)`` for distinct texts against distinct category names.

    Complete for equality, containment and a similarity of at least
    ``VALUE_SIM_MIN``, and built from equi-joins only.  The similarity is that
    of bigrams (Jaccard), or the ``similarity`` asked for, which brings its own
    search for pairs:

    * a name inside a text: the text holds the name's rarest bigram;
    * similar texts: within their ``n - ceil(t*n) + 1`` rarest bigrams they
      share one, and their sizes differ by no more than the threshold allows;
    * a text inside a name: all its bigrams are known, and the name holds the
      rarest of them;
    * one-character texts and names go through a character join.
    """
    names = _named(taxonomy).where("cat_norm is not null").select("cat_norm").distinct()
    name_grams = names.select("cat_norm", F.explode(T.bigrams(F.col("cat_norm"))).alias("gram"))
    freq = stage(name_grams.groupBy("gram").agg(F.count("*").alias("freq")), "gram-freq")

    ranked_names = _ranked_grams(names, "cat_norm", freq).withColumn("name_n", F.size("ranked"))
    name_index = ranked_names.select(
        "cat_norm", "name_n",
        F.posexplode(F.slice("ranked", F.lit(1), _prefix_len(F.col("name_n")).cast("int"))).alias("name_place", "g"),
    ).select(F.col("g.gram").alias("gram"), "cat_norm", "name_n", "name_place")

    ranked_texts = stage(_ranked_grams(norms, "norm", freq).withColumn("text_n", F.size("ranked")), "ranked-texts")
    text_index = ranked_texts.select(
        "norm", "text_n", F.posexplode("ranked").alias("text_place", "g"),
    ).where("g.freq > 0").select(F.col("g.gram").alias("gram"), "norm", "text_n", "text_place")

    a, b = F.col("norm"), F.col("cat_norm")
    comparable = F.least("text_n", "name_n") >= VALUE_SIM_MIN * F.greatest("text_n", "name_n") - 1e-9
    near = (F.col("text_place") < _prefix_len(F.col("text_n"))) & comparable
    holds_name = (F.col("name_place") == 0) & F.contains(a, b)
    by_gram = text_index.join(name_index, "gram").where(holds_name if similarity else holds_name | near).select(
        "norm", "cat_norm", "text_n", "name_n")
    if similarity:
        found = similarity.candidates(norms, "norm", names, "cat_norm", VALUE_SIM_MIN)
        by_gram = by_gram.unionByName(found.select("norm", "cat_norm", F.lit(1).alias("text_n"), F.lit(1).alias("name_n")))

    inside = ranked_texts.where(F.element_at("ranked", 1)["freq"] > 0).select(
        "norm", F.element_at("ranked", 1)["gram"].alias("gram"))
    by_rarest = inside.join(name_grams, "gram").where(F.contains(b, a)).select("norm", "cat_norm")

    char_of_name = names.select("cat_norm", F.explode(T.chars(b)).alias("norm"))
    char_of_text = norms.select("norm", F.explode(T.chars(a)).alias("cat_norm"))
    by_char = norms.where(F.length("norm") == 1).join(char_of_name, "norm").select("norm", "cat_norm").unionByName(
        char_of_text.join(names.where(F.length("cat_norm") == 1), "cat_norm").select("norm", "cat_norm"))

    # The sizes come out of the aggregate, so the costly comparison stays above
    # it and runs once per pair instead of once per shared bigram.
    pairs = by_gram.unionByName(by_rarest.unionByName(by_char), allowMissingColumns=True).groupBy(
        "norm", "cat_norm").agg(F.max("text_n").alias("text_n"), F.max("name_n").alias("name_n"))
    shared = F.size(F.array_intersect(T.bigrams(a), T.bigrams(b)))
    sim = similarity.score(a, b) if similarity else shared.cast("double") / (F.col("text_n") + F.col("name_n") - shared)
    related = F.when(a == b, EQ).when(T.contains_either(a, b), IN).when(F.col("text_n") > 0, SIM)
    return (
        pairs.withColumn("rel", related)
        .withColumn("sim", F.when(F.col("rel") == SIM, sim).otherwise(F.lit(1.0)))
        .where((F.col("rel") != SIM) | (F.col("sim") >= VALUE_SIM_MIN))
        .select("norm", "cat_norm", "rel", "sim")
    )


def level_pairs(pairs: DataFrame, taxonomy: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    nodes = _named(taxonomy).where(F.col("level").isin(*levels)).select("cat_norm", F.col("id").alias("node_id"))
    return pairs.join(nodes, "cat_norm").select("norm", "node_id", "rel", "sim")


# ---------------------------------------------------------------- row side

def prepare(signals: DataFrame) -> DataFrame:
    """Normalised signals of a row; the order of the extra values does not affect scores."""
    extras = F.coalesce(F.col("extras"), F.array().cast("array<string>"))
    extras = F.array_distinct(F.filter(F.transform(extras, T.norm_name), lambda x: x.isNotNull()))
    return signals.select(
        "row_id",
        T.norm_name(F.col("category_name")).alias("name_norm"),
        F.col("category_code").alias("code_raw"),
        T.norm_code(F.col("category_code")).alias("code_norm"),
        extras.alias("extras"),
        F.when(~T.is_blank(F.col("material_name")), F.col("material_name")).alias("mat_raw"),
        T.norm_name(F.col("material_name")).alias("mat_norm"),
    )


def distinct_norms(prepared: DataFrame) -> DataFrame:
    texts = F.array_union("extras", F.array("name_norm", "mat_norm"))
    return prepared.select(F.explode(texts).alias("norm")).where("norm is not null").distinct()


def with_signature(prepared: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``extras_hit`` (only values that can score) and ``sig_id``."""
    hits = pairs.select("norm").distinct()
    per_row = (
        prepared.select("row_id", F.explode("extras").alias("norm"))
        .join(hits, "norm", "left_semi")
        .groupBy("row_id").agg(F.sort_array(F.collect_list("norm")).alias("extras_hit"))
    )
    none = F.array().cast("array<string>")
    gone = F.lit("\u0001")
    sig = F.md5(F.concat_ws(
        "\u0002", F.coalesce("name_norm", gone), F.coalesce("code_raw", gone),
        F.coalesce("mat_raw", gone), F.array_join("extras_hit", "\u0003")))
    return (
        prepared.select("row_id", "name_norm", "code_raw", "code_norm", "mat_raw", "mat_norm")
        .join(per_row, "row_id", "left")
        .withColumn("extras_hit", F.coalesce("extras_hit", none))
        .withColumn("sig_id", sig)
    )


def signatures(rows: DataFrame) -> DataFrame:
    return rows.select(
        "sig_id", "name_norm", "code_raw", "code_norm", "mat_raw", "mat_norm", "extras_hit"
    ).dropDuplicates(["sig_id"])


# ---------------------------------------------------------------- stage 0: synonyms

def synonym_outcome(names: DataFrame, synonyms: DataFrame, taxonomy: DataFrame, closure: DataFrame) -> DataFrame:
    """``(name_norm, category_id)`` for distinct names that equal a synonym.

    The first usable synonym by id wins.  One that points above level 3 picks
    among the level-3 nodes below: same name, else containment, else the first.
    """
    syn = (
        synonyms.where(F.col("category_id").isNotNull() & ~T.is_blank(F.col("synonym_name")))
        .select(
            F.col("id").alias("syn_id"), F.col("category_id").alias("target_id"),
            F.when(T.is_blank(F.col("synonym_norm")), T.norm_name(F.col("synonym_name")))
            .otherwise(F.lower(T.jtrim(F.col("synonym_norm")))).alias("name_norm"),
        )
    )
    named = _named(taxonomy)
    leaves = named.where("level = 3").select(F.col("id").alias("l3_id"), "cat_norm")
    targets = closure.select(F.col("ancestor_id").alias("target_id"), "l3_id", "hops", "via_id").unionByName(
        leaves.select(F.col("l3_id").alias("target_id"), "l3_id", F.lit(0).alias("hops"),
                      F.lit(None).cast("long").alias("via_id")))
    a, b = F.col("name_norm"), F.col("cat_norm")
    fit = F.when(a == b, 0).when(T.contains_either(a, b), 1).otherwise(2)
    return (
        names.where("name_norm is not null").join(syn, "name_norm")
        .join(targets, "target_id").join(leaves, "l3_id")
        .groupBy("name_norm")
        .agg(F.min(F.struct("syn_id", fit.alias("fit"), "hops", "via_id", "l3_id")).alias("best"))
        .select("name_norm", F.col("best.l3_id").alias("category_id"))
    )


# ---------------------------------------------------------------- ancestors and boost

def ancestor_name_scores(pairs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(name_norm, ancestor_id, score)``: distinct texts against level-1/2 names."""
    score = (
        F.when(F.col("rel") == EQ, 1.0).when(F.col("rel") == IN, 0.8)
        .when(F.col("sim") >= NAME_SIM_MIN, scaled(F.col("sim")))
    )
    return (
        level_pairs(pairs, taxonomy, (1, 2))
        .select(F.col("norm").alias("name_norm"), F.col("node_id").alias("ancestor_id"), score.alias("score"))
        .where(F.col("score") >= ANCESTOR_MIN)
    )


def ancestor_code_scores(codes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(code_norm, ancestor_id, score)``: distinct codes against level-1/2 codes."""
    idx = code_prefixes(taxonomy.where("level in (1, 2)"))
    score = F.when(F.col("code_norm") == F.col("node_code"), 1.0).otherwise(0.7)
    return codes.join(idx, F.col("code_norm") == F.col("prefix")).select(
        "code_norm", F.col("node_id").alias("ancestor_id"), score.alias("score"))


def boost_of(scores: DataFrame, key: str, closure: DataFrame) -> DataFrame:
    """Best ancestor score per (key, level-3 node), times the boost factor."""
    return (
        scores.join(closure.select("ancestor_id", "l3_id"), "ancestor_id")
        .groupBy(key, F.col("l3_id").alias("category_id"))
        .agg((F.max("score") * BOOST_FACTOR).alias("boost"))
    )


# ---------------------------------------------------------------- level-3 scores

def name_scores(sigs: DataFrame, pairs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(sig_id, cat_norm, score, source)``: best text evidence per name of level 3, however many categories hold it.

    The name counts first, then description values, then the material name; a
    later signal takes over only with a strictly higher score.
    """
    def signal(kind: int, norm: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), norm.alias("norm"))

    redundant = F.array_contains("extras_hit", F.col("mat_norm"))
    listed = F.concat(
        F.array(signal(0, F.col("name_norm"))),
        F.transform("extras_hit", lambda e: signal(1, e)),
        F.array(signal(2, F.when(~F.coalesce(redundant, F.lit(False)), F.col("mat_norm")))),
    )
    signals = sigs.select("sig_id", F.inline(F.filter(listed, lambda s: s["norm"].isNotNull())))
    rel, sim, kind = F.col("rel"), F.col("sim"), F.col("kind")
    name_score = F.when(rel == EQ, 1.0).when(rel == IN, 0.85).when(sim >= NAME_SIM_MIN, scaled(sim))
    value_score = F.when(rel == EQ, 0.9).when(rel == IN, 0.8).otherwise(scaled(sim))
    names = _named(taxonomy).where("level = 3").select("cat_norm").distinct()
    scored = (
        signals.join(pairs.join(names, "cat_norm", "left_semi"), "norm")
        .withColumn("score", F.when(kind == 0, name_score).otherwise(value_score))
        .where("score is not null")
    )
    per_kind = scored.groupBy("sig_id", "cat_norm").agg(
        F.coalesce(F.max(F.when(kind == 0, F.col("score"))), F.lit(0.0)).alias("s0"),
        F.coalesce(F.max(F.when(kind == 1, F.col("score"))), F.lit(0.0)).alias("s1"),
        F.coalesce(F.max(F.when(kind == 2, F.col("score"))), F.lit(0.0)).alias("s2"),
        F.max(F.when(kind == 0, rel)).alias("name_rel"),
    )
    by_name = F.when(F.col("name_rel") == EQ, "NAME_EXACT").when(F.col("name_rel") == IN, "NAME_FUZZY").otherwise("SEMANTIC")
    source = (
        F.when(F.col("s2") > F.greatest("s0", "s1"), "MATERIAL_NAME")
        .when(F.col("s1") > F.col("s0"), "EXTRA_NAME").otherwise(by_name)
    )
    return per_kind.select("sig_id", "cat_norm", F.greatest("s0", "s1", "s2").alias("score"), source.alias("source"))


def text_scores(hits: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(sig_id, category_id, score, source)``: best text evidence per category, from that per name (:func:`name_scores`)."""
    nodes = _named(taxonomy).where("level = 3").select("cat_norm", F.col("id").alias("category_id"))
    return hits.join(nodes, "cat_norm").select("sig_id", "category_id", "score", "source")


def code_scores(sigs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(sig_id, category_id, score, source)`` from the given code alone."""
    leaves = taxonomy.where("level = 3")
    exact = sigs.where("code_raw is not null").join(
        leaves.where("category_code is not null").select("category_code", F.col("id").alias("category_id")),
        F.col("code_raw") == F.col("category_code"),
    ).select("sig_id", "category_id", F.lit(1.0).alias("score"), F.lit("CODE_EXACT").alias("source"))
    prefix = sigs.where("code_norm is not null").join(
        code_prefixes(leaves), F.col("code_norm") == F.col("prefix"),
    ).where(~F.col("code_raw").eqNullSafe(F.col("node_code"))).select(
        "sig_id", F.col("node_id").alias("category_id"), F.lit(0.6).alias("score"), F.lit("CODE_PREFIX").alias("source"))
    return exact.unionByName(prefix)


def _band() -> Column:
    by_text = ~F.col("source").isin("CODE_EXACT", "CODE_PREFIX")
    return F.col("score") + F.when(by_text, NAME_BAND).otherwise(0.0)


def postings(taxonomy: DataFrame) -> DataFrame:
    """``(kind, entry, category_id)``: level-3 categories by name, by code and by every prefix of their code."""
    leaves = _named(taxonomy).where("level = 3")
    by_name = leaves.where("cat_norm is not null").select(F.lit("name").alias("kind"), F.col("cat_norm").alias("entry"), F.col("id").alias("category_id"))
    by_code = leaves.where("category_code is not null").select(F.lit("code").alias("kind"), F.col("category_code").alias("entry"), F.col("id").alias("category_id"))
    by_prefix = code_prefixes(leaves).select(F.lit("prefix").alias("kind"), F.col("prefix").alias("entry"), F.col("node_id").alias("category_id"))
    return by_name.unionByName(by_code).unionByName(by_prefix)


def entry_scores(sigs: DataFrame, hits: DataFrame, lists: DataFrame) -> DataFrame:
    """``(sig_id, kind, entry, score, source)``: one row per posting list that a signature reaches, not per category in it.

    A signature with a text candidate asks for no code; one whose code exists
    asks for no prefix, since the largest boost cannot lift a prefix above it.
    """
    text = hits.select("sig_id", F.lit("name").alias("kind"), F.col("cat_norm").alias("entry"), "score", "source")
    rest = sigs.join(text.select("sig_id").distinct(), "sig_id", "left_anti")
    entries = lists.select("kind", "entry").distinct()
    exact = rest.where("code_raw is not null").select("sig_id", F.lit("code").alias("kind"), F.col("code_raw").alias("entry")).join(
        entries, ["kind", "entry"], "left_semi").select("sig_id", "kind", "entry", F.lit(1.0).alias("score"), F.lit("CODE_EXACT").alias("source"))
    prefix = rest.where("code_norm is not null").join(exact.select("sig_id"), "sig_id", "left_anti").select(
        "sig_id", F.lit("prefix").alias("kind"), F.col("code_norm").alias("entry")).join(entries, ["kind", "entry"], "left_semi").select(
        "sig_id", "kind", "entry", F.lit(0.6).alias("score"), F.lit("CODE_PREFIX").alias("source"))
    return text.unionByName(exact).unionByName(prefix)


def within_reach(entries: DataFrame) -> DataFrame:
    """Entries that the largest boost could still lift to the top of their signature; no winner is lost."""
    best = F.max("_band").over(Window.partitionBy("sig_id"))
    return entries.withColumn("_band", _band()).withColumn("_best", best).where(
        F.col("_band") >= F.col("_best") - BOOST_FACTOR - 1e-9).drop("_best")


def top_candidates(entries: DataFrame, sigs: DataFrame, name_anc: DataFrame, code_anc: DataFrame, closure: DataFrame, lists: DataFrame) -> DataFrame:
    """The candidates of highest rank of every signature, all of them: ``(sig_id, category_id, source, score, rank_score, confidence)``.

    A rank join over posting lists.  A list's rank is its score plus the best
    boost that any of its categories gets, known from the distinct ancestors
    of the list.  Only the lists of highest rank are opened, and of these only
    the categories below the ancestors that give that boost, so a name held by
    ever so many categories yields no more pairs than tie.
    """
    above = lists.join(closure.select("ancestor_id", F.col("l3_id").alias("category_id")), "category_id").select("kind", "entry", "ancestor_id", "category_id").distinct()
    heads = above.select("kind", "entry", "ancestor_id").distinct()
    keyed = stage(within_reach(entries).join(sigs.select("sig_id", "name_norm", "code_norm"), "sig_id"), "match-entries")

    def lift(key: str, scores: DataFrame) -> DataFrame:
        """The ancestors of each list that boost texts or codes of ``key``."""
        wanted = keyed.where(F.col(key).isNotNull()).select(key, "kind", "entry").distinct()
        return wanted.join(heads, ["kind", "entry"]).join(scores, [key, "ancestor_id"])

    by_name, by_code = stage(lift("name_norm", name_anc), "name-lift"), stage(lift("code_norm", code_anc), "code-lift")
    ns = by_name.groupBy("name_norm", "kind", "entry").agg(F.max("score").alias("ns"))
    cs = by_code.groupBy("code_norm", "kind", "entry").agg(F.max("score").alias("cs"))
    lifted = keyed.join(ns, ["name_norm", "kind", "entry"], "left").join(cs, ["code_norm", "kind", "entry"], "left").withColumn("top", F.greatest("ns", "cs"))
    boost, band = F.col("top") * BOOST_FACTOR, F.col("_band")
    ranked = lifted.withColumns({
        "rank_score": F.when(boost.isNotNull(), band + boost).otherwise(band),
        "confidence": F.when(boost.isNotNull(), F.least(F.lit(1.0), F.col("score") + boost)).otherwise(F.col("score"))})
    w = Window.partitionBy("sig_id").orderBy(F.col("rank_score").desc())
    first = stage(ranked.withColumn("r", F.rank().over(w)).where("r = 1").drop("r", "_band"), "match-top")

    out = ["sig_id", "category_id", "source", "score", "rank_score", "confidence"]
    level = first.where("top is null").join(lists, ["kind", "entry"]).select(*out)
    ours = first.where("top is not null").select("sig_id", "kind", "entry", "name_norm", "code_norm", "top", *out[2:])
    ways = ours.join(by_name.withColumnRenamed("score", "top"), ["name_norm", "kind", "entry", "top"]).select("sig_id", "kind", "entry", "ancestor_id", *out[2:]).unionByName(
        ours.join(by_code.withColumnRenamed("score", "top"), ["code_norm", "kind", "entry", "top"]).select("sig_id", "kind", "entry", "ancestor_id", *out[2:]))
    lifted_nodes = ways.distinct().join(above, ["kind", "entry", "ancestor_id"]).select(*out).distinct()
    return level.unionByName(lifted_nodes)


def rank_scores(candidates: DataFrame, sigs: DataFrame, name_anc: DataFrame, code_anc: DataFrame, closure: DataFrame) -> DataFrame:
    """Add ``rank_score`` (text candidates in the upper band) and ``confidence``.

    The boost of a candidate is looked up through its own few ancestors, so
    the work follows the candidates and not the nodes below a generic name.
    """
    above = candidates.join(sigs.select("sig_id", "name_norm", "code_norm"), "sig_id").join(
        closure.select("ancestor_id", F.col("l3_id").alias("category_id")), "category_id")
    boosts = (
        above.join(name_anc.withColumnRenamed("score", "ns"), ["name_norm", "ancestor_id"], "left")
        .join(code_anc.withColumnRenamed("score", "cs"), ["code_norm", "ancestor_id"], "left")
        .groupBy("sig_id", "category_id")
        .agg((F.max(F.greatest("ns", "cs")) * BOOST_FACTOR).alias("boost")))
    boost, band = F.col("boost"), _band()
    return (
        candidates.join(boosts, ["sig_id", "category_id"], "left")
        .select(
            "sig_id", "category_id", "source", "score",
            F.when(boost.isNotNull(), band + boost).otherwise(band).alias("rank_score"),
            F.when(boost.isNotNull(), F.least(F.lit(1.0), F.col("score") + boost))
            .otherwise(F.col("score")).alias("confidence"),
        )
    )


def tie_similarity(name_norm: Column, mat_raw: Column, cat_norm: Column, score: T.Similarity = T.jaccard) -> Column:
    def one(t: Column) -> Column:
        sim = F.when(cat_norm == t, 1.0).when(T.contains_either(cat_norm, t), 0.85).otherwise(score(t, cat_norm))
        return F.when(T.is_blank(t) | cat_norm.isNull(), 0.0).otherwise(sim)

    return F.greatest(one(name_norm), one(mat_raw))


def pick_best(ranked: DataFrame, sigs: DataFrame, taxonomy: DataFrame, score: T.Similarity = T.jaccard) -> DataFrame:
    """One row per signature: the top rank, ties settled, and how many tied.

    ``rank() = 1`` is pushed below the shuffle by Spark, so only the leading
    candidates of each signature travel.
    """
    w = Window.partitionBy("sig_id").orderBy(F.col("rank_score").desc())
    top = ranked.withColumn("r", F.rank().over(w)).where("r = 1").drop("r")
    cats = _named(taxonomy).where("level = 3").select(F.col("id").alias("category_id"), "category_code", "cat_norm")
    keyed = top.join(cats, "category_id").join(
        sigs.select("sig_id", "name_norm", "code_norm", "mat_raw"), "sig_id")
    closeness = tie_similarity(F.col("name_norm"), F.col("mat_raw"), F.col("cat_norm"), score)
    same_code = F.coalesce(F.col("code_norm") == F.col("category_code"), F.lit(False))
    order = F.struct(
        (-closeness).alias("far"), (~same_code).alias("other_code"), F.col("category_code").alias("code"),
        "category_id", "source", "rank_score", "confidence")
    return (
        keyed.groupBy("sig_id")
        .agg(F.min(order).alias("best"), F.count("*").alias("tie_count"))
        .select("sig_id", "best.category_id", "best.source", "best.rank_score", "best.confidence", "tie_count")
    )


def settle_ambiguous(best: DataFrame) -> DataFrame:
    """A fuzzy winner that shares the top rank is only a guess."""
    guess = F.col("source").isin(*FUZZY_SOURCES) & (F.col("tie_count") > 1)
    return best.withColumns({
        "source": F.when(guess, "FUZZY_AMBIGUOUS").otherwise(F.col("source")),
        "confidence": F.when(guess, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")),
    })


# ---------------------------------------------------------------- whole matcher

class MatchParts:
    """Every intermediate table of one matching run, each made when it is first asked for.

    Who asks for the names that equal a synonym waits for no pairs of texts,
    and who asks for pairs for no ranks.  Tables that several others read are
    staged.
    """

    def __init__(self, signals: DataFrame, taxonomy: DataFrame, synonyms: DataFrame, similarity: Strategy | None = None):
        self.signals, self.taxonomy, self.synonyms, self.similarity = signals, taxonomy, synonyms, similarity

    # -- rows and texts

    @cached_property
    def prepared(self) -> DataFrame:
        return stage(prepare(self.signals), "prepared")

    @cached_property
    def pairs(self) -> DataFrame:
        return stage(name_pairs(distinct_norms(self.prepared), self.taxonomy, self.similarity), "pairs")

    @cached_property
    def rows(self) -> DataFrame:
        return stage(with_signature(self.prepared, self.pairs), "signals")

    @cached_property
    def sigs(self) -> DataFrame:
        return stage(signatures(self.rows), "signatures")

    @cached_property
    def open_sigs(self) -> DataFrame:
        return self.sigs.join(self.synonym.select("name_norm"), "name_norm", "left_anti")

    # -- synonyms, ancestors and boost

    @cached_property
    def closure(self) -> DataFrame:
        return descendants(self.taxonomy)

    @cached_property
    def synonym(self) -> DataFrame:
        return synonym_outcome(self.prepared.select("name_norm").distinct(), self.synonyms, self.taxonomy, self.closure)

    @cached_property
    def name_anc(self) -> DataFrame:
        return ancestor_name_scores(self.pairs, self.taxonomy)

    @cached_property
    def code_anc(self) -> DataFrame:
        codes = self.prepared.where("code_norm is not null").select("code_norm").distinct()
        return ancestor_code_scores(codes, self.taxonomy)

    @cached_property
    def name_boost(self) -> DataFrame:
        return boost_of(self.name_anc, "name_norm", self.closure)

    @cached_property
    def code_boost(self) -> DataFrame:
        return boost_of(self.code_anc, "code_norm", self.closure)

    # -- winners

    @cached_property
    def name_hits(self) -> DataFrame:
        return stage(name_scores(self.open_sigs, self.pairs, self.taxonomy), "name-scores")

    @cached_property
    def top(self) -> DataFrame:
        lists = stage(postings(self.taxonomy), "postings")
        entries = entry_scores(self.open_sigs, self.name_hits, lists)
        return top_candidates(entries, self.sigs, self.name_anc, self.code_anc, self.closure, lists)

    @cached_property
    def best(self) -> DataFrame:
        return pick_best(self.top, self.sigs, self.taxonomy, self.similarity.score if self.similarity else T.jaccard)

    @cached_property
    def outcome(self) -> DataFrame:
        by_synonym = self.sigs.join(self.synonym, "name_norm").select(
            "sig_id", "category_id", F.lit("SYNONYM").alias("source"), F.lit(SYNONYM_CONFIDENCE).alias("confidence"))
        found = settle_ambiguous(self.best).where(F.col("confidence") >= MIN_CONFIDENCE).select(
            "sig_id", "category_id", "source", "confidence").unionByName(by_synonym)
        return self.rows.select("row_id", "sig_id").join(found, "sig_id", "left").select(
            "row_id", "category_id",
            F.coalesce("source", F.lit("UNMATCHED")).alias("source"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        )

    # -- every candidate with its score, for those who ask for more than the winner; the outcome does not read them

    @cached_property
    def text(self) -> DataFrame:
        return text_scores(self.name_hits, self.taxonomy)

    @cached_property
    def code(self) -> DataFrame:
        return code_scores(self.open_sigs.join(self.name_hits.select("sig_id").distinct(), "sig_id", "left_anti"), self.taxonomy)

    @cached_property
    def ranked(self) -> DataFrame:
        return rank_scores(self.text.unionByName(self.code), self.sigs, self.name_anc, self.code_anc, self.closure)


def match_parts(signals: DataFrame, taxonomy: DataFrame, synonyms: DataFrame,
                similarity: Strategy | None = None) -> MatchParts:
    return MatchParts(signals, taxonomy, synonyms, similarity)


def match(signals: DataFrame, taxonomy: DataFrame, synonyms: DataFrame, similarity: Strategy | None = None) -> DataFrame:
    """``(row_id, category_id, source, confidence)``, exactly one row per input row."""
    return match_parts(signals, taxonomy, synonyms, similarity).outcome
