"""Similarities of texts, each with a search that finds every pair reaching a threshold.

A strategy names tokens of a text such that similar texts share many: at least
``least(n, t)`` of them if one has n tokens and the similarity is t or more.
Then two such texts share a token among the ``n - least + 1`` rarest of each,
which is an equi-join, and the score is computed for what it brings together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from partsmith.functions import text as T
from partsmith.session import stage


def bigram_tokens(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.explode(T.bigrams(F.col(key))).alias("token"))


def numbered_chars(texts: DataFrame, key: str) -> DataFrame:
    """Characters with the number of their occurrence, so that sets of them count repeats."""
    each = texts.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(key)), F.lit("(?s)."), F.lit(0))).alias("char"))
    counted = each.groupBy(key, "char").agg(F.count("*").alias("n"))
    return counted.select(key, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"), "char").select(
        key, F.concat("char", F.col("i").cast("string")).alias("token"))


def gram_cosine(a: Column, b: Column) -> Column:
    """Cosine of the sets of bigrams: 1 when equal, 0 when either is blank."""
    x, y = F.lower(T.jtrim(a)), F.lower(T.jtrim(b))
    ga, gb = T.bigrams(x), T.bigrams(y)
    shared = F.size(F.array_intersect(ga, gb)).cast("double")
    return F.when(T.is_blank(a) | T.is_blank(b), 0.0).when(x == y, 1.0).otherwise(shared / F.sqrt(F.size(ga).cast("double") * F.size(gb)))


@dataclass(frozen=True)
class Strategy:
    """``score`` of two texts between 0 and 1; its ``tokens``; ``least`` of n tokens that a partner of similarity t shares.

    A partner has at least as many tokens as it must share.
    """

    score: T.Similarity
    tokens: Callable[[DataFrame, str], DataFrame]
    least: Callable[[Column, float], Column]

    def _ranked(self, texts: DataFrame, key: str, freq: DataFrame, t: float) -> DataFrame:
        """``(key, token, n)``: the rarest tokens of each text, as many as two similar texts cannot both miss."""
        of_text = self.tokens(texts, key).join(freq, "token", "left").groupBy(key).agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "token"))).alias("ranked"))
        sized = of_text.withColumn("n", F.size("ranked"))
        prefix = F.greatest(F.lit(0), F.col("n") - self.least(F.col("n"), t) + 1).cast("int")
        return sized.select(key, "n", F.explode(F.slice("ranked", F.lit(1), prefix)).alias("r")).select(key, "n", "r.token")

    def candidates(self, left: DataFrame, a: str, right: DataFrame, b: str, t: float) -> DataFrame:
        """``(a, b)``: every pair of the distinct texts of two tables whose similarity can reach ``t``, which must be above 0."""
        freq = stage(self.tokens(right, b).groupBy("token").agg(F.count("*").alias("freq")), "token-freq")
        x = self._ranked(left, a, freq, t).withColumnRenamed("n", "na")
        y = self._ranked(right, b, freq, t).withColumnRenamed("n", "nb")
        needed = F.greatest(self.least(F.col("na"), t), self.least(F.col("nb"), t))
        return x.join(y, "token").where(F.least("na", "nb") >= needed).select(a, b).distinct()


def _share(power: int) -> Callable[[Column, float], Column]:
    return lambda n, t: F.greatest(F.lit(1), F.ceil(n * t**power - 1e-9))


#: shared / all bigrams: a partner of similarity t shares t of the bigrams of either
GRAMS = Strategy(T.jaccard, bigram_tokens, _share(1))
#: 1 - edits / longer length: what is not edited is shared, t of the longer text's characters
EDITS = Strategy(T.edit_similarity, numbered_chars, _share(1))
#: shared >= t * sqrt(na * nb) and shared <= nb give nb >= t*t*na, so t*t of the bigrams of either
COSINE = Strategy(gram_cosine, bigram_tokens, _share(2))
