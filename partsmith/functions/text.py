"""Text normalisation, tokens, bigrams and similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Characters dropped from names and codes, and the token alphabet.
_EDGE = "".join(chr(i) for i in range(0x21))
_NAME_NOISE = r"[()（）\[\]【】{}/\-\s_]+"
_CODE_NOISE = r"[\s\-_/]+"
_TOKEN = r"[a-zA-Z0-9一-龥]+"

Similarity = Callable[[Column, Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    An outer expression named inside a lambda is evaluated for every element;
    a lambda's own argument is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def jtrim(c: Column) -> Column:
    """Strip every leading and trailing character up to U+0020."""
    return F.btrim(c, F.lit(_EDGE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (jtrim(c) == "")


def norm_name(c: Column) -> Column:
    return nonempty(F.regexp_replace(F.lower(jtrim(c)), _NAME_NOISE, ""))


def norm_code(c: Column) -> Column:
    return nonempty(F.regexp_replace(jtrim(c), _CODE_NOISE, ""))


def norm_field(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")


def tokens(c: Column) -> Column:
    """Runs of letters, digits and CJK characters, in order; null gives none."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_TOKEN), F.lit(0))


def name_tokens(c: Column, raw_text: bool = False) -> Column:
    """Tokens of a name.

    Normalising first glues words together, because it drops the spaces; with
    ``raw_text`` the words stay apart and only the case is folded.
    """
    return tokens(F.lower(c)) if raw_text else tokens(norm_name(c))


def bigrams(c: Column) -> Column:
    """Distinct two-character pieces; a single character stands for itself.

    One regular expression with a look-ahead instead of a lambda per position:
    it runs inside generated code and is several times faster.
    """
    pairs = F.regexp_extract_all(c, F.lit("(?s)(?=(..))"), F.lit(1))
    return F.array_distinct(F.when(F.length(c) == 1, F.array(c)).otherwise(pairs))


def chars(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)))


def gram_jaccard(ga: Column, gb: Column) -> Column:
    shared = F.size(F.array_intersect(ga, gb))
    return shared.cast("double") / (F.size(ga) + F.size(gb) - shared)


def jaccard(a: Column, b: Column) -> Column:
    """Bigram Jaccard of two texts: 1 when equal, 0 when either is blank."""
    x, y = F.lower(jtrim(a)), F.lower(jtrim(b))
    return (
        F.when(x.isNull() | y.isNull() | (x == "") | (y == ""), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .otherwise(gram_jaccard(bigrams(x), bigrams(y)))
    )


def edit_similarity(a: Column, b: Column) -> Column:
    """Alternative strategy: one minus the edit distance over the longer length."""
    x, y = F.lower(jtrim(a)), F.lower(jtrim(b))
    longest = F.greatest(F.length(x), F.length(y))
    return (
        F.when(x.isNull() | y.isNull() | (x == "") | (y == ""), F.lit(0.0))
        .otherwise(F.lit(1.0) - F.levenshtein(x, y) / longest)
    )


def cosine(a: Column, b: Column) -> Column:
    """Alternative strategy for embedding columns."""
    def dot(u: Column, v: Column) -> Column:
        products = F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def contains_either(a: Column, b: Column, min_len: int = 1) -> Column:
    hit = F.contains(a, b) | F.contains(b, a)
    if min_len > 1:
        hit = hit & (F.least(F.length(a), F.length(b)) >= min_len)
    return F.coalesce(hit, F.lit(False))


def same_unit(a: Column, b: Column) -> Column:
    """Units agree when either is missing or they are equal ignoring case."""
    return is_blank(a) | is_blank(b) | (F.lower(jtrim(a)) == F.lower(jtrim(b)))


def any_token_in(words: Column, text: Column) -> Column:
    return F.coalesce(F.exists(words, lambda t: F.contains(text, t)), F.lit(False))


def cell_text(c: Column) -> Column:
    """A cell as text: trimmed, whole numbers without a fraction, null as empty."""
    return F.coalesce(F.regexp_replace(jtrim(c.cast("string")), r"^(-?[0-9]+)\.0+$", "$1"), F.lit(""))


def split_multi(c: Column) -> Column:
    """Source list: cut at either comma, trimmed, without blanks or repeats."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,，]"), jtrim)
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), ",")


def fill_template(text: str, slots: dict[str, Column]) -> Column:
    out = F.lit(text)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def cut(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def sheet_name(c: Column, ident: Column, base_len: int = 25, cap: int = 31) -> Column:
    """A legal sheet name: illegal characters replaced, cut, the id appended."""
    clean = jtrim(F.regexp_replace(c, r"[\\/:*?\[\]]", "_"))
    return F.substring(F.concat(F.substring(clean, 1, base_len), F.lit("_"), ident.cast("string")), 1, cap)
