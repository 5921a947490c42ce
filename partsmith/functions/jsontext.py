"""JSON found inside free text, and repairs of it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from partsmith.functions.text import jtrim

_FENCED = r"(?s)^```[^\n]*\n(.*)```.*$"
_OPEN_FENCE = r"(?s)^```[^\n]*\n(.*)$"


def strip_fence(c: Column) -> Column:
    text = jtrim(c)
    inner = F.when(text.rlike(_FENCED), F.regexp_extract(text, _FENCED, 1)).otherwise(
        F.regexp_replace(text, _OPEN_FENCE, "$1"))
    return jtrim(inner)


def json_block(c: Column) -> Column:
    """From the first ``{`` to the last ``}``, fences removed; null when there is none."""
    block = F.regexp_extract(strip_fence(c), r"(?s)(\{.*\})", 1)
    return F.when(block != "", block)


def fix_escapes(c: Column) -> Column:
    """Double a backslash that does not start a legal JSON escape.

    Each match begins where the previous one ended, so a legal pair is always
    consumed whole and its second backslash is never taken for a new start.
    """
    legal_run = r'\G((?:[^\\]++|\\["\\/bfnrtu])*+)'
    return F.regexp_replace(c, legal_run + r"\\((?s:.)?)", r"$1\\\\$2")


def json_or_fixed(c: Column) -> Column:
    """The text if it parses as JSON, else its repaired form."""
    return F.when(F.get_json_object(c, "$").isNotNull(), c).otherwise(fix_escapes(c))


def flat_map(c: Column) -> Column:
    """JSON object to ``map<string,string>``; nested values stay JSON text, null becomes empty."""
    parsed = F.from_json(c, "map<string,string>")
    return F.transform_values(parsed, lambda k, v: F.coalesce(v, F.lit("")))
