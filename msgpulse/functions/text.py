"""Column functions over message text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------
# White space as Python's Unicode-aware "\s" defines it, written out so that Java
# and RE2 agree on it.
UNICODE_SPACE = (
    r"\t-\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
URL_PATTERN = rf"http[^{UNICODE_SPACE}]+"
CASHTAG_PATTERN = r"\$([A-Za-z][A-Za-z.]*)"
TOKEN_BREAK = r"[^\p{L}\p{N}$]+"
MAX_TOKENS = 160
# ---------------------------------------------------------------------------------


def strip_urls(body: Column) -> Column:
    return F.regexp_replace(body, URL_PATTERN, "")


def cashtags(body: Column, pattern: str = CASHTAG_PATTERN) -> Column:
    """Distinct upper-cased ticker mentions, without trailing sentence dots."""
    mentions = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(mentions, lambda m: F.upper(F.rtrim(m, F.lit(".")))))


def contains_any(body: Column, phrases: Sequence[str], ignore_case: bool = False) -> Column:
    """True when the text holds any phrase, taken literally.

    Literal ``contains`` tests stay on Spark's UTF-8 bytes and stop at the first
    hit, so no row is decoded for a regular expression.
    """
    text = F.lower(body) if ignore_case else body
    wanted = dict.fromkeys(p.lower() if ignore_case else p for p in phrases)
    if not wanted:
        return F.lit(False)
    return reduce(or_, (F.contains(text, F.lit(p)) for p in wanted))


def tokens(body: Column, limit: int = MAX_TOKENS) -> Column:
    """Lower-cased word tokens, truncated to the model's input length.

    Splitting ends once the wanted tokens are found; the two extra places are an
    empty piece before a leading break and the unsplit rest.
    """
    pieces = F.split(F.lower(body), TOKEN_BREAK, limit + 2)
    return F.slice(F.filter(pieces, lambda t: t != ""), 1, limit)


def tokens_sql(body: str, limit: int = MAX_TOKENS) -> str:
    """``tokens`` as SQL text, for a transformer stage."""
    pieces = f"split(lower({body}), r'{TOKEN_BREAK}', {limit + 2})"
    return f"slice(filter({pieces}, t -> t <> ''), 1, {limit})"
