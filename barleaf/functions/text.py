"""Text helpers built from Spark string and array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentiment word lists.
POSITIVE = (
    "beat beats soars surge rally record growth strong upgrade raises bullish wins approved"
).split()
NEGATIVE = (
    "miss misses plunge tumble lawsuit investigation downgrade cut warns bearish fraud halts denies recall"
).split()
# Words ignored when headlines are compared.
IGNORED = (
    "the a an and or of to for in on at by with from as is are was be this that "
    "its it s inc corp co ltd plc said says new update"
).split()


def words(list_of: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in list_of])


def hits(tokens: Column, vocabulary: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*vocabulary)))


def lexicon_sentiment(text: str | Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative) word hits, 0 without hits."""
    c = F.col(text) if isinstance(text, str) else text
    tokens = F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0))
    up, down = hits(tokens, positive), hits(tokens, negative)
    return F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0)


def token_set(text: str | Column) -> Column:
    """Distinct lower-case tokens of two or more characters, stop words removed."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9']{2,}"), F.lit(0))
    return F.sort_array(F.array_except(found, words(IGNORED)))


def jaccard(a: str | Column, b: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
