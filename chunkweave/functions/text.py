"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s　 ]"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """The text without white space at both ends."""
    return F.regexp_replace(_c(value), f"^{_BLANK}+|{_BLANK}+$", "")


def tokens(value: Column | str) -> Column:
    """Lower-case runs of Latin letters, digits and underscores, and single Han characters."""
    return F.regexp_extract_all(F.lower(_c(value)), F.lit("[a-z0-9_]+|[一-鿿]"), F.lit(0))


def punctuation_ratio(value: Column | str) -> Column:
    """Share of characters that are neither letters, digits nor white space; null for an empty text."""
    text = _c(value)
    return F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / F.nullif(F.length(text), F.lit(0))


def shortened(value: Column | str, most: int) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    flat = strip(F.regexp_replace(_c(value), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def joined_text(*parts: Column | str) -> Column:
    """The non-blank parts, stripped, joined by a blank."""
    cleaned = F.array(*[strip(F.coalesce(_c(p), F.lit(""))) for p in parts])
    return F.array_join(F.filter(cleaned, lambda x: x != ""), " ")


def media_number(value: Column | str) -> Column:
    """A figure or table number in ASCII digits without blanks and dashes."""
    ascii_digits = F.translate(_c(value), "０１２３４５６７８９", "0123456789")
    return F.regexp_replace(ascii_digits, r"[\s\-－–—]", "")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays of numbers, in double precision; null if either has no length."""
    x, y = _c(a), _c(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i.cast("double") * j), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def first_match(value: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that the text contains."""
    out = None
    for label, pattern in rules:
        hit = _c(value).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)
