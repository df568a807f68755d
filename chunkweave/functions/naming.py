"""Names and secrets: file names for exports, identifier styles, slugs and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkweave.functions.text import strip


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_filename(value: Column | str, suffix: str, fallback: str = "document", most: int = 120) -> Column:
    """A file name without its ending, path marks and control characters, with a suffix."""
    stem = F.regexp_replace(F.coalesce(_c(value), F.lit("")), r"\.[A-Za-z0-9]{1,5}$", "")
    clean = strip(F.regexp_replace(stem, r'[\\/:*?"<>|\x00-\x1f]+', "_"))
    return F.concat(F.left(F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback)), F.lit(most)), F.lit(suffix))


def slug(value: Column | str, fallback: str, most: int = 50) -> Column:
    """The stripped text cut to ``most`` characters, or the fallback where nothing is left."""
    return F.left(F.coalesce(F.nullif(strip(F.coalesce(_c(value), F.lit(""))), F.lit("")), F.lit(fallback)), F.lit(most))


def camel_case(value: Column | str) -> Column:
    """``snake_case`` as ``camelCase``."""
    parts = F.split(_c(value), "_")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def mask_middle(value: Column | str, head: int, tail: int) -> Column:
    """The first and last characters with stars between; short values become stars only."""
    col = _c(value)
    n = F.length(col)
    return F.when(n <= head + tail, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(col, F.lit(head)), F.lit("****"), F.right(col, F.lit(tail))))


def mask_address(value: Column | str) -> Column:
    """E-mail and IPv4 addresses inside a text made unreadable."""
    mail = F.regexp_replace(_c(value), r"([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")
    return F.regexp_replace(mail, r"\b(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}\b", "$1.$2.*.*")


def vector_text(value: Column | str) -> Column:
    """Numbers with six decimals, joined by commas."""
    return F.array_join(F.transform(_c(value), lambda x: F.format_string("%.6f", x.cast("double"))), ",")
