"""Identifier columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = r"^\{?\s*([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\s*\}?$"
NIL = "00000000-0000-0000-0000-000000000000"


def canonical_uuid(value: Column | str) -> Column:
    """Lower-case hyphenated UUID; null for anything that is no full UUID and for the nil UUID.

    Upper case, missing hyphens, braces and blanks around the id are spellings of the same id.
    """
    col = F.col(value) if isinstance(value, str) else value
    plain = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    shaped = F.when(plain.rlike(_UUID), F.regexp_replace(plain, _UUID, "$1-$2-$3-$4-$5"))
    return F.when(shaped != NIL, shaped)


def canonical_related(column: str) -> Column:
    """Related ids as an array of canonical ids, each once, in order; text that is no JSON array counts as one id."""
    listed = F.coalesce(F.from_json(column, "array<string>"), F.array(F.col(column)))
    return F.array_distinct(F.filter(F.transform(listed, canonical_uuid), lambda x: x.isNotNull()))
