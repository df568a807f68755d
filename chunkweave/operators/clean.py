"""Cleaning rules over content blocks and the quality gate over chunks.

Blocks have ``doc_id, block_pos, type, text, page_idx, is_table, image_path``; ``type`` is one of text, title, table
and image. All rules become one projected column, the first rule that removes a block, so a pipeline of
any length is a single pass; only the repeated-image rule needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.text import punctuation_ratio, strip

# Notices that make a short block an advertisement or a copyright line.
NOTICES = (
    r"[Cc]opyright\s*[©(c)]*\s*\d{4}",
    r"All\s+[Rr]ights\s+[Rr]eserved",
    r"版权所有",
    r"未经.*许可.*不得",
    r"https?://\S+",
)

_RULES: dict[str, callable] = {}


def register_rule(name: str):
    """Register a rule: a function from options to the Column that is true for blocks to remove."""

    def add(rule):
        _RULES[name] = rule
        return rule

    return add


def _media() -> Column:
    return F.coalesce(F.col("is_table"), F.lit(False)) | (F.col("type") == "image")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


@register_rule("remove_empty")
def _empty(**_) -> Column:
    return ~_media() & (F.length(strip(_text())) < 3)


@register_rule("remove_short")
def _short(min_chars: int = 10, **_) -> Column:
    return ~_media() & (F.col("type") != "title") & (F.length(strip(_text())) < min_chars)


@register_rule("remove_punctuation")
def _punctuation(max_punct: float = 0.8, **_) -> Column:
    return ~_media() & (strip(_text()) != "") & (punctuation_ratio(_text()) > max_punct)


@register_rule("remove_copyright")
def _copyright(notice_chars: int = 200, **_) -> Column:
    return (F.col("type") != "image") & (F.length(_text()) < notice_chars) & _text().rlike("|".join(NOTICES))


RUNTIME_RULES = ("remove_empty", "remove_short", "remove_punctuation", "remove_copyright")
FULL_RULES = (*RUNTIME_RULES, "remove_duplicate_images")


def clean_blocks(blocks: DataFrame, rules: Sequence[str] = FULL_RULES, **options) -> DataFrame:
    """Add ``removed_by``: the first rule that removes the block, null for a block that stays.

    A repeated image (same document and page, same path or, without one, same text) keeps its first block.
    """
    label = F.lit(None).cast("string")
    for name in reversed([r for r in rules if r != "remove_duplicate_images"]):
        label = F.when(_RULES[name](**options), name).otherwise(label)
    out = blocks.withColumn("removed_by", label)
    if "remove_duplicate_images" in rules:
        key = F.coalesce(F.nullif(F.col("image_path"), F.lit("")), strip(_text()))
        stays = (F.col("type") == "image") & F.col("removed_by").isNull()
        images = Window.partitionBy("doc_id", "page_idx", key).orderBy("block_pos")
        # Only images are shuffled.
        first = out.filter(stays).withColumn("__n", F.row_number().over(images))
        first = first.withColumn("removed_by", F.when(F.col("__n") > 1, "remove_duplicate_images")).drop("__n")
        out = out.filter(~F.coalesce(stays, F.lit(False))).unionByName(first)
    return out


def removed_by_rule(cleaned: DataFrame) -> DataFrame:
    """Removed blocks per rule."""
    return cleaned.filter("removed_by IS NOT NULL").groupBy("removed_by").agg(F.count("*").alias("removed"))


def removed_previews(cleaned: DataFrame, most: int = 60) -> DataFrame:
    """Audit rows of removed blocks with the start of their text, or the image path."""
    preview = F.left(strip(_text()), F.lit(most))
    return cleaned.filter("removed_by IS NOT NULL").select(
        "doc_id", "block_pos", "removed_by", F.when(preview == "", F.coalesce("image_path", F.lit(""))).otherwise(preview).alias("preview")
    )


def quality_gate(chunks: DataFrame, text: str, max_punct: float = 0.9, score: Column | None = None, min_score: int = 3) -> DataFrame:
    """Add ``passed`` to chunks with ``is_table_chunk, is_image_chunk``; ``score`` (1..5) may come from a model.

    Tables and images always pass; a missing score counts as 3.
    """
    media = F.coalesce(F.col("is_table_chunk"), F.lit(False)) | F.coalesce(F.col("is_image_chunk"), F.lit(False))
    fine = F.coalesce(punctuation_ratio(F.coalesce(F.col(text), F.lit(""))) <= max_punct, F.lit(True))
    if score is not None:
        fine = fine & (F.least(F.greatest(F.coalesce(score, F.lit(3)), F.lit(1)), F.lit(5)) >= min_score)
    return chunks.withColumn("passed", media | fine)


def gate_breakdown(gated: DataFrame) -> DataFrame:
    return gated.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("discarded"))
