"""Typed relations between chunks.

Chunks have ``doc_id, idx, id, content, layer, parent_id, is_table_chunk, is_image_chunk``; ``idx`` is their order.
Every linker returns rows ``src_id, dst_id, rel_type, weight, source, evidence``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.text import media_number, strip

COLUMNS = ("src_id", "dst_id", "rel_type", "weight", "source", "evidence")
# Numbers of figures and tables, words of cause and of order.
NUMBER = r"[0-9０-９]+(?:\s*[-－–—]\s*[0-9０-９]+){0,6}"
CAUSES = ("因为", "由于", "鉴于", "导致", "使得", "引起", "造成", "所以", "因此")
ORDER = r"^(?:第)?([0-9一二三四五六七八九十]+)(?:步|\.|\))"
HEADS = ("首先", "接着", "然后", "随后", "最后", "紧接着", "之后", "最终", "step")


def _is_text() -> Column:
    media = F.coalesce(F.col("is_table_chunk"), F.lit(False)) | F.coalesce(F.col("is_image_chunk"), F.lit(False))
    return ~media & ~F.coalesce(F.col("layer"), F.lit("child")).isin("parent", "enhanced")


def _relations(pairs: DataFrame, rel_type: Column | str, back: Column | str | None, weight: Column | float = 1.0, source: str = "rule") -> DataFrame:
    """Relations of ``a, b, evidence``; with ``back`` also the reverse ones, from the same scan."""
    kind = lambda k: F.lit(k) if isinstance(k, str) else k
    weight = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    ways = [F.struct(F.col("a").alias("src_id"), F.col("b").alias("dst_id"), kind(rel_type).alias("rel_type"))]
    if back is not None:
        ways.append(F.struct(F.col("b").alias("src_id"), F.col("a").alias("dst_id"), kind(back).alias("rel_type")))
    out = pairs.select(F.explode(F.array(*ways)).alias("r"), weight.alias("weight"), F.lit(source).alias("source"), F.left("evidence", F.lit(20)).alias("evidence"))
    return out.select("r.*", "weight", "source", "evidence")


def media_references(chunks: DataFrame) -> DataFrame:
    """Text chunks that name a figure or table, linked both ways with the first chunk bearing its number."""
    parts = []
    for mark, flag in (("图", "is_image_chunk"), ("表", "is_table_chunk")):
        labels = F.regexp_extract_all(F.left("content", F.lit(300)), F.lit(f"{mark}\\s*({NUMBER})"), F.lit(1))
        bearing = chunks.filter(F.col(flag)).select("doc_id", "idx", "id", F.explode(labels).alias("label"))
        first = bearing.withColumn("key", media_number("label")).groupBy("doc_id", "key").agg(F.min_by("id", "idx").alias("b"))
        named = F.regexp_extract_all("content", F.lit(f"((?:如\\s*)?{mark}\\s*{NUMBER})"), F.lit(1))
        texts = chunks.filter(_is_text()).select("doc_id", F.col("id").alias("a"), F.posexplode(named).alias("at", "evidence"))
        keyed = texts.withColumn("key", media_number(F.regexp_extract("evidence", NUMBER, 0)))
        once = keyed.groupBy("doc_id", "a", "key").agg(F.min_by("evidence", "at").alias("evidence"))
        parts.append(once.join(first, ["doc_id", "key"]).select("a", "b", "evidence"))
    # Two numbers that lead to the same chunk give one relation.
    pairs = parts[0].unionByName(parts[1]).groupBy("a", "b").agg(F.min("evidence").alias("evidence"))
    return _relations(pairs, "refers_to", "refers_to")


def adjacent_media(chunks: DataFrame, look_back: int = 4, related: DataFrame | None = None) -> DataFrame:
    """Media chunks without relations (``related.id``), linked with the nearest text among the ``look_back`` chunks before."""
    near = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(-look_back, -1)
    seen = chunks.withColumn("b", F.last(F.when(_is_text(), F.col("id")), ignorenulls=True).over(near))
    media = seen.filter((F.col("is_table_chunk") | F.col("is_image_chunk")) & F.col("b").isNotNull())
    if related is not None:
        media = media.join(related.select("id").distinct(), "id", "left_anti")
    return _relations(media.select(F.col("id").alias("a"), "b", F.lit("前文").alias("evidence")), "adjacent", "adjacent")


def siblings(chunks: DataFrame) -> DataFrame:
    """Media and text children of the same parent, linked both ways."""
    children = chunks.filter("layer = 'child' AND parent_id IS NOT NULL AND parent_id != ''")
    media = children.filter("is_table_chunk OR is_image_chunk").select("doc_id", "parent_id", F.col("id").alias("a"))
    texts = children.filter(_is_text()).select("doc_id", "parent_id", F.col("id").alias("b"))
    return _relations(media.join(texts, ["doc_id", "parent_id"]).withColumn("evidence", F.lit("同节")), "sibling", "sibling")


def inherited(chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations of a child given to its enhanced chunk."""
    grown = chunks.filter("layer = 'enhanced' AND parent_id IS NOT NULL").select(F.col("id").alias("new_id"), F.col("parent_id").alias("src_id"))
    child = chunks.filter("layer = 'child'").select(F.col("id").alias("src_id"))
    return relations.join(grown, "src_id").join(child, "src_id", "left_semi").withColumn("src_id", F.col("new_id")).select(*COLUMNS)


def unique_relations(relations: DataFrame, order: str | None = None) -> DataFrame:
    """The first relation (by ``order``) of each source, target and type; weights are clamped to 0..1 within rounding."""
    keys = ["src_id", "dst_id", "rel_type"]
    others = [c for c in relations.columns if c not in keys]
    by = F.col(order) if order else F.struct(*others)
    first = relations.groupBy(*keys).agg(F.min_by(F.struct(*others), by).alias("r")).select(*keys, "r.*")
    w = F.col("weight")
    clamped = F.when((w < 0) & (w >= -1e-9), 0.0).when((w > 1) & (w <= 1 + 1e-9), 1.0).otherwise(w)
    return first.withColumn("weight", clamped)


def procedure_order(content: Column | str) -> Column:
    """Number of a step; 999 for a step without a usable number, null for no step."""
    text = F.col(content) if isinstance(content, str) else content
    head = F.lower(strip(F.left(text, F.lit(80))))
    number = F.regexp_extract(head, ORDER, 1)
    han = F.instr(F.lit("一二三四五六七八九十"), number)
    value = F.when(number.rlike("^[0-9]{1,9}$"), number.cast("int")).when(F.length(number) == 1, han)
    is_step = head.rlike(ORDER) | reduce(lambda a, b: a | b, [head.startswith(h) for h in HEADS])
    return F.when(is_step, F.coalesce(F.nullif(value, F.lit(0)), F.lit(999)))


def procedure_links(chunks: DataFrame) -> DataFrame:
    """Consecutive steps of one parent: ``next_step`` and ``prev_step``."""
    steps = chunks.filter("layer = 'child' AND parent_id IS NOT NULL").withColumn("step", procedure_order("content")).filter("step IS NOT NULL")
    order = Window.partitionBy("doc_id", "parent_id").orderBy("step", "idx")
    following = steps.select(F.col("id").alias("a"), F.lead("id").over(order).alias("b"), F.left(F.coalesce("content", F.lit("")), F.lit(20)).alias("evidence"))
    return _relations(following.filter("b IS NOT NULL"), "next_step", "prev_step")


def causal_links(chunks: DataFrame) -> DataFrame:
    """A child that opens with a word of cause, and the child before it unless both have different parents."""
    children = chunks.filter("layer = 'child'")
    order = Window.partitionBy("doc_id").orderBy("idx")
    before = children.select(
        F.col("id").alias("b"), F.lag("id").over(order).alias("a"), "parent_id", F.lag("parent_id").over(order).alias("before"), F.left("content", F.lit(200)).alias("head")
    )
    same = F.col("parent_id").isNull() | F.col("before").isNull() | (F.col("parent_id") == F.col("before"))
    word = F.regexp_extract("head", "|".join(CAUSES), 0)
    pairs = before.filter(F.col("a").isNotNull() & same & (word != "")).select("a", "b", word.alias("evidence"))
    return _relations(pairs, "cause_of", "effect_of", 0.7)


def similar_pairs(
    vectors: DataFrame, key: str, vec: str, group: str | None, least: float = 0.85, k: int = 10, queries: Column | None = None, block: int = 2000
) -> DataFrame:
    """``a, b, sim``: for each query row its ``k`` nearest rows with cosine of at least ``least``, exactly.

    Rows with the same non-null ``group`` are no neighbours. Query rows and all rows meet in pairs of blocks,
    one matrix product each; only the best ``k`` of a block pair leave it. Rows without a usable vector
    take no part. Cost is queries x rows: for all rows against all use an index.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).alias("v"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"), (queries if queries is not None else F.lit(True)).alias("asks"))
    rows = rows.filter("id IS NOT NULL AND size(v) > 0")
    counted = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    # As many blocks of asking rows as those fill: an answering row is copied once for each.
    sides = [max(1, -(-counted[c] // block)) for c in ("q", "n")]
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = rows.filter("asks").select("id", "v", "g", "asks", place(sides[0]).alias("i"), every(sides[1]).alias("j"))
    answering = rows.select("id", "v", "g", F.lit(False).alias("asks"), every(sides[0]).alias("i"), place(sides[1]).alias("j"))
    kind = rows.schema["id"].dataType.simpleString()

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
        x = np.nan_to_num(x)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        asks = pdf["asks"].to_numpy()
        ids, groups = pdf["id"].to_numpy(), pdf["g"].to_numpy()
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        sims = x[q] @ x[r].T if len(q) and len(r) else np.zeros((len(q), len(r)))
        out_a, out_b, out_s = [], [], []
        for m, own in enumerate(q):
            ok = (sims[m] >= least) & (ids[r] != ids[own])
            if groups[own] is not None:
                ok &= groups[r] != groups[own]
            hit = np.flatnonzero(ok)
            for h in sorted(hit, key=lambda z: (-sims[m, z], ids[r[z]]))[:k]:
                out_a.append(ids[own])
                out_b.append(ids[r[h]])
                out_s.append(float(sims[m, h]))
        return pd.DataFrame({"a": pd.Series(out_a, dtype=object if kind == "string" else "int64"), "b": pd.Series(out_b, dtype=object if kind == "string" else "int64"), "sim": pd.Series(out_s, dtype="float64")})

    found = asking.unionByName(answering).groupBy("i", "j").applyInPandas(best, f"a {kind}, b {kind}, sim double")
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("a", "b", "sim")


def semantic_links(pairs: DataFrame, duplicate: float = 0.95) -> DataFrame:
    """Relations of ``a, b, sim`` in both directions, each once, with the higher similarity."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    kind = F.when(F.col("sim") >= duplicate, "duplicate_of").otherwise("semantic_similar")
    evidence = F.concat(F.lit("cos="), F.format_string("%.3f", "sim"))
    return both.select(F.col("a").alias("src_id"), F.col("b").alias("dst_id"), kind.alias("rel_type"), F.col("sim").alias("weight"), F.lit("embedding").alias("source"), evidence.alias("evidence"))


def migrated_relations(chunks: DataFrame) -> DataFrame:
    """Relations from the older ``related_ids``: sibling under the same parent, else adjacent; unknown targets are left out."""
    own = chunks.select(F.col("id").alias("src_id"), "parent_id", "related_ids")
    listed = own.select("src_id", "parent_id", F.explode(F.array_distinct(F.from_json("related_ids", "array<string>"))).alias("dst_id"))
    known = chunks.select(F.col("id").alias("dst_id"), F.col("parent_id").alias("other_parent"))
    joined = listed.filter("dst_id != src_id").join(known, "dst_id")
    return joined.select("src_id", "dst_id", F.when(F.col("parent_id") == F.col("other_parent"), "sibling").otherwise("adjacent").alias("rel_type"))
