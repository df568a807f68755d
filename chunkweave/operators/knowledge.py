"""Entities, mentions and the graph around them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.text import shortened, strip
from chunkweave.operators.components import connected_components
from chunkweave.runtime import written

# Kinds of entities.
ENTITY_TYPES = ("Concept", "Standard", "Equipment", "Process", "Hazard", "Person", "Organization", "Location", "Unknown")

#: Rows that one task merges, about; a component is never split.
MERGED_ROWS = 5_000


def merge_entities(raw: DataFrame, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """``kb_id, entity_no, name, type, aliases, source_chunks`` from ``kb_id, seq, name, type, aliases, source_chunk``.

    In the order of ``seq`` each entity joins the first one of its type that shares a name or alias with it,
    whatever the case; the longest of the two names stays the name. Blank names are dropped.
    Exact repetitions are folded before the sequential step, and only rows connected by a shared name or alias take part in
    one sequence, as no others can meet; so a base that holds most rows is no single task.
    """
    name = strip(F.regexp_replace("name", r"\s+", " "))
    kind = F.when(F.col("type").isin(*types), F.col("type")).otherwise("Unknown")
    cleaned = raw.select("kb_id", "seq", name.alias("name"), kind.alias("type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "source_chunk").filter("name != ''")
    folded = cleaned.groupBy("kb_id", "type", "name", "aliases").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_set("source_chunk")).alias("chunks"))
    folded = written(folded.withColumn("node", F.monotonically_increasing_id()), "spellings")
    # At least as coarse as the comparison in the sequence: what that holds for equal is connected.
    key = lambda a: F.trim(F.lower(F.upper(F.regexp_replace(a, r"(?U)[\s\x1c-\x1f]+", " "))))
    names = F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), "aliases"), key), lambda a: a != ""))
    named = folded.select("kb_id", "type", "node", F.explode(names).alias("n"))
    hub = named.groupBy("kb_id", "type", "n").agg(F.min("node").alias("hub"), F.count("*").alias("times")).filter("times > 1")
    same = [named[c].eqNullSafe(hub[c]) for c in ("kb_id", "type", "n")]
    edges = named.join(hub, same[0] & same[1] & same[2]).select(F.col("hub").alias("u"), F.col("node").alias("v"))
    parts = connected_components(edges)
    # Whole components share a task with others until it has about ``MERGED_ROWS`` rows.
    tasks = max(1, -(-folded.count() // MERGED_ROWS))
    placed = folded.join(parts, "node", "left").withColumn("task", F.pmod(F.xxhash64(F.coalesce("component", "node")), F.lit(tasks)))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[dict] = []
        index: dict[tuple, int] = {}  # base, type and folded name -> the earliest entity that knows it
        for row in pdf.sort_values("seq").itertuples(index=False):
            names = [row.name, *(" ".join(a.split()) for a in row.aliases if a and a.strip())]
            keys = [(row.kb_id, row.type, n.casefold()) for n in names]
            known = [index[k] for k in keys if k in index]
            if known:
                entity = found[min(known)]
                entity["name"] = max((entity["name"], row.name), key=len)
            else:
                entity = {"no": len(found), "kb": row.kb_id, "type": row.type, "seq": row.seq, "name": row.name, "names": {}, "chunks": {}}
                found.append(entity)
            for n, k in zip(names, keys):
                entity["names"].setdefault(n.casefold(), n)
                index[k] = min(entity["no"], index.get(k, entity["no"]))
            entity["chunks"].update(dict.fromkeys(c for c in row.chunks if c is not None))
        rows = [(e["kb"], e["seq"], e["name"], e["type"], [n for f, n in e["names"].items() if f != e["name"].casefold()], list(e["chunks"])) for e in found]
        return pd.DataFrame(rows, columns=["kb_id", "seq", "name", "type", "aliases", "source_chunks"])

    merged = placed.groupBy("task").applyInPandas(merge, "kb_id string, seq bigint, name string, type string, aliases array<string>, source_chunks array<string>")
    # Numbers from 0 in the order of the first mention; rows of one base and type are sorted, not gathered.
    order = Window.partitionBy("kb_id", "type").orderBy("seq", "name")
    return merged.withColumn("entity_no", F.row_number().over(order) - 1).select("kb_id", "entity_no", "name", "type", "aliases", "source_chunks")


def define_entities(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``kb_id, name, definition`` from ``kb_id, name, source_chunk`` and ``id, content``.

    The first sentence of the first source chunk that has text; cut to 120 characters if it holds the name, else
    the name and its first 100.
    """
    texts = chunks.select(F.col("id").alias("source_chunk"), strip(F.regexp_replace("content", r"\s+", " ")).alias("flat")).filter("flat != ''")
    sentence = F.substring_index(F.substring_index("flat", "。", 1), "；", 1)
    cut = F.when(F.instr(sentence, F.col("name")) > 0, F.left(sentence, F.lit(120))).otherwise(F.concat("name", F.lit("："), F.left(sentence, F.lit(100))))
    joined = mentions.join(texts, "source_chunk").withColumn("definition", cut)
    return joined.groupBy("kb_id", "name").agg(F.min_by("definition", "source_chunk").alias("definition"))


def chunk_entities(mentions: DataFrame) -> DataFrame:
    """``chunk_id, entities``: the distinct names of each chunk in order (bounded by what one chunk mentions)."""
    return mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("entities"))


def _graph_candidates(chunks: DataFrame, triples: DataFrame, most: int, mentions: DataFrame | None) -> DataFrame:
    """Every node of a document in the order of insertion: ``doc_id, node_id, node_type, label, n``."""
    kind = F.when(F.col("is_table_chunk"), "table").when(F.col("is_image_chunk"), "image").otherwise("text")
    label = shortened(F.coalesce(F.nullif(strip(F.coalesce("title", F.lit(""))), F.lit("")), F.col("content"), F.lit("")), 32)
    own = chunks.select("doc_id", F.col("id").alias("node_id"), kind.alias("node_type"), label.alias("label"), F.lit(0).alias("rank"), F.col("idx").cast("long").alias("at"))
    placed = own.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "node_id"))).filter(F.col("n") <= most)
    shown = placed.select("doc_id", F.col("node_id").alias("chunk_id"))
    known = triples.join(shown, ["doc_id", "chunk_id"], "left_semi") if "chunk_id" in triples.columns else triples
    order = [F.desc_nulls_first("confidence"), "s", "p", "o"] if {"confidence", "p"} <= set(triples.columns) else []
    line = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) if order else F.lit(0)
    terms = known.withColumn("line", line).select("doc_id", F.col("line").cast("long"), F.posexplode(F.array("s", "o")).alias("end", "term")).filter("term IS NOT NULL AND term != ''")
    first = terms.groupBy("doc_id", "term").agg(F.min(F.col("line") * 2 + F.col("end") if order else F.lit(0).cast("long")).alias("at"))
    named = first.select("doc_id", F.concat(F.lit("term:"), "term").alias("node_id"), F.lit("triple_term").alias("node_type"), shortened("term", 32).alias("label"), F.lit(2).alias("rank"), "at")
    every = own.unionByName(named)
    if mentions is not None:
        met = mentions.join(shown, ["doc_id", "chunk_id"], "left_semi").groupBy("doc_id", "entity_id").agg(F.min("name").alias("name"))
        at = F.row_number().over(Window.partitionBy("doc_id").orderBy("name", "entity_id")).cast("long")
        every = every.unionByName(met.select("doc_id", F.concat(F.lit("entity:"), "entity_id").alias("node_id"), F.lit("entity").alias("node_type"), F.col("name").alias("label"), F.lit(1).alias("rank"), at.alias("at")))
    return every.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "at", "node_id"))).select("doc_id", "node_id", "node_type", "label", "n")


def graph_nodes(chunks: DataFrame, triples: DataFrame, most: int, mentions: DataFrame | None = None) -> DataFrame:
    """``doc_id, node_id, node_type, label``: chunks, then entities, then terms of triples, at most ``most`` per document.

    ``chunks``: ``doc_id, id, idx, title, content, is_table_chunk, is_image_chunk``; ``triples``: ``doc_id, s, o`` and,
    where known, ``chunk_id, p, confidence`` (surest first); ``mentions``: ``doc_id, chunk_id, entity_id, name``.
    Entities and terms come only from chunks that are shown.
    """
    return _graph_candidates(chunks, triples, most, mentions).filter(F.col("n") <= most).drop("n")


def graph_edges(nodes: DataFrame, relations: DataFrame, triples: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """``doc_id, src, dst, edge_type`` between nodes that are shown: relations, triples, their sources and mentions.

    A triple with a ``chunk_id`` hangs on that chunk by its subject, as long as its object is shown too.
    """
    shown = nodes.select("doc_id", "node_id")

    def within(edges: DataFrame, *ends: str) -> DataFrame:
        for end in ends:
            edges = edges.join(shown.withColumnRenamed("node_id", end), ["doc_id", end], "left_semi")
        return edges

    def edge(df: DataFrame, src: str, dst: str, kind) -> DataFrame:
        return df.select("doc_id", F.col(src).alias("src"), F.col(dst).alias("dst"), kind.alias("edge_type"))

    terms = triples.select(*[c for c in ("doc_id", "chunk_id") if c in triples.columns], F.concat(F.lit("term:"), "s").alias("s"), F.concat(F.lit("term:"), "o").alias("o"))
    terms = within(terms, "s", "o", *(["chunk_id"] if "chunk_id" in triples.columns else []))
    every = within(edge(relations, "src_id", "dst_id", F.col("rel_type")), "src", "dst")
    every = every.unionByName(edge(terms, "s", "o", F.lit("triple")))
    if "chunk_id" in triples.columns:
        every = every.unionByName(edge(terms, "chunk_id", "s", F.lit("triple_source")))
    if mentions is not None:
        met = mentions.withColumn("entity_id", F.concat(F.lit("entity:"), "entity_id"))
        every = every.unionByName(within(edge(met, "chunk_id", "entity_id", F.lit("mentions")), "src", "dst"))
    return every.select("doc_id", "src", "dst", "edge_type").distinct()


def graph_stats(chunks: DataFrame, triples: DataFrame, most: int, mentions: DataFrame | None = None) -> DataFrame:
    """``doc_id, nodes, chunks, entities, dropped, truncated`` of the graph of each document.

    ``chunks``: all of the document; ``entities``: the shown nodes that are no chunks; ``dropped``: nodes beyond ``most``.
    """
    kept = F.col("n") <= most
    thing = F.col("node_type").isin("entity", "triple_term")
    counted = _graph_candidates(chunks, triples, most, mentions).groupBy("doc_id").agg(
        F.count_if(kept).alias("nodes"), F.count_if(~thing).alias("chunks"), F.count_if(kept & thing).alias("entities"), F.count_if(~kept).alias("dropped")
    )
    return counted.withColumn("truncated", F.col("dropped") > 0)


def graph_seeds(relations: DataFrame, most: int, chunks: DataFrame | None = None) -> DataFrame:
    """``kb_id, chunk_id, pos``: the first ``most`` ends of the heaviest relations of each base, each once.

    ``relations``: ``kb_id, id, src_id, dst_id, weight``; four times as many relations as nodes are looked at.
    A base with fewer ends is topped up with ``chunks`` (``kb_id, id, document_id, chunk_index, created_at, updated_at``),
    those of the documents updated last first.
    """
    heavy = Window.partitionBy("kb_id").orderBy(F.desc_nulls_last("weight"), "id")
    top = relations.withColumn("r", F.row_number().over(heavy)).filter(F.col("r") <= 4 * most)
    ends = top.select("kb_id", "r", F.posexplode(F.array("src_id", "dst_id")).alias("end", "chunk_id")).filter("chunk_id IS NOT NULL")
    first = ends.groupBy("kb_id", "chunk_id").agg(F.min(F.col("r") * 2 + F.col("end")).cast("long").alias("at"))
    if chunks is not None:
        recent = Window.partitionBy("kb_id").orderBy(F.desc_nulls_last("updated_at"), F.asc_nulls_last("document_id"), F.asc_nulls_last("chunk_index"), F.asc_nulls_last("created_at"), "id")
        # As many are enough: at least ``most`` less the ends found are not among those.
        rest = chunks.filter("kb_id IS NOT NULL").withColumn("r", F.row_number().over(recent)).filter(F.col("r") <= most)
        more = rest.select("kb_id", F.col("id").alias("chunk_id"), (F.col("r") + 8 * most + 2).cast("long").alias("at"))
        first = first.unionByName(more).groupBy("kb_id", "chunk_id").agg(F.min("at").alias("at"))
    order = Window.partitionBy("kb_id").orderBy("at")
    return first.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most).select("kb_id", "chunk_id", "pos")
