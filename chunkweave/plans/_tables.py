"""Views of the test tables shared by the plans, and the same views as SQL.

Ids are written in several spellings; every view gives them in their canonical form, so that joins lose no link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.ids import canonical_related, canonical_uuid
from chunkweave.runtime import broadcast_if_small, first_rows, table


def chunks(spark: SparkSession, sf_dir: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Chunks, each id once (the earliest delivery), with the columns asked for.

    ``where``: a filter on columns in which the deliveries of a chunk agree; it reaches the scan.
    """
    wanted = ["id", *[c for c in columns if c != "id"]]
    own = table(spark, sf_dir, "tmp_chunks_upload").select(*dict.fromkeys([*wanted, "created_at"]))
    own = own if where is None else own.filter(where)
    once = first_rows(own.withColumn("id", canonical_uuid("id")), "id", "created_at").select(*wanted)
    if "related_ids" in wanted:
        once = once.withColumn("related_ids", F.to_json(canonical_related("related_ids")))
    return once.withColumn("parent_id", canonical_uuid("parent_id")) if "parent_id" in wanted else once


def uuid_sql(x: str) -> str:
    """The SQL form of a canonical id: 32 hexadecimal digits in groups, not all zero; else null."""
    shape = "\\s*\\{?\\s*[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\\s*\\}?\\s*"
    hexa = f"lower(regexp_replace({x}, '[^0-9a-fA-F]', '', 'g'))"
    return f"""CASE WHEN regexp_full_match({x}, '{shape}') AND regexp_matches({x}, '[1-9a-fA-F]') THEN regexp_replace({hexa}, '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') END"""


_LIST = "CASE WHEN json_valid(related_ids) AND json_type(related_ids) = 'ARRAY' THEN CAST(json(CASE WHEN json_valid(related_ids) THEN related_ids END) AS VARCHAR[]) ELSE [related_ids] END"
_ONCE = "list_transform(list_filter(list_zip(l, range(len(l))), lambda z: z[1] IS NOT NULL AND list_position(l, z[1]) = z[2] + 1), lambda z: z[1])"
CHUNKS = f"""(SELECT * EXCLUDE (l) REPLACE (CAST(to_json({_ONCE}) AS VARCHAR) AS related_ids) FROM (
  SELECT * REPLACE ({uuid_sql('id')} AS id, {uuid_sql('parent_id')} AS parent_id), list_transform({_LIST}, lambda x: {uuid_sql('x')}) AS l FROM tmp_chunks_upload
  QUALIFY row_number() OVER (PARTITION BY {uuid_sql('id')} ORDER BY created_at) = 1) WHERE id IS NOT NULL)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = first_rows(table(spark, sf_dir, "tmp_chunk_relations_upload"), "id", "created_at")
    return once.withColumns({c: canonical_uuid(c) for c in ("src_id", "dst_id")})


RELATIONS = f"""(SELECT * REPLACE ({uuid_sql('src_id')} AS src_id, {uuid_sql('dst_id')} AS dst_id) FROM tmp_chunk_relations_upload
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(table(spark, sf_dir, "tmp_kg_triples_upload"), "id", "created_at").withColumn("source_chunk", canonical_uuid("source_chunk"))


TRIPLES = f"(SELECT * REPLACE ({uuid_sql('source_chunk')} AS source_chunk) FROM tmp_kg_triples_upload QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks seen as content blocks of their documents.

    A chunk without a document belongs to the one document of its source; where that is unknown, to a document made of the
    source, and without a source it is a document by itself.
    """
    own = chunks(spark, sf_dir, "content", "document_id", "source", "page", "chunk_index", "layer", "is_table_chunk", "is_image_chunk", "image_path")
    narrow = chunks(spark, sf_dir, "document_id", "source").filter("document_id IS NOT NULL AND source IS NOT NULL")
    named = narrow.groupBy("source").agg(F.min("document_id").alias("named"), F.max("document_id").alias("other")).filter("named = other").select("source", "named")
    own = own.join(broadcast_if_small(named), "source", "left")
    document = F.coalesce("document_id", "named", F.concat(F.lit("source:"), "source"), F.concat(F.lit("chunk:"), "id"))
    kind = F.when(F.col("is_table_chunk"), "table").when(F.col("is_image_chunk"), "image").when(F.col("layer") == "parent", "title").otherwise("text")
    return own.filter("layer != 'enhanced'").select(
        "id",
        document.alias("doc_id"),
        F.col("chunk_index").alias("block_pos"),
        kind.alias("type"),
        F.col("content").alias("text"),
        F.col("page").alias("page_idx"),
        F.col("source").alias("source_file"),
        F.coalesce("is_table_chunk", F.lit(False)).alias("is_table"),
        F.lit(None).cast("string").alias("table_html"),
        "image_path",
    )


BLOCKS = f"""(SELECT c.id, coalesce(document_id, named, 'source:' || c.source, 'chunk:' || c.id) AS doc_id, chunk_index AS block_pos,
  CASE WHEN is_table_chunk THEN 'table' WHEN is_image_chunk THEN 'image' WHEN layer = 'parent' THEN 'title' ELSE 'text' END AS type,
  content AS text, page AS page_idx, coalesce(is_table_chunk, false) AS is_table, image_path
  FROM {CHUNKS} c LEFT JOIN (SELECT source, any_value(document_id) AS named FROM tmp_chunks_upload WHERE source IS NOT NULL GROUP BY source HAVING count(DISTINCT document_id) = 1) n ON n.source = c.source
  WHERE layer <> 'enhanced')"""


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^[\\s\\x{{3000}}\\x{{00A0}}]+|[\\s\\x{{3000}}\\x{{00A0}}]+$', '', 'g')"
