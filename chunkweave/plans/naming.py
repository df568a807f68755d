"""Export names, masks and vector texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.functions import naming
from chunkweave.runtime import first_rows, table


def export_names(spark, sf_dir):
    documents = first_rows(table(spark, sf_dir, "kb_documents").select("id", "filename", "file_hash", "source_storage", "created_at"), "id", "created_at")
    return documents.select("id", naming.safe_filename("filename", "-chunks.csv").alias("name"), naming.mask_middle("file_hash", 6, 4).alias("hash"), naming.slug("source_storage", "unknown", 3).alias("storage"))


def vector_csv(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    return own.select("vec_id", F.md5(naming.vector_text("embedding")).alias("embedding"))


QUERIES = {"export_names": export_names, "vector_csv": vector_csv}
SQL = {
    "export_names": r"""SELECT id, left(coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(filename, ''), '\.[A-Za-z0-9]{1,5}$', ''), '[\\/:*?"<>|\x00-\x1f]+', '_', 'g')), ''), 'document'), 120) || '-chunks.csv' AS name,
  left(file_hash, 6) || '****' || right(file_hash, 4) AS hash, left(coalesce(nullif(trim(coalesce(source_storage, '')), ''), 'unknown'), 3) AS storage
FROM kb_documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1""",
    "vector_csv": "SELECT vec_id, md5(array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',')) AS embedding FROM embeddings",
}
