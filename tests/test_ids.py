"""Ids in any spelling meet, and chunks without a document stay apart."""

import os

import pytest
from pyspark.sql import functions as F

from chunkweave.functions.ids import canonical_related, canonical_uuid
from chunkweave.plans import _tables

A, B = "0a1b2c3d-0000-4000-8000-00000000000a", "0a1b2c3d-0000-4000-8000-00000000000b"
SPELLINGS = [A.upper(), A.replace("-", ""), "{" + A + "}", f"  {A}\t"]
CASES = [(s, A) for s in SPELLINGS] + [(A[:-1], None), ("", None), (None, None), ("00000000-0000-0000-0000-000000000000", None), ("x" + A, None)]


def test_spellings_of_an_id(spark):
    df = spark.createDataFrame(CASES, "given string, want string")
    assert df.filter(~canonical_uuid("given").eqNullSafe(F.col("want"))).count() == 0


def test_spellings_of_an_id_in_sql():
    duckdb = pytest.importorskip("duckdb")
    for given, want in CASES:
        assert duckdb.execute(f"SELECT {_tables.uuid_sql('x')} FROM (SELECT ?::VARCHAR AS x)", [given]).fetchone()[0] == want


def test_related_ids(spark):
    import json

    rows = [(json.dumps([B, *SPELLINGS, None, "", "short"]), [B, A]), (A.upper(), [A]), ("null", []), ("", []), (None, []), ("[]", []), ("[broken", [])]
    df = spark.createDataFrame(rows, "given string, want array<string>")
    assert [r.got for r in df.select(canonical_related("given").alias("got")).collect()] == [w for _, w in rows]


def test_blocks_without_a_document(spark, tmp_path):
    schema = (
        "id string, content string, document_id string, source string, page int, chunk_index int, layer string, is_table_chunk boolean, is_image_chunk boolean, "
        "image_path string, created_at timestamp"
    )
    ids = [f"0a1b2c3d-0000-4000-8000-0000000000{k:02x}" for k in range(7)]
    owners = [("d1", "a.pdf"), (None, "a.pdf"), ("d2", "b.pdf"), ("d3", "b.pdf"), (None, "b.pdf"), (None, None), (None, None)]
    rows = [(i, "x", d, s, 0, k, "child", False, False, None, None) for k, (i, (d, s)) in enumerate(zip(ids, owners))]
    spark.createDataFrame(rows, schema).write.parquet(os.path.join(tmp_path, "tmp_chunks_upload.parquet"))
    got = {r.id: r.doc_id for r in _tables.blocks(spark, str(tmp_path)).collect()}
    assert [got[i] for i in ids] == ["d1", "d1", "d2", "d3", "source:b.pdf", f"chunk:{ids[5]}", f"chunk:{ids[6]}"]
