"""Problem 2: groups of near-duplicate texts by b-bit MinHash.

1. One narrow pass normalises each text and computes ``HASHES`` minima of its character shingles; only the
   low ``BITS`` bits of each are kept, packed into a signature, plus ``BANDS`` band hashes of ``ROWS`` minima.
2. Exact copies are folded by digest, so a text that fills a third of the table is one node.
3. A bucket of two gives its pair; a bucket of more first links every member to its least one. Pairs
   whose collision-corrected similarity, from the count of equal b-bit fields, may reach the threshold
   are checked exactly, and components are formed.
4. Only buckets still holding several components are compared further: split into blocks of bounded size, in
   which a component lies in one block or has blocks of its own. Only blocks of different components meet, and in
   them bit counts pick the pairs, so a component as large as the bucket beside one stray text costs no square.
No bucket is capped and no link between different components is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.operators.components import connected_components
from chunkweave.runtime import broadcast_if_small, drop_written, spread, written

HASHES, BITS, ROWS = 96, 4, 3
BANDS = HASHES // ROWS
#: Most members of one side of a block pair.
BLOCK = 512
#: Standard errors of the estimate left below the threshold before a pair is given up without an exact check.
SLACK = 4.0
_PART = 1 << 19
_PAIRS = 1 << 18
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND = (_rng.integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Mixed 32-bit hashes of all windows of ``width`` code points."""
    n = len(codes) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= np.uint64(0x100000001B3)
        h += codes[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def signatures(texts: list[str], width: int) -> np.ndarray:
    """Minima, one row of ``HASHES`` uint32 per text; texts must have at least ``width`` characters."""
    out = np.full((len(texts), HASHES), 0xFFFFFFFF, np.uint32)
    # Parts of bounded size: (text number, code points); long texts are cut with an overlap of width - 1.
    part: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal part, owner, size
        if not part:
            return
        lengths = np.array([len(p) for p in part])
        ends = np.cumsum(lengths)
        h = shingle_hashes(np.concatenate(part), width)
        keep = np.ones(len(h), bool)
        for k in range(1, width):  # windows across two texts
            at = ends[:-1] - k
            keep[at] = False
        h = h[keep]
        counts = lengths - width + 1
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        who = np.array(owner)
        buffer = np.empty_like(h)
        for k in range(HASHES):
            np.multiply(h, _A[k], out=buffer)
            buffer += _B[k]
            np.minimum.at(out[:, k], who, np.minimum.reduceat(buffer, starts))
        part, owner, size = [], [], 0

    for r, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        for begin in range(0, max(1, len(codes) - width + 1), _PART):
            piece = codes[begin : begin + _PART + width - 1]
            part.append(piece)
            owner.append(r)
            size += len(piece)
            if size >= _PART:
                flush()
    flush()
    return out


def pack(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, two fields to a byte."""
    low = (minima & np.uint32(15)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << np.uint8(4))


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    h = (rows * _BAND[None]).sum(axis=2, dtype=np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def corrected_similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: the share of equal fields, corrected for chance agreement."""
    x = left ^ right
    equal = ((x & 15) == 0).sum(axis=-1) + ((x >> 4) == 0).sum(axis=-1)
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def _least_estimate(threshold: float) -> float:
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * threshold
    return threshold - SLACK * float(np.sqrt(p * (1 - p) / HASHES)) / (1 - chance)


def exact_jaccard(a: str, b: str, width: int) -> float:
    x = {a[k : k + width] for k in range(len(a) - width + 1)}
    y = {b[k : k + width] for k in range(len(b) - width + 1)}
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def signed_texts(df: DataFrame, key: str, text: str, width: int, least_chars: int) -> DataFrame:
    """``rid, id, digest, norm, sig, bands`` of every text that takes part, as a written table."""
    norm = F.lower(F.translate(F.col(f"`{text}`").cast("string"), " \t\r\n", ""))
    fields = df.select(F.col(f"`{key}`").alias("id"), norm.alias("norm")).filter(f"id IS NOT NULL AND length(norm) >= {max(least_chars, width)}")
    fields = spread(fields).withColumn("digest", F.unhex(F.md5("norm")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = signatures(batch.column(1).to_pylist(), width)
            packed = pack(minima)
            bands = band_keys(minima)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array([row.tobytes() for row in packed], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
                ],
                ["id", "norm", "digest", "sig", "bands"],
            )

    kind = fields.schema["id"].dataType.simpleString()
    signed = fields.mapInArrow(sign, f"id {kind}, norm string, digest binary, sig binary, bands array<bigint>")
    return written(signed.withColumn("rid", F.monotonically_increasing_id()), "signed")


def _checked(pairs: DataFrame, nodes: DataFrame, sigs: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs ``(u, v)`` whose texts are alike: estimate first, exact Jaccard of the shingle sets after."""
    least = _least_estimate(threshold)
    texts = nodes.select("rid", "norm")
    sig = broadcast_if_small(sigs)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array(corrected_similarity(a, b) >= least))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [exact_jaccard(x, y, width) >= threshold for x, y in zip(a, b)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    signed = pairs.join(sig.withColumnsRenamed({"rid": "u", "sig": "su"}), "u").join(sig.withColumnsRenamed({"rid": "v", "sig": "sv"}), "v").select("u", "v", "su", "sv")
    kept = written(signed.mapInArrow(likely, "u bigint, v bigint"), "likely")
    both = (
        kept.join(texts.select(F.col("rid").alias("u"), F.col("norm").alias("tu")), "u")
        .join(texts.select(F.col("rid").alias("v"), F.col("norm").alias("tv")), "v")
        .select("u", "v", "tu", "tv")
    )
    return both.mapInArrow(alike, "u bigint, v bigint")


def _cell_pairs(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (a, b) with ``start[a] <= b < end[a]``, in parts."""
    counts = end - start
    total = np.cumsum(counts)
    begin = 0
    while begin < len(counts):
        base = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, base + _PAIRS, side="right")))
        n = counts[begin:stop]
        a = np.repeat(np.arange(begin, stop), n)
        b = np.repeat(start[begin:stop], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        if len(a):
            yield a, b
        begin = stop


def several_components(named: DataFrame) -> DataFrame:
    """``key`` of the buckets ``(key, rid, comp)`` that hold several components."""
    return named.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b").select("key")


def _cells(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """``key, i, j, own, rid, comp, sig``: each row of a bucket in every cell (pair of blocks) where it meets other components.

    A component of at least ``BLOCK`` rows has blocks of its own; the others are spread whole over mixed blocks by a
    hash of the component. The blocks of one component never meet each other.
    """
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    large = F.col("n") >= BLOCK
    own_blocks = F.when(large, F.ceil(F.col("n") / BLOCK)).otherwise(0).cast("int")
    # At most a bucket's size over BLOCK components have blocks of their own.
    big = F.sort_array(F.collect_list(F.when(large, F.struct("comp", own_blocks.alias("blocks")))))
    mixed = F.greatest(F.lit(1), F.ceil(F.sum(F.when(large, 0).otherwise(F.col("n"))) / BLOCK)).cast("int")
    layout = counts.groupBy("key").agg(big.alias("big"), mixed.alias("mixed"), F.sum(own_blocks).cast("int").alias("pure"))
    at = F.aggregate("big", F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("from"), F.lit(0).alias("blocks")), lambda s, x: F.struct(
        (s["sum"] + x["blocks"]).alias("sum"),
        F.when(x["comp"] == F.col("comp"), s["sum"]).otherwise(s["from"]).alias("from"),
        F.when(x["comp"] == F.col("comp"), x["blocks"]).otherwise(s["blocks"]).alias("blocks"),
    ))
    placed = rows.join(layout, "key").withColumn("at", at)  # the signature comes after, so that it is shuffled once
    begin = F.when(F.col("at.from") >= 0, F.col("mixed") + F.col("at.from"))
    own = F.coalesce(begin + F.pmod(F.xxhash64("rid"), F.col("at.blocks")).cast("int"), F.pmod(F.xxhash64("comp"), F.col("mixed")).cast("int"))
    every = F.sequence(F.lit(0), F.col("mixed") + F.col("pure") - 1)
    others = F.filter(every, lambda k: F.coalesce((k < begin) | (k >= begin + F.col("at.blocks")), F.lit(True)))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    met = placed.withColumn("own", own).select("key", "rid", "comp", "own", pairs.alias("cells")).join(broadcast_if_small(signatures), "rid")
    return met.select("key", F.explode("cells").alias("c"), "own", "rid", "comp", "sig").select("key", "c.i", "c.j", "own", "rid", "comp", "sig")


def _block_pairs(rows: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs across components inside buckets ``(key, rid, comp)``, with ``signatures`` ``(rid, sig)``, by pairs of blocks; many cells share a task."""
    least = _least_estimate(threshold)
    # Cells stay together in a partition and lie next to each other; only a cell cut by a batch is carried over.
    near = _cells(rows, signatures).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "comp")

    def pairs(table: pa.Table, cell: np.ndarray) -> pa.RecordBatch:
        index = np.arange(len(cell))
        i, j, own, rid, comp = (table.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
        # Rows of one block, or in a single block of one component, don't meet.
        kin = np.where(i == j, comp, own)
        cells = np.flatnonzero(np.concatenate((cell[1:] != cell[:-1], [True]))) + 1
        runs = np.flatnonzero(np.concatenate(((cell[1:] != cell[:-1]) | (kin[1:] != kin[:-1]), [True]))) + 1
        end = cells[np.searchsorted(cells, index, side="right")]
        start = runs[np.searchsorted(runs, index, side="right")]
        sig = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8).reshape(len(cell), -1)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in _cell_pairs(start, end):
            ok = corrected_similarity(sig[a], sig[b]) >= least
            us.append(np.minimum(rid[a[ok]], rid[b[ok]]))
            vs.append(np.maximum(rid[a[ok]], rid[b[ok]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            key, i, j = (table.column(k).to_numpy() for k in range(3))
            changes = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            cell = np.cumsum(changes)
            cut = int(np.flatnonzero(changes)[-1])
            if cut:
                yield pairs(table.slice(0, cut), cell[:cut])
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield pairs(rest, np.zeros(rest.num_rows, np.int64))

    return near.mapInArrow(compare, "u bigint, v bigint").distinct()


def near_duplicate_groups(
    df: DataFrame, key: str, text: str, threshold: float = 0.6, width: int = 5, least_chars: int = 100
) -> DataFrame:
    """``id, first_id, copies``: the group of each text; ``first_id`` is its smallest id, ``copies`` its size.

    Texts are compared in lower case without blanks, tabs, CR and LF by the Jaccard similarity of the sets of
    their ``width``-character substrings. Only groups of two or more ids are returned, one row per id, the
    smallest one included. Null ids, null texts and texts with fewer than ``least_chars`` characters left take
    no part; a repeated id counts once (if its texts differ, each of them links it); other columns are
    ignored. Bands of 3 rows miss a pair at exactly 0.6 with probability 0.0004, at 0.7 with 2e-6.
    """
    signed = signed_texts(df, key, text, width, least_chars)
    copies = written(signed.groupBy("digest").agg(F.min("rid").alias("rep")), "copies")
    nodes = signed.join(copies.select(F.col("rep").alias("rid")), "rid", "left_semi")
    sigs = written(nodes.select("rid", "sig"), "signatures")
    banded = nodes.select("rid", F.explode("bands").alias("key"))
    buckets = written(
        banded.groupBy("key").agg(F.count("*").alias("size"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("size > 1"), "buckets"
    )
    members = written(banded.join(broadcast_if_small(buckets.filter("size > 2").select("key", "lo")), "key"), "members")
    pairs = (
        buckets.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        .unionByName(members.filter("rid != lo").select(F.col("lo").alias("u"), F.col("rid").alias("v")))
        .distinct()
    )
    linked = written(_checked(pairs, signed, sigs, threshold, width), "linked")
    parts = written(connected_components(linked), "parts")
    named = members.select("key", "rid").join(broadcast_if_small(parts.withColumnRenamed("node", "rid")), "rid", "left").select("key", "rid", F.coalesce("component", "rid").alias("comp"))
    rest = written(named.join(several_components(named), "key", "left_semi"), "rest")
    across = written(_block_pairs(rest, sigs, threshold), "across")
    more = _checked(across, signed, sigs, threshold, width)
    final = written(connected_components(linked.unionByName(more)), "components")
    owned = signed.select("id", "digest").join(copies, "digest").select("id", F.col("rep").alias("node")).join(final, "node", "left")
    member = written(owned.select("id", F.coalesce("component", "node").alias("group")).distinct(), "owned")
    for step in (signed, sigs, copies, buckets, members, linked, parts, rest, across, final):
        drop_written(step)
    groups = member.groupBy("group").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    return member.join(groups, "group").groupBy("id").agg(F.min("first_id").alias("first_id"), F.max("copies").alias("copies"))
