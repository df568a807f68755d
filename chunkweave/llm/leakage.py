"""Problem 7: evaluation texts inside training texts, by a distributed positional inverted index.

Texts are reduced to their letters and digits (NFKC, lower case). The index holds one posting
``(term, doc, pos)`` for each block of ``GRAM`` characters of a training text, at positions 0, GRAM,
2*GRAM, ... A test text is looked up at every offset, so any shared run of at least
``GRAM * (CHAIN + 1) - 1`` characters covers ``CHAIN`` whole blocks in a row. For each phrase of CHAIN terms
the postings of its rarest term give the candidates; the other lists are intersected after adjusting
for the offset. Surviving diagonals are extended to the exact length of the run.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.runtime import broadcast_if_small, spread, written

GRAM = 10
CHAIN = 4
#: Diagonals of a text that are extended together, about.
LINES = 4096
_NOT_KEPT = regex.compile(r"[^\p{L}\p{N}]+")
# Odd multipliers of a polynomial hash modulo 2**64.
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


def letters_and_digits(text: str) -> str:
    """NFKC, lower case, Unicode categories L and N only."""
    return _NOT_KEPT.sub("", unicodedata.normalize("NFKC", text).lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def block_terms(norm: str, gram: int = GRAM) -> np.ndarray:
    """Hashes of the whole blocks at positions 0, gram, 2*gram, ..."""
    codes = _codes(norm)
    n = len(codes) // gram
    return _mix((codes[: n * gram].reshape(n, gram) + np.uint64(1)) @ _POWERS[:gram]).view(np.int64)


def sliding_terms(norm: str, gram: int = GRAM) -> np.ndarray:
    """Hashes of the blocks at every offset."""
    codes = _codes(norm)
    if len(codes) < gram:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(codes + np.uint64(1), gram)
    return _mix(windows @ _POWERS[:gram]).view(np.int64)


def longest_run(doc: str, item: str, diagonal: int) -> int:
    """Longest run of equal characters with ``doc[i + diagonal] == item[i]``."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return 0
    same = _codes(doc[lo + diagonal : hi + diagonal]) == _codes(item[lo:hi])
    breaks = np.flatnonzero(~same)
    return int(np.diff(np.concatenate(([-1], breaks, [len(same)]))).max() - 1)


def build_postings(docs: DataFrame, key: str, text: str, gram: int = GRAM) -> DataFrame:
    """The positional index of the training texts: ``term, doc_key, pos``.

    Null texts, null keys and texts shorter than a block have no postings; other columns are ignored.
    """
    fields = spread(docs.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").cast("string").alias("__text")).filter("doc_key IS NOT NULL AND __text IS NOT NULL"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, rows, at = [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                own = block_terms(letters_and_digits(t), gram)
                terms.append(own)
                rows.append(np.full(len(own), r))
                at.append(np.arange(len(own), dtype=np.int32) * gram)
            if not terms:
                continue
            keys = batch.column(0).take(pa.array(np.concatenate(rows).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(terms)), keys, pa.array(np.concatenate(at).astype(np.int32))], ["term", "doc_key", "pos"])

    kind = fields.schema["doc_key"].dataType.simpleString()
    return fields.mapInArrow(post, f"term bigint, doc_key {kind}, pos int")


def item_phrases(items: DataFrame, key: str, texts: list[str], gram: int = GRAM, chain: int = CHAIN) -> DataFrame:
    """Phrases of every test text: ``item_key, field, at, norm, terms`` (``chain`` adjacent terms from offset ``at``)."""
    cols = [F.col(f"`{c}`").cast("string").alias(f"__{i}") for i, c in enumerate(texts)]
    fields = items.select(F.col(f"`{key}`").alias("item_key"), *cols).filter("item_key IS NOT NULL")

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, field, at, terms, norms = [], [], [], [], []
            for f in range(len(texts)):
                for r, t in enumerate(batch.column(1 + f).to_pylist()):
                    norm = letters_and_digits(t or "")
                    own = sliding_terms(norm, gram)
                    for k in range(len(own) - gram * (chain - 1)):
                        rows.append(r)
                        field.append(f)
                        at.append(k)
                        terms.append(own[k : k + gram * chain : gram].tolist())
                        norms.append(norm if k == 0 else None)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(field, pa.int32()), pa.array(at, pa.int32()), pa.array(norms, pa.string()), pa.array(terms, pa.list_(pa.int64()))],
                ["item_key", "field", "at", "norm", "terms"],
            )

    kind = fields.schema["item_key"].dataType.simpleString()
    return fields.mapInArrow(phrases, f"item_key {kind}, field int, at int, norm string, terms array<bigint>")


def _restricted(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """The part of the index whose terms occur in the test texts."""
    vocabulary = phrases.select(F.explode("terms").alias("term")).distinct()
    return postings.join(broadcast_if_small(written(vocabulary, "terms")), "term", "left_semi")


def phrase_diagonals(postings: DataFrame, phrases: DataFrame, gram: int = GRAM, chain: int = CHAIN) -> DataFrame:
    """``doc_key, item_key, field, diagonal`` of every phrase found whole, starting from its rarest term."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    listed = phrases.select("item_key", "field", "at", "terms", F.posexplode("terms").alias("no", "term"))
    anchors = (
        listed.join(df, "term")
        .groupBy("item_key", "field", "at")
        .agg(F.count("*").alias("known"), F.min(F.struct("df", "no", "term")).alias("rare"), F.first("terms").alias("terms"))
        .filter(F.col("known") == chain)  # a term that no text holds ends the phrase
        .select("item_key", "field", "at", "terms", F.col("rare.no").alias("rare_no"), F.col("rare.term").alias("term"))
    )
    started = (
        anchors.join(postings, "term")
        .withColumn("begin", F.col("pos") - F.col("rare_no") * gram)
        .filter("begin >= 0")
        .select("doc_key", "item_key", "field", "at", "rare_no", "begin", F.posexplode("terms").alias("no", "term"))
    )
    rest = started.filter("no != rare_no").withColumn("pos", (F.col("begin") + F.col("no") * gram).cast("int"))
    met = rest.join(postings, ["term", "doc_key", "pos"], "left_semi")
    return (
        met.groupBy("doc_key", "item_key", "field", "at", "begin")
        .agg(F.countDistinct("no").alias("met"))
        .filter(F.col("met") == chain - 1)
        .select("doc_key", "item_key", "field", (F.col("begin") - F.col("at")).alias("diagonal"))
        .distinct()
    )


def leaked_items(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_texts: list[str], least: int = 50, index: DataFrame | None = None
) -> DataFrame:
    """``doc_key, item_key, run``: training texts sharing a run of ``least`` characters with a test item.

    ``run`` is the longest shared run found. Null, empty and short texts on either side give no row; a
    repeated row counts once; a text that leaked into many documents is reported for each. The test
    vocabulary is broadcast only while its estimated size is small, else it is joined by shuffle. ``index``: the
    stored postings of ``docs`` from :func:`build_postings`, so that further test sets don't read the texts again;
    without it only the postings with terms of this test set are kept.
    """
    if least < GRAM * (CHAIN + 1) - 1:
        raise ValueError(f"runs below {GRAM * (CHAIN + 1) - 1} characters need smaller blocks")
    phrases = written(item_phrases(items, item_key, item_texts), "phrases")
    postings = written(_restricted(build_postings(docs, key, text) if index is None else index, phrases), "postings")
    found = written(phrase_diagonals(postings, phrases), "diagonals")
    norms = phrases.filter("norm IS NOT NULL").select("item_key", "field", "norm").dropDuplicates(["item_key", "field"])
    # A repetitive text has very many diagonals: they come in groups of bounded size.
    groups = found.groupBy("doc_key").agg(F.ceil(F.count("*") / LINES).alias("groups"))
    salt = F.pmod(F.xxhash64("item_key", "field", "diagonal"), F.col("groups"))
    salted = found.join(groups, "doc_key").withColumn("salt", salt).join(broadcast_if_small(norms), ["item_key", "field"])
    lines = salted.groupBy("doc_key", "salt").agg(F.collect_set(F.struct("item_key", "norm", "diagonal")).alias("lines"))
    texts = docs.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").alias("__text")).filter("__text IS NOT NULL")
    both = texts.join(lines, "doc_key").select("doc_key", "__text", "lines")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, runs = [], [], []
            for r, (t, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                norm = letters_and_digits(t)
                best: dict = {}
                for line in own:
                    run = longest_run(norm, line["norm"], line["diagonal"])
                    if run >= least:
                        best[line["item_key"]] = max(run, best.get(line["item_key"], 0))
                for k, run in best.items():
                    rows.append(r)
                    keys.append(k)
                    runs.append(run)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, batch.schema.field(2).type.value_type.field("item_key").type), pa.array(runs, pa.int32())],
                ["doc_key", "item_key", "run"],
            )

    schema = f"doc_key {both.schema['doc_key'].dataType.simpleString()}, item_key {phrases.schema['item_key'].dataType.simpleString()}, run int"
    return both.mapInArrow(exact, schema).groupBy("doc_key", "item_key").agg(F.max("run").alias("run"))


def _best_windows(hits, near: int, drift: int, least: int):
    """``row, item, terms`` of the pairs in ``hits`` (``row, item, field, offset, term, pos, rare``) that match."""
    import pandas as pd

    pair = ["row", "item"]
    hits = hits[hits.groupby(pair)["term"].transform("nunique") >= least]
    half, step = near // 2, drift // 2
    hits = hits.assign(w=hits["pos"] // half, band=(hits["pos"] - hits["offset"]) // step)
    placed = pd.concat([hits, hits.assign(w=hits["w"] - 1)])
    aligned = pd.concat([placed, placed.assign(band=placed["band"] - 1)])

    def most(rows, *within: str):
        return rows.drop_duplicates([*pair, *within, "term"]).groupby([*pair, *within]).size().groupby(level=[0, 1]).max()

    terms = most(placed, "w")
    near_line = most(aligned, "field", "w", "band").reindex(terms.index, fill_value=0)
    near_rare = most(placed[placed["rare"]], "w").reindex(terms.index, fill_value=0)
    return terms[(near_line >= least) | (near_rare >= least)].rename("terms").reset_index()


def proximity_matches(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_texts: list[str], rarest: int = 8, near: int = 400, least: int = 3, drift: int = 32,
    index: DataFrame | None = None,
) -> DataFrame:
    """``doc_key, item_key, terms``: texts holding at least ``least`` of an item's terms along it within ``near`` characters.

    Finds passages that were edited so often that no long run is left. All terms of an item count, however many
    texts hold them, where their places in text and item differ by the same number up to ``drift``; the ``rarest``
    terms (by document frequency, ties: term) count in any order. ``terms``: the item's terms in its fullest window.
    Windows overlap by half. Defined cases and ``index`` as in :func:`leaked_items`.
    """
    import pandas as pd
    from pyspark.sql import Window

    phrases = written(item_phrases(items, item_key, item_texts), "phrases")
    postings = written(_restricted(build_postings(docs, key, text) if index is None else index, phrases), "postings")
    df = postings.groupBy("term").agg(F.countDistinct("doc_key").alias("df"))
    listed = phrases.select("item_key", "field", "at", F.posexplode("terms").alias("no", "term"))
    listed = listed.select("item_key", "field", "term", (F.col("at") + F.col("no") * GRAM).alias("offset")).distinct()
    order = Window.partitionBy("item_key").orderBy("df", "term")
    ranked = listed.select("item_key", "term").distinct().join(df, "term").withColumn("n", F.row_number().over(order))
    terms = written(listed.join(ranked.select("item_key", "term", (F.col("n") <= rarest).alias("rare")), ["item_key", "term"]), "terms")
    # One list per text and item: as long as the text repeats the item's terms.
    one = F.struct("field", "offset", "term", "pos", "rare")
    hits = postings.join(broadcast_if_small(terms), "term").groupBy("doc_key", "item_key").agg(F.collect_list(one).alias("hits"))
    hits = hits.filter(F.size("hits") >= least)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            columns = dict(zip(("field", "offset", "term", "pos", "rare"), lists.flatten().flatten()))
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            own = pd.DataFrame({"row": rows, "item": 0} | {k: v.to_numpy(zero_copy_only=False) for k, v in columns.items()})
            best = _best_windows(own, near, drift, least)
            at = pa.array(best["row"], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(best["terms"], pa.int64())], ["doc_key", "item_key", "terms"])

    schema = f"doc_key {hits.schema['doc_key'].dataType.simpleString()}, item_key {hits.schema['item_key'].dataType.simpleString()}, terms bigint"
    return hits.mapInArrow(match, schema)
