"""Problem 6: fill containers of fixed token capacity, by histogram patterns and least squares.

Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver. There, patterns of up to three
lengths that fill a container exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded, and the residual histogram is packed largest-first in bulk.
The plan is a list of (lengths, repeats) whose size depends on the capacity and not on the number of texts.
Each text finds its container by its rank among the texts of equal length, with no container ever built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.runtime import spread, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published word pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Exact patterns kept per largest length, the ones that can repeat most often.
PATTERNS_PER_LENGTH = 24
#: Texts in one rank group, about.
RANK_GROUP = 50_000
_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file, loaded once per process."""
    if (path, pattern) not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def token_pieces(text: str, capacity: int, path: str = VOCABULARY, pattern: str = PATTERN) -> list[tuple[int, int]]:
    """(first token, end) of the pieces of a text; more than one only if it exceeds the capacity.

    A cut never falls inside a character: it moves back to a token that begins one.
    """
    own = encoding(path, pattern)
    tokens = own.encode_ordinary(text)
    n = len(tokens)
    pieces, begin = [], 0
    while n - begin > capacity:
        end = begin + capacity
        while end > begin + 1 and own.decode_single_token_bytes(tokens[end])[0] & 0xC0 == 0x80:
            end -= 1
        pieces.append((begin, end))
        begin = end
    if n > begin:
        pieces.append((begin, n))
    return pieces


def token_lengths(df: DataFrame, key: str, text: str, capacity: int, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``item_id, piece_no, token_start, n_tokens`` of every text, once per key."""
    fields = spread(df.select(F.col(f"`{key}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("__text")).filter("item_id IS NOT NULL AND __text != ''"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, no, start, size = [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(token_pieces(t, capacity, path, pattern)):
                    rows.append(r)
                    no.append(k)
                    start.append(a)
                    size.append(b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int32())],
                ["item_id", "piece_no", "token_start", "n_tokens"],
            )

    kind = fields.schema["item_id"].dataType.simpleString()
    sized = fields.mapInArrow(measure, f"item_id {kind}, piece_no int, token_start int, n_tokens int")
    # Repeated rows count once.
    return sized.dropDuplicates(["item_id", "piece_no"])


def exact_patterns(histogram: np.ndarray, per_length: int = PATTERNS_PER_LENGTH) -> np.ndarray:
    """Rows of up to three lengths (0: none) that sum to the capacity, ``histogram`` having ``capacity + 1`` bins."""
    capacity = len(histogram) - 1
    present = np.flatnonzero(histogram)
    present = present[present > 0]
    rows = []
    for a in present[::-1]:
        rest = capacity - a
        if rest == 0:
            rows.append(np.array([[a, 0, 0]]))
            continue
        b = present[(present <= min(a, rest)) & (present >= rest - present)]
        c = rest - b
        ok = (c == 0) | (histogram[c] > 0)
        b, c = b[ok], c[ok]
        if not len(b):
            continue
        often = np.minimum(np.minimum(histogram[a], histogram[b]), np.where(c > 0, histogram[c], np.iinfo(np.int64).max))
        best = np.argsort(-often, kind="stable")[:per_length]
        rows.append(np.column_stack([np.full(len(best), a), b[best], c[best]]))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of the pattern counts against the histogram (accelerated projected gradient)."""
    h = histogram.astype(float).copy()
    h[0] = 0
    used = patterns > 0

    def gather(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), weights=(x[:, None] * used).ravel(), minlength=len(h))

    x = np.zeros(len(patterns))
    if not len(x):
        return x
    # A diagonal preconditioner: a length that many patterns share moves each of them less.
    share = gather(np.ones(len(x)))
    scale = 1.0 / np.maximum(1.0, (share[patterns] * used).sum(axis=1))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        gradient = ((gather(y) - h)[patterns] * used).sum(axis=1)
        new = np.maximum(0.0, y - scale * gradient)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def packing_plan(histogram: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, times), ...], repeats)`` that use every text of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    capacity = len(left) - 1
    plan: list[tuple[list[tuple[int, int]], int]] = []
    patterns = exact_patterns(left)
    repeats = np.rint(fit_repeats(patterns, left)).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 1:
            break
        lengths, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        n = min(int(repeats[k]), int((left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            plan.append(([(int(a), int(b)) for a, b in zip(lengths[::-1], times[::-1])], n))
    while left.any():  # each round uses up at least one length, or all but a remainder of it
        space, pattern = capacity, []
        top = int(np.flatnonzero(left)[-1])
        while space > 0:
            fits = np.flatnonzero(left[: min(space, top) + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            times = min(space // length, int(left[length]))
            pattern.append((length, times))
            space -= length * times
            top = length - 1
            if top < 1:
                break
        n = min(int(left[a]) // b for a, b in pattern)
        for a, b in pattern:
            left[a] -= n * b
        plan.append((pattern, n))
    return plan


def packed(df: DataFrame, key: str, text: str, capacity: int = 2048, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``container, start, item_id, piece_no, token_start, n_tokens``: where each text lies.

    ``start`` is the position in the container, of ``capacity`` tokens. A text is cut only if it alone exceeds
    the capacity, into pieces of the capacity and a rest that is packed like any text. Null and empty
    texts and null keys are left out; a repeated key counts once; blank texts have tokens and are packed;
    other columns are ignored. A hot length is ranked in salted groups, never in one task.
    """
    spark = df.sparkSession
    items = written(token_lengths(df, key, text, capacity, path, pattern), "lengths")
    counts = items.groupBy("n_tokens").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts:
        histogram[row["n_tokens"]] = row["count"]
    plan = packing_plan(histogram)
    groups = max(1, int(histogram.sum()) // RANK_GROUP)

    # Ranges of ranks per length -> pattern; sorted by (length, first rank).
    ranges, used, container = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, n in plan:
        at = 0
        for length, times in lengths:
            ranges.append((length, int(used[length]), times, container, at))
            used[length] += n * times
            at += length * times
        container += n
    table = np.array(sorted(ranges), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    salted = items.withColumn("salt", F.pmod(F.xxhash64("item_id", "piece_no"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("n_tokens", "salt").orderBy("item_id", "piece_no")
    ranked = (
        salted.withColumn("no", F.row_number().over(within))
        .join(offsets, ["n_tokens", "salt"])
        .select("item_id", "piece_no", "token_start", "n_tokens", (F.col("before") + F.col("no") - 1).cast("long").alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        shift = np.int64(1) << np.int64(48)
        order = rows[:, 0] * shift + rows[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy().astype(np.int64)
            rank = batch.column(4).to_numpy()
            hit = rows[np.searchsorted(order, length * shift + rank, side="right") - 1]
            local = rank - hit[:, 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hit[:, 3] + local // hit[:, 2]), pa.array((hit[:, 4] + local % hit[:, 2] * length).astype(np.int32)), *[batch.column(k) for k in range(4)]],
                ["container", "start", "item_id", "piece_no", "token_start", "n_tokens"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"container bigint, start int, item_id {kind}, piece_no int, token_start int, n_tokens int")


def fill_report(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``containers, tokens, fill`` of a packing; an empty packing has no containers and a null fill."""
    total = placed.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return total.withColumn("fill", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)))
