"""Problem 1: cut oversized texts at natural boundaries by lexical cohesion.

A text is divided into units (sentences, lines, table rows). At each gap between units the word
vectors of the blocks on both sides are compared by cosine; a gap whose similarity lies deep below the
peaks on its left and right is a topic valley. A piece ends at the deepest valley inside its size
window; without any gap there, at the last clause mark, then the last white space, and only then
inside a word. Each next piece begins ``overlap`` characters before the end of the last one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A unit ends after a line break, or after a full stop with its closing marks. ASCII stops need white space.
_UNIT_END = re.compile(r"\n+|[。！？；｡।॥؟۔…]+[”’」』）)\"'»]*|[.!?;]+[”’)\"'»]*(?=\s)")
_CLAUSE_END = re.compile(r"[,，、:：،؛]+\s*")
_WORD = re.compile(r"[^\W\d_㐀-鿿぀-ヿ]+|[㐀-鿿぀-ヿ]|\d+")


def _unit_ends(text: str) -> list[int]:
    ends = []
    for m in _UNIT_END.finditer(text):
        e = m.end()
        while e < len(text) and text[e] == " ":
            e += 1
        if not ends or e > ends[-1]:
            ends.append(e)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def _cosine(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    if not dot:
        return 0.0
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def valley_depths(text: str, ends: list[int], block: int) -> list[float]:
    """Depth of the similarity valley at each inner unit end (``ends[:-1]``)."""
    bags, begin = [], 0
    for e in ends:
        bags.append(Counter(_WORD.findall(text[begin:e].lower())))
        begin = e
    sims = []
    left: Counter = Counter()
    right: Counter = Counter()
    for bag in bags[:block]:
        right.update(bag)
    for gap in range(1, len(bags)):  # blocks slide: bags[gap-block:gap] | bags[gap:gap+block]
        moved = bags[gap - 1]
        left.update(moved)
        right.subtract(moved)
        if gap - 1 - block >= 0:
            left.subtract(bags[gap - 1 - block])
        if gap + block - 1 < len(bags):
            right.update(bags[gap + block - 1])
        sims.append(_cosine(+left, +right))
    n = len(sims)
    peak_left, peak_right = [0.0] * n, [0.0] * n
    for i in range(n):  # the peak reached by climbing away from the gap while similarity rises
        peak_left[i] = max(sims[i], peak_left[i - 1]) if i and sims[i - 1] >= sims[i] else sims[i]
    for i in range(n - 1, -1, -1):
        peak_right[i] = max(sims[i], peak_right[i + 1]) if i + 1 < n and sims[i + 1] >= sims[i] else sims[i]
    return [peak_left[i] + peak_right[i] - 2 * sims[i] for i in range(n)]


def cut_points(text: str, limit: int, overlap: int, block: int = 4) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of each piece; kinds: end, valley, clause, space, hard."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    ends = _unit_ends(text)
    depth = valley_depths(text, ends, block)
    pieces, start, last, i = [], 0, 0, 0
    while n - start > limit:
        top = start + limit
        floor = max(last, start + overlap)  # a cut must leave room for the overlap
        low = floor + max(1, (top - floor) // 3)  # no slivers while a later gap exists
        while i < len(depth) and ends[i] <= floor:
            i += 1
        best, j = None, i
        late = None
        while j < len(depth) and ends[j] <= top:
            if ends[j] >= low:
                if best is None or (depth[j], ends[j]) > best:
                    best = (depth[j], ends[j])
            else:
                late = ends[j]
            j += 1
        if best:
            end, kind = best[1], "valley"
        elif late:
            end, kind = late, "valley"
        else:
            window = text[floor + 1 : top + 1]
            marks = [m.end() for m in _CLAUSE_END.finditer(window) if floor + 1 + m.end() <= top]
            spaces = max(window.rfind(" ", 0, top - floor), window.rfind("\t", 0, top - floor))
            if marks:
                end, kind = floor + 1 + marks[-1], "clause"
            elif spaces >= 0 and floor + 2 + spaces <= top:
                end, kind = floor + 2 + spaces, "space"
            else:
                end, kind = top, "hard"
                while end > floor + 1 and (unicodedata.combining(text[end]) or unicodedata.category(text[end])[0] == "M" or text[end] == "‍"):
                    end -= 1
                if end == floor + 1:
                    end = top
        pieces.append((start, end, kind))
        last, start = end, max(end - overlap, start + 1)
    pieces.append((start, n, "end"))
    return pieces


def split_oversized(
    df: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 50, block: int = 4
) -> DataFrame:
    """Pieces of every text: ``item_id, piece_no, n_pieces, start_pos, end_pos, cut, piece``.

    Positions count Unicode code points; ``piece = text[start_pos:end_pos]`` is at most ``limit`` long and
    consecutive pieces share exactly ``overlap`` characters. Dropping the first ``overlap`` characters of each
    later piece and joining gives the text back. A text within the limit is one piece; a null or empty
    text gives no row; rows repeated in the input repeat in the output; a null key is kept. Other
    columns are ignored, whatever their names. One narrow pass, no shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and below half the limit")
    fields = df.select(F.col(f"`{key}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("__text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, no, total, start, end, cut, piece = [], [], [], [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                cuts = cut_points(t, limit, overlap, block)
                for k, (s, e, kind) in enumerate(cuts):
                    rows.append(r)
                    no.append(k)
                    total.append(len(cuts))
                    start.append(s)
                    end.append(e)
                    cut.append(kind)
                    piece.append(t[s:e])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(no, pa.int32()),
                    pa.array(total, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(end, pa.int64()),
                    pa.array(cut, pa.string()),
                    pa.array(piece, pa.string()),
                ],
                ["item_id", "piece_no", "n_pieces", "start_pos", "end_pos", "cut", "piece"],
            )

    kind = fields.schema["item_id"].dataType.simpleString()
    return fields.mapInArrow(
        pieces,
        f"item_id {kind}, piece_no int, n_pieces int, start_pos bigint, end_pos bigint, cut string, piece string",
    )
