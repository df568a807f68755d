"""Problem 5: noise in text from scanned pages, and its repair into readable paragraphs.

One pass over all texts counts words, the pairs of words and characters that follow one another in running text, and
the page numbers and titles of each file. Skip-gram vectors are learnt from these counts in their matrix form: the
log odds of every left and right neighbour, smoothed so that they weigh as much as the word was seen, reduced by the
leading factors of the most frequent words. The vectors propose: a word may be a misreading of one of the
``NEIGHBOURS`` frequent words nearest to it. Of these, only those stay from which a plausible glyph edit leads to the
word. Each occurrence is then decided in its context: how much more frequent the proposed word is, times how well the
words around it fit the proposed word's vector. In scripts without word breaks the glyph takes the place of the
word: the vectors propose the glyphs that fit between its neighbours, and the counts of the pairs decide.
A second pass labels lines; page furniture is removed before words are joined across lines.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.runtime import broadcast_if_small, spread, written

# Glyphs that recognition confuses, as (printed, read).
LATIN_GLYPHS = [
    ("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("n", "ri"), ("h", "li"), ("k", "lc"), ("b", "lo"),
    ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("t", "f"), ("f", "t"), ("e", "c"), ("c", "e"), ("o", "0"),
    ("s", "5"), ("b", "8"), ("b", "6"), ("g", "9"), ("g", "q"), ("q", "g"), ("z", "2"), ("h", "b"), ("b", "h"),
    ("n", "u"), ("u", "n"), ("v", "y"), ("y", "v"), ("o", "c"), ("a", "o"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("t", "l"), ("i", "j"), ("l", "t"),
]
HAN_GLYPHS = (
    "检捡 检俭 险俭 险捡 阀闽 压庄 标棕 测侧 人入 校佼 处外 备各 电屯 拆折 设没 急怠 操澡 滤滬 未末 洁沽 日曰 冶治 "
    "己已 土士 千干 干于 大太 清请 情请 管菅 班斑 流硫 线钱 间问 闻问 第弟 体休 阔阀 值植 徽微 贷货 今令 免兔 拔拨 "
    "候侯 栽裁 戍戌 撤撒 晴睛 辨辩 历厉 折析 住往 名各 申甲 由田 巳己 幻幼 氏民 夭天 夫天 目且 刀力 几儿 旦且 朱未 "
    "束柬 赢羸 复夏 侍待 科料 根恨 鸟乌 王玉 白自 毎每 章草"
).split()
_READINGS: dict[str, set[str]] = {}
for _pair in HAN_GLYPHS:
    for _p, _q in (_pair, _pair[::-1]):
        _READINGS.setdefault(_p, set()).add(_q)

HYPHENS = "-­‐‑¬"
#: A correction must be this many times as frequent as the word it replaces.
LEAST_RATIO = 8
#: Least log odds of a Han correction in its context.
LEAST_ODDS = 3.0
#: Weight of a pair whose other glyph is a reading as well.
SECOND_PRICE = 0.1
#: Context words of the skip-gram vectors, their length, and the neighbours that every word is taken to have had besides its own.
CONTEXT_WORDS, VECTOR_SIZE, SMOOTHING = 1000, 64, 50.0
#: A word may be a misreading of so many of the frequent words nearest to it, a glyph of so many of the confusable glyphs.
NEIGHBOURS, GLYPH_NEIGHBOURS = 256, 24
#: Frequent words compared at once: the size of a broadcast, not a limit.
VECTOR_BLOCK = 20_000
#: So many of the most frequent words that are no misreadings are left out of the lookup (a shortcut without effect).
FREQUENT_WORDS = 50_000

_WORD = re.compile(r"[A-Za-z0-9]+")
_HAN = "㐀-鿿"
_ASTRAL = re.compile(r"[A-Za-z0-9]*[\U00010000-\U0010ffff][A-Za-z0-9\U00010000-\U0010ffff]*")
_RUN = re.compile(f"[{_HAN}]+")
_CONFUSABLE = re.compile("[" + "".join(sorted(_READINGS)) + "]")
_SPACE = re.compile(r"\s+")
_BROKEN = re.compile(rf"([A-Za-z0-9]+)[{HYPHENS}]\s*$")
_NEXT = re.compile(r"\s*([A-Za-z0-9]+)")
_DIGIT = "[0-9lIOoSB|]"
_NUMBER = re.compile(
    rf"^(?P<d1>[-–—‒~·•*=_\[(（【|\s]*)(?P<w>(?:page|pag|p\.?|seite|第)\s*)?(?P<n>{_DIGIT}{{1,5}}|[ivxlcIVXLC]{{1,8}}|[〇零一二三四五六七八九十百]{{1,6}})"
    rf"\s*(?P<w2>页|頁|ページ)?(?P<t>\s*(?:/|／|of|共)\s*(?P<m>{_DIGIT}{{1,5}})\s*页?)?(?P<d2>[-–—‒~·•*=_\])）】|\s]*)$",
    re.I,
)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_HAN_DIGIT = {c: k for k, c in enumerate("零一二三四五六七八九")} | {"〇": 0}
_CHAPTER = re.compile(r"^(\w{5,9}?)\s*[0-9lo]{1,3}\s+\S|^第[一二三四五六七八九十百零〇0-9]{1,4}(\w)\s*\S", re.I)
_EDGE_NUMBER = re.compile(rf"^\s*{_DIGIT}{{1,5}}(?:\s*/\s*{_DIGIT}{{1,5}})?\s{{2,}}|\s{{2,}}{_DIGIT}{{1,5}}(?:\s*/\s*{_DIGIT}{{1,5}})?\s*$")
_SENTENCE_END = tuple("。．.!?！？；;，,、：:》”\"")


def is_running_text(content: str, table: bool | None, image: bool | None) -> bool:
    head = content.lstrip()[:8].lower()
    return not (table or image or head.startswith(("|", "<table", "<tr", "![")))


def printed_number(line: str) -> tuple[int, bool, bool] | None:
    """(value, decorated, roman) of a line that holds nothing but a page number, in whatever form."""
    t = unicodedata.normalize("NFKC", line).strip()
    if not t or len(t) > 24:
        return None
    m = _NUMBER.match(t)
    if not m:
        return None
    n = m["n"]
    decorated = bool(m["w"] or m["w2"] or m["t"] or (m["d1"].strip() and m["d2"].strip()))
    digits = n.replace("l", "1").replace("I", "1").replace("|", "1").replace("O", "0").replace("o", "0").replace("S", "5").replace("B", "8")
    if digits.isascii() and digits.isdigit() and (any(c.isdigit() for c in n) or decorated):
        return int(digits), decorated, False
    if all(c in _ROMAN for c in n.lower()):
        low, value = n.lower(), 0
        for k, c in enumerate(low):
            value += -_ROMAN[c] if any(_ROMAN[d] > _ROMAN[c] for d in low[k + 1 : k + 2]) else _ROMAN[c]
        return value, decorated, True
    if n[0] in _HAN_DIGIT or n[0] in "十百":
        if not (set(n) & set("十百")):
            return int("".join(str(_HAN_DIGIT[c]) for c in n)), decorated, False
        value, unit = 0, 0
        for c in n:
            if c in _HAN_DIGIT:
                unit = _HAN_DIGIT[c]
            else:
                value += (unit or 1) * (10 if c == "十" else 100)
                unit = 0
        return value + unit, decorated, False
    return None


_CLASS = str.maketrans({"1": "l", "i": "l", "j": "l", "t": "l", "f": "l", "|": "l", "c": "e", "o": "e", "0": "e", "5": "s", "8": "b", "6": "b", "h": "b", "9": "g", "q": "g", "u": "n", "y": "v", "2": "z"})
_HAN_CLASS: dict[str, str] = {}
for _a in sorted(_READINGS):  # the least member of a class of confusable glyphs
    _seen, _todo = {_a}, [_a]
    while _todo:
        for _b in _READINGS[_todo.pop()]:
            if _b not in _seen:
                _seen.add(_b)
                _todo.append(_b)
    _HAN_CLASS[_a] = min(_seen)
_HAN_TABLE = str.maketrans(_HAN_CLASS)


def glyph_class(title: str) -> str:
    """A form in which titles that differ only by misread glyphs, case and blanks are equal."""
    t = unicodedata.normalize("NFKC", title).lower()
    t = re.sub(r"[\W_]+", "", t)
    for printed, read in (("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv")):
        t = t.replace(read, printed)
    return t.translate(_CLASS).translate(_HAN_TABLE)


_CHAPTER_FORMS = {glyph_class(w) for w in ("chapter", "章")}


def chapter_form(line: str) -> str | None:
    """The form of a line that looks like a chapter title (word or sign of a chapter, number, title), perhaps misread."""
    t = unicodedata.normalize("NFKC", line).strip()
    t = _EDGE_NUMBER.sub("", t).strip() or t
    if not t or len(t) > 60 or t.endswith(_SENTENCE_END):
        return None
    m = _CHAPTER.match(_SPACE.sub("", t) if t[0] == "第" else t)
    return glyph_class(t) if m and glyph_class(m[1] or m[2]) in _CHAPTER_FORMS else None


def _edits_at_most(a: str, b: str, most: int) -> bool:
    """Is the edit distance of two short strings at most ``most``?"""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def is_running_head(line: str, classes: set[str], longest: int) -> bool:
    """A line that holds only a book or chapter title of its file, perhaps damaged or with the page number."""
    t = unicodedata.normalize("NFKC", line).strip()
    if not t or len(t) > longest + 16 or t.endswith(_SENTENCE_END):
        return False
    form = glyph_class(_EDGE_NUMBER.sub("", t).strip() or t)
    if len(form) < 3:
        return False
    if form in classes:
        return True
    most = max(1, len(form) // 6)
    return any(_edits_at_most(form, c, most) for c in classes if len(c) >= 5)


def stands_apart(line: str, width: int, beside_number: bool) -> bool:
    """Is a line in the form of a chapter title set as one, not part of the sentences around it?

    In scripts with case most of its words begin with a capital; in others it is clearly narrower than the
    ``width`` of its text, or a page number stands on it or beside it.
    """
    t = unicodedata.normalize("NFKC", line).strip()
    bare = _EDGE_NUMBER.sub("", t).strip() or t
    if bare[0] != "第":
        words = [w for w in bare.split() if len(w) > 3 and w[0].isalpha()][1:]
        return 2 * sum(w[0].isupper() for w in words) >= len(words)
    return bare != t or beside_number or len(_SPACE.sub("", bare)) <= 0.6 * width


def book_title(filename: str | None) -> str:
    """The title in a file name: without its ending and its serial number."""
    return re.sub(r"-\d+$", "", re.sub(r"\.\w{1,5}$", "", filename or "")).strip()


def _title_classes(book: str, chapters: Iterable[str], heads: Iterable[str]) -> tuple[set[str], int]:
    """(forms of the titles of a file, length of its longest): its book and chapters, and the ``heads`` its pages repeat."""
    titles = {book, re.sub(r"[（(][^）)]*[）)]$", "", book), *chapters} - {""}
    forms = {*map(glyph_class, titles), *heads}
    return {c for c in forms if len(c) >= 3}, max([0, *map(len, titles), *(2 * len(h) for h in heads)])


def label_furniture(lines: list[str], page: int | None, classes: set[str], longest: int, offsets: tuple[int | None, int | None]) -> list[str | None]:
    """``header``, ``page_number`` or None for each line."""
    out: list[str | None] = []
    for line in lines:
        number = printed_number(line) if len(line) <= 40 else None
        kind = None
        if number:
            value, decorated, roman = number
            offset = offsets[1] if roman else offsets[0]
            if page is None:
                kind = "page_number" if decorated else None
            elif offset is not None and value - page in (offset, offset + 1):
                kind = "page_number"
        elif len(line) <= longest + 40 and is_running_head(line, classes, longest):
            kind = "header"
        out.append(kind)
    width = max([0, *(len(line.strip()) for line in lines)])
    for k, line in enumerate(lines):
        if out[k] is None and len(line) <= 80 and chapter_form(line):
            beside = "page_number" in (out[k - 1 : k] + out[k + 1 : k + 2])
            if stands_apart(line, width, beside):
                out[k] = "header"
    return out


def _ends_broken(line: str) -> re.Match | None:
    """The match of a word cut by a hyphen at the end of a line."""
    t = line.rstrip()
    if not t or t[-1] not in HYPHENS:
        return None
    begin = len(t) - 1
    while begin and t[begin - 1].isalnum() and t[begin - 1].isascii():
        begin -= 1
    return _BROKEN.match(line, begin)


def broken_words(lines: list[str], furniture: list[str | None]) -> list[tuple[int, int, str, int]]:
    """(line, next line, joined word, length of its first part) of words cut by a hyphen at a line's end."""
    out = []
    body = [k for k, f in enumerate(furniture) if f is None and lines[k].strip()]
    for a, b in zip(body, body[1:]):
        m = _ends_broken(lines[a])
        n = _NEXT.match(lines[b]) if m else None
        if m and n and any(c.isalpha() for c in m[1]):
            out.append((a, b, (m[1] + n[1]).lower(), len(m[1])))
    return out


def _is_word(word: str) -> bool:
    if not 3 <= len(word) <= 40:
        return False
    return word.isalpha() or sum(map(str.isalpha, word)) >= 2


def _words(lines: list[str], furniture: list[str | None], broken: list[tuple[int, int, str, int]]) -> list[list[str]]:
    """Whole words of each line, in lower case, without parts of broken words."""
    ends = {a for a, *_ in broken}
    begins = {b for _, b, *_ in broken}
    out = []
    for k, line in enumerate(lines):
        if furniture[k]:
            out.append([])
            continue
        if not line.isascii() and _ASTRAL.search(line):  # words that pictographs were put into
            line = _ASTRAL.sub(" ", line)
        found = [w.lower() for w in _WORD.findall(line)]
        if k in begins:
            found = found[1:]
        if k in ends or _ends_broken(line):
            found = found[:-1]
        out.append([w for w in found if _is_word(w)])
    return out


def _sequence(words: list[list[str]], broken: list[tuple[int, int, str, int]]) -> list[tuple[str, int, int]]:
    """(word, line, number of the broken word or -1) in the order of the text, broken words joined."""
    cut = {a: (w, k) for k, (a, _, w, _) in enumerate(broken)}
    out = []
    for line, own in enumerate(words):
        out += [(w, line, -1) for w in own]
        if line in cut:
            out.append((cut[line][0], line, cut[line][1]))
    return out


def _condensed(lines: list[str], furniture: list[str | None]) -> tuple[str, list[int]]:
    """Running text without white space, and the number of the line of each character."""
    parts, owner = [], []
    for k, line in enumerate(lines):
        if furniture[k] is None:
            t = _SPACE.sub("", line)
            parts.append(t)
            owner += [k] * len(t)
    return "".join(parts), owner


# Kinds of the counts of the first pass.
WORD, PAIR, JOINED, NUMBER, ROMAN, CHAPTER, CONTEXT, HEAD = range(8)
_SEP = "\x00"


class _Tally:
    """Counts of one partition, given out in parts of bounded size."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()

    def batch(self) -> pa.RecordBatch:
        kinds = pa.array([k for k, _ in self.counts], pa.int32())
        tokens = pa.array([t for _, t in self.counts], pa.string())
        numbers = pa.array(list(self.counts.values()), pa.int64())
        self.counts = Counter()
        return pa.RecordBatch.from_arrays([kinds, tokens, numbers], ["kind", "token", "n"])


def first_pass(fields: DataFrame) -> DataFrame:
    """``kind, token, n`` over all texts of ``(id, content, page, table, image, layer, file, title)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            words: Counter = Counter()
            pairs: Counter = Counter()
            joined: Counter = Counter()
            contexts: Counter = Counter()
            other = tally.counts
            columns = [batch.column(k).to_pylist() for k in range(1, 8)]
            for content, page, table, image, layer, file, title in zip(*columns):
                if file and title and chapter_form(title):
                    other[CHAPTER, file + _SEP + title] += 1
                if not content or not is_running_text(content, table, image):
                    continue
                lines = content.split("\n")
                if layer == "parent":
                    head = lines[0].strip()
                    if file and chapter_form(head):
                        other[CHAPTER, file + _SEP + head] += 1
                furniture: list[str | None] = [None] * len(lines)
                if layer != "parent":
                    for k, line in enumerate(lines):
                        number = printed_number(line) if len(line) <= 40 else None
                        if number:
                            furniture[k] = "page_number"
                            if file and page is not None:
                                value, decorated, roman = number
                                other[ROMAN if roman else NUMBER, f"{file}{_SEP}{value - page}"] += 3 if decorated else 1
                        elif file and len(line) <= 80:
                            head = chapter_form(line)
                            if head:
                                other[HEAD, file + _SEP + head] += 1
                broken = broken_words(lines, furniture)
                joined.update(w for _, _, w, _ in broken)
                listed = _words(lines, furniture, broken)
                for own in listed:
                    words.update(own)
                running = [w for w, _, _ in _sequence(listed, broken)]
                contexts.update(zip(running, running[1:]))
                text, _ = _condensed(lines, furniture)
                for run in _RUN.findall(text):
                    pairs.update(zip(run, run[1:]))
            for w, n in words.items():
                other[WORD, w] += n
            for w, n in joined.items():
                other[JOINED, w] += n
            for (a, b), n in pairs.items():
                if a in _READINGS or b in _READINGS:
                    other[PAIR, a + b] += n
            for (a, b), n in contexts.items():
                other[CONTEXT, a + _SEP + b] += n
            if len(other) > 300_000:
                yield tally.batch()
        yield tally.batch()

    return fields.mapInArrow(count, "kind int, token string, n bigint").groupBy("kind", "token").agg(F.sum("n").alias("n"))


def glyph_edits(word: str) -> list[tuple[str, int]]:
    """(candidate, position of the edit) of every single reading undone."""
    out = []
    for printed, read in LATIN_GLYPHS:
        at = word.find(read)
        while at >= 0:
            out.append((word[:at] + printed + word[at + len(read) :], at))
            at = word.find(read, at + 1)
    return out


def _log_odds(rows: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Smoothed log odds of the neighbours counted in ``rows``: a word seen seldom has small ones."""
    total = rows.sum(axis=1, keepdims=True)
    return np.log((rows + SMOOTHING * share) / ((total + SMOOTHING) * share))


class SkipGrams:
    """Skip-gram vectors in matrix form. ``position``: context word -> number; ``basis``: one row per right, then left, context."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.position = {w: k for k, w in enumerate(names)}
        total = counts.sum(axis=0) + 1.0
        self.share = total / total.sum()
        odds = _log_odds(counts, self.share)
        _, values, factors = np.linalg.svd(odds, full_matrices=False)
        rank = max(1, min(VECTOR_SIZE, int((values > 1e-6).sum())))
        self.basis = factors[:rank].T.astype(np.float32)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Vectors of words whose neighbours are counted in ``rows``."""
        return _log_odds(rows, self.share) @ self.basis

    def context(self, before: str | None, after: str | None) -> list[int]:
        """Rows of ``basis`` of the words around an occurrence."""
        right, left = self.position.get(after), self.position.get(before)
        return ([] if right is None else [right]) + ([] if left is None else [len(self.position) + left])


def word_model(counts: DataFrame) -> SkipGrams:
    """The skip-gram factors of the ``CONTEXT_WORDS`` most frequent words, fitted on the driver on their mutual counts."""
    words = counts.filter(F.col("kind") == WORD).orderBy(F.desc("n"), "token").limit(CONTEXT_WORDS).toPandas()
    names = list(words["token"])
    known = counts.sparkSession.createDataFrame([(w,) for w in names] or [("",)], "b string")
    pair = F.split("token", _SEP)
    both = counts.filter(F.col("kind") == CONTEXT).select(pair[0].alias("a"), pair[1].alias("b"), "n")
    few = F.broadcast(known)  # CONTEXT_WORDS rows
    mutual = both.join(few, "b").join(few.withColumnRenamed("b", "a"), "a").toPandas()  # at most their square
    at = {w: k for k, w in enumerate(names)}
    table = np.zeros((max(1, len(names)), 2 * max(1, len(names))))
    a, b = mutual["a"].map(at).to_numpy(int), mutual["b"].map(at).to_numpy(int)
    table[a, b] = mutual["n"].to_numpy(float)
    table[b, len(names) + a] = mutual["n"].to_numpy(float)
    return SkipGrams(names, table)


def word_vectors(counts: DataFrame, model: SkipGrams) -> DataFrame:
    """``token, vector`` of every word with a neighbour among the context words, however rare, folded in where its counts lie."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    size = len(model.position)
    known = spark.createDataFrame(list(model.position.items()) or [("", 0)], "b string, c int")
    pair = F.split("token", _SEP)
    both = counts.filter(F.col("kind") == CONTEXT).select(pair[0].alias("a"), pair[1].alias("b"), "n")
    few = F.broadcast(known)  # CONTEXT_WORDS rows
    right = both.join(few, "b").select(F.col("a").alias("token"), "c", "n")
    left = both.join(few.withColumnRenamed("b", "a"), "a").select(F.col("b").alias("token"), (F.col("c") + size).alias("c"), "n")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                rows = np.zeros((part.num_rows, len(model.share)))
                for r, near in enumerate(part.column(1).to_pylist()):
                    for x in near:
                        rows[r, x["c"]] += x["n"]
                out = model.vectors(rows).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(out), pa.list_(pa.float32()))], ["token", "vector"])

    # At most two entries per word and context word.
    grouped = right.unionByName(left).groupBy("token", "c").agg(F.sum("n").alias("n")).groupBy("token").agg(F.collect_list(F.struct("c", "n")).alias("near"))
    return grouped.mapInArrow(fold, "token string, vector array<float>")


def _nearer(likely: DataFrame, frequent: DataFrame, size: int) -> DataFrame:
    """``likely`` with ``nearer``: how many frequent words are nearer to ``v`` than ``cosine``; in blocks of ``VECTOR_BLOCK`` words."""
    blocks = max(1, -(-frequent.count() // VECTOR_BLOCK))
    spark = likely.sparkSession
    for b in range(blocks):
        own = frequent if blocks == 1 else frequent.filter(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b)
        block = own.select("vector").toPandas()["vector"]  # about VECTOR_BLOCK vectors
        matrix = np.array(list(block), np.float32).reshape(-1, size)
        shared = spark.sparkContext.broadcast(matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = batch.column("nearer").to_numpy().copy()
                for begin in range(0, batch.num_rows, 256):
                    part = batch.slice(begin, 256)
                    v = np.array(part.column("v").to_pylist(), np.float32)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    near[begin : begin + 256] += (v @ shared.value.T > part.column("cosine").to_numpy()[:, None] + 1e-6).sum(axis=1)
                yield batch.set_column(batch.schema.get_field_index("nearer"), "nearer", pa.array(near))

        likely = likely.mapInArrow(count, likely.schema)
    return likely


def glyph_links(counts: DataFrame, model: SkipGrams) -> DataFrame:
    """``token, choices``: the frequent words that a word may be a misreading of, each ``correct, at, lead, vector``.

    A choice is one of the ``NEIGHBOURS`` frequent words nearest to the word by their vectors, and a plausible
    glyph edit leads from it to the word. ``at``: place of the edit; ``lead``: log of how much more frequent it is.
    """
    words = counts.filter(F.col("kind") == WORD).select("token", "n")
    joined = counts.filter(F.col("kind") == JOINED).select("token", F.lit(1).cast("bigint").alias("n")).join(words.select("token"), "token", "left_anti")
    vectors = written(word_vectors(counts, model), "word-vectors")
    frequent = written(words.filter(f"n >= {LEAST_RATIO}").join(vectors, "token"), "frequent-words")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ns, candidates, places = [], [], [], []
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for c, at in glyph_edits(t):
                    tokens.append(t)
                    ns.append(n)
                    candidates.append(c)
                    places.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(ns, pa.int64()), pa.array(candidates, pa.string()), pa.array(places, pa.int32())], ["token", "n", "correct", "at"])

    plausible = words.unionByName(joined).mapInArrow(edits, "token string, n bigint, correct string, at int")
    theirs = frequent.select(F.col("token").alias("correct"), F.col("n").alias("often"), F.col("vector").alias("u"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("float"), lambda s, x: s + x)
    pairs = plausible.join(theirs, "correct").filter("often > n").join(vectors.withColumnRenamed("vector", "v"), "token")
    cosine = F.coalesce(F.try_divide(dot("v", "u"), F.sqrt(dot("v", "v") * dot("u", "u"))), F.lit(0.0))
    compared = pairs.select("token", "correct", "at", F.log(F.col("often") / F.col("n")).alias("lead"), "u", "v", cosine.cast("float").alias("cosine"), F.lit(0).cast("bigint").alias("nearer"))
    near = _nearer(written(compared, "likely-glyphs"), frequent, model.basis.shape[1]).filter(F.col("nearer") < NEIGHBOURS)
    # At most one choice per glyph edit.
    return near.groupBy("token").agg(F.collect_list(F.struct("correct", "at", "lead", F.col("u").alias("vector"))).alias("choices"))


def read_in_context(waiting: DataFrame, model: SkipGrams) -> DataFrame:
    """``id, line_no, noise, token, cut, next_no, whole, correct, at``: each occurrence with its correction, or none.

    The choice with the highest odds counts: its lead in frequency, times the odds of the words around the
    occurrence by its vector; they must reach ``LEAST_RATIO``.
    """
    shared = waiting.sparkSession.sparkContext.broadcast(model.basis)
    kept = ["id", "line_no", "noise", "token", "cut", "next_no", "whole"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, least = shared.value, math.log(LEAST_RATIO)
        for batch in batches:
            correct, place = [], []
            for near, choices in zip(batch.column("near").to_pylist(), batch.column("choices").to_pylist()):
                best, word, at = least, None, None
                if choices:
                    around = basis[near].sum(axis=0) if near else np.zeros(basis.shape[1], np.float32)
                    for c in choices:
                        odds = c["lead"] + float(np.dot(np.array(c["vector"], np.float32), around))
                        if odds >= best and (odds > best or word is None or c["correct"] < word):
                            best, word, at = odds, c["correct"], c["at"]
                correct.append(word)
                place.append(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(correct, pa.string()), pa.array(place, pa.int32())], [*kept, "correct", "at"])

    schema = ", ".join(f"{k} {waiting.schema[k].dataType.simpleString()}" for k in kept)
    return waiting.select(*kept, "near", "choices").mapInArrow(decide, f"{schema}, correct string, at int")


def file_facts(counts: DataFrame) -> DataFrame:
    """``file, offset, roman_offset, chapters, heads``: printed number of page 0, by the votes of the file's number lines;
    its chapter titles, and the forms of lines like chapter titles that come back in it."""
    part = F.split("token", _SEP)
    votes = counts.filter(F.col("kind").isin(NUMBER, ROMAN)).select("kind", part[0].alias("file"), part[1].cast("int").alias("d"), "n")
    order = Window.partitionBy("kind", "file").orderBy("d")
    following = F.when(F.lead("d").over(order) == F.col("d") + 1, F.lead("n").over(order)).otherwise(0)
    support = votes.withColumn("s", F.col("n") + following)
    best = support.groupBy("kind", "file").agg(F.max_by("d", F.struct("s", "n", "d")).alias("d"))
    offsets = best.groupBy("file").agg(F.max(F.when(F.col("kind") == NUMBER, F.col("d"))).alias("offset"), F.max(F.when(F.col("kind") == ROMAN, F.col("d"))).alias("roman_offset"))
    # Titles of a file: as many as it has chapters.
    named = counts.filter((F.col("kind") == CHAPTER) | ((F.col("kind") == HEAD) & (F.col("n") > 1)))
    titles = named.groupBy(part[0].alias("file")).agg(
        F.collect_set(F.when(F.col("kind") == CHAPTER, part[1])).alias("chapters"), F.collect_set(F.when(F.col("kind") == HEAD, part[1])).alias("heads")
    )
    return offsets.join(titles, "file", "full_outer")


class GlyphReader:
    """Reads Han glyphs in their context: skip-gram vectors of the confusable glyphs propose, the counts of pairs decide."""

    def __init__(self, pairs: dict[str, int]) -> None:
        self.pairs = pairs
        self.glyphs = sorted(_READINGS)
        own = {g: k for k, g in enumerate(self.glyphs)}
        chars = sorted({c for p in pairs for c in p})
        self.at = {c: k for k, c in enumerate(chars)}
        table = np.zeros((len(own), 2 * max(1, len(chars))))
        for (a, b), n in pairs.items():
            if a in own:
                table[own[a], self.at[b]] += n
            if b in own:
                table[own[b], len(chars) + self.at[a]] += n
        model = SkipGrams(chars or [""], table)
        self.basis, self.rows, self.own = model.basis, model.vectors(table).astype(np.float32), own
        self.seen: dict[tuple[str, str], set[str]] = {}

    def proposed(self, x: str, y: str) -> set[str]:
        """The ``GLYPH_NEIGHBOURS`` confusable glyphs that fit best between ``x`` and ``y``, either of them may be empty."""
        if (x, y) not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            # A neighbour that may itself be misread counts in each of its readings.
            score = np.zeros(len(self.glyphs), np.float32)
            for c, shift in ((y, 0), (x, len(self.at))):
                forms = [z for z in (c, *sorted(_READINGS.get(c, ()))) if z in self.at]
                if forms:
                    score += (self.rows @ self.basis[[self.at[z] + shift for z in forms]].T).max(axis=1)
            least = np.partition(score, -GLYPH_NEIGHBOURS)[-GLYPH_NEIGHBOURS] if len(score) > GLYPH_NEIGHBOURS else -np.inf
            self.seen[x, y] = {g for g, v in zip(self.glyphs, score) if v >= least}
        return self.seen[x, y]


def han_readings(reader: GlyphReader, text: str) -> list[tuple[int, str]]:
    """(position, correction) of misread Han glyphs: proposed by the vectors, decided by the pairs with their neighbours."""
    out = []
    n = len(text)
    get = reader.pairs.get
    for m in _CONFUSABLE.finditer(text):
        at = m.start()
        a = text[at]
        x = text[at - 1] if at and "\u3400" <= text[at - 1] <= "\u9fff" else ""
        y = text[at + 1] if at + 1 < n and "\u3400" <= text[at + 1] <= "\u9fff" else ""
        before = get(x + a, 0) if x else 0
        after = get(a + y, 0) if y else 0
        best, correction = LEAST_ODDS, ""
        for b in _READINGS[a]:
            odds, top = 0.0, 0
            # The neighbour may be misread too, at a price.
            if x:
                there = get(x + b, 0)
                for z in _READINGS.get(x, ()):
                    there = max(there, get(z + b, 0) * SECOND_PRICE)
                odds = math.log((there + 0.5) / (before + 0.5))
                top = there
            if y:
                there = get(b + y, 0)
                for z in _READINGS.get(y, ()):
                    there = max(there, get(b + z, 0) * SECOND_PRICE)
                odds += math.log((there + 0.5) / (after + 0.5))
                top = max(top, there)
            if odds > best and top >= LEAST_RATIO:
                best, correction = odds, b
        if correction and correction in reader.proposed(x, y):
            out.append((at, correction))
    return out


def _glyph_pairs(counts: DataFrame) -> dict[str, int]:
    """Counts of the pairs with a confusable glyph: bounded by the glyph table times the characters in use."""
    listed = counts.filter(F.col("kind") == PAIR).select("token", "n").toPandas()
    return dict(zip(listed["token"], listed["n"].astype(int)))


def noise_candidates(fields: DataFrame, counts: DataFrame, links: DataFrame, model: SkipGrams) -> DataFrame:
    """``id, line_no, noise, token, cut, next_no, near``: labels, and words still to be looked up in the counts.

    ``noise`` is a final label if ``token`` is null; *broken* and *rare* wait for their word, ``near`` its context.
    """
    spark = fields.sparkSession
    facts = written(file_facts(counts), "file-facts")
    pairs = _glyph_pairs(counts)
    # Words that are no misreadings need no lookup; the most frequent ones of them are most of the text.
    right = counts.filter(F.col("kind") == WORD).select("token", "n").join(links.select("token"), "token", "left_anti")
    frequent = right.orderBy(F.desc("n"), "token").limit(FREQUENT_WORDS).select("token").toPandas()["token"]
    shared = spark.sparkContext.broadcast((GlyphReader(pairs), model, frozenset(frequent)))
    joined = fields.join(broadcast_if_small(facts), "file", "left").select("id", "content", "page", "table", "image", "layer", "file", "book", "offset", "roman_offset", "chapters", "heads")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model, frequent = shared.value
        cache: dict = {}
        for batch in batches:
            rows, line_no, noise, token, cut, next_no, near = [], [], [], [], [], [], []

            def add(r: int, line: int, what: str, word: str | None = None, at: int | None = None, following: int | None = None, around: list[int] | None = None) -> None:
                rows.append(r)
                line_no.append(line + 1)
                noise.append(what)
                token.append(word)
                cut.append(at)
                next_no.append(None if following is None else following + 1)
                near.append(around)

            columns = [batch.column(k).to_pylist() for k in range(1, 12)]
            for r, (content, page, table, image, layer, file, book, offset, roman, chapters, heads) in enumerate(zip(*columns)):
                if not content or not is_running_text(content, table, image):
                    continue
                if (file, book) not in cache:
                    if len(cache) > 10_000:
                        cache.clear()
                    cache[file, book] = _title_classes(book or "", chapters or [], heads or [])
                classes, longest = cache[file, book]
                lines = content.split("\n")
                furniture: list[str | None] = [None] * len(lines)
                if layer != "parent" and len(lines) > 1:
                    furniture = label_furniture(lines, page, classes, longest, (offset, roman))
                    for k, what in enumerate(furniture):
                        if what:
                            add(r, k, what)
                broken = broken_words(lines, furniture)
                running = _sequence(_words(lines, furniture, broken), broken)
                for k, (w, line, cut_no) in enumerate(running):
                    if cut_no < 0 and w in frequent:
                        continue
                    around = model.context(running[k - 1][0] if k else None, running[k + 1][0] if k + 1 < len(running) else None)
                    if cut_no < 0:
                        add(r, line, "rare", w, around=around)
                    else:
                        add(r, line, "broken", w, broken[cut_no][3], broken[cut_no][1], around)
                if _CONFUSABLE.search(content):
                    text, owner = _condensed(lines, furniture)
                    for k in sorted({owner[at] for at, _ in han_readings(reader, text)}):
                        add(r, k, "glyph")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(line_no, pa.int32()), pa.array(noise, pa.string()), pa.array(token, pa.string()), pa.array(cut, pa.int32()), pa.array(next_no, pa.int32()), pa.array(near, pa.list_(pa.int32()))],
                ["id", "line_no", "noise", "token", "cut", "next_no", "near"],
            )

    kind = fields.schema["id"].dataType.simpleString()
    return joined.mapInArrow(label, f"id {kind}, line_no int, noise string, token string, cut int, next_no int, near array<int>")


def prepared(df: DataFrame) -> DataFrame:
    """The columns of the chunk table that count, with the file of each chunk found by either of its names."""
    names = df.filter("document_id IS NOT NULL AND source IS NOT NULL").groupBy("document_id").agg(F.min("source").alias("named"))
    chunks = df.select(
        "id", "content", "page", F.col("is_table_chunk").alias("table"), F.col("is_image_chunk").alias("image"), "layer", "source", "title", "document_id"
    ).filter("id IS NOT NULL")
    joined = chunks.join(broadcast_if_small(names), "document_id", "left")
    file = F.coalesce("source", "named")
    book = F.regexp_replace(F.regexp_replace(file, r"\.\w{1,5}$", ""), r"-\d+$", "")
    return joined.select("id", "content", "page", "table", "image", "layer", file.alias("file"), "title", book.alias("book"))


def _scan(df: DataFrame) -> dict[str, DataFrame]:
    """All tables of a scan: ``fields, counts, links, found`` and ``waiting``, the words that were looked up."""
    fields = spread(prepared(df))
    counts = written(first_pass(fields.select("id", "content", "page", "table", "image", "layer", "file", "title")), "scan-counts")
    model = word_model(counts)
    links = written(glyph_links(counts, model), "glyph-links")
    found = written(noise_candidates(fields, counts, links, model), "noise-candidates")
    words = counts.filter(F.col("kind") == WORD).select("token", F.lit(True).alias("whole"))
    known = words.join(links, "token", "full_outer")
    waiting = read_in_context(found.filter("token IS NOT NULL").join(known, "token"), model)
    return {"fields": fields, "counts": counts, "links": links, "found": found, "waiting": waiting}


def scan_noise(df: DataFrame) -> DataFrame:
    """``id, line_no, noise``, each row once: header, page_number, hyphen and glyph lines, counted from 1.

    Expects ``id, content, page, is_table_chunk, is_image_chunk, layer, source, title, document_id``; others are
    ignored. Null ids and null or empty contents give no row, tables and images have no running text; a chunk
    without a page gets page-number labels only for numbers in page-number dress; one whose file is
    unknown is checked for chapter heads only; repeated rows count once; one-line contents have no furniture.
    """
    scan = _scan(df)
    waiting = scan["waiting"]
    hyphens = waiting.filter("noise = 'broken' AND (whole OR correct IS NOT NULL)").select("id", "line_no", F.lit("hyphen").alias("noise"))
    at_line = F.when((F.col("noise") == "broken") & (F.col("at") >= F.col("cut")), F.col("next_no")).otherwise(F.col("line_no"))
    glyphs = waiting.filter("correct IS NOT NULL").select("id", at_line.alias("line_no"), F.lit("glyph").alias("noise"))
    ready = scan["found"].filter("token IS NULL").select("id", "line_no", "noise")
    return ready.unionByName(hyphens).unionByName(glyphs).distinct()


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() else word.capitalize() if like[:1].isupper() else word


def repaired_text(content: str, furniture: set[int], joins: set[int], fixes: dict[str, str], reader: GlyphReader) -> str:
    """Continuous paragraphs: furniture removed, words joined, glyphs corrected, lines reflowed (line numbers from 1)."""
    lines = [(k, line.rstrip()) for k, line in enumerate(content.split("\n"), 1) if k not in furniture]
    full = [line for _, line in lines if line.strip()]
    if not full:
        return ""
    width = max(map(len, full))
    closed = sum(line.endswith(_STOPS) for line in full)
    wrapped = len(full) > 1 and closed < 0.6 * len(full)
    paragraphs: list[str] = []
    text = ""
    open_word = False
    for k, line in lines:
        own = line.strip()
        if not own:
            if text and not open_word and (text.endswith(_STOPS) or not wrapped):
                paragraphs.append(text)
                text = ""
            continue
        if not text:
            text = own
        elif open_word:
            text = text + own
        elif _RUN.match(text[-1]) or _RUN.match(own[0]) or text[-1] in "，。；：、！？（“《" or own[0] in "，。；：、！？）”》":
            text = text + own
        else:
            text = text + " " + own
        open_word = k in joins
        if open_word:
            text = text.rstrip(HYPHENS + " ")
        elif text.endswith(_STOPS) and (not wrapped or len(line) < 0.7 * width):
            paragraphs.append(text)
            text = ""
        elif not wrapped:
            paragraphs.append(text)
            text = ""
    if text:
        paragraphs.append(text)
    out = []
    for t in paragraphs:
        if fixes:
            t = _WORD.sub(lambda m: _cased(m[0], fixes[m[0].lower()]) if m[0].lower() in fixes else m[0], t)
        for at, b in han_readings(reader, t):
            t = t[:at] + b + t[at + 1 :]
        out.append(t)
    return "\n\n".join(out)


_STOPS = ("。", ".", "!", "?", "！", "？", "．", "｡", "”", '"', "：", ":")


def repair_scans(df: DataFrame) -> DataFrame:
    """``id, text``: the running text of every chunk as continuous paragraphs; defined cases as in :func:`scan_noise`.

    Tables, images and null contents come out as they are.
    """
    scan = _scan(df)
    waiting = scan["waiting"].filter("correct IS NOT NULL OR (noise = 'broken' AND whole)")
    # At most as many entries per chunk as its text has lines and words.
    words = waiting.groupBy("id").agg(
        F.collect_set(F.when(F.col("correct").isNotNull(), F.struct("token", "correct"))).alias("fixes"),
        F.collect_set(F.when(F.col("noise") == "broken", F.col("line_no"))).alias("joins"),
    )
    lines = scan["found"].filter("noise IN ('header', 'page_number')").groupBy("id").agg(F.collect_set("line_no").alias("furniture"))
    # One row per id: the content is the same in every delivery.
    fields = scan["fields"].groupBy("id").agg(F.min(F.struct("content", "table", "image")).alias("f"))
    joined = fields.join(lines, "id", "left").join(words, "id", "left").select("id", "f.content", "f.table", "f.image", "furniture", "joins", "fixes")
    shared = df.sparkSession.sparkContext.broadcast(GlyphReader(_glyph_pairs(scan["counts"])))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, table, image, furniture, joins, fixes in zip(*(batch.column(k).to_pylist() for k in range(1, 7))):
                if not content or not is_running_text(content, table, image):
                    out.append(content)
                else:
                    own = {f["token"]: f["correct"] for f in fixes or []}
                    out.append(repaired_text(content, set(furniture or []), set(joins or []), own, shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    return joined.mapInArrow(repair, f"id {fields.schema['id'].dataType.simpleString()}, text string")
