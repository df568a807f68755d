"""Problem 8: sentence boundaries across languages and scripts.

The terminators are those of the Unicode ``Sentence_Break`` property (STerm and ATerm), so every script
with its own full stop is covered. On top of the standard rules stand suppression of language-specific
abbreviations, ordinals and item numbers, closing of quotations and brackets, and the Thai rule that a
blank is a boundary. A blank line ends a unit, a single line break never does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by language, after which the same sentence goes on.
_NEVER_LAST = {
    "": "no nos vs cf e.g i.e viz p pp v",
    "en": "dr mr mrs ms messrs prof dept gen col capt lt sgt maj cmdr adm gov sen rep rev hon pres st mt fig figs sec secs vol vols ch chap eq eqs ref refs "
    "art approx resp max est temp ed eds rd av ave blvd dist ft",
    "de": "dr prof nr abb tab art ca ggf bzw vgl inkl exkl evtl z.b d.h u.a o.ä s.o s.u i.d.r z.t hr fr str bd hrsg geb ing dipl max resp st temp fig vol gem lt kap bspw sog",
    "fr": "m mm mme mlle dr pr fig vol chap art env ex p.ex cf st ste av bd éd",
    "es": "sr sra srta dr dra fig vol cap art pág págs núm ej p.ej aprox ud uds av",
    "it": "sig sigg dott prof fig vol cap art pag pagg es ecc",
    "pt": "sr sra dr dra fig vol cap art pág págs nº ex",
    "ru": "рис табл стр см гл ст т.е др пр ул д г им проф акад",
    "hi": "क्र डॉ श्री सं प्रो पृ",
    "ar": "ص د م",
}
# These end a sentence if no lower-case letter follows.
_MAY_BE_LAST = {
    "": "etc a.m p.m u.s u.k",
    "en": "min inc ltd co corp bros jr sr al",
    "de": "usw usf min inkl gmbh",
    "fr": "etc cie",
    "es": "etc cía",
    "ru": "т.д т.п",
}
# These are abbreviations only before a number.
_BEFORE_NUMBER = {"": "no nos art p pp ch v", "de": "tab abb nr str bd kap", "en": "tab", "ru": "г д", "ar": "م د ص"}
# Frequent words that tell languages of the Latin script apart.
_TELLING = {
    "en": "the and of to is are was with for that this be by must from at on it as",
    "de": "der die das und ist nicht mit von den dem des ein eine auf für wird werden bei zu im aus dann nach oder siehe sich wenn auch",
    "fr": "le les des et est une dans pour que qui sur par avec du aux ne pas sont",
    "es": "el los las y es una en para que con del por se no son como su al",
    "it": "il gli di che è una per con non sono della nel alla dei si da",
    "pt": "o os as e é uma em para que com do da não são por no na ao",
}
_NAMES = {
    "en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german", "deutsch"), "fr": ("fr", "fra", "fre", "french", "français"),
    "es": ("es", "spa", "spanish", "español"), "it": ("it", "ita", "italian", "italiano"), "pt": ("pt", "por", "portuguese", "português"),
}


class Abbreviations:
    """The abbreviations of one language of the Latin script, with those of languages that their script tells."""

    def __init__(self, *latin: str) -> None:
        def words(table: dict[str, str]) -> frozenset[str]:
            return frozenset(" ".join(table.get(k, "") for k in ("", "ru", "hi", "ar", *latin)).split())

        self.may_be_last, self.before_number = words(_MAY_BE_LAST), words(_BEFORE_NUMBER)
        self.never_last = words(_NEVER_LAST) - self.may_be_last


_BY_LANGUAGE = {k: Abbreviations(k) for k in _TELLING}
_BY_LANGUAGE[""] = Abbreviations("en")
# Where the language is unknown, abbreviations of any language count before a number.
_BY_LANGUAGE[""].before_number |= frozenset(w for k in _TELLING for w in _NEVER_LAST[k].split()) - _BY_LANGUAGE[""].never_last
_LANGUAGE_OF = {name: k for k, names in _NAMES.items() for name in names}
_LANGUAGES_OF_WORD: dict[str, list[str]] = {}
for _k, _v in _TELLING.items():
    for _w in _v.split():
        _LANGUAGES_OF_WORD.setdefault(_w, []).append(_k)
#: A number with a full stop after one of these words, or before a month, is a German ordinal.
ORDINAL_AFTER = frozenset("am der dem den des die das vom zum zur im ab bis seit ein eine einer einem einen jeder jede jedes und oder beim".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

_OPEN = "“「『《〈（(［[【〔｛{«„‘‹"
_CLOSE_OF = {"“": "”", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）)", "(": ")）", "［": "］]", "[": "]］", "【": "】", "〔": "〕", "｛": "｝}", "{": "}｝", "«": "»", "„": "“”", "‘": "’", "‹": "›"}
_CLOSE = "”」』》〉）)］]】〕｝}»’›"
_CONTINUES = regex.compile(r"\p{SB=SC}")
_LATIN_WORD = regex.compile(r"\b\p{Latin}{1,9}\b")
_QUOTES = set("“”「」『』«»„‘’‹›\"＂")

_BREAK = r"(?>\r\n|[\n\r\x85\u2028])"
_SAME_LINE = r"[^\S\n\r\x85\u2028\u2029]*"
_PARAGRAPH = regex.compile(f"{_BREAK}{_SAME_LINE}(?:{_BREAK}{_SAME_LINE})+|{_BREAK}?\\u2029")
_HIT = regex.compile(r"[\p{SB=ST}\p{SB=AT}…]+|[" + regex.escape(_OPEN + _CLOSE) + r"\"＂]|(?<=\p{Thai})[ \t\xa0\u3000]+(?=\S)")
_TRAIL = regex.compile(r"(?:[" + regex.escape(_CLOSE) + r"\"＂']|(?=\p{SB=CL})[\p{Pe}\p{Pf}])+")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}.]+$")
_NUMBERISH = regex.compile(r"[\p{N}IVXLCivxlc]")
_ITEM = regex.compile(r"^[\s\ufeff]*[(（]?(?:\p{Nd}{1,4}(?:\.\p{Nd}{1,3})*|[IVXLC]{1,5}|[一二三四五六七八九十]{1,3}|\p{Latin})$")
_WORD_BEFORE = regex.compile(r"(\p{L}+)\s+$")
_UNIT_BEFORE = regex.compile(r"(?:/|\p{Nd}\s?)$")
_WORD_AFTER = regex.compile(r"\s*(\p{L}+)")
_BLANKS = regex.compile(r"[ \t\xa0\u3000]*")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_LATIN_OR_NUMBER = regex.compile(r"[\p{Latin}\p{N}]")
_SOLID = regex.compile(r"[^\s\ufeff\u200b]")


def language(text: str, lang: str | None = None) -> str:
    """The language of the Latin words of a text, by their frequent words; where they tell none, what ``lang`` says; else ''."""
    votes: dict[str, int] = {}
    for m in _LATIN_WORD.finditer(text.lower()):
        for k in _LANGUAGES_OF_WORD.get(m.group(), ()):
            votes[k] = votes.get(k, 0) + 1
    if votes:
        top = max(votes.values())
        best = [k for k, n in votes.items() if n == top]
        if len(best) == 1:
            return best[0]
    else:
        best = []
    said = _LANGUAGE_OF.get(regex.split(r"[-_ ]", (lang or "").strip().lower())[0], "")
    return said if not best or said in best else sorted(best)[0]


def _pairs(para: str, hits: list) -> dict[int, int]:
    """Position of the opening mark -> position of its closing mark; unpaired marks are left out."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    straight: dict[str, int] = {}
    for m in hits:
        c = m.group()
        if len(c) != 1:
            continue
        at = m.start()
        if c in "\"＂":
            if c in straight:
                begin = straight.pop(c)
                pairs[begin] = at
                while stack and stack[-1][1] > begin:
                    stack.pop()
            else:
                straight[c] = at
            continue
        closing = next((k for k in range(len(stack) - 1, -1, -1) if c in _CLOSE_OF[stack[k][0]]), None)
        if closing is not None and (c in _CLOSE or c == "“"):
            pairs[stack[closing][1]] = at
            del stack[closing:]
        elif c in _CLOSE_OF:
            if c == "‘" and at and para[at - 1].isalnum():
                continue
            stack.append((c, at))
    return pairs


def _lower_follows(para: str, at: int) -> bool:
    while at < len(para) and (para[at].isspace() or para[at] in _QUOTES or para[at] in _OPEN):
        at += 1
    return at < len(para) and para[at].islower()


def _abbreviation(para: str, begin: int, start: int):
    """The token before a full stop, and its word where it may be an abbreviation: not in units such as mL/min, nor before a wide stop."""
    token = _TOKEN.search(para, max(begin, start - 40), start)
    if not token:
        return None, ""
    word = token.group().lower()
    if not word.isdigit() and (para[start] == "．" or para[token.start() - 1 : token.start()] == "/"):
        return token, "" if len(word) > 1 else word
    return token, word


def _stop_ends(para: str, begin: int, start: int, end: int, words: Abbreviations) -> bool:
    """Does the full stop at ``para[start:end]`` end the unit that began at ``begin``?"""
    before, after = para[start - 1 : start], para[end : end + 1]
    if not before:
        return False
    if after and not after.isspace() and (after.isalnum() or after in "_-/\\@&=%℃°,，;；:"):
        if not (_CJK.match(after) and after.isalnum()):
            return False
        if not (_CJK.match(before) or before.isalpha() or before in "%℃°”」）)"):
            return False  # a digit in front: a number or an item
        return _abbreviation(para, begin, start)[1] not in words.never_last and not _ITEM.match(para[begin:start])
    if _ITEM.match(para[begin:start][:16]) and start - begin <= 16:
        return False
    rest = _BLANKS.match(para, end).end()
    follows = para[rest : rest + 1]
    if follows in ("\n", "\r") and follows:
        gap = _WORD_AFTER.match(para, end)
        rest = gap.start(1) if gap else rest + 1
        while rest < len(para) and para[rest].isspace():
            rest += 1
        follows = para[rest : rest + 1]
    token, word = _abbreviation(para, begin, start)
    if word.isdigit() and follows:
        lead = _WORD_BEFORE.search(para, max(begin, start - 40), token.start())
        if lead and lead.group(1).lower() in ORDINAL_AFTER:
            return False
        nxt = _WORD_AFTER.match(para, end)
        if nxt and nxt.group(1).lower() in MONTHS:
            return False
        if follows.isdigit():
            return False
    if word:
        plain = word.rstrip(".")
        if plain in words.may_be_last:
            return not _lower_follows(para, end)
        if plain in words.before_number:
            if follows and _NUMBERISH.match(follows):
                return False
        elif plain in words.never_last:
            return not follows
        elif len(plain) == 1 and plain.isalpha() and not _CJK.match(plain) and follows:
            if not _UNIT_BEFORE.search(para, max(begin, start - 40), token.start()):
                return False  # initials, "z. B."; "mg/L." and "5 V." are units of measure
    return not _lower_follows(para, end)


def _paragraph_ends(para: str, words: Abbreviations) -> list[int]:
    """Ends of the units of one paragraph without surrounding white space."""
    hits = list(_HIT.finditer(para))
    pairs = _pairs(para, hits) if any(m.group() in _OPEN or m.group() in "\"＂" for m in hits) else {}
    closers = {b: a for a, b in pairs.items()}
    inside: list[int] = []  # closing positions of the open pairs
    ends: list[int] = []
    begin, n, skip = 0, len(para), -1
    for m in hits:
        start, end = m.span()
        mark = m.group()
        if start in pairs and end - start == 1:
            inside.append(pairs[start])
            continue
        if start in closers and end - start == 1:
            while inside and inside[-1] <= start:
                inside.pop()
            continue
        if start < skip or (end - start == 1 and (mark in _OPEN or mark in _CLOSE or mark in "\"＂")):
            continue
        if mark[0].isspace():
            left, right = para[start - 1], para[end]
            if not inside and not _LATIN_OR_NUMBER.match(left) and not _LATIN_OR_NUMBER.match(right):
                ends.append(start)
                begin = end
            continue
        dots = mark.strip(".․﹒．…") == ""
        if dots and (len(mark) > 1 or mark == "…"):
            continue  # ellipses
        if inside:
            # Only a mark right before the closing marks of every open pair can end the unit.
            at = end
            last = None
            depth = list(inside)
            while depth and at < n:
                gap = _BLANKS.match(para, at).end()
                if gap != depth[-1]:
                    break
                last = depth.pop()
                at = last + 1
            if depth or last is None:
                continue
            if not para[at:].strip():
                continue  # the end of the paragraph
            if para[last] not in _QUOTES or not para[at].isspace():
                continue
            letter = regex.search(r"\p{L}\P{L}*$", para[max(begin, start - 40) : start])
            if not letter or not regex.match(r"\p{Latin}", letter.group()) or _lower_follows(para, at):
                continue
            if dots and not _stop_ends(para, max(begin, inside[-1] - 10**9), start, end, words) and _lower_follows(para, at):
                continue
            ends.append(at)
            begin, skip = at, at
            while begin < n and para[begin].isspace():
                begin += 1
            continue
        if dots and not _stop_ends(para, begin, start, end, words):
            continue
        if not dots and mark[-1] in "!?" and end < n and not para[end].isspace() and regex.match(r"[\p{Latin}\p{Nd}=&/_]", para[end]):
            continue  # inside an address or a name
        if not dots and mark[-1] in "!?" and _CONTINUES.match(para, end):
            continue  # a comma, colon, dash or the like goes on with the sentence
        trail = _TRAIL.match(para, end)
        stop = end
        if trail:
            stop = end
            while stop < trail.end() and stop not in pairs:
                stop += 1
        ends.append(stop)
        begin, skip = stop, stop
        while begin < n and para[begin].isspace():
            begin += 1
    if _SOLID.search(para, ends[-1] if ends else 0):
        ends.append(n)
    return ends


def sentence_spans(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit, in order, without surrounding white space.

    ``lang`` counts only where the words of the text don't tell its language.
    """
    words = _BY_LANGUAGE[language(text, lang)]
    spans: list[tuple[int, int]] = []
    begin = 0
    cuts = [*((m.start(), m.end()) for m in _PARAGRAPH.finditer(text)), (len(text), len(text))]
    for stop, following in cuts:
        raw = text[begin:stop]
        stripped = raw.strip()
        if stripped and _SOLID.search(stripped):
            base = begin + len(raw) - len(raw.lstrip())
            last = 0
            for end in _paragraph_ends(stripped, words):
                while last < end and stripped[last].isspace():
                    last += 1
                if end > last:
                    spans.append((base + last, base + end))
                last = end
        begin = following
    return spans


def split_sentences(df: DataFrame, key: str, text: str, with_text: bool = True, lang: str | None = None) -> DataFrame:
    """Sentence units: ``item_id, sentence_no, start_pos, end_pos[, sentence]``.

    Positions count code points and ``end_pos`` follows the last character of the unit. Null, empty and
    blank texts give no row; a text without any mark is one unit per paragraph; null keys and repeated
    rows are kept; other columns are ignored, whatever their names. ``lang`` names a column with the language, which may
    be null or wrong: abbreviations are those of the language that the text's own words show. One narrow pass without a shuffle;
    time is linear in the text.
    """
    said = F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string")
    fields = df.select(F.col(f"`{key}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("__text"), said.alias("__lang"))
    names = ["item_id", "sentence_no", "start_pos", "end_pos"] + (["sentence"] if with_text else [])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, no, start, end, sentence = [], [], [], [], []
            for r, (t, said) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if not t:
                    continue
                for k, (s, e) in enumerate(sentence_spans(t, said)):
                    rows.append(r)
                    no.append(k)
                    start.append(s)
                    end.append(e)
                    if with_text:
                        sentence.append(t[s:e])
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            if with_text:
                arrays.append(pa.array(sentence, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = fields.schema["item_id"].dataType.simpleString()
    more = ", sentence string" if with_text else ""
    return fields.mapInArrow(units, f"item_id {kind}, sentence_no int, start_pos int, end_pos int{more}")
