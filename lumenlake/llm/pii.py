"""Personal data: plain identifiers, and disguised ones by transducers that keep source offsets."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Letters that look like Latin ones, and characters that stand for a sign.
LOOKALIKES = {
    "a": "аα", "b": "Ьɓ", "c": "сϲ", "d": "ԁ", "e": "еє", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    ".": "。․‧∙⸱", "-": "‐‑‒–—―−⁃", "@": "＠﹫",
}
INVISIBLE = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
DIGIT_WORDS = {
    "0": "zero oh null cero zéro", "1": "one eins ein uno un", "2": "two zwei zwo dos deux", "3": "three drei tres trois", "4": "four vier cuatro quatre",
    "5": "five fünf fuenf cinco cinq", "6": "six sechs seis", "7": "seven sieben siete sept", "8": "eight acht ocho huit", "9": "nine neun nueve neuf",
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at ät arroba arobase klammeraffe", "dot punkt punto point", "plus más mas"
#: Dot words that go with an at word in running text, where the wrong pair is prose: "at this point blank".
SPOKEN = {"at": "dot punkt", "ät": "dot punkt", "klammeraffe": "dot punkt", "arroba": "dot punto", "arobase": "dot point"}
#: Articles, pronouns, prepositions and the like, which are no name or host around an at sign that is only a word or stands apart. Top domains are free.
FUNCTION_WORDS = frozenset(
    "a an the this that these those and or but of on if as we he she they his her its our their with for from into was were are been not be "
    "der die das den dem des ein eine einen einem und oder von vom zum zur mit für ist sind war nicht "
    "el los las una unos unas y o del con por para es son era no que "
    "le les des du et ou avec pour est sont dans ce cette qui".split())  # fmt: skip

WORD_DIGIT = {w: d for d, words in DIGIT_WORDS.items() for w in words.split()}
_ANY = lambda words: "|".join(sorted(words, key=len, reverse=True))
_WORDS, _AT, _DOT, _PLUS = _ANY(WORD_DIGIT), _ANY(AT_WORDS.split()), _ANY(DOT_WORDS.split()), _ANY(PLUS_WORDS.split())
#: What the token transducer rewrites: words, of which runs of digit words are one; signs in brackets or apart; digits with letters or wide gaps among them.
_KINDS = {w: "digits" for w in WORD_DIGIT} | {w: "at" for w in AT_WORDS.split()} | {w: "dot" for w in DOT_WORDS.split()} | {w: "plus" for w in PLUS_WORDS.split()}
_FIRST = "".join(sorted({w[0] for w in _KINDS}))
_WORD = re.compile(rf"[{_FIRST}](?<![^\W\d_].)[^\W\d_]*", re.S)
_RUN, _HEADS, _TAILS = re.compile(rf"(?:{_WORDS})+"), frozenset(w[:2] for w in WORD_DIGIT), frozenset(w[-2:] for w in WORD_DIGIT)
_SIGN = re.compile(rf"[\[({{<@.+](?:(?<=[\[({{<])\s*+(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))\s*+[\])}}>]|(?<=@)(?P<sign>)|(?<=\s\.)(?P<apart>)(?=\s)|(?<=\+)(?P<plus>)(?=[\s(]))")
_DIGITS, _LETTERED = re.compile(r"[0-9]+"), frozenset("0123456789oil")
_LETTER_DIGITS = str.maketrans("oil", "011")
_GAP, _OPENING = re.compile(r"[ \t-]*"), re.compile(r"[\s(]*")

_BASE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_BASE_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_BASE_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_BASE_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_BASE_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

@cache
def _characters() -> tuple[dict[int, str | None], frozenset[str]]:
    """What the first transducer writes for a character, None to delete it; and those characters."""
    table: dict[int, str | None] = {ord(c): None for c in INVISIBLE} | {ord(c): to for to, cs in LOOKALIKES.items() for c in cs}
    for c in range(0x80, 0x20000):
        ch = chr(c)
        digit = unicodedata.decimal(ch, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", ch)
        if c not in table and plain != ch and len(plain) == 1 and plain.isascii():
            table[c] = plain
    return table, frozenset(map(chr, table))


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The plain identifiers, leftmost and without overlap for each kind, in order; end exclusive."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _BASE_LOCAL:
            start -= 1
        if start < at and (m := _BASE_DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _ANY_DIGIT.search(text):
        out += [("ip", *m.span()) for m in _BASE_IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _BASE_CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _BASE_PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


Event = tuple[int, int, str]


def _words(low: str) -> Iterator[Event]:
    for m in _WORD.finditer(low):
        word = m[0]
        kind = _KINDS.get(word)
        if kind:
            yield *m.span(), kind
        elif len(word) > 3 and word[:2] in _HEADS and word[-2:] in _TAILS and _RUN.fullmatch(word):
            yield *m.span(), "digits"


def _mixed(low: str) -> Iterator[Event]:
    """Tokens of digits and o, i or l, one such letter between groups of digits, and wide gaps between digits."""
    done = 0
    for m in _DIGITS.finditer(low):
        start, end = m.span()
        if start < done:
            continue
        while start > done and low[start - 1] in _LETTERED:
            start -= 1
        while end < len(low) and low[end] in _LETTERED:
            end += 1
        done = end
        if end - start > len(m[0]) and (start == 0 or not low[start - 1].isalnum()) and not low[end : end + 1].isalnum() and not low[start:end].isdigit():
            yield start, end, "mixed"
        if low[end : end + 1] in (" ", ".", "-") and low[end + 1 : end + 2] in ("o", "i", "l") and low[end + 2 : end + 3] in (" ", ".", "-") and low[end + 3 : end + 4] in _LETTERED:
            yield end + 1, end + 2, "mixed"
        if low[end : end + 1] in (" ", "-") and low[end + 1 : end + 2] in (" ", "-"):
            to = end + 2
            while low[to : to + 1] in (" ", "-"):
                to += 1
            if low[to : to + 1] in _LETTERED:
                yield end, to, "gap"
                done = to


class Tokens:
    """The token transducer's output for a text, and where in the text each of its characters stands.

    Digit words become digits, and lose the blanks between them and to a word before; o, i and l
    among digits become digits, and wide gaps between digits one blank; at signs and dots that
    are words, bracketed or apart become plain signs without the blanks around them, and so does
    the plus of a number. Everything else is copied.
    """

    def __init__(self, text: str):
        self.text, self.out = text, text
        #: Parallel lists: where a piece starts in the output, where in the text, its length there, and whether it is a copy.
        self.begin: list[int] = [0]
        self.source: list[tuple[int, int, bool]] = [(0, len(text), True)]
        #: At signs by position in the output: the word, or @ for one that stands apart; dot words likewise.
        self.bare: dict[int, str] = {}
        # the one letter that lower() writes as two
        low = text.replace("\u0130", "i").lower()
        events = [*_words(low), *_mixed(low), *((*m.span(), m.lastgroup) for m in _SIGN.finditer(low))]
        if events:
            self._rewrite(low, sorted(events, key=lambda e: (e[0], -e[1])))

    def _rewrite(self, low: str, events: list[Event]) -> None:
        text, out, length, at, said = self.text, [], 0, 0, -1
        numbers = {e[0] for e in events if e[2] in ("digits", "mixed")}
        self.begin, self.source = [], []

        def put(chars: str, a: int, b: int, copy: bool = False) -> None:
            nonlocal length
            if chars:
                self.begin.append(length)
                self.source.append((a, b, copy))
                out.append(chars)
                length += len(chars)

        for start, end, kind in events:
            if start < at:
                continue
            word, bracketed = low[start:end], text[start] in "[({<"
            if kind == "digits":
                gap = text[at:start]
                if said == at and _GAP.fullmatch(gap):
                    at = start
                elif gap.endswith(" ") and start > 1 and text[start - 2].isalpha():
                    put(gap[:-1], at, start - 1, True)
                    at = start
                put(text[at:start], at, start, True)
                for w in _split_words(word):
                    put(WORD_DIGIT.get(w, w), start, start + len(w))
                    start += len(w)
                said = at = end
            elif kind in ("mixed", "gap"):
                put(text[at:start], at, start, True)
                put(" " if kind == "gap" else word.translate(_LETTER_DIGITS), start, end, kind == "mixed")
                at = end
            elif kind == "plus":
                to = _OPENING.match(text, end).end()
                if to < len(text) and (text[to] in "0123456789" or to in numbers):
                    put(text[at:start], at, start, True)
                    put("+", start, to)
                    at = to
            else:
                left, right = start, end
                while left > at and text[left - 1].isspace():
                    left -= 1
                while right < len(text) and text[right].isspace():
                    right += 1
                apart = left < start and right > end
                if not bracketed and kind in ("at", "dot") and not apart or kind == "sign" and left == start and right == end:
                    continue
                put(text[at:left], at, left, True)
                if not bracketed and kind != "apart":
                    self.bare[length] = word
                put("@" if kind in ("at", "sign") else ".", start, end)
                at = right
        put(text[at:], at, len(text), True)
        self.out = "".join(out)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The part of the text behind a part of the output."""
        i, j = bisect_right(self.begin, start) - 1, bisect_right(self.begin, end - 1) - 1
        (a, _, copied), (b, to, also) = self.source[i], self.source[j]
        return a + (start - self.begin[i]) * copied, b + end - self.begin[j] if also else to

    def spans(self) -> Iterator[Span]:
        """What the plain detectors find in the output, less what only looks like an address because a word became a sign."""
        for kind, a, b in base_spans(self.out):
            if kind != "email" or self._address(a, b):
                yield kind, *self.span(a, b)

    def _address(self, a: int, b: int) -> bool:
        name, _, domain = self.out[a:b].partition("@")
        labels = domain.lower().split(".")
        bare = {i: w for i, w in self.bare.items() if a <= i < b} if self.bare else {}
        at = bare.get(a + len(name))
        if not (labels[-1].isalpha() and len(labels[-1]) > 1) and (at or bare):
            return False
        if at is None:
            return True
        spoken = SPOKEN.get(at, DOT_WORDS).split()
        if any(w in DOT_WORDS.split() and w not in spoken for i, w in bare.items() if i > a + len(name)):
            return False
        return FUNCTION_WORDS.isdisjoint([name.lower(), labels[0]] if at != "@" else [name.lower()])


def _split_words(said: str) -> list[str]:
    """The digit words of a run without blanks, which may need another split than the longest first."""
    if said in WORD_DIGIT:
        return [said]
    ends: dict[int, int] = {0: -1}
    for end in range(1, len(said) + 1):
        for n in range(min(end, 8), 0, -1):
            if end - n in ends and said[end - n : end] in WORD_DIGIT:
                ends[end] = end - n
                break
    out, at = [], len(said)
    while at > 0 and at in ends:
        out.append(said[ends[at] : at])
        at = ends[at]
    return out[::-1] if at == 0 else [said]


def find_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) of a whole text in code points, by kind, start and end.

    A first transducer rewrites homoglyphs, other scripts' digits, wide and invisible
    characters one by one and notes each source position. A second one (Tokens) rewrites
    spelled digits and disguised signs of its output. The plain detectors run on the text and
    on what either transducer made of it, and spans are mapped back to the source. A span
    that a plain one of its kind equals, holds or cuts adds nothing; one that holds plain ones
    and more, as when a homoglyph cuts a name, is added beside them.
    """
    if not text:
        return []
    base = base_spans(text)
    table, strange = _characters()
    odd = not text.isascii() and not strange.isdisjoint(text)
    if odd:
        kept = [i for i, c in enumerate(text) if table.get(ord(c), c) is not None]
        norm = text.translate(table)
    else:
        kept, norm = range(len(text)), text
    tokens = Tokens(norm)
    found = [*(base_spans(norm) if odd else ()), *(tokens.spans() if tokens.out is not norm else ())]
    # Plain spans of a kind lie apart, and so do added ones, as longer ones come first: both stay sorted.
    plain = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
    plain = {k: ([a for a, _ in spans], [b for _, b in spans]) for k, spans in plain.items()}
    added: dict[str, tuple[list[int], list[int]]] = {k: ([], []) for k in KINDS}
    out = [(*s, True) for s in base]
    for kind, a, b in sorted(found, key=lambda s: (s[1] - s[2], s)):
        a, b = kept[a], kept[b - 1] + 1
        (starts, ends), (own_starts, own_ends) = plain[kind], added[kind]
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        at = bisect_right(own_ends, a)
        if at < bisect_left(own_starts, b) or i < j and (starts[i] < a or ends[j - 1] > b or (starts[i], ends[i]) == (a, b)):
            continue
        own_starts.insert(at, a)
        own_ends.insert(at, b)
        out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans of each document: kind, start, end (code points, end exclusive), base.

    A null text is empty and has no spans; a null doc_id is passed on; repeated rows are
    searched alike; an empty table gives an empty result. Columns other than doc_id and text
    are ignored. Texts are searched whole, in linear time: every pattern starts at the edge of
    a run and either takes it in one go or has a bounded number of parts.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base"), s)) for s in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """One row per document: how many spans of each kind, the base spans' SHA-256 and all spans as text."""
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
