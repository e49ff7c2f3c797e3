"""Personal data, also behind disguises: texts are normalised by transducers that remember where each character came from.

Detectors find e-mail addresses, IP addresses, card numbers and telephone numbers. They read the text as it
is (*base* spans), and once more after two transducers: one maps homoglyphs and other digits to ASCII and
deletes invisible characters, the next turns spelled digits into digits and ``(at)``, ``[dot]``, ``at .. dot``
into ``@`` and ``.``. A match that holds a rewritten character is mapped back to the span of source characters
it came from and added, unless a base span of its kind covers it.

Most texts hold nothing to look for. Per run of texts, one pass over the bytes finds those with an ``@``, a
digit, a byte that homoglyphs begin with, a bracket that can hold a disguise, or a word that disguises are made
of; only these become Python strings. All detectors take time in proportion to the text, so long texts and long runs of digits are safe.

Nulls and ties: a null text counts as empty; every row gets one result row, repeated or not.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm import textvec as tv
from stopweave.llm.store import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]+")
#: From the first digit of a run, as no later one does better; so a run is read four times at most.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHER = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[Span]:
    """What comes before an @ starts where the last match or the last @ ended, at the earliest."""
    low, at = 0, text.find("@")
    while at >= 0:
        begin = low + len(text[low:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        low = at + 1
        if found:
            yield begin, found.end()
            low = found.end()
        at = text.find("@", low)


def ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(run[0]):
                if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
                    yield run.start() + m.start(), run.start() + m.end()


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2], sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_OTHER.sub("", m[0])) <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))

# Letters that look like Latin ones, in the order of the Latin letters they look like.
_LOOKS = {
    "АВЕЅІЈКМНОРСТХУԌ": "ABESIJKMHOPCTXYG",
    "аеѕіјорсухԁһԛԝӏ": "aesijopcyxdhqwl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "αεικνορτυχ": "aeikvoptux",
    "․‧∙•。＠﹫⁺": ".....@@+",
    "‐‑‒–—−": "------",
}
_CHARS = {ord(a): b for key, to in _LOOKS.items() for a, b in zip(key, to, strict=True)}
_CHARS |= {0xFF00 + i: chr(0x20 + i) for i in range(1, 95)}
_CHARS |= {zero + i: chr(0x30 + i) for zero in (0x660, 0x6F0, 0x966, *range(0x1D7CE, 0x1D800, 10)) for i in range(10)}
_CHARS |= {first + i: chr(0x41 + i) for first in range(0x1D400, 0x1D6A4, 52) for i in range(26)}
_CHARS |= {first + 26 + i: chr(0x61 + i) for first in range(0x1D400, 0x1D6A4, 52) for i in range(26)}
_CHARS |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_CHARS |= {0xA0: " ", 0x2009: " ", 0x202F: " "}
_FOREIGN = re.compile(r"[^\x00-\x7F]")
#: First bytes, in UTF-8, of the characters above, but for the no-break space and the soft hyphen (C2).
_BYTES = sorted({chr(c).encode()[0] for c in _CHARS})

_DIGITS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_SPELLED = {w: str(i) for words in _DIGITS.values() for i, w in enumerate(words.split())}
_DOTS = ("dot", "punkt", "punto", "point")
_ATS = ("at", "arroba", "chez")
_PLUS = ("plus", "más", "mas")
_alt = lambda words: "|".join(sorted(words, key=len, reverse=True))
_ATOM = rf"(?:(?<!\w)(?:{_alt(_SPELLED)})(?!\w)|[0-9])"
_NUMBER = re.compile(rf"(?i)(?:(?<!\w)(?:{_alt(_PLUS)})[ ]+(?={_ATOM}))?{_ATOM}(?:[ -]?{_ATOM})+|(?<!\w)(?:{_alt(_SPELLED)})(?!\w)")
_PART = re.compile(rf"(?i){_alt(_SPELLED)}|{_alt(_PLUS)}|[0-9]")
#: What the patterns, which ignore case, let pass for i and s.
_FOLD = str.maketrans({"ı": "i", "İ": "i", "ſ": "s"})
_WORD = re.compile(r"\w+")
#: A sign between brackets, and as a word; patterns begin at the bracket and at the last space before the word.
_IN_BRACKETS = r"(?i)[(\[{<][ ]*+(?:%s|%s)[ ]*+[)\]}>][ ]*"
_AT = re.compile(_IN_BRACKETS % (_alt(_ATS), "@"))
_DOT = re.compile(_IN_BRACKETS % (_alt(_DOTS), r"\."))
_AT_WORD = re.compile(
    rf"(?i)[ ](?:{_alt(_ATS)})(?=[ ]+[a-z0-9-]+(?:[ ]+(?:{_alt(_DOTS)})[ ]+|[ ]*[(\[{{<][ ]*(?:{_alt(_DOTS)}))[a-z0-9]*)"
)
_DOT_WORD = re.compile(rf"(?i)[ ](?:{_alt(_DOTS)})(?=[ ]+[a-z0-9])")
_BEFORE = re.compile(r"(?i)[a-z0-9]")
_SPACES = re.compile("[ ]*")


class Tape:
    """A text whose character i stands for characters start[i] to end[i] of the source; new[i]: it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        n = len(text)
        self.start, self.end, self.new = np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Ranges, ascending, and what takes the place of each; each new character stands for the whole range."""
        if not edits:
            return
        text, at = [], 0
        for begin, end, to in edits:
            text += self.text[at:begin], to
            at = end
        text.append(self.text[at:])
        self.text = "".join(text)
        begin, end, size = (np.array(x, np.int64) for x in zip(*((b, e, len(to)) for b, e, to in edits), strict=True))
        self.new[np.minimum(end[size == 0], len(self.new) - 1)] = True  # what follows a deleted character, by its neighbour
        kept = np.flatnonzero(~tv.covered(begin, end - begin, len(self.new)))
        order = np.argsort(np.r_[2 * kept + 1, np.repeat(2 * begin, size)], kind="stable")
        joined = lambda own, value: np.r_[own[kept], np.repeat(value, size)][order]
        self.start, self.end, self.new = (
            joined(self.start, self.start[begin]), joined(self.end, self.end[end - 1]), joined(self.new, np.ones(len(size), bool)),
        )


def _lookalikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    found = ((m.start(), _CHARS.get(ord(m[0]))) for m in _FOREIGN.finditer(text))
    return [(i, i + 1, to) for i, to in found if to is not None]


def _signs(text: str, bracketed: re.Pattern, word: re.Pattern, sign: str) -> list[tuple[int, int, str]]:
    """Where ``sign`` is meant, with the spaces around it. A word stands for it only after a letter or digit."""
    edits, low = [], 0
    for m in bracketed.finditer(text):
        edits.append((low + len(text[low : m.start()].rstrip(" ")), m.end(), sign))
        low = m.end()
    low = 0
    for m in word.finditer(text):
        begin = low + len(text[low : m.start() + 1].rstrip(" "))
        if m.start() >= low and begin and _BEFORE.match(text, begin - 1):
            low = _SPACES.match(text, m.end()).end()
            edits.append((begin, low, sign))
    return sorted(edits)


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits, with what separates them from the next digit; those written as digits stay."""
    edits = []
    if not any(w in _SPELLED or w in _PLUS for w in _WORD.findall(text.translate(_FOLD).lower())):
        return edits
    for m in _NUMBER.finditer(text):
        parts = list(_PART.finditer(text, m.start(), m.end()))
        for p, following in zip(parts, [*parts[1:], None], strict=True):
            word = p[0].lower()
            if word in _SPELLED or word in _PLUS:
                end = following.start() if following else p.end()
                edits.append((p.start(), end, _SPELLED.get(word, "+")))
    return edits


def normalised(text: str) -> Tape:
    tape = Tape(text)
    tape.rewrite(_lookalikes(tape.text))
    tape.rewrite(_signs(tape.text, _AT, _AT_WORD, "@"))
    tape.rewrite(_signs(tape.text, _DOT, _DOT_WORD, "."))
    tape.rewrite(_numbers(tape.text))
    return tape


def find(text: str, disguised: bool = True) -> list[tuple[int, int, int, bool]]:
    """Spans as (start, number of the kind, end, whether base), ascending."""
    spans = [(a, k, b, True) for k, f in enumerate(DETECTORS.values()) for a, b in f(text)]
    if disguised:
        tape = normalised(text)
        if tape.new.any():
            base = {k: sorted((a, b) for a, kind, b, _ in spans if kind == k) for k in range(len(KINDS))}
            changed = np.r_[0, np.cumsum(tape.new)]
            for k, f in enumerate(DETECTORS.values()):
                for a, b in f(tape.text):
                    if changed[b] > changed[a]:
                        begin, end = int(tape.start[a]), int(tape.end[b - 1])
                        at = bisect.bisect_right(base[k], (begin, len(text) + 1)) - 1  # of a kind, none overlap
                        if at < 0 or base[k][at][1] < end:
                            spans.append((begin, k, end, False))
    return sorted(set(spans))


def _word_hashes(words: list[str]) -> np.ndarray:
    offsets, data = tv.bytes_of(pa.array(words, pa.large_string()))
    return np.sort(tv.split_words(tv.LOWER[data], offsets, tv.ALNUM).hashes())


def _member(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, hashes), len(of) - 1)] == hashes


_PLAIN = np.zeros(256, bool)
_PLAIN[[0x40, *range(0x30, 0x3A)]] = True
_ODD = np.zeros(256, bool)
_ODD[_BYTES] = True
_ODD[0xC2] = True  # no-break space and soft hyphen, and signs that only cost time


_DIGIT, _OPENING, _INNER = np.zeros((3, 256), bool)
_DIGIT[0x30:0x3A] = True
_OPENING[list(b"([{<")] = True
_INNER[[ord(w[0]) for w in (" ", "@", ".", *_ATS, *_DOTS)]] = True
_ASCII = tv.ALNUM.copy()
_ASCII[0x80:] = False


@functools.cache
def _hashes(words: tuple[str, ...]) -> np.ndarray:
    """Words in lower case, and with the other letters that the patterns, which ignore case, let pass for theirs."""
    out = []
    for w in words:
        made = [""]
        for c in w:
            same = [c, *([] if c.isascii() else [c.upper()]), *{"i": "ıİ", "s": "ſ"}.get(c, "")]
            made = [m + x for m in made for x in same]
        out += made
    return _word_hashes(out)


def worth(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts of a run can have base spans, and which can have disguised ones."""
    n = len(offsets) - 1
    low = tv.LOWER[data]
    some = lambda mask: np.add.reduceat(np.append(mask, False), offsets[:-1]) * (np.diff(offsets) > 0) > 0
    plain, odd = some(_PLAIN[data].astype(np.int32)), some(_ODD[data].astype(np.int32))
    after = np.append(low[1:], np.uint8(0x20))  # of a bracket: a space, or what _ATS, _DOTS, @ and . begin with
    bracket = some((_OPENING[data] & _INNER[after]).astype(np.int32))
    words_found = np.zeros(n, bool)
    for kind in (tv.ALNUM, _ASCII):  # words with the letters beside them, then without, as these can be signs
        words = tv.split_words(low, offsets, kind)
        short = np.flatnonzero(words.end - words.start <= 7)
        h, text = words.hashes()[short], words.text_of()[short]
        spelled, dot, plus = (_member(h, _hashes(w)) for w in (tuple(_SPELLED), _DOTS, _PLUS))
        beside = (np.diff(short) == 1) & (np.diff(text) == 0)
        words_found[text[dot]] = True
        words_found[text[1:][spelled[1:] & spelled[:-1] & beside]] = True
        words_found[text[spelled & plain[text]]] = True
        of = text[plus]
        at = short[plus] + 1  # the word after, which can be long
        at, of = at[at < len(words.start)], of[at < len(words.start)]
        words_found[of[_DIGIT[data[words.start[at]]]]] = True
    return plain, odd | words_found | bracket


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, offsets, data in tv.runs(batches):
        plain, hidden = worth(data, offsets)
        found: list[list] = [[]] * rows.num_rows
        for i in np.flatnonzero(plain | hidden):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            found[i] = [
                {"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in find(text, bool(hidden[i]))
            ]
        yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(found, _SPANS)], ["doc_id", "spans"])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every document, ascending by start and kind; offsets count code points."""
    return small_batches(docs).select("doc_id", "text").mapInArrow(_detect, f"doc_id long, spans {SPANS}")


def digest(rows: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(k) for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
