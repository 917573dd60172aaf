"""Personal data: plain patterns, and disguised forms found by transducers.

The plain patterns run over the text as it is; their spans (*base* spans)
always stay.  Around possible disguises a cascade of transducers rewrites the
text and remembers, for every character it writes, which source characters it
stands for:

1. homoglyphs: look-alike letters and digits become ASCII, invisible
   characters vanish, letters inside runs of digits become digits;
2. spelled digits: runs of at least three number words (English, German,
   French, Spanish) become digits, "plus" before them a plus sign;
3. at and dot disguises: ``[at]``, ``(dot)``, `` at ... dot ...``, ``[.]`` and
   spaced signs become ``@`` and ``.``.

The patterns then run over the rewritten window, and what they find is mapped
back to source characters.  A span inside a base span of its kind is the same
find and is not added again; one that reaches beyond a base span is added, as
the base span is only a fragment of it, and the two overlap.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.batches import bound_batches

KINDS = ("email", "ip", "card", "phone")
#: Characters around a possible disguise that the transducers see, and up to how
#: many more they see to reach white space.
MARGIN, WIDEN = 96, 160
#: Characters that are rewritten at a time where disguises stand close together.
SEGMENT = 1 << 15
#: Digits that a spelled-out number without a plus sign needs to be a phone;
#: three of them must differ, as prose also repeats an article.
SPELLED_PHONE = (9, 15)
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does: what fails there fails later in the run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping emails: the local part is all of the run before an at sign."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            last = found.end()
            yield begin, last
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the plain patterns, by kind as listed, then by start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# Look-alikes of ASCII letters and digits that compatibility
# normalisation leaves alone.
_LOOKALIKE = dict(
    zip(
        "аеорсухіјѕһԁԛԝвмнкткАВЕКМНОРСТУХІЈЅαοινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijshdqwbmhktkABEKMHOPCTYXIJSaoivptukABEZHIKMNOPTYX",
        strict=True,
    )
) | {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".", "＠": "@", "﹫": "@", " ": " ", " ": " ", " ": " "}
_INVISIBLE = frozenset("​‌‍‎‏⁠﻿­᠎")
_ODD = re.compile("[" + "".join(re.escape(c) for c in [*_LOOKALIKE, *_INVISIBLE]) + "٠-٩۰-۹०-९²³¹⁰-⁹₀-₉①-⑨Ⓐ-⓪！-～\U0001d400-\U0001d7ff]")
# Number words.
_NUMBERS = {
    w: str(d)
    for d, ws in enumerate(
        ["zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"]
    )
    for w in ws.split()
}
_ONE_NUMBER = "(?:" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + ")"
_GAP = r"[\s,./-]{1,3}"
_SPELLED = re.compile(rf"\b(?:plus{_GAP})?{_ONE_NUMBER}\b(?:{_GAP}(?:{_ONE_NUMBER}|[0-9]+)\b){{2,}}", re.I)
_NUMBER_WORD = re.compile(rf"\b(?:{_ONE_NUMBER}|plus|[0-9]+)\b", re.I)
# Words and brackets for at and dot.
_AT, _DOT = "at|ät|arobase|arroba|chez|klammeraffe", "dot|punkt|point|punto"
# Top-level domains that end an address of spaced plain signs; after
# a named sign any label may end it.
_TLD = "com|org|net|edu|gov|mil|int|info|biz|io|ai|co|uk|de|fr|es|it|nl|eu|ch|be|us|ca|au|jp|cn|ru|br|in|me|tv|app|dev|example|test|invalid|local"
# Letters that stand for digits between digits.
_LEET = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1", "Z": "2", "S": "5", "B": "8"}
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT_MARK = re.compile(rf"\s*{_OPEN}\s*(?:{_AT}|a|@)\s*{_CLOSE}\s*", re.I)
_DOT_MARK = re.compile(rf"\s*{_OPEN}\s*(?:{_DOT}|\.)\s*{_CLOSE}\s*", re.I)
_AT_WORD = rf"\s+(?:{_AT})\s+|\s*[_-]+at[_-]+\s*|\s*@\s*"
_DOT_WORD = rf"\s+(?:{_DOT})\s+|\s*[_-]+dot[_-]+\s*|\s+\.\s*|\.\s+|\."
_BARE = re.compile(rf"(?<=[a-z0-9])({_AT_WORD})([a-z0-9-]+(?:(?:{_DOT_WORD})[a-z0-9-]+)*)(?:{_DOT_WORD})(?:{_TLD})\b(?![a-z0-9-])", re.I)
_LABEL = r"[a-z0-9](?:[a-z0-9]|-+(?!-*dot[_-]))*+"
_STRICT_DOT = rf"\s+(?:{_DOT})\s+|[_-]+dot[_-]+|\."
_NAMED = re.compile(rf"(?<=[a-z0-9])({_AT_WORD})((?:{_LABEL}(?:{_STRICT_DOT}))++[a-z]{{2,24}})(?![\w-])", re.I)
# Words before a dot word that show prose ("at the dot").
_BEFORE_PROSE = re.compile(rf"\b(?:the|a|an|this|that|each|every|any|one|some|no|which|what|le|la|un|ce|au|el|der|den|dem|ein|einen|diesem)\s+(?:{_DOT})\s", re.I)
_BARE_DOT = re.compile(_DOT_WORD, re.I)
_NAMED_DOT = re.compile(rf"\b(?:{_DOT})\b|[_-]dot[_-]", re.I)
_NAMED_SIGN = re.compile(_STRICT_DOT, re.I)
_DIGIT_DOT = re.compile(rf"(?<=[0-9])(?:\s+(?:{_DOT})\s+|\s+\.\s*|\.\s+)(?=[0-9])", re.I)
_HINT = re.compile(rf"{_OPEN}\s*(?:{_AT}|a|@|{_DOT}|\.)\s*{_CLOSE}|\s@|@\s|\b(?:{_DOT})\b|[_-](?:at|dot)[_-]|\s(?:{_AT})\s+[a-z0-9-][a-z0-9.-]*\.[a-z]{{2}}|[0-9]\s+\.\s+[0-9]", re.I)
_DIGITLIKE = "0-9" + "".join(re.escape(c) for c in _LEET)
_LEET_HINT = re.compile("[0-9][ -]?[" + "".join(re.escape(c) for c in _LEET) + "]|[" + "".join(re.escape(c) for c in _LEET) + "][ -]?[0-9]")
_LEET_RUN = re.compile(rf"(?<![\w+])\+?[{_DIGITLIKE}][{_DIGITLIKE} ().-]{{6,}}[{_DIGITLIKE}](?!\w)")


class Tape:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str, offset: int):
        self.text = text
        self.start = list(range(offset, offset + len(text)))
        self.end = list(range(offset + 1, offset + len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace character ranges (ascending, apart); a replacement stands for its whole range."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.start, self.end = "".join(text), start + self.start[at:], end + self.end[at:]


def _homoglyphs(tape: Tape) -> None:
    edits = []
    for m in _ODD.finditer(tape.text):
        c = m[0]
        new = "" if c in _INVISIBLE else _LOOKALIKE.get(c) or (str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else unicodedata.normalize("NFKC", c))
        edits.append((m.start(), m.end(), new))
    tape.rewrite(edits)


def _digits(tape: Tape) -> list[tuple[int, int]]:
    """Write spelled digits as digits; returns where the written runs are."""
    edits, runs, shift = [], [], 0
    for run in _SPELLED.finditer(tape.text):
        begin, at, written = run.start() + shift, run.start(), 0
        for m in _NUMBER_WORD.finditer(tape.text, run.start(), run.end()):
            word = m[0].lower()
            new = "+" if word == "plus" else _NUMBERS.get(word, m[0])
            if m.start() > at:  # the gap before this word
                edits.append((at, m.start(), ""))
            edits.append((m.start(), m.end(), new))
            at, written = m.end(), written + len(new)
        if at < run.end():
            edits.append((at, run.end(), ""))
        runs.append((begin, begin + written))
        shift += written - (run.end() - run.start())
    tape.rewrite(edits)
    return runs


def _signs(tape: Tape) -> None:
    for pattern, sign in ((_AT_MARK, "@"), (_DOT_MARK, "."), (_DIGIT_DOT, ".")):
        tape.rewrite([(m.start(), m.end(), sign) for m in pattern.finditer(tape.text)])
    edits = []
    for m in _BARE.finditer(tape.text):
        named = m[1].strip() not in ("@", "")
        rest = tape.text[m.end(1) : m.end()]
        if named and (re.search(r"\s\.|\.\s", rest) or re.search(r"\s", rest) and not _NAMED_DOT.search(rest)):
            continue  # prose: "look at this. In it"
        edits.append((m.start(1), m.end(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(tape.text, m.end(1), m.end())]
    tape.rewrite(edits)
    edits = []
    for m in _NAMED.finditer(tape.text):
        sign, dots = m[1].strip().lower(), {d[0].lower().strip("_-") for d in _NAMED_DOT.finditer(m[2])}
        if sign == "@" and not dots or sign in ("at", "chez") and dots == {"point"} or _BEFORE_PROSE.search(m[2]):
            continue  # nothing named, or prose: "at this point he"
        edits.append((m.start(1), m.end(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in _NAMED_SIGN.finditer(tape.text, m.end(1), m.end())]
    tape.rewrite(edits)


def _leet(tape: Tape) -> None:
    """Letters inside runs that are digits for the most part."""
    edits = []
    for m in _LEET_RUN.finditer(tape.text):
        digits, letters = sum(c.isdigit() for c in m[0]), [i for i, c in enumerate(m[0]) if c in _LEET]
        if letters and digits >= 2 * len(letters):
            edits += [(m.start() + i, m.start() + i + 1, _LEET[m[0][i]]) for i in letters]
    tape.rewrite(edits)


def _windows(text: str) -> list[tuple[int, int]]:
    """Parts of the text that may hold a disguise, apart from each other.

    They begin and end at white space, if there is some within ``WIDEN``
    characters, so they cost what the hits cost, however the text is spaced.
    """
    hits = [] if text.isascii() else [m.span() for m in _ODD.finditer(text)]
    hits += [m.span() for p in (_HINT, _SPELLED, _LEET_HINT) for m in p.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and b + MARGIN <= out[-1][1]:
            continue
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        gap = next((i for i in range(a, max(0, a - WIDEN), -1) if text[i - 1].isspace()), max(0, a - WIDEN))
        b = next((i for i in range(b, min(len(text), b + WIDEN)) if text[i].isspace()), min(len(text), b + WIDEN))
        if out and gap <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((gap, b))
    return out


def _segments(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, first, last): what is rewritten at a time, and where its spans may begin.

    A long window is cut into segments that see ``MARGIN + WIDEN`` characters
    of their neighbours; each span is found by the segment it begins in.
    """
    around = MARGIN + WIDEN
    for a, b in _windows(text):
        for first in range(a, b, SEGMENT):
            last = min(b, first + SEGMENT)
            yield max(a, first - around), min(b, last + around), first, last


def disguised_spans(text: str) -> list[Span]:
    """Spans that only the rewritten text shows, in source characters."""
    found: list[Span] = []
    for a, b, first, last in _segments(text):
        tape = Tape(text[a:b], a)
        _homoglyphs(tape)
        _leet(tape)
        own: list[Span] = []
        for s, e in _digits(tape):
            digits = tape.text[s:e].lstrip("+")
            if digits.isdigit() and not tape.text[s:e].startswith("+"):
                if 13 <= len(digits) <= 19 and luhn(digits):
                    own.append(("card", tape.start[s], tape.end[e - 1]))
                elif SPELLED_PHONE[0] <= len(digits) <= SPELLED_PHONE[1] and len(set(digits)) >= 3:
                    own.append(("phone", tape.start[s], tape.end[e - 1]))
        _signs(tape)
        if tape.text != text[a:b]:
            own += [(kind, tape.start[s], tape.end[e - 1]) for kind, s, e in base_spans(tape.text)]
        found += [x for x in own if first <= x[1] < last]
    return found


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text; a null text has none."""
    if not text:
        return [], []
    base = base_spans(text)
    plain = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}  # ascending and apart
    added: list[Span] = []
    until = dict.fromkeys(KINDS, 0)
    for kind, a, b in sorted(set(disguised_spans(text)), key=lambda s: (s[1], -s[2])):
        at = bisect.bisect_right(plain[kind], (a, len(text) + 1)) - 1
        inside = at >= 0 and b <= plain[kind][at][1]
        if not inside and a >= until[kind]:
            added.append((kind, a, b))
            until[kind] = b
    return base, added


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_documents(documents: DataFrame) -> DataFrame:
    """Per document row: base counts by kind, digest of the base spans, all spans.

    Offsets are code points of the whole text, end exclusive.  Null and empty
    texts have no spans; a null doc_id is carried through; repeated rows give
    equal results; other columns are ignored.
    """

    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                base, added = find_spans(text)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((None if pd.isna(doc_id) else int(doc_id), *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added), len(base) + len(added)))
            yield pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"]).astype({"doc_id": "Int64"})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, RESULT)
