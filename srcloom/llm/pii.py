"""Personal data, found through disguises, with offsets of the source text.

A transducer rewrites a text to plain form and keeps, for every character it writes, the source span it stands for:
look-alike letters and wide forms become ASCII, invisible characters go, spelled digits become digits, and bracketed
or spelled "at" and "dot" become @ and a point. The same detectors read the source (base spans) and the plain form;
a span of the plain form is added, at its source offsets, if the rewriting changed something within it and it does
not overlap a base span of its kind.
"""

from __future__ import annotations

import io
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
_AT_START = re.compile(rf"[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_AT_RUN = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Look-alikes of ASCII letters in the Cyrillic and Greek blocks.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ",
}
# Digits spelled in English, German, French and Spanish.
DIGIT_WORDS = {
    w: str(d)
    for d, words in enumerate(
        ("zero null zéro cero oh", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
         "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
    )
    for w in words.split()
}
_DIGIT_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ODD = "".join(LOOK_ALIKES)
#: Characters that have an ASCII compatibility form, or are digits of other scripts, lie in these ranges.
_RANGES = "٠-٩۰-۹०-९⁰-⁹₀-₉①-⓿！-～\U0001d400-\U0001d7ff"
_UNSEEN = "­​-‏⁠-⁤﻿"
_OPEN, _CLOSE = r"(?:(?<!\s)\s++)?[\[({<]\s*+", r"\s*+[\])}>]\s*+"
_DOT = r"dot|punkt|point|punto"
# Endings that make "at" and "dot" an address in any of the spellings, and more of them for "dot" and a point.
SURE_ENDS = frozenset("com org net edu gov int info biz io eu de fr es at ch uk us ca au it nl".split())
MORE_ENDS = frozenset(
    "mil name pro aero coop mobi asia tel jobs travel cat xyz online site tech store shop app dev page blog cloud space website live news media agency email digital "
    "design studio company group team solutions services systems network academy school university institute health bank finance global berlin london paris wien".split()
)
# English words of two letters, which are endings only before a pause; words that begin a place, not a host.
SMALL_WORDS = frozenset("of to in is as on or by we he if so no up my me do go be am an ad hi oh ok".split())
DETERMINERS = frozenset("the a an this that these those each every any some my our your his her its their one".split())
# First labels of hosts of mail, and words that tell of an address, for a spelled "at" before a real point.
MAIL_HOSTS = frozenset("mail gmail gmx hotmail outlook yahoo proton protonmail icloud web aol yandex zoho fastmail mailbox posteo orange wanadoo".split())
_CUE = re.compile(r"mail|contact|kontakt|contacto|write|reach|address|adresse|schreib|courriel|correo|escrib|écri", re.IGNORECASE)
_SEPARATOR = rf"\s++(?:{_DOT})\s++|\s*+[\[({{<]\s*+(?:\.|{_DOT})\s*+[\])}}>]\s*+|\."
_LABEL = r"[a-z0-9-]{1,63}+"  # a host has at most 127 labels
_HOST = re.compile(rf"({_SEPARATOR})", re.IGNORECASE)
_LOCAL_END = re.compile(rf"[{_LOCAL}]*\Z")
_TOKEN = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@|arroba|arobase|klammeraffe){_CLOSE})"
    rf"|(?P<said>(?<=[a-z0-9])\s++at\s++(?=(?P<host>{_LABEL}(?:(?:{_SEPARATOR}){_LABEL}){{1,126}}+)))"
    rf"|(?P<dot>{_OPEN}(?:\.|{_DOT}){_CLOSE}|(?<=[a-z0-9])\s++(?:{_DOT})\s++(?=[a-z0-9]))"
    rf"|(?P<plus>\bplus\s++(?=[0-9]|(?:{_DIGIT_WORD})\b))"
    rf"|(?P<digit>\b(?:{_DIGIT_WORD})\b)"
    rf"|(?P<unseen>[{_UNSEEN}]+)|(?P<odd>[{_ODD}{_RANGES}])",
    re.IGNORECASE,
)
#: A text without any of these has nothing to rewrite; lone digit words are no sign.
_SIGNS = re.compile(
    rf"[{_UNSEEN}{_ODD}{_RANGES}]|[\[({{<]\s*+(?:at|@|arroba|arobase|klammeraffe|\.|{_DOT})\s*+[\])}}>]"
    rf"|\s(?:{_DOT})\s|\sat\s++[a-z0-9-]++\.[a-z]|\b(?:{_DIGIT_WORD})[ -](?:{_DIGIT_WORD}|[0-9])\b|\bplus\s++(?:[0-9]|(?:{_DIGIT_WORD})\b)",
    re.IGNORECASE,
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in time linear in the text: a run of local characters is tried at its start only."""
    at = 0
    while "@" in text and (m := _AT_START.match(text, at) or _AT_RUN.search(text, at)):
        yield m.span()
        at = m.end()


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), in order of kind and start."""
    found = [(0, *s) for s in emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def plain_char(c: str) -> str:
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    plain = unicodedata.normalize("NFKC", c)
    if plain.isascii():
        return plain
    return str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else c


def _tells_of_mail(text: str, at: int, host: str, end: int) -> bool:
    """Whether what stands around a spelled "at" makes a host with a real point an address: the local part, the host,
    a word shortly before, or a line of its own."""
    local = _LOCAL_END.search(text, max(0, at - 64), at)
    start = local.start()
    alone = text[max(0, start - 1) : start] in ("", "\n") and text[end : end + 1] in ("", "\n", "\r")
    return alone or host in MAIL_HOSTS or bool(re.search(r"[0-9._%+]", local[0])) or bool(_CUE.search(text, max(0, start - 40), start))


def is_address(text: str, m: re.Match) -> bool:
    """Whether a spelled "at" begins a host: one of its labels must be an ending that suits the way its point is written."""
    pieces = _HOST.split(m["host"])
    if pieces[0].lower() in DETERMINERS:
        return False
    end = m.start("host") + len(pieces[0])
    for point, label in zip(pieces[1::2], pieces[2::2], strict=True):
        end += len(point) + len(label)
        if len(label) < 2 or not label.isalpha() or (after := text[end : end + 1]).isalnum() or after == "_":
            continue
        low, word = label.lower(), point.strip().lower()
        pause = not re.match(r"\s+\w", text[end : end + 8])
        country = len(low) == 2 and (low not in SMALL_WORDS or pause)
        if word == ".":
            if label == low and (low in SURE_ENDS or low in MORE_ENDS or country) and after != "/" and _tells_of_mail(text, m.start(), pieces[0].lower(), m.end("host")):
                return True
        elif word[0] in "[({<" or low in SURE_ENDS or (word == "dot" and (low in MORE_ENDS or country)):
            return True
    return False


class PlainForm:
    """The rewritten text, and where its pieces come from: sorted starts and ends in the plain form and in the source."""

    def __init__(self, text: str):
        out = io.StringIO()
        self.starts, self.ends, self.lows, self.highs = (array("I") for _ in range(4))
        at = done = 0
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind == "said" and not is_address(text, m):
                continue
            new = {"at": "@", "said": "@", "dot": ".", "plus": "+", "unseen": ""}.get(kind)
            if new is None:
                new = DIGIT_WORDS[m[0].lower()] if kind == "digit" else plain_char(m[0])
            done += out.write(text[at : m.start()])
            self.starts.append(done)
            done += out.write(new)
            self.ends.append(done)
            self.lows.append(m.start())
            self.highs.append(m.end())
            at = m.end()
        out.write(text[at:])
        self.text = out.getvalue()

    def source(self, place: int) -> tuple[int, int]:
        """The source span of one character of the plain form."""
        i = bisect_right(self.starts, place) - 1
        if i < 0:
            return place, place + 1
        if place < self.ends[i]:
            return self.lows[i], self.highs[i]
        low = self.highs[i] + place - self.ends[i]
        return low, low + 1

    def changed(self, start: int, end: int) -> bool:
        """Whether a piece was rewritten, or something left out, within a span of the plain form."""
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.ends[i] > start


def find_spans(text: str | None) -> list[tuple[int, int, int, bool, str]]:
    """(kind, start, end, added, plain value) of a whole text, in order of kind and start; none in null or empty texts."""
    if not text:
        return []
    base = detect(text)
    found = [(*b, False, text[b[1] : b[2]]) for b in base]
    if _SIGNS.search(text):
        plain = PlainForm(text)
        taken = [[(s, e) for k, s, e in base if k == kind] for kind in range(len(KINDS))]
        for kind, start, end in detect(plain.text):
            if not plain.changed(start, end):
                continue
            low, high = plain.source(start)[0], plain.source(end - 1)[1]
            # base spans of a kind are in order and apart: only the last one that begins before `high` can overlap
            i = bisect_left(taken[kind], (high, 0)) - 1
            if i < 0 or taken[kind][i][1] <= low:
                found.append((kind, low, high, True, plain.text[start:end]))
    return sorted(found)


SPANS = "array<struct<kind:string,start:bigint,end:bigint,added:boolean,value:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_()), ("value", pa.string())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row: kind, start and end in code points (end exclusive), whether the method added it, and
    its plain value; in order of kind as in KINDS and start.

    A null text is an empty one and has no spans. Ids may be null or repeated, other columns are not read, and texts of
    any length are read whole; detectors take time linear in the text, and a rewritten piece 16 bytes of memory."""
    arrow_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [{"kind": KINDS[k], "start": s, "end": e, "added": a, "value": v} for k, s, e, a, v in find_spans(t)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW)], ["doc_id", "spans"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
