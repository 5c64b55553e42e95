"""Personal data by offset-preserving deobfuscation.

A text is searched as it is (base spans) and again after normalisation: transducers replace
homoglyphs and full-width forms, drop invisible characters, turn spelled digits into digits
and undo ``(at)`` / ``[dot]`` disguises. Each records where every normalised character came
from, so a span found in the normalised text maps back to characters of the source. A
transducer is left out only where a text lacks what each of its rewrites needs. Base
spans all stay; an added span touches a base span of its kind only to hold it and more.

Kinds, each leftmost and non-overlapping; failing matches are dropped without a retry:
email, ip (parts up to 255), card (13 to 19 digits passing Luhn), phone (9 to 15 digits).
The searches are linear in the text, however long its runs of letters or digits are.

Defined cases: a null text is empty and has no spans; offsets count code points, ends are
exclusive; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import map_pieces, whole_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# fixed values: look-alikes of ASCII characters, invisible characters, spelled digits, words for @ and .
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ӏ": "l", "м": "m", "т": "t", "к": "k", "в": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "﹒": ".", "٫": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ", "＿": "_",
}
INVISIBLE = "­​‌‍⁠﻿‎‏"
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT = ("at", "arroba", "arobase", "chez", "ät")
DOT = ("dot", "punto", "point", "punkt")
BEFORE_AT = frozenset("a all an and are arrive arrived available back be been buy call came click come down found go goes hosted in is it join left live look looked looking looks me meet met more online or out page people read see shop sign site sold start stay stop store that the them there they this up us version visit was we website work working works you".split())
ENDINGS = frozenset("com org net edu gov info biz io co de fr es it uk us ch at be nl eu ca au jp cn in br mx ar".split())

_MAP = {ord(k): ord(v) for k, v in LOOKALIKES.items()} | {0xFF01 + k: 0x21 + k for k in range(94)} | {0x0660 + k: 48 + k for k in range(10)} | {0x06F0 + k: 48 + k for k in range(10)}
_ODD = frozenset([*map(chr, _MAP), *INVISIBLE])
_HIDDEN = re.compile("[" + INVISIBLE + "]")
_AT_MARK = re.compile(r"\s?[\[({<]\s?(?:" + "|".join(AT) + r"|@)\s?[\])}>]\s?", re.I)
_DOT_MARK = re.compile(r"\s?[\[({<]\s?(?:" + "|".join(DOT) + r"|\.)\s?[\])}>]\s?", re.I)
_AT_WORD, _DOT_WORD = (rf"\s++(?:{'|'.join(x)})\s++" for x in (AT, DOT))
# bare "first dot last at host dot org", each mark spelled or not; up to eight spelled dots before the at
_CHAIN = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++(?:{_DOT_WORD}(?!(?:{'|'.join(AT)})\s)[A-Za-z0-9._%+-]++){{0,8}}+)({_AT_WORD}|@|\s@\s)([A-Za-z0-9-]++(?:(?:{_DOT_WORD}|\.)[A-Za-z0-9-]++)+)", re.I)
_BARE_DOT = re.compile(_DOT_WORD, re.I)
_DIGIT_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPELLED = re.compile(r"(?<!\w)(?:(?:" + _DIGIT_WORDS + r"|[0-9]+|plus|\+)(?:[ \t,.-]{1,2}|(?=\W|$))){7,}", re.I)
# numbers of up to three digits with spelled dots between them, in digits or spelled digit by digit
_NUMBER_RUN = rf"(?:{_DIGIT_WORDS}|\d++(?:\.\d++)*+)"
_DOTTED = re.compile(rf"(?<![\w.]){_NUMBER_RUN}(?:[ \t]{_NUMBER_RUN}){{0,2}}(?:{_DOT_WORD}{_NUMBER_RUN}(?:[ \t]{_NUMBER_RUN}){{0,2}})++(?!\w)", re.I)
#: What each match of _CHAIN ends in, as far as its first dot.
_CHAIN_TAIL = re.compile(rf"(?:(?<!\s){_AT_WORD}|@|\s@\s)[A-Za-z0-9-]++(?:{_DOT_WORD}|\.)[A-Za-z0-9-]", re.I)
#: Blanks all of ASCII but letters, and makes all digits 0: words in a run that _SPELLED matches are then in _COUNTED.
_PLAIN = bytes(48 if chr(c).isdigit() and c < 128 else c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_COUNTED = frozenset([*(w.encode() for w in SPELLED), b"plus", *(b"0" * k for k in range(1, 20))])
_SPELLED_WORD = re.compile(r"(?<!\w)(?:" + _DIGIT_WORDS + r")(?!\w)", re.I)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern local@domain finds them, from each @ outwards: linear for any run of letters."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind in a text as it stands."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if not _ANY_DIGIT.search(text):
        return found
    if _DIGIT_DOT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


_ANY_DIGIT, _DIGIT_DOT = re.compile("[0-9]"), re.compile(r"[0-9]\.[0-9]")


class Tape:
    """A text with, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces each (start, end, text); the new characters stand for the whole replaced piece."""
        if not edits:
            return
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            lo, hi = (self.start[a], self.end[b - 1])
            starts += [self.start[at:a], np.full(len(new), lo)]
            ends += [self.end[at:a], np.full(len(new), hi)]
            at = b
        self.text = "".join([*texts, self.text[at:]])
        self.start, self.end = np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]])


def normalised(text: str) -> Tape:
    """The text after all transducers."""
    tape = Tape(text)
    if not text.isascii() and not _ODD.isdisjoint(text):
        tape.text = tape.text.translate(_MAP)  # one for one: offsets stay
        tape.rewrite([(m.start(), m.end(), "") for m in _HIDDEN.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "@") for m in _AT_MARK.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), ".") for m in _DOT_MARK.finditer(tape.text)])
    edits = []
    for m in _CHAIN.finditer(tape.text) if _CHAIN_TAIL.search(tape.text) else ():
        dots = [(m.start(g) + d.start(), m.start(g) + d.end(), ".") for g in (1, 3) for d in _BARE_DOT.finditer(m[g])]
        # "at" and "point" are words of prose too: they count before a known ending, and "at" alone after no word that prose has there
        ending = re.split(r"[\s.]", m[3])[-1].lower() in ENDINGS
        if (dots or m[2].strip() != "@") and not ending or not dots and m[2].strip() != "@" and m[1].lower() in BEFORE_AT:
            continue
        if m[2] != "@":
            dots.append((m.start(2), m.end(2), "@"))
        edits += sorted(dots)
    tape.rewrite(edits)
    edits = []
    low = tape.text.lower()
    for m in _DOTTED.finditer(tape.text) if any(w in low for w in DOT) else ():
        for w in re.finditer(rf"({_DOT_WORD})|([ \t])|({_DIGIT_WORDS})(?!\w)", m[0], re.I):
            edits.append((m.start() + w.start(), m.start() + w.end(), "." if w[1] else "" if w[2] else SPELLED[w[3].lower()]))
    tape.rewrite(edits)
    edits = []
    run = b"\1" * 6 in bytes(map(_COUNTED.__contains__, tape.text.lower().encode().translate(_PLAIN).split()))
    for m in _SPELLED.finditer(tape.text) if run else ():
        if _SPELLED_WORD.search(m[0]):
            last = m.start()
            for w in re.finditer(r"[^\W\d_]+|\d+|\+", m[0]):
                a, b = m.start() + w.start(), m.start() + w.end()
                new = SPELLED.get(w[0].lower(), "+" if w[0].lower() == "plus" else w[0])
                if last < a and last > m.start():
                    edits.append((last, a, ""))
                if new != w[0]:
                    edits.append((a, b, new))
                last = b
    tape.rewrite(edits)
    return tape


def all_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and those with what only the normalised text shows, both sorted by start."""
    base = spans(text)
    tape = normalised(text)
    if tape.text == text:
        return base, base
    both = {k: list(v) for k, v in base.items()}
    for kind, found in spans(tape.text).items():
        # a span that holds a base span and more is added beside it; any other overlap is not
        taken, k, last = base[kind], 0, -1
        for a, b in found:
            source = (int(tape.start[a]), int(tape.end[b - 1]))
            while k < len(taken) and taken[k][1] <= source[0]:
                k += 1
            met = [t for t in taken[k : k + 2] if t[0] < source[1]]
            if source[0] >= last and source not in met and all(source[0] <= x and y <= source[1] for x, y in met):
                both[kind].append(source)
                last = source[1]
        both[kind].sort()
    return base, both


def listed(found: dict[str, list[tuple[int, int]]]) -> str:
    """kind:start:end, comma-joined, by kind and start."""
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def redacted(text: str) -> str:
    """The text with each span replaced by its kind; of overlapping spans, all are covered by the first's kind."""
    merged: list[list] = []
    for a, b, kind in sorted((a, b, k) for k, v in all_spans(text)[1].items() for a, b in v):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    if not merged:
        return text
    cuts = [0, *(x for a, b, _ in merged for x in (a, b)), len(text)]
    kept = [text[a:b] for a, b in list(pairwise(cuts))[::2]]
    return "".join(x for pair in zip(kept, [*(_PLACEHOLDER[k] for *_, k in merged), ""], strict=True) for x in pair)


def _found(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [all_spans(t) for t in batch.column("text").to_pylist()]
    bases = [listed(b) for b, _ in rows]
    counts = [pa.array([len(b[k]) for b, _ in rows], pa.int64()) for k in KINDS]
    added = pa.array([sum(map(len, x.values())) - sum(map(len, b.values())) for b, x in rows], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in bases]), pa.array([listed(x) for _, x in rows], pa.string()), added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base counts by kind, digest of the base spans, all spans, and how many were added."""
    return map_pieces(docs.select("doc_id", whole_text().alias("text")), _found, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` counted anew; a null text stays null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]
        arrays = [pa.array(new, pa.string()) if f.name == "text" else batch.column(k) for k, f in enumerate(batch.schema)]
        return pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    out = map_pieces(docs, run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
