"""Line-first quality rules.

Every line is judged on its own; lines that fail are removed, and a document that loses
more than half of its word characters is rejected. A line fails if

* it has no letter, or is navigation: at least a third of its tokens are separators such as
  ``|`` or ``>``, or it is a short list of links without an end of sentence;
* it is boilerplate: a notice about cookies, scripts, sign-in, sharing, rights or licences;
* it is decorated: at least 30 % of its words end in runs of symbols or exclamation marks;
* it does not end like a sentence although it has at least LONG_LINE words and is not the
  last, or is short and stands beside others of its kind (see ``unfinished``);
* it repeats an earlier line of the document that has at least REPEAT_WORDS words;
* it is one word again and again (at least 30 % of its words equal the one before).

Defined cases: a null text has no words, so the base rule rejects it, as it does an empty
one; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from itertools import pairwise
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinlake.llm.common import map_pieces, texts, whole_text

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
SYMBOLS = b"#*$%&|<>"
#: Share of the word characters that has to stay.
KEEP = 0.5
LONG_LINE = 40
REPEAT_WORDS = 3
SHORT_LINE = 6
# fixed values: phrases of notices that are no part of a text
BOILERPLATE = re.compile(
    rb"cookie policy|use of cookies|we use cookies|uses cookies|accept cookies|enable javascript|javascript is disabled|requires javascript"
    rb"|all rights reserved|copyright \(c\)|\xc2\xa9|licensed under|permission is hereby granted|spdx-license-identifier"
)
# fixed values: phrases of links and buttons, which whole sentences may use as well
INVITING = re.compile(rb"terms of use|terms of service|privacy policy|sign in|log in to|sign up|subscribe to our|follow us on|share this|read more|click here|powered by")
SENTENCE = 12
_END = re.compile(rb"[.!?:;][\"')\]]*$|(?:\xe2\x80\xa6|\xc2\xbb|\xe2\x80\x9d|\xe3\x80\x82)$")
_DECOR = frozenset(b"#*$%&|<>~^=")
_SEPARATOR = frozenset([b"|", b">", b"<", b"/", b"\xc2\xbb", b"\xe2\x80\xba", b"\xc2\xb7", b"\xe2\x80\xa2", b"-", b"*"])


def decorated(word: bytes) -> bool:
    """Whether a word ends in two marks of decoration, or in several exclamation marks, before its stops; looks at its end only."""
    bare = word.rstrip(b".,;:?!")
    return len(bare) > 1 and bare[-1] in _DECOR and bare[-2] in _DECOR or b"!!" in word[len(bare) :]


def unfinished(words: list[bytes]) -> bool:
    """Whether a line looks like a menu entry or a heading: few words and no end of sentence."""
    return len(words) < SHORT_LINE and not _END.search(words[-1])


def line_fails(words: list[bytes], last: bool = False) -> str:
    """The rule that a line with these words breaks, or the empty text; the last line of a text may break off."""
    line = b" ".join(words)
    if not re.search(rb"[A-Za-z\x80-\xff]", line):
        return "no_letter"
    n = len(words)
    if 3 * sum(w in _SEPARATOR for w in words) >= n and n >= 3:
        return "navigation"
    if n <= 40 and (BOILERPLATE.search(low := line.lower()) or INVITING.search(low) and (n < SENTENCE or not _END.search(words[-1]))):
        return "boilerplate"
    if 10 * sum(map(decorated, words)) >= 3 * n:
        return "decorated"
    if n >= LONG_LINE and not last and not _END.search(words[-1]):
        return "no_end"
    if n >= 10 and 10 * sum(map(eq, words, words[1:])) >= 3 * n:
        return "one_word"
    return ""


def cleaned(text: bytes) -> tuple[bytes, int, int, int]:
    """The text without failing lines, the word characters before and after, and the number of lines removed."""
    lines = text.split(b"\n")
    words = [x.split() for x in lines]
    size = lambda ws: sum(len(w.decode("utf-8", "replace")) for w in ws) if not all(map(bytes.isascii, ws)) else sum(map(len, ws))
    open_ = [bool(w) and unfinished(w) for w in words]
    near = [False, *(a and b for a, b in pairwise(open_)), False]
    seen: set[bytes] = set()
    kept, before, after, removed = [], 0, 0, 0
    final = max((k for k, ws in enumerate(words) if ws), default=-1)
    for k, (line, ws) in enumerate(zip(lines, words, strict=True)):
        if not ws:
            kept.append(line)
            continue
        n = size(ws)
        before += n
        again = len(ws) >= REPEAT_WORDS and (key := b" ".join(ws)) in seen
        if len(ws) >= REPEAT_WORDS and not again:
            seen.add(key)
        if again or near[k] or near[k + 1] or line_fails(ws, k == final):
            removed += 1
        else:
            after += n
            kept.append(line)
    return b"\n".join(kept), before, after, removed


def repeated_words(batch_words: list[list[bytes]], window: int = WINDOW) -> list[int]:
    """By document: words inside windows of ``window`` words that occur at least twice in it.

    Windows are told apart by ids built by doubling (1, 2, 4, 8 words), so that equal ids
    mean equal windows; no hash decides.
    """
    sizes = np.array([len(w) for w in batch_words], np.int64)
    total = int(sizes.sum())
    if not total:
        return [0] * len(batch_words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for ws in batch_words for w in ws), np.int64, total)
    width = 1
    while width < window:
        ids = pd.factorize(ids[:-width] * (int(ids.max()) + 1) + ids[width:])[0].astype(np.int64) if len(ids) > width else ids[:0]
        width *= 2
    ends = np.cumsum(sizes)
    out = np.zeros(len(batch_words), np.int64)
    whole = np.flatnonzero(sizes >= window)
    if not len(whole):
        return out.tolist()
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(ids)]
    valid = np.arange(len(ids)) <= ends[doc] - window
    at = np.flatnonzero(valid)
    key = pd.factorize(ids[at] * len(sizes) + doc[at])[0]
    twice = at[np.bincount(key)[key] > 1]
    mark = np.zeros(total + 1, np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + window, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
    return (inside[ends] - inside[ends - sizes]).tolist()


def _judged(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = texts(batch)
    words = [t.split() for t in rows]
    repeated = repeated_words(words)
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", "n_lines_removed")}
    for text, ws, again in zip(rows, words, repeated, strict=True):
        lines = [x for x in text.split(b"\n") if x.split()]
        blank = len(text.decode().translate(_BLANK)) if not text.isascii() else sum(map(len, ws))
        _, before, after, removed = cleaned(text)
        failed = len(ws) < MIN_WORDS or 100 * again > MAX_REPEATED * len(ws)
        for k, v in zip(out, (len(ws), blank, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), again, failed, not failed and after >= KEEP * before, after, removed), strict=True):
            out[k].append(v)
    kinds = {"base_failed": pa.bool_(), "kept": pa.bool_()}
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], ["doc_id", *out])


_BLANK = dict.fromkeys([32, *range(9, 14)])


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, the base rule, the verdict, and what line cleaning leaves."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_chars long, n_lines_removed long"
    return map_pieces(docs.select("doc_id", whole_text().alias("text")), _judged, schema)


def clean_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text with the failing lines removed, for the documents that stay."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [cleaned(t) for t in texts(batch)]
        full = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0].decode() for f in found])], ["doc_id", "text"])
        return full.filter(_judged(batch).column("kept"))

    return map_pieces(docs.select("doc_id", whole_text().alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
