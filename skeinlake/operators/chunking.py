"""Chunkers. Words are found by one expression; packing them is an ordered fold per document, in Python."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.ids import chunk_id, content_hash

#: A word with the blank after it, or the rest of a sentence with its mark and the blanks after it.
PIECE = "[^ .;!?…。！？]*(?: |[.;!?…。！？] *|$)"
_PIECE = re.compile(r"[^ .;!?…。！？]*(?: |[.;!?…。！？] *|\Z)")
_MARK = re.compile(r"[.;!?…。！？] *\Z")
#: Letters of the documents whose chunks leave a task together.
BATCH_LETTERS = 1 << 20


def pieces(text: Column) -> Column:
    """The words of a text, lossless, as an array."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({PIECE})"), 1), lambda p: F.length(p) > 0)


def words(text: str) -> Iterator[tuple[str, str]]:
    """(piece, kind): word, sentence_end, or paragraph_end where a line break follows the mark."""
    for m in _PIECE.finditer(text):
        if m[0]:
            ends = _MARK.search(m[0])
            yield m[0], "word" if not ends else "paragraph_end" if text[m.end() : m.end() + 1] in ("\n", "\r") else "sentence_end"


def sentences(text: str, most: int | None = None) -> Iterator[tuple[str, int, str]]:
    """(sentence, words, kind) with at most ``most`` words each; a piece without letters keeps the kind before it."""
    held, size, kind = "", 0, None
    for piece, found in words(text):
        if found != "word" or any(map(str.isalpha, piece)):
            kind = found
        if most and size + 1 > most:
            yield held, size, "sentence_cut" if kind == "word" else kind
            held, size = piece, 1
        elif found == "word":
            held, size = held + piece, size + 1
        else:
            yield held + piece, size + 1, kind
            held, size = "", 0
    if held:
        yield held, size, "sentence_cut" if kind == "word" else kind


def paragraphs(text: str, most: int, batch: bool = True) -> Iterator[tuple[str, int, str]]:
    """(chunk, words, kind of its end): sentences packed up to ``most`` words, or a chunk per paragraph."""
    held, size, last = "", 0, "default"
    for sentence, n, kind in sentences(text, most):
        if size and size + n > most:
            yield held, size, last
            held, size = "", 0
        held, size = held + sentence, size + n
        if kind in ("paragraph_end", "sentence_cut") and not batch:
            yield held, size, kind
            held, size = "", 0
        last = kind or "default"
    if held:
        yield held, size, "sentence_cut" if last == "word" else last


def rows(text: str, most: int, pair_size: int = 3) -> Iterator[tuple[str, int, str]]:
    """(chunk, size, row_cut or row_end): rows split at blank lines, pairs at commas; empty rows give nothing."""
    for row in text.split("\n\n"):
        held: list[str] = []
        for pair in row.split(", "):
            if held and (len(held) + 1) * pair_size > most:
                yield ", ".join(held), len(held) * pair_size, "row_cut"
                held = []
            held.append(pair)
        if joined := ", ".join(held):
            yield joined, len(held) * pair_size, "row_end"


def overlapping(text: str, most: int, ratio: float) -> Iterator[tuple[str, int]]:
    """(chunk, words) of packed paragraphs; the tail of each chunk, up to ratio x most words, opens the next."""
    held: list[tuple[str, int]] = []
    for chunk, n, _ in paragraphs(text, max(1, int(most * ratio)) if ratio > 0 else most):
        if held and sum(k for _, k in held) + n > most:
            yield " ".join(c for c, _ in held), sum(k for _, k in held)
            tail: list[tuple[str, int]] = []
            while held and sum(k for _, k in tail) + held[-1][1] <= most * ratio:
                tail.insert(0, held.pop())
            held = tail if sum(k for _, k in tail) + n <= most else []
        held.append((chunk, n))
    if held:
        yield " ".join(c for c, _ in held), sum(k for _, k in held)


def recursive(text: str, most: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Characters split at the coarsest separator that helps, merged up to ``most`` with ``overlap`` carried on."""
    sep = next(s for s in separators if not s or s in text)
    parts = list(text) if not sep else text.split(sep)
    rest = separators[separators.index(sep) + 1 :]
    out: list[str] = []
    held: list[str] = []
    size = lambda xs: sum(map(len, xs)) + len(sep) * max(0, len(xs) - 1)
    for part in parts:
        if len(part) > most and rest:
            if held:
                out.append(sep.join(held))
                held = []
            out += recursive(part, most, overlap, rest)
            continue
        if held and size([*held, part]) > most:
            out.append(sep.join(held))
            while held and (size(held) > overlap or size([*held, part]) > most):
                held.pop(0)
        held.append(part)
    if held:
        out.append(sep.join(held))
    return [x for x in out if x.strip()]


def _chunked(docs: DataFrame, cut) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    names = ["id", "chunk_index", "text", "chunk_size", "cut_type"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held: list[tuple] = []
            letters = 0
            for key, text in zip(frame["id"], frame["text"], strict=True):
                held += [(key, i, f[0], f[1], f[2] if len(f) > 2 else "default") for i, f in enumerate(cut(text or ""))]
                letters += len(text or "")
                if letters >= BATCH_LETTERS and held:
                    yield pd.DataFrame(held, columns=names)
                    held, letters = [], 0
            if held:
                yield pd.DataFrame(held, columns=names)

    return docs.select("id", "text").mapInPandas(run, f"id {kind}, chunk_index int, text string, chunk_size int, cut_type string")


def paragraph_chunks(docs: DataFrame, most: int, batch: bool = True) -> DataFrame:
    """id, chunk_index, text, chunk_size, cut_type; the chunks of a document join to its text."""
    return _chunked(docs, lambda t: paragraphs(t, most, batch))


def row_chunks(docs: DataFrame, most: int) -> DataFrame:
    return _chunked(docs, lambda t: rows(t, most))


def overlapping_chunks(docs: DataFrame, most: int, ratio: float) -> DataFrame:
    return _chunked(docs, lambda t: overlapping(t, most, ratio))


def recursive_chunks(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    return _chunked(docs, lambda t: [(c, len(c)) for c in recursive(t, most, overlap)])


def json_items(docs: DataFrame) -> DataFrame:
    """One chunk per item of a JSON list, as compact text; anything but a list gives nothing."""
    return docs.select("id", F.posexplode(F.from_json("text", "array<variant>")).alias("chunk_index", "item")).select("id", "chunk_index", F.to_json("item").alias("text"))


def identified(chunks: DataFrame) -> DataFrame:
    """Chunks with content hash, and ids that tell equal texts of a document apart by their occurrence."""
    w = Window.partitionBy("id", "content_hash").orderBy("chunk_index")
    hashed = chunks.withColumn("content_hash", content_hash(F.col("text"))).withColumn("occurrence", F.row_number().over(w) - 1)
    return hashed.withColumn("chunk_id", chunk_id(F.col("id"), F.col("content_hash"), F.col("occurrence")))


def offsets(chunks: DataFrame) -> DataFrame:
    """Chunks with start and end in their document, in characters."""
    w = Window.partitionBy("id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("end", F.sum(F.length("text")).over(w)).withColumn("start", F.col("end") - F.length("text"))


def overlapping_span(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks that overlap a span of their document: spans(id, from, to)."""
    return placed.join(spans, "id").where((F.col("start") < F.col("to")) & (F.col("end") > F.col("from")))


def anchor(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """id, from, to, chunk_index of the chunk that covers most of each span, the first of equals."""
    shared = F.least("end", "to") - F.greatest("start", "from")
    return overlapping_span(placed, spans).groupBy("id", "from", "to").agg(F.max_by("chunk_index", F.struct(shared, -F.col("chunk_index"))).alias("chunk_index"))


def namespace_id(text: str) -> str:
    """Id of a chunk by its text alone."""
    return str(uuid.uuid5(uuid.NAMESPACE_OID, text))
