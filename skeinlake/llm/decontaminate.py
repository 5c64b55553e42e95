"""Benchmark decontamination by template canonicalisation.

Words become template tokens: a run of numbers (in digits or spelled) with the unit after it
becomes one quantity, a run of names (capitalised inside a sentence) one name, everything else
its lower-case form without outer punctuation. Windows of WINDOW template tokens, and beside
them windows of WINDOW plain words, are hashed; windows of documents are joined with those of
the benchmark by hash. A match puts the document at an offset (diagonal) to the item, and the
slot values along each diagonal have to agree: one value of the item always stands for one
value of the document. The item counts as leaked when the windows of consistent diagonals
cover at least COVER of its words, or when RUN of its words in a row stand in the document as
they are. So a question asked again with other numbers and names is caught, a verbatim copy is
caught whatever its words are, and a chance run of placeholders is not.

Both sides are tables of windows. A bitmap of the benchmark's hashes, of at most 2**MAX_BITS
bits however large the benchmark is, lets documents send only windows that can match; what
passes it by chance finds no partner in the join. Documents themselves are never shuffled.

Defined cases: null texts are empty; an item with fewer than MIN_ITEM words matches nothing;
an item shorter than a window is one window; of ties in cover each item gets its row; repeated
documents give repeated rows, repeated items give a row each.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from skeinlake.llm.common import map_pieces, pieces, texts, whole_text, written

WINDOW = 8
#: Tokens of a template window that are no placeholders.
LITERALS = 4
MIN_ITEM = 4
COVER = 0.5
#: Words in a row that are a leak by themselves.
RUN = 20
CONSISTENT = 0.8
MIN_BITS, MAX_BITS = 16, 28
QUANTITY, NAME = (np.uint64(xxh64_intdigest(x)) for x in (b"<quantity>", b"<name>"))
_MEMO = 200_000
_STRIP = bytes(c for c in range(33, 127) if not chr(c).isalnum())
# fixed values: spelled numbers and unit names
SPELLED = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
UNITS = frozenset(b"km m cm mm mi mile miles ft foot feet inch inches yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons tonnes l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur gbp percent % kmh mph w kw v a hz khz mhz ghz b kb mb gb tb degree degrees c f k j kj cal kcal pa bar".split())

_ITEM_WINDOWS = "item long, hash long, at int, low int, high int, words int, slots int, values array<long>"
_DOC_WINDOWS = "doc_id {}, row long, hash long, place long, values array<long>"


class Words:
    """Classes of words, learnt once per word: the literal's hash, and flags in a byte."""

    NUMBER, UNIT, TITLE, STOP = 1, 2, 4, 8

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.hash, self.flags = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """A number for each word, good until the next call."""
        if len(self.memo) > _MEMO:
            self.memo.clear()
        found = list(map(self.memo.get, words))
        if None in found:
            for k, f in enumerate(found):
                if f is None:
                    found[k] = self._learnt(words[k])
        return np.array(found, np.int64)

    def _learnt(self, word: bytes) -> int:
        if (i := self.memo.get(word)) is not None:
            return i
        i = self.memo[word] = len(self.memo)
        if i == len(self.hash):
            self.hash, self.flags = np.resize(self.hash, 2 * i), np.resize(self.flags, 2 * i)
        core = word.strip(_STRIP) or word
        low, text = core.lower(), core.decode("utf-8", "replace")
        title = len(text) > 1 and text[0].isupper() and any(c.islower() for c in text[1:])
        stop = word.rstrip(b"\"')]}").endswith((b".", b"!", b"?", b":"))
        self.hash[i] = xxh64_intdigest(text.lower().encode())
        self.flags[i] = self.NUMBER * (core[:1].isdigit() or low in SPELLED) | self.UNIT * (low in UNITS) | self.TITLE * title | self.STOP * stop
        return i


@lru_cache(1)
def _words() -> Words:
    """One for each Python worker."""
    return Words()


class Templates:
    """Word hashes and template tokens of several texts, one after the other.

    ``h`` and ``ends`` are by word; ``token``, ``literal``, ``value`` (what a slot holds),
    ``low`` and ``high`` (its words) and ``token_ends`` are by template token.
    """

    def __init__(self, rows: list[bytes]) -> None:
        words = [t.split() for t in rows]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.sizes)
        known = _words()
        ids = known.ids([w for ws in words for w in ws])
        self.h, flags = known.hash[ids], known.flags[ids]
        n = len(ids)
        number, unit, title, stop = (flags & x > 0 for x in (Words.NUMBER, Words.UNIT, Words.TITLE, Words.STOP))
        first = np.zeros(n, bool)
        first[(self.ends - self.sizes)[self.sizes > 0]] = True
        before = lambda x: np.concatenate([[False], x[:-1]])[: len(x)]
        name = title & ~first & ~before(stop) & ~number
        unit &= before(number) & ~first & ~number
        starts = np.flatnonzero(first | ~(number & before(number) | unit | name & before(name)))
        self.low, self.high = starts, np.append(starts[1:], n)[: len(starts)]
        number, name = number[starts], name[starts]
        self.literal = ~(number | name)
        self.token = np.where(number, QUANTITY, np.where(name, NAME, self.h[starts]))
        place = (np.arange(n) - np.repeat(starts, self.high - starts)).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (self.h ^ self.h >> np.uint64(31)) * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        self.value = np.add.reduceat(mixed, starts) if n else mixed
        self.token_ends = np.searchsorted(starts, self.ends)

    def windows(self, width: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
        """Of templates and of words: hashes of all windows inside a text, their first tokens and their texts."""
        for kind, keys, ends in ((True, self.token, self.token_ends), (False, self.h, self.ends)):
            hashes = window_hashes(keys, width, kind)
            at = np.arange(len(hashes))
            doc = np.searchsorted(ends, at, "right")
            inside = at + width <= ends[doc] if len(at) else np.zeros(0, bool)
            yield kind, hashes[inside], at[inside], doc[inside]


def window_hashes(keys: np.ndarray, width: int, kind: bool) -> np.ndarray:
    """Polynomial hash of each window of ``width`` keys; other widths and kinds hash otherwise."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 2 * width + kind, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (keys[k : k + n] ^ (keys[k : k + n] >> np.uint64(29)))
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def _values(value: np.ndarray, at: np.ndarray, width: int, kind: bool) -> pa.Array:
    """For each template window the values of its tokens; nothing for windows of words."""
    size = width if kind else 0
    flat = value[(at[:, None] + np.arange(size)).reshape(-1)].view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), pa.array(flat, pa.int64()))


def item_windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The windows of each item: hash, first token, words covered, and which of its tokens are slots."""
    found = Templates(texts(batch))
    items = batch.column("item").to_numpy(zero_copy_only=False)
    out: list[pa.RecordBatch] = []
    full = found.sizes >= MIN_ITEM
    word_starts, token_starts = found.ends - found.sizes, np.concatenate([[0], found.token_ends[:-1]])[: len(found.ends)]
    tokens = found.token_ends - token_starts
    for width in range(1, WINDOW + 1):
        for kind, hashes, at, doc in found.windows(width):
            of, starts = (tokens, token_starts) if kind else (found.sizes, word_starts)
            literals = np.lib.stride_tricks.sliding_window_view(found.literal, width)[at] if kind and len(at) else np.ones((len(at), width), bool)
            use = full[doc] & (np.minimum(of[doc], WINDOW) == width) & (literals.sum(1) * WINDOW >= LITERALS * width)
            hashes, at, doc, literals = hashes[use], at[use], doc[use], literals[use]
            if not len(at):
                continue
            low, high = (found.low[at], found.high[at + width - 1]) if kind else (at, at + width)
            slots = (~literals @ (1 << np.arange(width))).astype(np.int32)
            columns = [items[doc], hashes.view(np.int64), (at - starts[doc]).astype(np.int32), (low - word_starts[doc]).astype(np.int32), (high - word_starts[doc]).astype(np.int32), found.sizes[doc].astype(np.int32), slots]
            out.append(pa.RecordBatch.from_arrays([*map(pa.array, columns), _values(found.value, at, width, kind)], ["item", "hash", "at", "low", "high", "words", "slots", "values"]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, int]:
    """Bits that are set where a hash of the benchmark begins so, and their number as a power of two."""
    n = windows.count()
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(256 * n + 1))))
    chunk = min(bits, 16)
    slot = F.shiftrightunsigned("hash", 64 - bits)
    slots = windows.select(F.shiftright(slot, chunk).alias("part"), F.pmod(slot, F.lit(1 << chunk)).cast("int").alias("bit")).distinct()

    def packed(table: pa.Table) -> pa.Table:
        held = np.zeros(1 << chunk, bool)
        held[table.column("bit").to_numpy()] = True
        return pa.table({"part": table.column("part")[:1].cast(pa.int64()), "bits": pa.array([np.packbits(held).tobytes()])})

    out = np.zeros(1 << bits, bool)
    for r in slots.groupBy("part").applyInArrow(packed, "part long, bits binary").toLocalIterator():
        out[r["part"] << chunk : (r["part"] + 1) << chunk] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return np.packbits(out), bits


def _asking(bitmap: np.ndarray, bits: int, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in pieces(batch) if batch.num_rows else ():
                found = Templates(texts(piece))
                starts = found.ends - found.sizes, np.concatenate([[0], found.token_ends[:-1]])[: len(found.ends)]
                for width in widths:
                    for kind, hashes, at, doc in found.windows(width):
                        slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                        met = np.flatnonzero(bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                        if len(met):
                            at, doc = at[met], doc[met]
                            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(doc)), pa.array(row + doc), pa.array(hashes[met].view(np.int64)), pa.array(at - starts[kind][doc]), _values(found.value, at, width, kind)], ["doc_id", "row", "hash", "place", "values"])
                row += piece.num_rows

    return run


def judged(rows: list[tuple[int, int, int, int, int, int, list[int], list[int]]], words: int) -> tuple[float, int, int, int]:
    """Cover, slots met, slots changed and longest run of words, from (place, at, low, high, slots, kind, item's values, document's values)."""
    plain, diagonals = np.zeros(words, bool), defaultdict(list)
    exact: dict[int, set[int]] = defaultdict(set)
    for place, at, low, high, slots, kind, mine, its in rows:
        if kind:
            diagonals[place - at].append((at, low, high, slots, mine, its))
        else:
            plain[low:high] = True
            exact[place - at].update(range(low, high))
    covered = plain.copy()
    met = changed = longest = 0
    for along in diagonals.values():
        pairs = {at + k: (mine[k], its[k]) for at, _, _, slots, mine, its in along for k in range(len(mine)) if slots >> k & 1}
        values: dict[int, Counter] = defaultdict(Counter)
        for mine, its in pairs.values():
            values[mine][its] += 1
        if pairs and sum(max(c.values()) for c in values.values()) < CONSISTENT * len(pairs):
            continue
        fresh = False
        for _, low, high, *_ in along:
            fresh |= not covered[low:high].all()
            covered[low:high] = True
        if fresh or not met:
            met += len(pairs)
            changed += sum(mine != its for mine, its in pairs.values())
    for held in exact.values():
        run = 0
        for k in range(words):
            run = run + 1 if k in held else 0
            longest = max(longest, run)
    return float(covered.mean()) if words else 0.0, met, changed, longest


def _verdicts(table: pa.Table) -> pa.Table:
    """One row, or none, for the matching windows of one document and one item."""
    get = lambda c: table.column(c).to_pylist()
    rows = list(zip(get("place"), get("at"), get("low"), get("high"), get("slots"), map(bool, get("mine")), get("mine"), get("its"), strict=True))
    words = table.column("words")[0].as_py()
    cover, met, changed, longest = judged(rows, words)
    keep = cover >= COVER or longest >= RUN
    first = table.slice(0, 1 if keep else 0)
    return pa.table([first.column("doc_id"), first.column("item"), *(pa.array([x] * first.num_rows, t) for x, t in ((cover, pa.float64()), (met, pa.int64()), (changed, pa.int64())))], names=["doc_id", "item", "cover", "n_slots", "n_changed"])


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item (hash of its text), cover, n_slots, n_changed: a row for each leaked text of a row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = benchmark.select(whole_text().alias("text")).distinct().select("text", F.xxhash64("text").alias("item"))
    windows = written(map_pieces(items, item_windows, _ITEM_WINDOWS), "item-windows")
    bitmap, bits = _bitmap(windows)
    template = F.size("values") > 0
    widths = sorted({r[0] for r in windows.select(F.when(template, F.size("values")).otherwise(F.col("high") - F.col("low"))).distinct().collect()})
    asked = written(docs.select("doc_id", whole_text().alias("text")).mapInArrow(_asking(bitmap, bits, widths), _DOC_WINDOWS.format(kind)), "doc-windows")
    mine = windows.withColumnRenamed("values", "mine").withColumnRenamed("hash", "_hash")
    met = asked.withColumnRenamed("values", "its").join(mine, F.col("hash") == F.col("_hash")).drop("hash", "_hash")
    return met.groupBy("row", "item").applyInArrow(lambda t: _verdicts(t), f"doc_id {kind}, item long, cover double, n_slots long, n_changed long")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cover, n_slots, n_changed: a row for each benchmark item that a document leaks."""
    ids = benchmark.select("item_id", F.xxhash64(whole_text()).alias("_item"))
    found = _leaks(docs, benchmark)
    return found.join(ids, found["item"] == ids["_item"]).select("doc_id", "item_id", "cover", "n_slots", "n_changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item: an anti join on id and text."""
    key = F.xxhash64(whole_text())
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), key.alias("text")).alias("doc_id"), "text")
    leaked = written(_leaks(keyed, benchmark).select(F.col("doc_id.id").alias("_leaked_id"), F.col("doc_id.text").alias("_leaked_text")).distinct(), "leaks")
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["_leaked_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == leaked["_leaked_text"]), "left_anti")
