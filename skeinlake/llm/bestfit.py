"""Best-fit packing by large-item matching, on the histogram of lengths.

Lengths are whole numbers from 1 to the capacity, so the packing is planned on their counts,
which fit on the driver whatever the size of the corpus: pieces above one third of the
capacity are matched greedily, the longest with the longest partner that fits, at most two
to a bin, many bins at a time; then each shorter length, from the longest down, goes to the
bins with the tightest gap that holds it, and to new bins when there is none. The plan is a
list of (length, ranks, first bin, offset); each piece finds its place by its rank among the
pieces of its length, which comes from counts by task, so no task and no driver ever sees
all pieces. Any number of pieces of one length costs nothing more.

Defined cases: a null text is empty and is one token (the end id); repeated rows are packed
as often as they occur; only texts with more tokens than the capacity are cut.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.llm.common import pieces, texts, whole_text, written

CAPACITY = 4096
END_ID = 1
_MEMO = 500_000
#: Marks at the end of a word that are one token group by themselves after a letter; an apostrophe is not.
_TAIL = '.,!?;:#*$%&|"()[]<>'


class WordIds:
    """Token ids of a text, word by word with a memory.

    The tokenizer lower-cases and never joins across white space, so the ids of a text are
    those of its words in turn, and those of a word that ends in marks after a letter are the ids
    of both parts. New words of letters alone are encoded many at once
    and told apart by the tokens that end a word.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _encode(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_cores(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        for w in words:
            if not w.isalpha():
                self.cores[w] = self._encode(w)
        for start in range(0, len(plain), 200):
            part = plain[start : start + 200]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # a letter that lower-cases to more than letters
                self.cores.update((w, self._encode(w)) for w in part)
            else:
                raw, cuts = ids.tobytes(), (4 * cuts).tolist()
                self.cores.update((w, raw[i:j]) for w, i, j in zip(part, [0, *cuts], cuts, strict=False))

    def _learn(self, words: set[bytes]) -> None:
        new: dict[bytes, tuple[str, str]] = {}
        for w in words:
            text = w.decode()
            core = text.rstrip(_TAIL)
            # the tokenizer lower-cases and composes first, which may leave a letter with a combining mark
            new[w] = (core, text[len(core) :]) if core and core[-1].isalpha() and unicodedata.normalize("NFC", core.lower())[-1].isalpha() else (text, "")
        self._learn_cores([c for c in {x for pair in new.values() for x in pair if x} if c not in self.cores])
        for w, (core, tail) in new.items():
            self.memo[w] = self.cores[core] + self.cores[tail] if tail else self.cores[core]

    def batch(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, with the end id."""
        if len(self.memo) > _MEMO:
            self.memo.clear()
            self.cores.clear()
        words = [r.lower().split() for r in rows]
        if new := set().union(*words).difference(self.memo):
            self._learn(new)
        end = np.array([END_ID], "<u4").tobytes()
        return [np.frombuffer(b"".join([*map(self.memo.__getitem__, ws), end]), "<u4") for ws in words]


@lru_cache(1)
def _word_ids(path: str) -> WordIds:
    """One for each Python worker, which keeps its memory from task to task."""
    return WordIds(path)


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (task) and nth (among the part's pieces of that length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = _word_ids(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for piece in pieces(batch) if batch.num_rows else ():
                rows: list[tuple] = []
                for k, ids in enumerate(words.batch(texts(piece))):
                    for number, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start : start + capacity]
                        rows.append((k, number, start, len(cut), zlib.crc32(cut.tobytes()), part, seen[len(cut)]))
                        seen[len(cut)] += 1
                k, number, start, length, crc, parts, nth = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(k)), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(parts, pa.int32()), pa.array(nth, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, number, first bin, offset) of each run of pieces, and the number of bins."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of (first bin, number)

    def put(length: int, number: int, first: int, offset: int) -> None:
        out.append((length, used[length], number, first, offset))
        used[length] += number
        left[length] -= number

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            partner = next((m for m in large if m <= capacity - length and left[m] > (m == length)), None)
            number = left[length] if partner is None else left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, number, bins, 0)
            if partner is not None:
                put(partner, number, bins, length)
            open_[capacity - length - (partner or 0)].append((bins, number))
            bins += number
    gaps = [g for g in open_ if g]
    heapq.heapify(gaps)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        skipped: list[int] = []
        while left[length]:
            while gaps and (gaps[0] < length or not open_.get(gaps[0])):
                g = heapq.heappop(gaps)
                if open_.get(g):
                    skipped.append(g)  # too tight for this length, not for shorter ones
            if not gaps:
                fit = capacity // length
                whole, rest = divmod(left[length], fit)
                if whole:
                    for k in range(fit):
                        put(length, whole, bins, k * length)
                    open_[capacity - fit * length].append((bins, whole))
                    heapq.heappush(gaps, capacity - fit * length)
                    bins += whole
                if rest:
                    for k in range(rest):
                        put(length, 1, bins, k * length)
                    open_[capacity - rest * length].append((bins, 1))
                    heapq.heappush(gaps, capacity - rest * length)
                    bins += 1
                break
            gap = gaps[0]
            first, number = open_[gap].pop()
            # a run takes the same number of pieces in each of its bins, as many as fit
            per = gap // length
            full, rest = divmod(left[length], per)
            if full >= number:
                for k in range(per):
                    put(length, number, first, capacity - gap + k * length)
                now = gap - per * length
                open_[now].append((first, number))
                heapq.heappush(gaps, now)
                continue
            if full:
                for k in range(per):
                    put(length, full, first, capacity - gap + k * length)
                open_[gap - per * length].append((first, full))
                heapq.heappush(gaps, gap - per * length)
            if rest:
                for k in range(rest):
                    put(length, 1, first + full, capacity - gap + k * length)
                open_[gap - rest * length].append((first + full, 1))
                heapq.heappush(gaps, gap - rest * length)
            if (over := number - full - (rest > 0)) > 0:
                open_[gap].append((first + full + (rest > 0), over))
        for g in skipped:
            heapq.heappush(gaps, g)
    return out, bins


def _placing(found: list[tuple[int, int, int, int, int]]):
    runs = np.array(sorted(found), np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.unique(runs[:, 0])
        low = np.searchsorted(runs[:, 0], lengths)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.zeros(batch.num_rows, np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                n = length[order[a]]
                k = int(np.searchsorted(lengths, n))
                hi = low[k + 1] if k + 1 < len(low) else len(runs)
                at[order[a:b]] = low[k] + np.searchsorted(runs[low[k] : hi, 1], rank[order[a:b]], "right") - 1
            sequence = runs[at, 3] + rank - runs[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(runs[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its offset there.

    The plan has a run for each length and kind of gap: bounded by the capacity, not by the
    rows, so it goes to the tasks with the function.
    """
    cut = written(tokenised(docs, path, capacity), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select(F.col("length").alias("_length"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, (cut["length"] == bases["_length"]) & (cut["part"] == bases["_part"])).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(_placing(found), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
