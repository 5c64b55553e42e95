"""Compact codes for vectors: product quantisation whose searches are filtered by a vector-approximation file.

Components become integers floor(256 * x), so all that follows is exact. A vector is cut into
PARTS equal parts; each part position has a codebook that starts as the parts of the vectors
with the ENTRIES smallest ids and is refined in ROUNDS rounds of assigning and averaging.

Finding a part's nearest entry is filtered first. Each entry's coordinates are quantised to BITS
bits: a coordinate's sorted values are dealt into 2^BITS cells of equal count, and an entry is
known by its cells. A part gets one table per coordinate with the least and the greatest squared
distance to each cell; sums of looked-up values bound its distance to each entry from below and
above. Entries whose lower bound is beyond the smallest upper bound cannot be nearest, and only
the others are compared by their integers, ties to the lower index.

Codebooks have PARTS * ENTRIES entries at any size of the input; they and their sums are all that
meets on the driver. A round is one pass over the vectors and hands on one sum per entry and task;
the sums of an entry, as many as there are tasks, are added by one group.

Defined cases: vectors that are null, empty, of a length that PARTS does not divide, or with null
or non-finite components are dropped, and so are those not as long as the first vector kept (by id,
nulls last, then by content); repeated ids and rows each count and each get a row; ties in id are
ordered by content; with fewer than ENTRIES vectors the codebooks are that much smaller; an empty
table gives none. Components too large for 64-bit squares are computed with unbounded integers, and
an error beyond 64 bits is null, and so is the sum of a label with one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Bits by which an entry's coordinate is known to the filter.
BITS = 3
#: Vectors of a step: bounds the tables and bounds held at once.
STEP_ROWS = 4_096


def _limit(part: int) -> int:
    """Integers up to it can be subtracted, squared and summed over a part in 64 bits."""
    return 1 << ((62 - part.bit_length()) // 2 - 1)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of rows of finite numbers, as 64-bit integers where distances allow it and as Python's elsewhere."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * 256)
    if np.abs(scaled).max(initial=0) <= _limit(values.shape[1] // PARTS):
        return scaled.astype(np.int64)
    out = np.empty(values.shape, object)
    out.reshape(-1)[:] = [(n * 256) // d for n, d in map(float.as_integer_ratio, map(float, values.reshape(-1)))]
    return out


class Filter:
    """The approximation file of one codebook (entries x components)."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, width = entries.shape
        cells = 1 << bits
        ranks = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cells = (ranks * cells // n).astype(np.uint8)
        self.low, self.high = np.zeros((width, cells), entries.dtype), np.zeros((width, cells), entries.dtype)
        for j in range(width):
            for c in np.unique(self.cells[:, j]):
                own = entries[self.cells[:, j] == c, j]
                self.low[j, c], self.high[j, c] = own.min(), own.max()

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each part (rows) to each entry (columns)."""
        lower = upper = 0
        for j in range(parts.shape[1]):
            x = parts[:, j, None]
            below, above = self.low[j] - x, x - self.high[j]
            least, most = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            lower = lower + (least * least)[:, self.cells[:, j]]
            upper = upper + (most * most)[:, self.cells[:, j]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part."""
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == best[row])
        first = hits[np.r_[True, row[hits[1:]] != row[hits[:-1]]]]
        return entry[first], best


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, v (doubles) of the vectors without null or non-finite components, cut into equal parts without rest."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(column).cast("array<double>")
    good = F.coalesce((F.size(v) > 0) & (F.size(v) % PARTS == 0) & F.forall(v, finite), F.lit(False))
    return vectors.where(good).select("vec_id", "label", v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(books: list[np.ndarray], width: int):
    part = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS * ENTRIES, part), object)
        counts = np.zeros(PARTS * ENTRIES, np.int64)
        filters = [Filter(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                rows = integers(_matrix(batch.slice(at, STEP_ROWS).column(0), width))
                for p, own in enumerate(filters):
                    parts = rows[:, p * part : (p + 1) * part]
                    index, _ = own.nearest(parts)
                    found = np.zeros((ENTRIES, part), rows.dtype)
                    np.add.at(found, index, parts)
                    sums[p * ENTRIES : (p + 1) * ENTRIES] += found.astype(object)
                    counts[p * ENTRIES : (p + 1) * ENTRIES] += np.bincount(index, minlength=ENTRIES)
        used = np.flatnonzero(counts)
        yield pa.record_batch({"k": pa.array(used, pa.int32()), "n": pa.array(counts[used]), "s": pa.array([[str(x) for x in sums[k]] for k in used], pa.list_(pa.string()))})

    return run


def _total(sums: pa.Table) -> pa.Table:
    """The sum of one entry over all tasks, as texts: whole numbers without a bound."""
    rows = sums.column("s").to_pylist()
    return pa.table({"k": sums.column("k").slice(0, 1), "n": pa.array([sum(sums.column("n").to_pylist())], pa.int64()), "s": pa.array([[str(sum(map(int, x))) for x in zip(*rows, strict=True)]], pa.list_(pa.string()))})


def codebooks(vectors: DataFrame) -> tuple[list[np.ndarray], int]:
    """The codebook of each part position after ROUNDS rounds, and the length of the vectors (0 without any)."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return [], 0
    width = len(first[0]["v"])
    part = width // PARTS
    start = vectors.where(F.size("v") == width).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    entries = integers(np.array([r["v"] for r in start], np.float64))
    books = [entries[:, p * part : (p + 1) * part].copy() for p in range(PARTS)]
    for _ in range(ROUNDS):
        sums = vectors.where(F.size("v") == width).select("v").mapInArrow(_sums(books, width), "k int, n long, s array<string>")
        for row in sums.groupBy("k").applyInArrow(_total, "k int, n long, s array<string>").collect():
            p, e = divmod(row["k"], ENTRIES)
            mean = [int(x) // row["n"] for x in row["s"]]
            if max(map(abs, mean)) > _limit(part):
                books[p] = books[p].astype(object)
            books[p][e] = mean
    return books, width


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def _codes(books: list[np.ndarray], width: int):
    part = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                piece = batch.slice(at, STEP_ROWS)
                rows = integers(_matrix(piece.column(2), width))
                code, error = np.zeros((len(rows), PARTS), np.uint8), 0
                for p, own in enumerate(filters):
                    code[:, p], best = own.nearest(rows[:, p * part : (p + 1) * part])
                    error = error + best
                told = pa.array([bytes(c).hex() for c in code])
                yield pa.record_batch({"vec_id": piece.column(0), "label": piece.column(1), "code": told, "error": pa.array([int(x) if x < 1 << 63 else None for x in error], pa.int64())})

    return run


def encoded(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error, codebooks_sha256 of every usable vector.

    ``label_error`` sums the errors of equal labels, nulls together; sums are made by label before they are
    joined, so no label's vectors meet in one task.
    """
    rows = usable(vectors)
    books, width = codebooks(rows)
    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not width:
        empty = rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.select("vec_id", "label", "code", "error", F.col("error").alias("label_error"), F.lit(digest([])).alias("codebooks_sha256"))
    found = written(rows.where(F.size("v") == width).mapInArrow(_codes(books, width), schema), "codes")
    of = found.groupBy(F.col("label").alias("_label")).agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"))
    return found.join(of, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
