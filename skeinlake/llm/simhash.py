"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most three bits have a 32-bit half in which
they differ in at most one. Each half is covered by the code Hamming[31,26] x {0,1}:
every 32-bit value lies within radius 1 of exactly one anchor (its home). A value is
replicated to all anchors within radius + threshold = 2, at most 17 a half; if two halves
differ in one bit at most, each is therefore a guest at the other's home, and comparing
the members of each anchor finds every linked pair. Only distinct fingerprints are
replicated, an anchor hands on a spanning forest and not its pairs, and components come
from large-star/small-star rounds over written tables.

Defined cases: a null text is empty; no word gives fingerprint zero, which links like any
other; repeated rows stay repeated rows; a null doc_id takes part, and gets the smallest
known id of its component (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from skeinlake.llm.common import map_pieces, release, texts, whole_text, written

SEED = 42
SHINGLE = 3
THRESHOLD = 3
#: Anchors with more members than this are searched breadth first.
SMALL_GROUP = 48
_CHUNK = 1 << 16
#: Tasks that the neighbours of one node are dealt to.
SALTS = 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    sums = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for start in range(0, n, _CHUNK):
        part = words[start : min(n, start + _CHUNK) + shingle - 1]
        hashes = [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long with the fingerprint's bits), one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_pieces(docs.select("doc_id", whole_text().alias("text")), _fingerprints, f"doc_id {kind}, fp long")


@lru_cache(1)
def _syndromes() -> list[np.ndarray]:
    """By byte of the 31-bit word: XOR of the positions 1..31 of its set bits."""
    tables = []
    for byte in range(4):
        t = np.zeros(256, np.uint32)
        for bit in range(8):
            if (position := 8 * byte + bit + 1) <= 31:
                t[(np.arange(256) >> bit & 1) == 1] ^= position
        tables.append(t)
    return tables


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """index, anchor, home of each anchor within 2 of each 32-bit value; home: within 1, on the same side."""
    half = half.astype(np.uint32)
    word, side = half >> np.uint32(1), half & np.uint32(1)
    tables = _syndromes()
    z = tables[0][word & 255] ^ tables[1][word >> 8 & 255] ^ tables[2][word >> 16 & 255] ^ tables[3][word >> 24 & 255]
    flip = lambda p: np.where(p > 0, np.uint32(1) << (np.maximum(p, 1) - 1).astype(np.uint32), np.uint32(0)).astype(np.uint32)
    near = (word ^ flip(z)).astype(np.int64)
    every = np.arange(len(half))
    index, anchor, home = [every, every], [near << 1 | side, near << 1 | (side ^ 1)], [np.ones(len(half), bool), np.zeros(len(half), bool)]
    for i in range(1, 32):
        j = z ^ np.uint32(i)
        at = np.flatnonzero((z > 0) & (j > i))
        code = (word[at] ^ flip(np.full(len(at), i, np.uint32)) ^ flip(j[at])).astype(np.int64)
        index.append(at)
        anchor.append(code << 1 | side[at])
        home.append(np.zeros(len(at), bool))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for k in range(2):
            index, anchor, home = anchors((fp.view(np.uint64) >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(anchor << 1 | k), pa.array(fp[index]), pa.array(home)], ["anchor", "fp", "home"])


def _forest(parent: dict[int, int], a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of each pair; the smaller root stays."""

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (x := root(x)) != (y := root(y)):
            parent[max(x, y)] = min(x, y)


def _breadth_first(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked in one large group; each member meets only those not reached yet."""
    left, a, b = np.unique(fp), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= THRESHOLD
            if near.any():
                a.append(np.full(int(near.sum()), x, np.uint64))
                b.append(left[near])
                queue.extend(left[near])
                left = left[~near]
    none = np.zeros(0, np.uint64)  # of the same type: a signed one would turn all into floats
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _compared(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, parent: dict[int, int]) -> None:
    """Links within whole anchor groups; rows are sorted by anchor."""
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(starts, len(anchor)))
    lived = np.add.reduceat(home.astype(np.int64), starts) > 0
    bits = fp.view(np.uint64)
    small = starts[lived & (sizes > 1) & (sizes <= SMALL_GROUP)]
    sizes_small = sizes[lived & (sizes > 1) & (sizes <= SMALL_GROUP)]
    for step in range(1, SMALL_GROUP):
        keep = sizes_small > step
        small, sizes_small = small[keep], sizes_small[keep]
        if not len(small):
            break
        for offset in range(int(sizes_small.max()) - step):
            i = small[sizes_small > offset + step] + offset
            near = np.bitwise_count(bits[i] ^ bits[i + step]) <= THRESHOLD
            if near.any():
                i = i[near]
                _forest(parent, fp[i], fp[i + step])
    for s, n in zip(starts[lived & (sizes > SMALL_GROUP)], sizes[lived & (sizes > SMALL_GROUP)], strict=True):
        a, b = _breadth_first(bits[s : s + n])
        _forest(parent, a.view(np.int64), b.view(np.int64))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by anchor: (child, root) of the forest over all its links."""
    parent: dict[int, int] = {}
    held: list[tuple] = []
    rows = 0

    def settle(last: bool) -> None:
        nonlocal held, rows
        if not held:
            return
        anchor, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            _compared(anchor[:cut], fp[:cut], home[:cut], parent)
        held = [(anchor[cut:], fp[cut:], home[cut:])] if cut < len(anchor) else []
        rows = len(anchor) - cut

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= 1 << 19:
                settle(False)
    settle(True)
    child = [x for x in parent if parent[x] != x]
    tops = []
    for x in child:
        while parent[x] != x:
            x = parent[x]
        tops.append(x)
    if child:
        yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(tops, pa.int64())], ["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """u, v: edges whose components are those of all fingerprints of ``distinct`` (fp) within the threshold."""
    spark = distinct.sparkSession
    replicated = distinct.select("fp").mapInArrow(_replicated, "anchor long, fp long, home boolean")
    dealt = replicated.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_linked, "u long, v long").distinct()


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges(u, v) with the m of their u; the neighbours of a hub are dealt to SALTS tasks."""
    dealt = edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))
    return dealt.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node) of the undirected edges u, v; nodes without an edge are left out.

    Alternates large-star and small-star until the edges stay the same; each round is a
    written table, so a lost executor costs a round at most, and the table before it goes.
    Minima are added up before the shuffle, and the rows of a hub are dealt to several tasks.
    """
    told = lambda df: tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")).cast("string")).first())
    now = written(edges.where("u <> v").distinct(), "edges")
    before, seen = None, told(now)
    while seen != before:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _met(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = _met(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, seen = seen, told(after)
        release(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _placed(found: DataFrame) -> DataFrame:
    """fp, root of its component, and the smallest doc_id that has it, for each distinct fp."""
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row per row."""
    found = written(fingerprints(docs), "fingerprints")
    placed = _placed(found)
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(ids, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(classes, "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest known doc_id, then fingerprint, then hash.

    Rows are told apart by a hash of all their columns, so different texts that share an id, or
    have none, each stay or go with their own component.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), {"ignoreNullFields": "false"}))
    keyed = docs.select("doc_id", whole_text().alias("text"), row.alias("key"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), _fingerprints(batch).column("fp"), batch.column("key")], ["doc_id", "fp", "key"])

    found = written(map_pieces(keyed, run, f"doc_id {kind}, fp long, key long"), "fingerprints")
    first = found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp", "key")).alias("first"))
    kept = _placed(found).select("fp", "root").join(first, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("_kept_key"), F.col("first.doc_id").alias("_kept_id"))
    names = [f"_c{k}" for k in range(len(docs.columns))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), row.alias("_row"), F.col("doc_id").alias("_id"))
    one = plain.join(kept, (plain["_row"] == kept["_kept_key"]) & plain["_id"].eqNullSafe(kept["_kept_id"]), "left_semi").dropDuplicates(["_row", "_id"])
    return one.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
