"""A growing hierarchy of buckets over items with vectors: items in buckets, buckets in buckets, one root.

Items are placed in an order, and each choice depends on those before it. What makes the fold
parallel is that a block of items is scored against all open buckets at once, and that only its
best few candidates are needed to replay the block in order: a bucket that the block hasn't
touched has the score it had, and those it has touched are known to the replay. An item whose
candidates have all been touched ends the block, and is the first of the next one, so the result is
that of the fold, item by item. A replay holds a block and its candidates (BLOCK * KEPT rows);
the buckets stay distributed. Mean cosine distances to a bucket's members are one inner product with
the sum of their unit vectors. Scores are compared to nine digits.

Defined cases: see ``nearest.items`` for null, odd and repeated vectors; items that have a
place keep it; empty tables give an empty index without a root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.shared import numbered, release, written
from skeinlake.operators.nearest import items as usable

#: Items that are placed together, the candidates that each takes into the replay, and the items scored at once.
BLOCK, KEPT, SCORED = 8_192, 16, 256
_BUCKET = "bucket string, born long, size int, total array<double>"


@dataclass
class Index:
    """buckets(level, bucket, born, size, total) and links(level, child, parent); the root's links have the highest level."""

    buckets: DataFrame
    links: DataFrame


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _candidates(block: list, most: int, threshold: float, kept: int):
    """Of a batch of buckets, the best few of each item of the block (n, v)."""
    numbers, v = np.array([r["n"] for r in block]), np.array([r["v"] for r in block], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, born = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((born, size))  # ties: the smaller bucket, then the older
            batch, size = batch.take(pa.array(order)), size[order]
            centre = (_matrix(batch.column(3), batch.num_rows) / size[:, None]).T
            for start in range(0, len(v), SCORED):
                mean = np.round(1 - v[start : start + SCORED] @ centre, 9)
                mean[:, size >= most] = np.inf
                mean[mean > threshold] = np.inf
                row, at = np.nonzero(mean < np.inf)
                score = mean[row, at]
                best = np.lexsort((at, score, row))
                row, at, score = row[best], at[best], score[best]
                first = np.arange(len(row)) - np.searchsorted(row, row, "left") < kept
                taken = batch.take(pa.array(at[first]))
                yield pa.record_batch([pa.array(numbers[start + row[first]]), pa.array(score[first]), *taken.columns], ["n", "mean", *batch.schema.names])

    return run


def _replay(level: int, most: int, threshold: float, kept: int):
    """The block in order: n, id, and the buckets that it has touched, as they are afterwards."""

    def run(items: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        items, found = items.sort_values("n"), found.sort_values(["n", "mean", "size", "born"])
        own = {n: list(f.itertuples(index=False)) for n, f in found.groupby("n")}
        names: list[str] = []
        place: dict[str, int] = {}
        width = len(items["v"].iloc[0])
        totals, sizes, born = np.zeros((len(items), width)), np.zeros(len(items), int), np.zeros(len(items), np.int64)
        links: list[tuple] = []
        for n, key, v in zip(items["n"], items["id"], items["v"], strict=True):
            v, mine = np.asarray(v, float), own.get(n, [])
            still = next((c for c in mine if c.bucket not in place), None)
            if still is None and len(mine) == kept:
                break
            options = [] if still is None else [(still.mean, still.size, still.born, still.bucket)]
            m = len(names)
            if m:
                mean = np.round(1 - totals[:m] @ v / sizes[:m], 9)
                options += [(mean[k], sizes[k], born[k], names[k]) for k in np.flatnonzero((mean <= threshold) & (sizes[:m] < most))]
            name = min(options)[3] if options else f"{level}/{key}"
            if name not in place:
                place[name] = m
                names.append(name)
                totals[m], sizes[m], born[m] = (still.total, still.size, still.born) if options else (0, 0, n)
            k = place[name]
            totals[k], sizes[k] = totals[k] + v, sizes[k] + 1
            links.append((n, key, name))
        rows = [(n, key, name, None, None, None) for n, key, name in links] + [(None, None, name, born[k], sizes[k], totals[k].tolist()) for k, name in enumerate(names)]
        return pd.DataFrame(rows, columns=["n", "id", "bucket", "born", "size", "total"]).astype({"n": "Int64", "born": "Int64", "size": "Int32"})

    return run


def assigned(items: DataFrame, buckets: DataFrame, level: int, most: int, threshold: float, block: int = BLOCK, kept: int = KEPT) -> tuple[DataFrame, DataFrame]:
    """links (child, parent) of items (id, v) placed in order of id, and all buckets afterwards.

    An item goes to the bucket with room whose members are nearest on average, at ``threshold`` or less,
    of equal ones to the smaller, then to the older; else it opens a bucket.
    """
    spark = items.sparkSession
    first = (buckets.agg(F.max("born")).first()[0] or 0) + 1
    todo = numbered(items.select(F.col("id").cast("string").alias("id"), "v"), "id").withColumn("n", F.col("n") + first)
    last = (todo.agg(F.max("n")).first()[0] or 0) if not todo.isEmpty() else 0
    open_, full = buckets.where(F.col("size") < most).select("bucket", "born", "size", "total"), [buckets.where(F.col("size") >= most).select("bucket", "born", "size", "total")]
    links: list[DataFrame] = []
    at = first + 1
    while at <= last:
        now = todo.where(F.col("n").between(at, at + block - 1))
        rows = now.select("n", "v").collect()  # a block
        scored = open_.mapInArrow(_candidates(rows, most, threshold, kept), f"n long, mean double, {_BUCKET}")
        best = scored.withColumn("_k", F.row_number().over(Window.partitionBy("n").orderBy("mean", "size", "born"))).where(F.col("_k") <= kept).drop("_k")
        told = now.select("n", "id", "v", F.lit(0).alias("one")).groupBy("one").cogroup(best.withColumn("one", F.lit(0)).groupBy("one")).applyInPandas(_replay(level, most, threshold, kept), f"n long, id string, {_BUCKET}")
        told = written(told, "placed")
        links.append(told.where("n is not null").select(F.col("id").alias("child"), F.col("bucket").alias("parent")))
        touched = told.where("n is null").select("bucket", "born", "size", "total")
        full.append(touched.where(F.col("size") >= most))
        before, open_ = open_, written(open_.join(touched, "bucket", "left_anti").unionByName(touched.where(F.col("size") < most)), "open")
        if hasattr(before, "_written_to"):
            release(before)
        at = told.agg(F.max("n")).first()[0] + 1
    placed = reduce(DataFrame.unionByName, links) if links else spark.createDataFrame([], "child string, parent string")
    return placed, reduce(DataFrame.unionByName, full).unionByName(open_)


def _closest(seeds: list, kept: int):
    """Of a batch of items (id, n, v), the nearest few to each seed."""
    numbers, v = np.array([r["n"] for r in seeds]), np.array([r["v"] for r in seeds], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                batch = batch.take(pa.array(np.argsort(batch.column(1).to_numpy(), kind="stable")))
                apart = np.round(1 - v @ _matrix(batch.column(2), batch.num_rows).T, 9)
                best = np.argsort(apart, axis=1, kind="stable")[:, :kept]
                row = np.repeat(np.arange(len(v)), best.shape[1])
                taken = batch.take(pa.array(best.reshape(-1)))
                yield pa.record_batch([pa.array(numbers[row]), pa.array(np.take_along_axis(apart, best, 1).reshape(-1)), taken.column(0), taken.column(1)], ["seed", "apart", "id", "n"])

    return run


def _gathered(level: int, most: int, kept: int):
    def run(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["seed", "apart", "n"])
        taken: set[int] = set()
        rows: list[tuple] = []
        for seed, near in found.groupby("seed", sort=True):
            if seed in taken:
                continue
            own = near[near["n"] == seed]
            left = [(n, key) for n, key in zip(near["n"], near["id"], strict=True) if n != seed and n not in taken][: most - 1]
            if len(own) == 0 or len(left) < most - 1 and len(near) == kept:
                break  # more may lie beyond what was kept: the next round starts here
            name = f"{level}/{own['id'].iloc[0]}"
            members = [(seed, own["id"].iloc[0]), *left]
            taken |= {n for n, _ in members}
            rows += [(int(n), key, name, int(seed)) for n, key in members]
        return pd.DataFrame(rows, columns=["n", "id", "bucket", "born"])

    return run


def gathered(items: DataFrame, level: int, most: int, seeds: int = 256) -> DataFrame:
    """child, parent, born of items (id, v): the first item without a bucket opens one and takes the nearest others without one.

    Some seeds at a time are met with all items left; they are replayed in order, up to the first
    that would need a neighbour beyond the ``kept`` nearest of it. The first seed never does.
    """
    kept = 4 * most
    left = numbered(items.select(F.col("id").cast("string").alias("id"), "v"), "id").select("id", "n", "v")
    out: list[DataFrame] = []
    while True:
        first = left.orderBy("n").limit(seeds).collect()  # a bounded number of seeds
        if not first:
            break
        near = left.mapInArrow(_closest(first, kept), "seed long, apart double, id string, n long")
        # a seed is its own nearest; a zero vector is not, so it is named
        own = left.where(F.col("n").isin([r["n"] for r in first])).select(F.col("n").alias("seed"), F.lit(-1.0).alias("apart"), "id", "n")
        ranked = near.where("seed <> n").unionByName(own).withColumn("_k", F.row_number().over(Window.partitionBy("seed").orderBy("apart", "n"))).where(F.col("_k") <= kept).drop("_k")
        told = written(ranked.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_gathered(level, most, kept), "n long, id string, bucket string, born long"), "gathered")
        out.append(told.select(F.col("id").alias("child"), F.col("bucket").alias("parent"), "born"))
        left = written(left.join(told.select("n"), "n", "left_anti").select("id", "n", "v"), "left")
    return reduce(DataFrame.unionByName, out) if out else items.sparkSession.createDataFrame([], "child string, parent string, born long")


def _vector(total: str = "total"):
    """What stands for a bucket one level up: its members' mean at length one."""
    size = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(size), lambda n: F.transform(total, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0]


def _summed(links: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """parent, size, total of links (child, parent) by vectors (id, v)."""
    met = links.join(vectors.select(F.col("id").cast("string").alias("child"), "v"), "child")
    return met.groupBy("parent").agg(F.count("*").cast("int").alias("size"), F.array(*(F.sum(F.col("v")[j]) for j in range(width))).alias("total"))


def build(items: DataFrame, most: int, threshold: float, before: Index | None = None, describe: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """The index after ``items`` (id, vector) have been added to one built before.

    New items are placed on the lowest level. Each level's new buckets are the next level's items:
    they are placed there if it exists and gathered anew, all buckets of the level, if not. Buckets
    whose members have changed are described again, and so are their parents. It ends with a level
    of at most ``most`` buckets, which the root holds.

    ``describe`` takes buckets (bucket, total) and returns (id, v), the vector that stands for
    each on the next level, where a model writes and embeds their summaries; without it that is the
    mean of the members.
    """
    if most < 2:
        raise ValueError("buckets of fewer than two do not make a hierarchy")
    spark = items.sparkSession
    describe = describe or (lambda b: b.select(F.col("bucket").alias("id"), _vector().alias("v")))
    vectors = written(usable(items), "items")
    old_buckets = before.buckets if before else spark.createDataFrame([], f"level int, {_BUCKET}")
    old_links = before.links if before else spark.createDataFrame([], "level int, child string, parent string")
    head = vectors.limit(1).collect()
    if not head:
        return Index(old_buckets, old_links)
    width = len(head[0]["v"])
    new = vectors.join(old_links.where("level = 0").select(F.col("child").alias("_c")), F.col("id").cast("string") == F.col("_c"), "left_anti")
    buckets: list[DataFrame] = []
    links: list[DataFrame] = []
    for level in count():
        there = old_buckets.where(F.col("level") == level).drop("level")
        known = old_links.where(F.col("level") == level).select("child", "parent")
        exists = not there.isEmpty()
        if level and exists:
            # members that have changed give their parents new sums
            sums = _summed(known, all_vectors, width)
            there = written(there.select("bucket", "born").join(sums, there["bucket"] == sums["parent"]).select("bucket", "born", "size", "total"), "resummed")
        if exists or not level:
            placed, now = assigned(new, there, level, most, threshold)
        else:
            made = gathered(all_vectors, level, most)
            placed = made.select("child", "parent")
            now = _summed(placed, all_vectors, width).join(made.groupBy("parent").agg(F.min("born").alias("born")), "parent").select(F.col("parent").alias("bucket"), "born", "size", "total")
            known = known.limit(0)
        now, placed = written(now, "buckets"), written(placed, "links")
        told = written(known.unionByName(placed), "links")
        buckets.append(now.select(F.lit(level).alias("level"), "bucket", "born", "size", "total"))
        links.append(told.select(F.lit(level).alias("level"), "child", "parent"))
        all_vectors = written(describe(now), "described")
        if now.count() <= most:
            break
        above = old_links.where(F.col("level") == level + 1).select("child")
        new = all_vectors.join(above.withColumnRenamed("child", "id"), "id", "left_anti")
    top = now.select(F.lit(level + 1).alias("level"), F.col("bucket").alias("child"), F.lit("root").alias("parent"))
    return Index(reduce(DataFrame.unionByName, buckets), reduce(DataFrame.unionByName, [*links, top]))
