"""Vector search.

Queries are a stated set against all rows: blocks of rows meet blocks of queries, as one product of
matrices each, and only the best k of a query leave a block. Vectors and queries are brought to length one first, so a comparison is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skeinlake.functions.shared import written
from skeinlake.functions.vector import cosine, unit, unit_cosine
from skeinlake.operators.traversal import component_labels

#: Vectors of a block when every row is a query: at least, at most, and blocks of a table between.
BLOCK_LEAST, BLOCK_MOST, BLOCKS = 4_096, 65_536, 8
#: Queries and rows whose products are held at once there, and what single precision and six digits may hide of a distance.
QUERIES_TILE, ROWS_TILE, SLACK = 512, 4_096, 2e-5
#: Rows of a block that meets a block of queries (at most; at least, up to MEETINGS blocks), and queries of one.
ROWS_MOST, ROWS_LEAST, MEETINGS, QUERIES_MOST = 65_536, 2_048, 48, 8_192
#: Distances that a task holds at once, and pairs whose products it sums at once.
CELLS, SUMMED = 1 << 22, 1 << 15
#: Centres that blocks are grouped by, and the rows they are learnt from: both bound what is broadcast and collected.
CENTRES, SAMPLE_ROWS = 1_024, 20_000


def tagged(vectors: DataFrame, tags: Sequence[str], every: bool = False, column: str = "belongs_to_set") -> DataFrame:
    """Vectors with any (or every) of the tags."""
    wanted = F.array(*map(F.lit, tags))
    has = F.size(F.array_except(wanted, column)) == 0 if every else F.arrays_overlap(wanted, column)
    return vectors.where(F.coalesce(has, F.lit(False)))


def scored(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, distance for each query of a bounded set against all vectors."""
    rows = vectors.select("id", unit(F.col("vector")).alias("v"))
    asked = queries.select("query_id", unit(F.col("vector")).alias("q"))
    return rows.crossJoin(asked).select("query_id", "id", (1 - unit_cosine(F.col("v"), F.col("q"))).alias("distance"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int | None, skip_self: bool = False) -> DataFrame:
    """query_id, id, distance, rank (from 1) of the k nearest of each query; ties by id, rows without a distance last.

    Blocks of rows meet blocks of queries, a pair of blocks a task, and the best k of a query leave each of them.
    """
    found = scored(vectors, queries) if k is None else _best_of_blocks(vectors, queries, k, skip_self)
    if skip_self:
        found = found.where("query_id <> id")
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 6).asc_nulls_last(), "id")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _matrix(v: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows; those that are null, have another width or components that are null or not finite are zero, and marked."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    whole = pc.fill_null(pc.equal(pc.list_value_length(v), width), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(v), width))
    if whole.any():
        out[whole] = v.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
    bad = ~whole | ~np.isfinite(out).all(axis=1)
    out[bad] = 0
    return out, bad


def _id_order(ids: pa.Array) -> np.ndarray:
    """Positions in order of the ids, which are plain values or structs of them."""
    table = pa.Table.from_arrays(ids.flatten(), names=[f.name for f in ids.type]) if pa.types.is_struct(ids.type) else pa.table({"id": ids})
    return pc.sort_indices(table, sort_keys=[(n, "ascending") for n in table.column_names], null_placement="at_start").to_numpy()


def _block_best(k: int, skip_self: bool):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        asked, ids = queries.column("query_id").combine_chunks(), rows.column("id").combine_chunks()
        if rows.num_rows and queries.num_rows:
            order = _id_order(ids)
            rows, ids = rows.take(pa.array(order)), ids.take(pa.array(order))
            lengths = pc.list_value_length(pa.concat_arrays([rows.column("v").combine_chunks(), queries.column("q").combine_chunks()])).drop_null()
            width = max(lengths.value_counts().to_pylist(), key=lambda x: (x["counts"], x["values"]))["values"] if len(lengths) else 0
        found, kept = [], k + 1 if skip_self else k
        if rows.num_rows and queries.num_rows:
            (r, bad), (q, none) = _matrix(rows.column("v"), width), _matrix(queries.column("q"), width)
            step = max(1, CELLS // len(r))
            for start in range(0, len(q), step):
                own = q[start : start + step]
                distance = 1 - own @ r.T
                np.round(distance, 6, out=distance)
                distance[:, bad] = np.inf
                distance[none[start : start + step]] = np.inf
                if kept < len(r):
                    last = np.partition(distance, kept - 1, axis=1)[:, kept - 1 : kept]
                    less = distance < last
                    # rows are in order of their ids: of those at the last distance the first ones
                    row, col = np.nonzero(distance == last)
                    first = np.searchsorted(row, row, "left")
                    room = (kept - less.sum(axis=1))[row]
                    taken = np.arange(len(row)) - first < room
                    less[row[taken], col[taken]] = True
                    at, col = np.nonzero(less)
                else:
                    at, col = (x.reshape(-1) for x in np.indices(distance.shape))
                # the sum in order, as an expression over the arrays has it
                exact = np.empty(len(at))
                for i in range(0, len(at), SUMMED):
                    exact[i : i + SUMMED] = 1 - np.cumsum(own[at[i : i + SUMMED]] * r[col[i : i + SUMMED]], axis=1)[:, -1] if width else 1.0
                missing = np.isinf(distance[at, col])
                found.append((asked.take(pa.array(at + start)), ids.take(pa.array(col)), pa.array(exact, pa.float64(), mask=missing)))
        pick = lambda n, t: pa.chunked_array([x[n] for x in found], t)
        return pa.table({"query_id": pick(0, asked.type), "id": pick(1, ids.type), "distance": pick(2, pa.float64())})

    return run


def _best_of_blocks(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """query_id, id, distance: all that may be among the k nearest of a query."""
    rows = vectors.select("id", unit(F.col("vector")).alias("v"))
    asked = queries.select("query_id", unit(F.col("vector")).alias("q"))
    n, m = vectors.count(), queries.count()
    many = max(1 + n // ROWS_MOST, min(MEETINGS, 1 + n // ROWS_LEAST))
    by = 1 + m // QUERIES_MOST
    part = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    copies = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.withColumn("rb", part("id", many)).withColumn("qb", copies(by))
    right = asked.withColumn("b", part("query_id", by)).withColumn("a", copies(many))
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", vectors.schema["id"].dataType), StructField("distance", DoubleType())])
    return left.groupBy("rb", "qb").cogroup(right.groupBy("a", "b")).applyInArrow(_block_best(k, skip_self), schema)


def items(vectors: DataFrame, scaled: bool = True) -> DataFrame:
    """id, v: a vector for each id, at length one unless ``scaled`` is false.

    Rows without an id or a vector, with null or non-finite components, or of another length than
    most rows (of equally frequent lengths, the longer) are left out; an id with several vectors
    keeps the smallest.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("vector").cast("array<double>")
    good = vectors.where(F.col("id").isNotNull() & F.coalesce((F.size(v) > 0) & F.forall(v, finite), F.lit(False)))
    length = good.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).agg(F.max(F.struct("c", "n"))["n"]).first()[0]
    return good.where(F.size("vector") == (length or 0)).groupBy("id").agg(F.min(v).alias("_v")).select("id", (unit(F.col("_v")) if scaled else F.col("_v")).alias("v"))


def _side(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    return t.column("id").combine_chunks(), t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))


def _candidates(q: np.ndarray, r: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of a query and a row that are within the query's limit: single precision, so some more."""
    at, col = [], []
    least = (1 - limit - SLACK).astype(np.float32)[:, None]
    for start in range(0, len(r), ROWS_TILE):
        tile = r[start : start + ROWS_TILE]
        hit = np.flatnonzero(q @ tile.T >= least)
        at.append(hit // len(tile))
        col.append(hit % len(tile) + start)
    return np.concatenate(at), np.concatenate(col)


def _block_nearest(k: int, kind: pa.DataType, alone: bool = False):
    """The k nearest rows of each query within its bound, of equally near ones the first; ``alone`` compares a block with itself.

    Products in single precision tell which pairs can be within the bound, and only these are compared in full. A query
    without a bound takes the k-th distance among the block's first rows.
    """

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        (qi, q), (ri, r) = _side(queries), _side(rows)
        out: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        if len(qi) and len(ri):
            order = _id_order(ri)
            ri, r = ri.take(pa.array(order)), r[order]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            bound = queries.column("bound").combine_chunks().fill_null(np.inf).to_numpy(zero_copy_only=False)
            thin, light = r.astype(np.float32), q.astype(np.float32)
            for start in range(0, len(qi), QUERIES_TILE):
                stop = min(start + QUERIES_TILE, len(qi))
                limit, own = bound[start:stop].copy(), light[start:stop]
                wanted = k + 1 if alone else k
                if np.isinf(limit).any() and len(r) > wanted:
                    some = 1 - own @ thin[:ROWS_TILE].T
                    if some.shape[1] >= wanted:
                        limit = np.minimum(limit, np.partition(some, wanted - 1, axis=1)[:, wanted - 1] + SLACK)
                at, col = _candidates(own, thin, limit)
                if alone:
                    other = col != place[start + at]
                    at, col = at[other], col[other]
                exact = np.empty(len(at))
                for i in range(0, len(at), SUMMED):
                    exact[i : i + SUMMED] = np.einsum("ij,ij->i", q[start + at[i : i + SUMMED]], r[col[i : i + SUMMED]])
                distance = np.round(1 - exact, 6) + 0.0
                there = distance <= bound[start:stop][at]
                at, col, distance = at[there], col[there], distance[there]
                sort = np.lexsort((col, distance, at))
                at, col, distance = at[sort], col[sort], distance[sort]
                best = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
                out.append((qi.take(pa.array(at[best] + start)), ri.take(pa.array(col[best])), distance[best]))
        pick = lambda n, t: pa.chunked_array([x[n] if n < 2 else pa.array(x[n]) for x in out], t)
        return pa.table({"query_id": pick(0, kind), "id": pick(1, kind), "distance": pick(2, pa.float64())})

    return (lambda key, rows: run(rows, rows)) if alone else (lambda key, queries, rows: run(queries, rows))


def _learnt(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` centres of a sample, by a few rounds of assigning and averaging."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(5):
        nearest = (sample @ centres.T).argmax(1)
        for c in np.unique(nearest):
            mean = sample[nearest == c].mean(0)
            centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return np.unique(centres, axis=0)


def _apart(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to centres."""
    return np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (centres * centres).sum(1) - 2 * v @ centres.T))


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = _apart(_side(pa.Table.from_batches([batch]))[1], centres)
                yield pa.record_batch([*batch.columns, pa.array(apart.argmin(1), pa.int32()), pa.array(apart.min(1))], [*batch.schema.names, "c", "apart"])

    return run


def _asked(centres: np.ndarray, radius: np.ndarray, parts: np.ndarray):
    """Rows (id, v, c, part, bound) with each block (rc, rp) that may hold something within their bound, but their own."""
    slack = 2e-6  # distances are rounded to six digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                v = _side(pa.Table.from_batches([piece]))[1]
                gap = np.maximum(0, _apart(v, centres) - radius)
                bound = piece.column(4).fill_null(np.inf).to_numpy(zero_copy_only=False)
                # unit vectors: 1 - cosine is half the squared distance; a zero vector is 1 from all
                unit_row = (v * v).sum(1) > 0.5
                row, c = np.nonzero((gap * gap / 2 <= bound[:, None] + slack) | ~unit_row[:, None] | (radius < 0))
                many = parts[c]
                row, c, p = np.repeat(row, many), np.repeat(c, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                other = (c != piece.column(2).to_numpy()[row]) | (p != piece.column(3).to_numpy()[row])
                taken = piece.take(pa.array(row[other]))
                yield pa.record_batch([*taken.columns[:4], pa.array(c[other], pa.int32()), pa.array(p[other], pa.int32()), taken.columns[4]], ["id", "v", "c", "part", "rc", "rp", "bound"])

    return run


def _asked_blocks(centres: np.ndarray, radius: np.ndarray, parts: np.ndarray):
    """(qc, qp, mc, mp): the blocks that some row of a block asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _asked(centres, radius, parts)(batches):
            pairs = pa.Table.from_batches([batch]).select(["c", "part", "rc", "rp"])
            yield from pairs.group_by(pairs.column_names).aggregate([]).rename_columns(["qc", "qp", "mc", "mp"]).to_batches()

    return run


def nearest_of_all(vectors: DataFrame, k: int, block_rows: int | None = None, within: float | None = None) -> DataFrame:
    """query_id, id, distance (6 digits), rank of the k nearest others of every item (see ``items``); ties by id.

    Every item is a query, and the result is exact; ``within`` leaves out what is farther away. Equal vectors are compared
    once. The different ones are dealt to the nearest of up to CENTRES centres, learnt from SAMPLE_ROWS of them, and a
    centre's rows to blocks of about ``block_rows``. First each block is compared with itself; the
    k-th distance found is a bound for its rows. A row then meets only the blocks of centres whose
    rows may be within its bound: by the triangle inequality none is nearer than the distance to
    the centre less the centre's radius. Where that excludes nothing (vectors without clusters)
    all blocks are met, which is every comparison and, in rows shuffled, the vectors times the
    blocks; so blocks are large. A task holds two blocks; what is broadcast are the centres with their radii.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    known = items(vectors)
    # of equal vectors the first k + 1 ids are all that can be among anyone's k nearest
    firsts = known.withColumn("_k", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_k") <= k + 1)
    groups = written(firsts.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "groups")
    reps = groups.select(F.col("ids")[0].alias("id"), "v")
    n = reps.count()
    block_rows = block_rows or min(BLOCK_MOST, max(BLOCK_LEAST, 1 + n // BLOCKS))
    sample = np.array([r["v"] for r in reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()], np.float64)
    if not n:
        return reps.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
    centres = _learnt(sample, min(CENTRES, len(sample), 1 + n // block_rows))
    dealt = written(reps.mapInArrow(_assigned(centres), f"id {kind}, v array<double>, c int, apart double"), "dealt")
    parts, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for row in dealt.groupBy("c").agg(F.count("*").alias("n"), F.max("apart").alias("r")).collect():
        parts[row["c"]], radius[row["c"]] = 1 + (row["n"] - 1) // block_rows, row["r"]
    split = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("c") + 1)
    rows = dealt.withColumn("part", F.pmod(F.xxhash64("id"), split).cast("int")).select("id", "v", "c", "part")
    schema, most = f"query_id {kind}, id {kind}, distance double", F.lit(within).cast("double")
    own = written(rows.withColumn("bound", most).groupBy("c", "part").applyInArrow(_block_nearest(k, arrow, alone=True), schema), "own")
    bound = own.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))
    bounded = written(rows.join(bound, "id", "left").select("id", "v", "c", "part", F.coalesce("bound", most).alias("bound")), "bounded")
    asked = bounded.mapInArrow(_asked(centres, radius, parts), f"id {kind}, v array<double>, c int, part int, rc int, rp int, bound double")
    pairs = written(bounded.mapInArrow(_asked_blocks(centres, radius, parts), "qc int, qp int, mc int, mp int").distinct(), "pairs")
    met = pairs.join(rows.toDF("id", "v", "mc", "mp"), ["mc", "mp"]).select("id", "v", "qc", "qp", "mc", "mp")
    found = own.unionByName(asked.groupBy("c", "part", "rc", "rp").cogroup(met.groupBy("qc", "qp", "mc", "mp")).applyInArrow(_block_nearest(k, arrow), schema))
    best = lambda *by: Window.partitionBy(*by).orderBy("distance", "id")
    near = found.withColumn("_k", F.row_number().over(best("query_id"))).where(F.col("_k") <= k).select("query_id", F.col("id").alias("rep"), "distance")
    named = groups.select(F.col("ids")[0].alias("rep"), "ids", F.round(1 - F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("self"))
    others = near.join(named, "rep").select("query_id", "distance", F.explode("ids").alias("id"))
    lists = others.unionByName(named.select(F.col("rep").alias("query_id"), F.col("self").alias("distance"), F.explode("ids").alias("id")))
    lists = lists.withColumn("_k", F.row_number().over(best("query_id"))).where(F.col("_k") <= k + 1).groupBy(F.col("query_id").alias("rep")).agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    queries = known.join(groups.select("v", F.col("ids")[0].alias("rep")), "v").select(F.col("id").alias("query_id"), "rep")
    ranked = queries.join(lists, "rep").select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return ranked.select("query_id", F.posexplode("near").alias("at", "n")).select("query_id", "n.id", "n.distance", (F.col("at") + 1).alias("rank"))


def similarity_classes(vectors: DataFrame, k: int, least: float) -> DataFrame:
    """id, cluster (smallest id), links: classes of vectors joined by neighbours at ``least`` or more."""
    pairs = written(nearest_of_all(vectors, k, within=1 - least + 1e-6).where(F.round(1 - F.col("distance"), 6) >= least).select(F.col("query_id").alias("u"), F.col("id").alias("v")), "similar")
    roots = component_labels(pairs)
    links = pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct().select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    return vectors.select("id").join(roots, F.col("id") == F.col("node"), "left").join(links, "id", "left").select("id", F.coalesce("root", "id").alias("cluster"), F.coalesce("links", F.lit(0)).alias("links"))


def coordinates(vectors: DataFrame, basis: DataFrame) -> DataFrame:
    """id, coords: cosine to each basis vector (slot, vector) in order of slot; the basis is small by definition."""
    slots = basis.agg(F.array_sort(F.collect_list(F.struct("slot", "vector"))).alias("slots"))
    return vectors.crossJoin(F.broadcast(slots)).select("id", F.transform("slots", lambda s: cosine(F.col("vector"), s["vector"])).alias("coords"))
