"""Look-ups and all-to-all similarity against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinlake.operators import nearest, store


@pytest.mark.parametrize("block_rows", [7, 4_096])
def test_nearest_of_all_is_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (60, 5)).astype(float)
    v[10] = v[11] = v[12]
    found = nearest.nearest_of_all(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>"), 4, block_rows).collect()
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    distance = np.round(1 - unit @ unit.T, 6)
    for q in range(60):
        best = sorted((d, k) for k, d in enumerate(distance[q].tolist()) if k != q)[:4]
        assert [(r.distance, r.id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == best


def _nearest_by_hand(rows, k):
    """Each id's k nearest others from all comparisons."""
    kept: dict = {}
    for i, v in rows:
        if i is not None and v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v):
            kept[i] = min(kept.get(i, v), v)
    ids = sorted(kept)
    v = np.array([kept[i] for i in ids])
    size = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.where(size > 0, v / np.where(size > 0, size, 1), 0)
    distance = np.round(1 - u @ u.T, 6) + 0.0
    return {(i, j, d, r) for a, i in enumerate(ids) for r, (d, j) in enumerate(sorted((distance[a, b], j) for b, j in enumerate(ids) if b != a)[:k], 1)}


@pytest.mark.parametrize(("k", "block_rows"), [(3, 5), (6, 16), (2, 4_096)])
def test_nearest_of_all_with_copies_nulls_and_clusters(spark, k, block_rows):
    rng = np.random.default_rng(k)
    spots = rng.normal(size=(8, 4)) * 5
    rows = [(i, [float(x) for x in np.round(spots[i % 8] + rng.normal(size=4) * 0.1, 3)]) for i in range(90)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0]) for i in range(40)] + [(200, [0.0] * 4), (201, [0.0] * 4)]
    rows += [(7, [0.0, 0.0, 0.0, 9.0]), (8, rows[8][1]), (8, rows[8][1]), (None, [1.0] * 4), (300, None), (301, [1.0, None, 2.0, 3.0]), (302, [1.0, 2.0]), (303, []), (304, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").withColumns({"v": F.lit(1), "c": F.lit(1)}).repartition(3)
    found = {(r.query_id, r.id, round(r.distance, 6), r.rank) for r in nearest.nearest_of_all(df, k, block_rows).collect()}
    assert found == _nearest_by_hand(rows, k)
    assert nearest.nearest_of_all(df.where("false"), k).count() == nearest.nearest_of_all(df.where("id = 300"), k).count() == 0


def test_bounds_leave_out_blocks_of_other_clusters(spark):
    rng = np.random.default_rng(9)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    v = np.repeat(centres, 40, axis=0) + rng.normal(size=(640, 16)) * 0.02
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    own = nearest._learnt(v[::3].copy(), 16)
    apart = nearest._apart(v, own)
    radius = np.array([apart[apart.argmin(1) == c, c].max(initial=0) for c in range(len(own))])
    batch = pa.record_batch({"id": pa.array(range(640)), "v": pa.array(v.tolist()), "c": pa.array(apart.argmin(1), pa.int32()), "part": pa.array([0] * 640, pa.int32()), "bound": pa.array(np.sort(1 - v @ v.T, axis=1)[:, 5])})
    met = sum(b.num_rows for b in nearest._asked(own, radius, np.ones(len(own), int))([batch]))
    assert met < 640 * (len(own) - 1) / 3  # of the pairs of rows and other blocks


@pytest.mark.parametrize("block_rows", [9, 64, None])
def test_nearest_within_a_distance(spark, block_rows):
    rng = np.random.default_rng(4)
    rows = [(i, np.round(x, 2).tolist()) for i, x in enumerate(rng.normal(size=(150, 4)))] + [(500 + i, [0.5, 0.5, 0.0, 1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found = {(r.query_id, r.id, r.distance, r.rank) for r in nearest.nearest_of_all(df, 5, block_rows, within=0.05).collect()}
    assert found == {x for x in _nearest_by_hand(rows, 5) if x[2] <= 0.05} and found


def test_a_block_gives_only_what_is_within_the_bound():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(5_000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q, r = v[:600], v[600:]
    distance = np.round(1 - q @ r.T, 6)
    bound = np.sort(distance, axis=1)[:, 1]
    bound[::7] = np.nan
    queries = pa.table({"id": pa.array(range(600)), "v": pa.array(q.tolist()), "bound": pa.array(bound, mask=np.isnan(bound))})
    rows = pa.table({"id": pa.array(range(600, 5_000)), "v": pa.array(r.tolist())})
    found = nearest._block_nearest(4, pa.int64())((), queries, rows).to_pylist()
    best = {(a, int(b) + 600) for a in range(600) for b in np.argsort(distance[a], kind="stable")[:4] if not distance[a, b] > bound[a]}
    assert {(x["query_id"], x["id"]) for x in found} == best and len(found) == len(best)


def test_similarity_classes(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.02]), (5, [0.0, 2.0])]
    found = nearest.similarity_classes(spark.createDataFrame(rows, "id long, vector array<double>"), 3, 0.9).collect()
    assert {r.id: (r.cluster, r.links) for r in found} == {1: (1, 2), 2: (1, 2), 4: (1, 2), 3: (3, 1), 5: (3, 1)}


def test_metadata_and_pages_of_the_store(spark):
    kept = store.noted(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("b", None), ("c", "3")], "key string, value string"))
    assert sorted((r.key, str(r.value)) for r in kept.collect()) == [("a", "1"), ("b", "None"), ("c", "3")]
    owned = spark.createDataFrame([("x", "one"), ("y", "one"), ("x", "two"), ("z", "two")], "label string, dataset string")
    assert [r.label for r in store.orphaned_labels(owned, "one").collect()] == ["y"]
    nodes = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2), ("d", 0)], "id string, position int")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r")], "source_id string, target_id string, relationship_name string")
    near = store.nearest_to_seeds(nodes, edges, spark.createDataFrame([("c", 0), ("a", 1), ("b", 1)], "id string, hops int"), 2)
    assert sorted(r.id for r in near.nodes.collect()) == ["b", "c"] and [(r.source_id, r.target_id) for r in near.edges.collect()] == [("b", "c")]
    c = spark.createDataFrame([("a",), ("b",)], "collection string")
    assert store.pruned(c).count() == 0 and store.pruned(c, ["a"]).count() == 1
    assert store.with_reference(spark.createDataFrame([(1, ["d/x/r"]), (2, None)], "id int, source_refs array<string>"), "d/x/r").select(F.max("id")).first()[0] == 1
