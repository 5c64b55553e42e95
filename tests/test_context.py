"""The hierarchy of buckets equals a plain fold over the items, one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from skeinlake.operators import context

VECTORS = "id long, vector array<double>"


def made(n, seed, spots=6, width=5):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(spots, width))
    v = np.round(at[rng.integers(0, spots, n)] + rng.normal(size=(n, width)) * 0.5, 3)
    return [(int(i), v[i].tolist()) for i in range(n)]


def units(rows):
    return {str(i): np.asarray(v) / max(np.linalg.norm(v), 1e-300) for i, v in rows}


def mean_apart(v, members, unit):
    return round(float(1 - v @ sum(unit[m] for m in members) / len(members)), 9)


def folded(unit, order, buckets, level, most, threshold):
    """buckets: name -> members, in order of birth; returns the links of ``order``."""
    links = {}
    for key in order:
        options = [(m, len(own), k, name) for k, (name, own) in enumerate(buckets.items()) if len(own) < most and (m := mean_apart(unit[key], own, unit)) <= threshold]
        name = min(options)[3] if options else f"{level}/{key}"
        buckets.setdefault(name, []).append(key)
        links[key] = name
    return links


def gathered(unit, level, most):
    left, links = sorted(unit), {}
    while left:
        seed = left.pop(0)
        near = sorted(left, key=lambda k: (round(float(1 - unit[seed] @ unit[k]), 9), k))[: most - 1]
        left = [k for k in left if k not in near]
        links |= {k: f"{level}/{seed}" for k in (seed, *near)}
    return links


def hierarchy(rows, most, threshold):
    unit, out = units(rows), []
    links = folded(unit, sorted(unit), {}, 0, most, threshold)
    level = 0
    while True:
        out += [(level, c, p) for c, p in links.items()]
        names = sorted(set(links.values()))
        sums = {b: sum(unit[c] for c, p in links.items() if p == b) for b in names}
        unit = {b: s / max(np.linalg.norm(s), 1e-300) for b, s in sums.items()}
        if len(names) <= most:
            return sorted(out + [(level + 1, b, "root") for b in names])
        level += 1
        links = gathered(unit, level, most)


@pytest.mark.parametrize(("n", "most", "threshold", "block", "kept"), [(48, 4, 0.3, 16, 2), (60, 10, 0.8, 2_048, 3), (12, 6, 2.0, 4, 1)])
def test_placing_is_the_fold(spark, n, most, threshold, block, kept):
    rows = made(n, n + most)
    vectors = context.usable(spark.createDataFrame(rows, VECTORS).repartition(3))
    none = spark.createDataFrame([], context._BUCKET)
    links, buckets = context.assigned(vectors, none, 0, most, threshold, block, kept)
    unit = units(rows)
    want: dict = {}
    told = folded(unit, sorted(unit), want, 0, most, threshold)
    assert {r.child: r.parent for r in links.collect()} == told
    assert {r.bucket: r.size for r in buckets.collect()} == {b: len(m) for b, m in want.items()}
    # more items go on from there
    more = [(i + 1_000, v) for i, v in made(30, 77)]
    links, _ = context.assigned(context.usable(spark.createDataFrame(more, VECTORS)), buckets, 0, most, threshold, block, kept)
    unit |= units(more)
    assert {r.child: r.parent for r in links.collect()} == folded(unit, sorted(units(more)), want, 0, most, threshold)


@pytest.mark.parametrize(("most", "seeds"), [(3, 5), (7, 256)])
def test_gathering_is_the_fold(spark, most, seeds):
    rows = made(70, 5)
    vectors = context.usable(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert {r.child: r.parent for r in context.gathered(vectors, 2, most, seeds).collect()} == gathered(units(rows), 2, most)


def test_levels_end_in_one_root(spark):
    rows = made(80, 11)
    index = context.build(spark.createDataFrame(rows, VECTORS), 3, 0.2)
    assert sorted(map(tuple, index.links.select("level", "child", "parent").collect())) == hierarchy(rows, 3, 0.2)
    top = index.links.agg({"level": "max"}).first()[0]
    assert top >= 3 and index.links.where(f"level = {top}").select("parent").distinct().collect()[0].parent == "root"


def test_growing_keeps_what_is_placed(spark):
    rows, more = made(40, 3), [(i + 500, v) for i, v in made(12, 4)]
    first = context.build(spark.createDataFrame(rows, VECTORS), 4, 0.3)
    both = context.build(spark.createDataFrame(rows + more, VECTORS), 4, 0.3, first)
    old = {(r.level, r.child): r.parent for r in first.links.collect() if r.level == 0}
    new = {(r.level, r.child): r.parent for r in both.links.collect()}
    assert old.items() <= new.items() and len([1 for level, _ in new if level == 0]) == 52
    levels = {level for level, _ in new}
    for level in levels - {max(levels)}:  # each bucket hangs from one bucket of the next level
        assert {p for (x, _), p in new.items() if x == level} == {c for x, c in new if x == level + 1}
    sizes = {r.bucket: r.size for r in both.buckets.collect()}
    assert all(sizes[b] == sum(p == b for p in new.values()) <= 4 for b in sizes)


def test_empty_and_odd(spark):
    none = spark.createDataFrame([], VECTORS)
    assert context.build(none, 3, 0.2).links.count() == 0
    odd = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (None, [1.0, 1.0]), (4, [1.0])], VECTORS)
    assert sorted(map(tuple, context.build(odd, 3, 0.2).links.collect())) == [(0, "2", "0/2"), (0, "3", "0/3"), (1, "0/2", "root"), (1, "0/3", "root")]


def test_candidates_of_a_large_block_are_scored_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    v, total, size = rng.normal(size=(70, 6)), rng.normal(size=(50, 6)), rng.integers(1, 5, 50)
    batch = pa.record_batch({"bucket": pa.array([f"b{i}" for i in range(50)]), "born": pa.array(range(50), pa.int64()), "size": pa.array(size, pa.int32()), "total": pa.array(total.tolist())})
    monkeypatch.setattr(context, "SCORED", 16)
    pieces = list(context._candidates([{"n": i, "v": x.tolist()} for i, x in enumerate(v)], 4, 0.9, 3)([batch]))
    assert len(pieces) == 5
    mean = np.round(1 - v @ (total / size[:, None]).T, 9)
    want = [(i, f"b{j}") for i in range(70) for _, _, j in sorted((mean[i, j], size[j], j) for j in range(50) if size[j] < 4 and mean[i, j] <= 0.9)[:3]]
    assert [(r["n"], r["bucket"]) for p in pieces for r in p.to_pylist()] == want
