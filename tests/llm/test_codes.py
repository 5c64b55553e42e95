"""Vector codes: the filtered search finds what comparing with every entry finds."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from skeinlake.llm import codes, queries

ROWS = "vec_id long, label int, embedding array<float>"


def recounted(rows):
    """vec_id, code, error, label_error in Python's integers, and the digest, comparing every part with every entry."""
    kept = [(i, la, [math.floor(256 * x) for x in v]) for i, la, v in rows if v and len(v) % 16 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    part = len(kept[0][2]) // 16
    cut = lambda v, p: v[p * part : (p + 1) * part]
    books = [[cut(v, p) for _, _, v in kept[:64]] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))
    for _ in range(2):
        for p, book in enumerate(books):
            own: dict[int, list] = {}
            for _, _, v in kept:
                own.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            for e, xs in own.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [(i, la, [near(cut(v, p), books[p]) for p in range(16)]) for i, la, v in kept]
    label: dict = {}
    for _, la, best in found:
        label[la] = label.get(la, 0) + sum(d for d, _ in best)
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted((i is None, i or 0, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label[la], digest) for i, la, best in found)


def told(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize(("n", "width", "scale"), [(200, 32, 1.0), (90, 16, 0.01), (20, 48, 3.0), (150, 16, 2.0**21)])
def test_against_all_comparisons(spark, n, width, scale):
    rng = np.random.default_rng(n)
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), [float(x) for x in (rng.normal(size=width) * scale).astype(np.float32)]) for i in rng.permutation(n)]
    rows += [(3, 1, rows[0][2]), (3, 1, rows[0][2]), (None, 1, rows[1][2])]
    assert told(codes.encoded(spark.createDataFrame(rows, ROWS).repartition(5))) == recounted(rows)


def test_filter_bounds_hold():
    rng = np.random.default_rng(1)
    entries, parts = rng.integers(-300, 300, (64, 4)), rng.integers(-300, 300, (500, 4))
    own = codes.Filter(entries)
    lower, upper = own.bounds(parts)
    exact = ((parts[:, None] - entries) ** 2).sum(2)
    assert (lower <= exact).all() and (exact <= upper).all()
    index, best = own.nearest(parts)
    assert (index == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert (lower <= upper.min(1)[:, None]).mean() < 0.5


def test_odd_vectors(spark):
    good = [(i, 1, [float(i % 5)] * 16) for i in range(70)]
    bad = [(100, 1, None), (101, 1, []), (102, 1, [1.0] * 15), (103, 1, [None] + [1.0] * 15), (104, 1, [float("nan")] * 16), (105, None, [float("inf")] * 16), (106, 1, [1.0] * 32)]
    df = spark.createDataFrame(bad + good, ROWS)
    assert told(codes.encoded(df.selectExpr("*", "1 as code", "2 as error", "3 as v"))) == recounted(good)
    assert codes.encoded(df.where("vec_id between 100 and 105")).count() == 0
    assert codes.encoded(df.where("false")).columns == codes.encoded(df).columns


def test_beyond_64_bits(spark):
    rows = [(i, i % 2, [float(i) * 1e30] * 16) for i in range(80)]
    found = {r.vec_id: r for r in codes.encoded(spark.createDataFrame(rows, ROWS)).collect()}
    assert found[0].error == 0 and found[63].error is None and found[0].label_error is None and len(found) == 80


def test_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 5 == 0 else i % 3, [float(x) for x in rng.normal(size=32).astype(np.float32)]) for i in range(130)] + [(900, 1, None)]
    spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = con.sql(queries.OP11_SQL)
    found = queries.op11_va_file_codes(spark, str(tmp_path))
    assert sorted(map(tuple, found.select(*sql.columns).collect())) == sorted(sql.fetchall())
