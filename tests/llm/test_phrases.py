"""Collocations: equal to counting in Python's integers and strings."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinlake.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = "doc_id long, text string, lang string"


def recounted(rows, least, top, percent=50):
    f, n = {}, Counter()
    for _, text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        most: dict[tuple, int] = {}
        for p, a in candidates.items():
            for k in (0, 1):
                if len(p) == 3:
                    most[p[k : k + 2]] = max(a, most.get(p[k : k + 2], 0))
        for p, a in candidates.items():
            if len(p) == 2 and 100 * most.get(p, -1) >= percent * a:
                continue
            score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made(seed, n=200):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "new", "york", "ÉT", "été", "日本", "x" * 40, "c++", "\x01", "\x85"] + [f"w{i}" for i in range(20)]
    gap = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", " ! "]
    text = lambda: "".join(w + rng.choice(gap) for w in rng.choices(words, [30 / (i + 1) for i in range(len(words))], k=rng.randint(0, 60)))
    rows = [(i, text(), rng.choice(["en", "en", "en", "fr", None, "und", ""])) for i in range(n)]
    return rows + [(900, None, "en"), (901, "", None), (902, " .,; ", "en"), (903, "solo", "xx"), *[rows[3]] * 12]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 3, 10_000), (2, 10, 7), (3, 1, 50), (4, 2, 1)])
def test_against_counting(spark, seed, least, top):
    rows = made(seed)
    df = spark.createDataFrame(rows, ROWS).withColumns({"word": F.lit("x"), "n": F.lit(1), "a": F.lit(1)}).repartition(4)
    assert sorted(map(tuple, phrases.collocations(df, least, top).collect())) == recounted(rows, least, top)


def test_blocks_ranges_and_slices_change_nothing(spark, monkeypatch):
    rows = made(5) + [(950, "a b c. " * 500, "en"), (951, "a b c " * 500, "en")]
    for name, value in (("BLOCK_WORDS", 50), ("BLOCK_TYPES", 9), ("SLICE_BYTES", 64), ("RANGE_KEYS", 40), ("RANGES", 5), ("SAMPLE_BLOCKS", 3), ("SAMPLE_STEP", 2)):
        monkeypatch.setattr(phrases, name, value)
    blocks = list(phrases._slices(("a b, " * 200 + "c" * 500 + " d. e").encode()))
    assert b"".join(blocks) == ("a b, " * 200 + "c" * 500 + " d. e").encode().translate(phrases._LOWER) and all(b.endswith(b"\n") for b in blocks[:-1]) and len(blocks) > 10
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, ROWS), 3, 100).collect())) == recounted(rows, 3, 100)


def test_radix_order_and_run_lengths():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (2_000, 6)).astype(np.uint8)
    keys[:1_500, :5] = 7
    found, n = phrases.run_lengths(keys, np.full(len(keys), 3))
    want = Counter(map(bytes, keys))
    assert [bytes(k) for k in found] == sorted(want) and list(n) == [3 * want[k] for k in sorted(want)]


def test_wide_numbers():
    ids = [np.array([1, 70_000, 1 << 33]), np.array([2, 5, 1 << 32]), np.array([0, 3, 9])]
    for width in (5, 6, 8):
        keys = phrases._packed(ids, width)
        assert keys.shape[1] % 2 == 0 and [int.from_bytes(bytes(k), "big") for k in keys] == [(a << 16 * width) + (b << 8 * width) + c for a, b, c in zip(*map(lambda x: x.tolist(), ids), strict=True)]


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], ROWS)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], ROWS)).collect() == []


def test_sql(spark, tmp_path):
    rows = made(7, 600)
    spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(queries.OP12_SQL)
    found = sorted(map(tuple, queries.op12_phrase_collocations(spark, str(tmp_path)).select(*sql.columns).collect()))
    assert found == sorted(sql.fetchall()) == recounted(rows, 10, 2_000)


def test_keys_of_a_block_are_made_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    n, types = 1 << 19, 20_000
    local = np.minimum(rng.zipf(1.3, n) + 1, types).astype(np.uint16)
    local[rng.random(n) < 0.1] = 0
    own = pa.array([[{"k": k, "id": k * 7} for k in range(2, types + 1)]], pa.list_(pa.struct([("k", pa.int32()), ("id", pa.int64())])))
    row = (pa.scalar(False), pa.scalar(local.tobytes(), pa.binary()), own[0], 3)
    tracemalloc.start()
    keys, counts = phrases._block_keys(*row)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 35_000_000
    monkeypatch.setattr(phrases, "PART_KEYS", 1 << 30)
    whole, n = phrases._block_keys(*row)
    assert (keys == whole).all() and (counts == n).all() and (np.diff(phrases._as_text(keys).argsort(kind="stable")) == 1).all()
