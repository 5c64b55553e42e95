"""Expressions against plain Python."""

from __future__ import annotations

import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinlake.functions import ids, moments, text, vector, weights
from skeinlake.operators import chunking


def test_uuid5_is_pythons(spark):
    names = ["", "a", "Nation:été", "x" * 300]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in found} == {n: str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names}


def test_edge_id_has_no_separator(spark):
    row = spark.sql("select 'A b' s, 'is a' r, \"C'd\" t").select(ids.edge_id(F.col("s"), F.col("r"), F.col("t")).alias("u")).first()
    assert row.u == str(uuid.uuid5(uuid.NAMESPACE_OID, "a_bis_acd"))


def test_tokens_keep_duplicates_and_drop_stop_words(spark):
    row = spark.sql("select 'The Été, the çà x_1 été' t").select(text.tokens(F.col("t")).alias("a"), text.tokens(F.col("t"), text.STOP_WORDS).alias("b")).first()
    assert row.a == ["the", "été", "the", "çà", "x_1", "été"] and row.b == ["été", "çà", "x_1", "été"]


def test_roman_numbers(spark):
    rows = spark.createDataFrame([("XIV", 14), ("mcmxc", 1990), ("IIII", None), ("", None), ("abc", None)], "t string, v int").select("v", text.roman_value(F.col("t")).alias("r")).collect()
    assert all(r.v == r.r for r in rows)


def test_quotes_are_folded(spark):
    row = spark.sql("select 'He  said “Hi”' q, 'x he said \"hi\" y' t, ' ' b").select(text.quote_found(F.col("q"), F.col("t")).alias("a"), text.quote_found(F.col("b"), F.col("t")).alias("b")).first()
    assert row.a and not row.b


def test_cosine_of_empty_and_zero_is_zero(spark):
    row = spark.sql("select array(1d,0d) a, array(0d,0d) z, cast(array() as array<double>) e").select(vector.cosine(F.col("a"), F.col("z")).alias("x"), vector.cosine(F.col("a"), F.col("e")).alias("y"), vector.cosine(F.col("a"), F.col("a")).alias("w")).first()
    assert (row.x, row.y, row.w) == (0, 0, 1)


def test_penalty_is_weighed_before_feedback(spark):
    row = spark.range(1).select(weights.weighed_distance(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(1.0), 0.5).alias("p"), weights.weighed_distance(F.lit(1.0), F.lit(1.0), F.lit(1.0), 0.5).alias("q")).first()
    assert row.p == 9.75 and row.q == 0.5


def test_feedback_rounds_every_step(spark):
    row = spark.range(1).select(weights.feedback_step(F.lit(0.5), F.lit(5)).alias("w"), weights.importance_factor(F.lit(None).cast("double")).alias("i"), weights.personal_factor(F.lit(None).cast("double"), 0.3, True).alias("p")).first()
    assert (row.w, row.i, row.p) == (0.55, 1.0, 1.0)


def test_times_from_text_and_epochs(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("1704164645",), ("1704164645000",), ("1704164645000000",), ("nonsense",), (None,)], "v string").select(moments.parsed(F.col("v")).cast("string").alias("t")).collect()
    assert [r.t for r in rows] == ["2024-01-02 03:04:05"] * 4 + [None, None]


@pytest.mark.parametrize("sample", ["", " ", "A", "One. Two!  Three\nFour;five", "a\n\n\nb", "… x。y", "no end"])
def test_pieces_are_lossless(spark, sample):
    assert "".join(p for p, _ in chunking.words(sample)) == sample
    row = spark.createDataFrame([(sample,)], "t string").select(chunking.pieces(F.col("t")).alias("p")).first()
    assert row.p == [p for p, _ in chunking.words(sample)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!\n,é", max_size=80), st.integers(1, 9), st.booleans())
def test_chunks_join_to_their_text(sample, most, batch):
    found = list(chunking.paragraphs(sample, most, batch))
    assert "".join(c for c, _, _ in found) == sample
    assert all(n <= most for _, n, _ in found)


def test_rows_skip_blank_ones():
    assert list(chunking.rows("a: 1, b: 2\n\n\n\nc: 3", 3)) == [("a: 1", 3, "row_cut"), ("b: 2", 3, "row_end"), ("c: 3", 3, "row_end")]


def test_overlap_carries_the_tail_on():
    found = [c for c, _ in chunking.overlapping("One two. Three four. Five six. Seven eight.", 4, 0.5)]
    assert len(found) > 1 and all(w in " ".join(found) for w in re.findall(r"\w+", "One two Three four Five six Seven eight"))


def test_recursive_splits_keep_to_the_size():
    found = chunking.recursive("alpha beta gamma\n\ndelta epsilon " + "x" * 30, 12, 4)
    assert all(len(c) <= 12 for c in found) and any("delta" in c for c in found)
