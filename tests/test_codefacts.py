"""Code facts: lookup, resolution, walks, locators."""

from __future__ import annotations

import pytest

from skeinlake.operators import codefacts, ingest


@pytest.fixture()
def facts(spark):
    rows = [("1", "pkg.Store", "class", "a/store.py", "r1", '{"lines": {"n": 3}}'), ("2", "pkg.Store.get", "method", "a/store.py", "r1", "{}"), ("3", "Restore", "function", "b/x.py", "r2", "broken"), ("4", "get", "function", "b/x.py", "r2", None)]
    return spark.createDataFrame(rows, "id string, name string, type string, file string, repo string, properties string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_facets(facts):
    assert ids(codefacts.matching(facts, name="STORE")) == ["1", "2", "3"]
    assert ids(codefacts.matching(facts, file="a/", kind="method")) == ["2"]
    assert ids(codefacts.matching(facts, properties={"lines.n": "3"})) == ["1"] and ids(codefacts.matching(facts, properties={"lines.n": None})) == ["1"]


def test_pages_know_what_follows(facts):
    page = codefacts.paged(facts, ["id"], 1, 2).collect()
    assert [r.id for r in page] == ["2", "3"] and all(r.total == 4 and r.has_more for r in page)


def test_best_tier_resolves(facts):
    assert [(r.id, r.candidates) for r in codefacts.resolved_name(facts, "store").collect()] == [("1", 1)]
    assert [(r.id, r.candidates) for r in codefacts.resolved_name(facts, "get").collect()] == [("4", 1)]


def test_walk_is_capped_and_filtered(spark, facts):
    edges = spark.createDataFrame([("1", "2", "has"), ("2", "3", "calls"), ("1", "4", "calls"), ("3", "1", "calls")], "source_id string, target_id string, relationship_name string")
    seed = spark.createDataFrame([("1",)], "id string")
    assert ids(codefacts.bounded_walk(facts, edges, seed, 5, 10)) == ["1", "2", "3", "4"]
    assert ids(codefacts.bounded_walk(facts, edges, seed, 5, 2)) == ["1", "2"]
    assert ids(codefacts.bounded_walk(facts, edges, seed, 2, 10, types=["function"])) == ["3", "4"]
    assert ids(codefacts.bounded_walk(facts, edges, seed, 1, 10, "backward", ["calls"])) == ["1", "3"]


def test_locators(spark):
    d = spark.createDataFrame([("d", "Intro\nSection 1 first\ntext\nsection 2\nrest"), ("e", "none"), ("f", "")], "id string, text string")
    found = sorted((r.id, r.number, r["from"], r["to"]) for r in codefacts.locator_spans(d, "section", 1000).collect())
    assert found == [("d", 1, 6, 27), ("d", 2, 27, 41)]


def test_findings_without_confidence_come_last(spark):
    rows = spark.createDataFrame([("a", None, "s", False), ("b", 0.9, "s", True), ("c", 0.5, "t", None)], "finding_id string, confidence double, source string, informational boolean")
    evidence = spark.createDataFrame([("b", "y"), ("b", "x")], "finding_id string, text string")
    assert [r.finding_id for r in codefacts.findings(rows, evidence).collect()] == ["b", "c", "a"]
    assert [r.finding_id for r in codefacts.findings(rows, evidence, 0.4, informational=False).collect()] == ["c"]


def test_references_resolve_in_order(spark):
    facts = spark.createDataFrame([("1", "f", "r"), ("2", "g", "r"), ("3", "g", "q"), ("4", "h", "r"), ("5", "h", "r")], "id string, name string, repo string")
    refs = spark.createDataFrame([(1, "1", "g", "r"), (2, "x", "f", "q"), (3, "x", "g", "q"), (4, "x", "h", "r"), (5, "x", "z", "r")], "ref_id int, target_id string, target_name string, repo string")
    assert sorted((r.ref_id, r.fact_id, r.told_by) for r in ingest.resolved(refs, facts).collect()) == [(1, "1", "id"), (2, "1", "name"), (3, "3", "repo"), (4, None, "ambiguous"), (5, None, "unknown")]
