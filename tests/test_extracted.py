"""Capped links, extracted graphs, session pages and values that end, against plain versions."""

from __future__ import annotations

import datetime
import random

import pytest

from skeinlake.operators import consolidation, extracted, sessions
from skeinlake.operators.graph import Graph
from skeinlake.streaming import live

PAIRS = "group string, a long, b long, score double"
NODES, EDGES = "chunk string, id string, name string, type string", "chunk string, source_id string, target_id string, relationship_name string"


def in_one_pass(pairs, most):
    best = {}
    for g, a, b, s in pairs:
        if None not in (a, b, s) and a != b:
            key = (g, min(a, b), max(a, b))
            best[key] = max(s, best.get(key, s))
    count, kept = {}, set()
    for (g, a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0][1:])):
        if count.get((g, a), 0) < most and count.get((g, b), 0) < most:
            count[g, a], count[g, b] = count.get((g, a), 0) + 1, count.get((g, b), 0) + 1
            kept.add((g, a, b, s))
    return kept


@pytest.mark.parametrize(("most", "scores"), [(1, 5), (3, 40), (2, 1)])
def test_links_are_capped_as_in_one_pass(spark, most, scores):
    rng = random.Random(most)
    pairs = [(rng.choice(["x", "y", None]), rng.randrange(25), rng.randrange(25), float(rng.randrange(scores))) for _ in range(400)]
    pairs += [("x", 0, i, 50.0) for i in range(25)] + [("x", None, 1, 1.0), ("x", 1, 2, None), ("x", 3, 3, 9.0)]
    found = consolidation.capped_per_node(spark.createDataFrame(pairs, PAIRS).selectExpr("*", "1 as k", "2 as node"), most)
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == in_one_pass(pairs, most) and len(rows) == len(set(rows))


def test_links_of_no_pairs_and_along_a_chain(spark):
    none = spark.createDataFrame([], PAIRS)
    assert consolidation.capped_per_node(none, 2).count() == 0
    chain = [("x", i, i + 1, float(i)) for i in range(9)]
    assert {tuple(r) for r in consolidation.capped_per_node(spark.createDataFrame(chain, PAIRS), 1).collect()} == in_one_pass(chain, 1)


def _graphs(spark):
    nodes = [("c1", "1", "Acme", "org"), ("c1", "2", " ACME ", "org"), ("c1", "3", "bob", "man"), ("c2", "3", "bob", "man"), ("c2", "4", None, "x"), ("c1", "1", "Acme", "org"), (None, "9", "z", "t"), ("c1", None, "n", "t")]
    edges = [("c1", "1", "3", "pays"), ("c1", "2", "3", "pays"), ("c1", "1", "77", "knows"), ("c2", "3", "4", "is"), ("c1", "1", None, "is"), ("c2", "3", "4", "is")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame([("T2", "acme"), ("T1", "Acme"), ("T3", None), (None, "bob"), ("T4", "")], "id string, name string")


def test_names_meet_their_term(spark):
    told = extracted.canonical(*_graphs(spark))
    assert {(r.chunk, r.id, r.name, r.ontology_valid) for r in told.nodes.collect()} == {("c1", "T1", "Acme", True), ("c1", "3", "bob", False), ("c2", "3", "bob", False), ("c2", "4", None, False), (None, "9", "z", False)}
    assert sorted(tuple(r) for r in told.edges.collect()) == [("c1", "T1", "3", "pays"), ("c1", "T1", "77", "knows"), ("c2", "3", "4", "is")]
    strict = extracted.canonical(*_graphs(spark), strict=True)
    assert {(r.chunk, r.id) for r in strict.nodes.collect()} == {("c1", "T1")} and strict.edges.count() == 0
    counts = {r.chunk: tuple(r)[1:] for r in strict.counts.where("chunk is not null").collect()}
    assert counts == {"c1": (3, 1, 3, 3), "c2": (2, 2, 1, 1)}
    assert {tuple(r)[1:] for r in told.counts.where("chunk = 'c1'").collect()} == {(3, 0, 3, 0)}
    none = [df.where("false") for df in _graphs(spark)]
    assert extracted.canonical(*none).nodes.count() == 0 and extracted.canonical(*none, strict=True).counts.count() == 0


def test_graphs_of_chunks_come_together(spark):
    nodes, edges, _ = _graphs(spark)
    graph, owners = extracted.integrated(nodes, edges, spark.createDataFrame([("1", "3", "pays")], "source_id string, target_id string, relationship_name string"))
    assert {r.id for r in graph.nodes.collect()} == {"1", "2", "3", "4"}
    contains = {("c1", "1"), ("c1", "2"), ("c1", "3"), ("c2", "3"), ("c2", "4")}
    assert sorted(tuple(r) for r in graph.edges.collect()) == sorted([(c, i, "contains") for c, i in contains] + [("2", "3", "pays"), ("3", "4", "is")])
    assert owners.where("relationship_name <> 'contains'").count() == 3
    graph, owners = extracted.integrated(nodes.where("false"), edges, edges)
    assert graph.edges.count() == 0 and owners.count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_containers_give_way_to_what_they_hold(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(30)] + [f"b{i}" for i in range(14)]
    edges = {(rng.choice(ids), rng.choice(ids), rng.choice("rs")) for _ in range(60)} | {(f"b{i}", f"b{i + 1}", "r") for i in range(12)} | {("b12", "b0", "r"), ("n0", "b0", "r")}
    graph = Graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(sorted(edges) + [("n1", None, "r")], "source_id string, target_id string, relationship_name string"))

    def held(box, met):
        if box in met:
            return set()
        inner = {t for s, t, _ in edges if s == box}
        return {t for t in inner if t[0] != "b"} | {x for t in inner if t[0] == "b" for x in held(t, met | {box})}

    want = {(s, x, r) for s, t, r in edges if s[0] != "b" for x in (held(t, frozenset()) if t[0] == "b" else {t})}
    found = extracted.unwrapped(graph, graph.nodes.where("id like 'b%'"))
    assert sorted(tuple(r) for r in found.edges.collect()) == sorted(want) and found.nodes.count() == 30
    assert extracted.unwrapped(graph, graph.nodes.where("false")).edges.count() == len(edges)


def test_pages_of_sessions(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = spark.createDataFrame([("a", 1, 10, at(1), "running"), ("b", 2, 20, at(2), "failed"), ("c", 3, None, at(3), "running"), ("d", None, 10, None, "running"), ("e", 1, 20, at(2), "running")], "session_id string, user_id long, dataset_id long, last_activity_at timestamp, effective_status string")
    owners, sets = spark.createDataFrame([(1,), (1,), (None,)], "user_id long"), spark.createDataFrame([(10,)], "dataset_id long")
    ids = lambda df: [r.session_id for r in df.collect()]
    assert ids(sessions.listed(rows)) == ["c", "b", "e", "a", "d"]
    assert ids(sessions.listed(rows, owners)) == ["e", "a"] and ids(sessions.listed(rows, owners, sets)) == ["e", "a", "d"]
    page = sessions.listed(rows, None, None, None, "running", "last_activity_at", False, 1, 2).collect()
    assert [(r.session_id, r.total, r.has_more) for r in page] == [("e", 4, True), ("c", 4, True)]
    assert sessions.listed(rows.where("false"), owners, sets).count() == 0


def test_values_end_with_the_watermark(spark, tmp_path):
    schema = "key string, value string, ttl long, time timestamp"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    batches = [
        [("a", "1", 5_000, at(0)), ("a", "2", 60_000, at(1)), ("b", "x", 2_000, at(0)), ("c", "stays", None, at(0)), (None, "n", 1, at(0))],
        [("d", "later", None, at(30))],
        [("a", "3", 10_000, at(35)), ("d", "older", None, at(31))],
        [("e", "end", None, at(100))],
        [("e", "end", None, at(101))],
    ]
    source = tmp_path / "in"
    spark.createDataFrame([], schema).write.parquet(str(source))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        run = live.values(spark.readStream.schema(schema).parquet(str(source)), "time", "0 seconds").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        run.awaitTermination(120)
    ms = lambda s: int((at(s) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    found = spark.read.parquet(str(tmp_path / "out"))
    ended = {(r.key, r.value, r.ends_at) for r in found.where("expired").collect()}
    assert ended == {("b", "x", ms(2)), ("a", "3", ms(45))}
    assert {(r.key, r.value) for r in found.where("not expired").collect()} == {("a", "2"), ("b", "x"), ("c", "stays"), ("d", "later"), ("a", "3"), ("d", "older"), ("e", "end")}


def test_a_chunk_is_brought_together_once(spark):
    nodes, edges, ontology = _graphs(spark)
    had = spark.createDataFrame([("T1", "3", "pays")], "source_id string, target_id string, relationship_name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = extracted.canonical(nodes, edges, ontology)
        dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")
        assert dealt(told.edges) == 1 and dealt(told.nodes) == 1 and dealt(told.counts) == 1
        graph, owners = extracted.integrated_chunks(told.chunks, had)
        assert dealt(owners) == 1 and dealt(graph.edges) <= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    again, _ = extracted.integrated(told.nodes, told.edges, had)
    rows = sorted(tuple(r) for r in graph.edges.collect())
    assert rows == sorted(tuple(r) for r in again.edges.collect()) == [("3", "4", "is"), ("c1", "3", "contains"), ("c1", "T1", "contains"), ("c2", "3", "contains"), ("c2", "4", "contains")]
