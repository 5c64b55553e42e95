"""Operators on small graphs and logs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import consolidation, evaluation, graph, lexical, nearest, sessions, traversal
from skeinlake.plans import retrieval, router, stages
from skeinlake.sources import exports, files
from skeinlake.streaming import live


def made(spark, pairs, nodes=None):
    edges = spark.createDataFrame([(a, b, "r") for a, b in pairs], "source_id string, target_id string, relationship_name string")
    names = nodes if nodes is not None else sorted({x for p in pairs for x in p})
    return graph.Graph(spark.createDataFrame([(n, n, "t") for n in names], "id string, name string, type string"), edges)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


CONNECTED = [("d", "c"), ("c", "a"), ("c", "b"), ("a", "k"), ("b", "k"), ("a", "a")]


def test_metrics_of_a_connected_graph(spark):
    g = made(spark, CONNECTED)
    row = traversal.graph_metrics(g).first()
    assert (row.num_nodes, row.num_edges, row.mean_degree, row.density, row.num_components, row.num_selfloops) == (5, 6, 2.4, 0.3, 1, 1)
    assert traversal.path_metrics(g.edges).first() == (3, 1.6)
    assert traversal.clustering(g).agg(F.avg("coefficient")).first()[0] == 0


def test_components_keep_lone_nodes(spark):
    g = made(spark, [("a", "b"), ("b", "c"), ("x", "y")], ["a", "b", "c", "x", "y", "z"])
    assert values(traversal.components(g), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")]


def test_components_are_contracted_before_rounds_of_stars(spark, monkeypatch):
    monkeypatch.setattr(traversal, "_starred", None)  # never asked for: two contractions leave nothing
    monkeypatch.setattr(traversal, "HUB", 8)
    edges = [(f"p{i % 40}", f"s{i % 40 // 10}") for i in range(80)] + [(f"s{i}", f"n{i % 2}") for i in range(4)] + [("z", "z")]
    found = traversal.component_labels(spark.createDataFrame(edges, "u string, v string")).collect()
    want = {"z": "z"} | {f"s{i}": f"n{i % 2}" for i in range(4)} | {f"n{i}": f"n{i}" for i in range(2)} | {f"p{i}": f"n{i // 10 % 2}" for i in range(40)}
    assert {r.node: r.root for r in found} == want and len(found) == len(want)


def test_components_of_a_long_chain(spark):
    n = 60
    g = made(spark, [(f"{i:03}", f"{i + 1:03}") for i in range(n)])
    assert traversal.components(g).select("component").distinct().count() == 1


def test_filters_differ_in_their_edges(spark):
    g = made(spark, CONNECTED)
    ids = spark.createDataFrame([("a",), ("b",), ("zz",)], "id string")
    assert values(g.induced(ids).edges, "source_id", "target_id") == [("a", "a")]
    assert values(g.touching(ids).edges, "source_id", "target_id") == [("a", "a"), ("a", "k"), ("b", "k"), ("c", "a"), ("c", "b")]


def test_node_set_any_and_every(spark):
    g = made(spark, CONNECTED)
    assert values(g.node_set("t", ["a", "b", "missing"]).nodes, "id") == [("a",), ("b",), ("c",), ("k",)]
    assert values(g.node_set("t", ["a", "b"], True).nodes, "id") == [("a",), ("b",), ("c",), ("k",)]
    assert values(g.node_set("t", ["a", "d"], True).nodes, "id") == [("a",), ("c",), ("d",)]


def test_walks(spark):
    g = made(spark, CONNECTED)
    seed = spark.createDataFrame([("d",)], "id string")
    assert values(traversal.reached(g.edges, seed, 2), "id", "hops") == [("a", 2), ("b", 2), ("c", 1), ("d", 0)]
    assert values(traversal.shortest_path(g.edges, "d", "k"), "step", "id") == [(0, "d"), (1, "c"), (2, "a"), (3, "k")]
    assert traversal.shortest_path(g.edges, "k", "d").count() == 0
    assert values(traversal.shortest_path(g.edges, "d", "d"), "step", "id") == [(0, "d")]


def test_a_path_may_be_as_long_as_it_is(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "next") for i in range(19)], "source_id string, target_id string, relationship_name string")
    assert values(traversal.shortest_path(edges, "n00", "n19"), "step", "id") == [(i, f"n{i:02}") for i in range(20)]
    assert values(traversal.reached(edges, spark.createDataFrame([("n05",)], "id string"), 10, direction="forward"), "id", "hops") == [(f"n{5 + i:02}", i) for i in range(11)]


def test_pagerank_goes_on_until_it_stands(spark):
    pairs = [(f"n{k}", f"n{(k * k + 1) % 30}") for k in range(30)] + [("n1", "n0"), ("n2", "sink")] + [(f"n{k}", f"n{k + 1}") for k in range(29)]
    g = made(spark, pairs)
    names = sorted({x for p in pairs for x in p})
    to = {a: {y for x, y in pairs if x == a} for a in names}
    ranks = dict.fromkeys(names, 1 / len(names))
    for _ in range(300):
        spread = 0.5 + 0.5 * sum(r for a, r in ranks.items() if not to[a])
        ranks = {b: spread / len(names) + 0.5 * sum(ranks[a] / len(to[a]) for a in names if b in to[a]) for b in names}
    found = dict(values(traversal.pagerank(g, damping=0.5, tolerance=1e-9), "id", "rank"))
    assert sum(abs(found[a] - r) for a, r in ranks.items()) < 1e-8
    cut = dict(values(traversal.pagerank(g, 2, 0.5), "id", "rank"))
    assert sum(abs(cut[a] - r) for a, r in ranks.items()) > 1e-3


def test_pagerank_sums_to_one(spark):
    ranks = traversal.pagerank(made(spark, CONNECTED), 20)
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)
    assert ranks.orderBy(F.desc("rank")).first().id == "a" or ranks.orderBy(F.desc("rank")).first().id == "k"


def test_upserts_and_deletes(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, n int")
    assert values(graph.upserted(old, new, ["id"], "n"), "id", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert values(graph.inserted_if_new(old, new.where("n = 1"), ["id"]), "id", "v") == [(1, "a"), (2, "b"), (3, "e")]
    g = graph.deleted(made(spark, CONNECTED), spark.createDataFrame([("c",)], "id string"))
    assert values(g.edges, "source_id", "target_id") == [("a", "a"), ("a", "k"), ("b", "k")]


def test_supersession_compares_times_as_text(spark):
    rows = [("s", "x", "f", "2024-01-02", 0), ("s", "y", "f", "2024-01-10", 1), ("s", "z", "f", "2024-01-10", 0), ("s", "y", "f", "2023", 5), ("q", "x", "f", "1", 0)]
    e = spark.createDataFrame(rows, "source_id string, target_id string, relationship_name string, updated_at string, position int")
    assert values(graph.superseded(e, ["f"]), "source_id", "target_id", "position", "superseded") == [("q", "x", 0, False), ("s", "x", 0, True), ("s", "y", 1, False), ("s", "y", 5, False), ("s", "z", 0, True)]


def test_bm25_orders_and_fills_with_zeros(spark):
    d = spark.createDataFrame([("a", "alpha alpha alpha project"), ("b", "alpha project project project"), ("c", "beta gamma delta")], "id string, text string")
    q = spark.createDataFrame([(1, "project project")], "query_id int, text string")
    top = lexical.top_k(lexical.bm25(d, q), d, q, 3).orderBy("rank").collect()
    assert [r.id for r in top] == ["b", "a", "c"] and top[2].score == 0


def test_f1_of_empty_answers(spark):
    p = spark.createDataFrame([(1, "", ""), (2, "a b", "b c"), (3, "", "x")], "id int, answer string, golden string")
    assert values(lexical.token_f1(p), "id", "f1") == [(1, 1.0), (2, 0.5), (3, 0.0)]


def test_nearest_with_tags(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], ["a"]), (2, [1.0, 1.0], ["a", "b"]), (3, [0.0, 1.0], None)], "id int, vector array<double>, belongs_to_set array<string>")
    q = spark.createDataFrame([(9, [1.0, 0.1])], "query_id int, vector array<double>")
    assert [r.id for r in nearest.nearest(v, q, 2).orderBy("rank").collect()] == [1, 2]
    assert values(nearest.tagged(v, ["a", "b"], True), "id") == [(2,)] and values(nearest.tagged(v, ["a", "b"]), "id") == [(1,), (2,)]


def test_triplets_need_no_hits_to_rank(spark):
    g = made(spark, CONNECTED)
    nodes = spark.createDataFrame([(1, "k", 0.2, "A"), (1, "k", 0.9, "B")], "query_id int, id string, distance double, collection string")
    types = spark.createDataFrame([], "query_id int, edge_type string, distance double")
    top = retrieval.scored_triplets(g, nodes, types, 4).orderBy("rank").collect()
    assert [(r.source_id, r.target_id) for r in top] == [("a", "k"), ("b", "k"), ("a", "a"), ("c", "a")]
    assert top[0].score == pytest.approx(1.5 * 0.9 + 2 * 9.75) and top[2].score == pytest.approx(3 * 9.75)


def test_merged_lists_keep_a_reserve(spark):
    a = spark.createDataFrame([(i, i) for i in range(5)], "id int, rank int")
    b = spark.createDataFrame([(3, 0), (10, 1), (11, 2)], "id int, rank int")
    assert [r.id for r in retrieval.merged(a, b, 4, 1).orderBy("rank").collect()] == [3, 0, 1, 10]
    assert [r.id for r in retrieval.merged(a, b, 4).orderBy("rank").collect()] == [3, 0, 1, 2]


def test_router_rules_and_negation(spark):
    q = spark.createDataFrame([("summarize the report",), ("do not summarize",), ('"exact words"',), ("hello",), ("what happened between 1990 and 1995",)], "text string")
    found = {r.text: r.search_type for r in router.routed(q).collect()}
    assert list(found.values()) == ["GRAPH_SUMMARY_COMPLETION", "HYBRID_COMPLETION", "CHUNKS_LEXICAL", "HYBRID_COMPLETION", "TEMPORAL"]


def test_router_runner_up(spark):
    q = spark.createDataFrame([("hello",), ("import this",), ("explain the timeline of the summary",), ("summarize",), (None,)], "text string")
    found = {r.text: (r.search_type, r.confidence, r.runner_up, r.runner_up_score) for r in router.routed(q).collect()}
    default = "HYBRID_COMPLETION"
    assert found["hello"] == found[None] == (default, 2.0, default, 0.0)
    assert found["import this"] == (default, 1.0, "CODING_RULES", 1.0)
    assert found["explain the timeline of the summary"] == ("GRAPH_SUMMARY_COMPLETION", 5.0, "GRAPH_COMPLETION_COT", 4.0)
    assert found["summarize"] == ("GRAPH_SUMMARY_COMPLETION", 5.0, default, 0.0)


def test_consolidation(spark):
    e = spark.createDataFrame([("1", "Acme Inc.", "org", 5), ("2", "acme inc", "org", 3), ("3", "ACME-INC", "person", 1), ("4", "Other", "org", 1)], "id string, name string, type string, created_at int")
    placed = consolidation.clusters(e, consolidation.name_links(e))
    assert values(placed, "id", "cluster") == [("1", "1"), ("2", "1"), ("3", "3"), ("4", "4")]
    degree = spark.createDataFrame([("9", 1)], "id string, degree long")
    assert values(consolidation.canonical(e, placed, degree), "id", "canonical") == [("1", "2"), ("2", "2"), ("3", "3"), ("4", "4")]


def test_weighted_overlap_is_brute_force(spark):
    import itertools
    import math
    import random

    random.seed(3)
    sets = {i: {random.randint(0, 14) for _ in range(random.randint(1, 6))} for i in range(25)}
    idf = {n: math.log(len(sets) / sum(n in s for s in sets.values())) for n in range(15) if any(n in s for s in sets.values())}
    w = lambda s: sum(idf[n] for n in s)
    expected = {(a, b): w(sets[a] & sets[b]) / w(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2) if w(sets[a] | sets[b]) > 0}
    links = spark.createDataFrame([(i, n) for i, s in sets.items() for n in s], "item int, entity int")
    found = {(r.a, r.b): r.score for r in consolidation.weighted_overlap(links, "item", "entity", 0.3).collect()}
    assert found.keys() == {k for k, v in expected.items() if v >= 0.3} and all(found[k] == pytest.approx(expected[k]) for k in found)


def test_buckets_are_bounded(spark):
    items = spark.createDataFrame([("g", str(i), {f"e{i % 3}": 1.0}) for i in range(7)] + [("g", "z", {})], "group string, id string, entities map<string,double>")
    found = consolidation.buckets(items, 2, 0.5).groupBy("bucket").count().collect()
    assert max(r["count"] for r in found) <= 2 and sum(r["count"] for r in found) == 8


def test_feedback_counts_a_turn_once(spark):
    used = spark.createDataFrame([("e", "q1", 5, 1), ("e", "q1", 1, 2), ("e", "q2", 1, 3)], "element_id string, qa_id string, score int, position int")
    assert values(sessions.feedback_weights(used), "element_id", "weight", "n") == [("e", 0.495, 2)]


def test_budget_skips_what_does_not_fit(spark):
    rows = [("s", "a", "x", 6, 3.0), ("s", "b", "x", 6, 2.0), ("s", "c", "y", 4, 1.0), ("s", "d", "y", 1, 0.5)]
    e = spark.createDataFrame(rows, "key string, entry_id string, section string, size int, score double")
    assert sessions.under_budget(e, 10, 10).first().kept == ["a", "c"]


def test_chain_verdicts(spark):
    rows = spark.createDataFrame([("e", 1, "x"), ("e", 2, "y"), ("e", 4, "z")], "entity_id string, sequence int, v string").withColumn("checksum", sessions.checksum(["entity_id", "v"]))
    from pyspark.sql import Window

    linked = rows.withColumn("previous_checksum", F.lag("checksum").over(Window.partitionBy("entity_id").orderBy("sequence")))
    assert values(sessions.chain_checked(linked, ["entity_id", "v"]), "sequence", "verdict") == [(1, "ok"), (2, "ok"), (4, "gap")]


def test_spread_needs_two_runs(spark):
    s = spark.createDataFrame([("q", "1", 1.0), ("q", "2", 0.0), ("p", "1", 1.0), ("p", "1", None)], "question_type string, run string, score double")
    found = {r.question_type: (r.mean, r.run_std, r.runs) for r in evaluation.across_runs(s).collect()}
    assert found["p"] == (1.0, None, 1) and found["q"][0] == 0.5 and found[None][2] == 2


def test_delimiter_is_the_first_that_fits():
    assert files.delimiter(["a;b;c", "1;2;3"]) == ";" and files.delimiter(["abc", "def"]) == "," and files.delimiter(['A,A,"A,A"', "1,2,3"]) == ","


def test_csv_rows_are_numbered(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name\n1,x\n2,\n")
    assert values(files.csv_rows(spark, str(tmp_path / "t.csv")), "number", "text") == [(1, "Row 1:\nid: 1, name: x\n"), (2, "Row 2:\nid: 2, name: \n")]


def test_loader_by_kind(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello\nworld")
    assert files.load(spark, str(tmp_path / "a.md")).first().text == "hello\nworld"
    files.use_loader("log", lambda s, p: s.range(1).select(F.lit(p).alias("path"), F.lit("own").alias("text")))
    assert files.load(spark, "x.log", "log").first().text == "own"


def test_memories_of_foreign_exports(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"id":"1","memory":"likes tea","user_id":"u","created_at":"2024-01-02T00:00:00Z"}\n{"id":"2"}\n')
    row = files.memories(spark, str(tmp_path / "m.json"), "mem0").collect()
    assert len(row) == 1 and row[0].text == "likes tea" and str(row[0].created_at) == "2024-01-02 00:00:00"


def test_exports_escape(spark):
    n = spark.createDataFrame([("a&b", "x<y", "t")], "id string, name string, type string")
    e = spark.createDataFrame([("a&b", "a&b", "r")], "source_id string, target_id string, relationship_name string")
    assert any("a&amp;b" in r.value and "x&lt;y" in r.value for r in exports.graphml(n, e).collect())
    odd = spark.createDataFrame([("n", 'a\\"b\nc', "t")], "id string, name string, type string")
    label = exports.triples(odd, e, "http://x/").where("predicate = 'rdfs:label'").first().object
    assert label == '"a\\\\\\"b\\nc"'
    ticked = e.withColumn("relationship_name", F.lit("a`b"))
    assert "[:`a``b`]" in exports.merge_script(odd, ticked).where("part = 2").first().value
    with pytest.raises(ValueError):
        exports.matched(exports.triples(n, e, "http://x/"), [("?a", "rdf:type", "?b"), ("?c", "rdfs:label", "?d")])


def test_guarded_sql(spark):
    rows, more = stages.guarded_sql(spark, "select * from range(10)", 3)
    assert rows.count() == 3 and more
    for bad in ("create table t (a int)", "drop table t", "select 1; select 2", "insert into t values (1)"):
        with pytest.raises(Exception):  # noqa: B017
            stages.guarded_sql(spark, bad, 1)


def test_stages_chain(spark):
    tasks = [stages.task("double")(lambda d: d.withColumn("id", F.col("id") * 2)), stages.task("even")(lambda d: d.where("id % 4 = 0"))]
    assert stages.chained(spark.range(4), tasks).count() == 2
    found = stages.side_by_side(spark.range(4), tasks).collect()  # 0 to 3 doubled, and of 0 to 3 the one divisible by 4
    assert sorted((r.id, r["_task"]) for r in found) == [(0, "double"), (0, "even"), (2, "double"), (4, "double"), (6, "double")]
    with pytest.raises(KeyError):
        stages.search("unknown")


def _streamed(spark, tmp_path, rows, schema, plan, mode):
    source = tmp_path / "in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    query = plan(spark.readStream.schema(schema).parquet(str(source))).writeStream.outputMode(mode).format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(query.name)


def test_streamed_feedback_is_the_batch_result(spark, tmp_path):
    schema = "element_id string, qa_id string, score int, position long"
    rows = [("e", f"q{i % 7}", i % 5 + 1, i) for i in range(20)] + [("f", "q1", 5, 1)]
    batch = sessions.feedback_weights(spark.createDataFrame(rows, schema))
    found = _streamed(spark, tmp_path, rows, schema, live.feedback, "update")
    assert values(found, "element_id", "weight") == values(batch, "element_id", "weight")


def test_streamed_usage(spark, tmp_path):
    schema = "user_id long, event_type string, value double"
    found = _streamed(spark, tmp_path, [(1, "a", 1.0), (1, "a", 2.0), (2, "b", 3.0)], schema, live.usage, "complete")
    assert values(found, "user_id", "calls", "total") == [(1, 2, 3.0), (2, 1, 3.0)]
