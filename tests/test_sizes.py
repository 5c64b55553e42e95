"""What an operator makes on the way, counted: it may not outgrow its input."""

from __future__ import annotations

import difflib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skeinlake.operators import chunking, consolidation, graph, ingest, lexical, nearest, ontology, overlap, references, traversal
from skeinlake.plans import evidence
from skeinlake.sources import ontologies


def joined_rows(df) -> int:
    """Collects the frame; the most rows that any of its joins has made."""
    query = df._jdf.queryExecution()
    df._jdf.collectToPython()
    most, left = 0, [query.executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return most


class Taken:
    """Stands in for a frame and keeps the function that would run in its tasks."""

    def __init__(self, schema=None) -> None:
        self.schema, self.run = schema, None

    def select(self, *_):
        return self

    groupBy = select

    def mapInPandas(self, run, _):
        self.run = run

    applyInPandas = mapInPandas


def test_weighted_overlap_joins_whole_sets_only_of_close_pairs(spark):
    rng = random.Random(5)
    sets = {i: rng.sample(range(90), 30) for i in range(60)} | {60: list(range(30)), 61: list(range(1, 31))}
    links = spark.createDataFrame([(i, n) for i, s in sets.items() for n in s], "item int, entity int")
    df = consolidation.weighted_overlap(links, "item", "entity", 0.6)
    assert [(r.a, r.b) for r in df.collect()] == [(60, 61)]
    # some 1,900 pairs share something; their whole sets are 57,000 rows
    assert joined_rows(consolidation.weighted_overlap(links, "item", "entity", 0.6)) < 8_000


def test_clustering_makes_no_pairs_of_neighbours(spark):
    # 60 pages each link to the same 40 hubs, and two hubs to each other: 46,800 pairs of hubs at a page
    edges = [(f"p{i}", f"h{j}") for i in range(60) for j in range(40)] + [("h0", "h1")]
    frame = spark.createDataFrame([(*e, "r") for e in edges], "source_id string, target_id string, relationship_name string")
    df = traversal.clustering(graph.Graph(graph.ends(frame), frame))
    found = {r.id: r.coefficient for r in df.collect()}
    assert found["p3"] == pytest.approx(2 / (40 * 39)) and found["h0"] == pytest.approx(2 * 60 / (61 * 60)) and found["h2"] == 0
    assert joined_rows(traversal.clustering(graph.Graph(graph.ends(frame), frame))) <= 2 * len(edges)


def test_readable_is_not_shuffled(spark):
    rng = random.Random(2)
    grants = [(f"g{rng.randrange(6)}", rng.randrange(30)) for _ in range(60)] + [("u1", 99), (None, 5), ("g0", None)]
    membership = [(f"u{rng.randrange(40)}", f"g{rng.randrange(8)}") for _ in range(90)] + [("u1", None), ("u2", "g0"), (None, "g0")]
    df = ingest.readable(spark.createDataFrame(grants, "principal string, dataset long"), spark.createDataFrame(membership, "user string, principal string"))
    told = {(u, d) for u, p in membership + [(u, u) for u, _ in membership] for q, d in grants if p == q and p is not None}
    found = [tuple(r) for r in df.collect()]
    assert set(found) == told and len(found) == len(told)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(user#\d+L?, dataset#|keys=\[user#\d+L?, dataset#", plan)


def test_chunks_of_many_documents_leave_together(spark):
    docs = Taken(spark.createDataFrame([], "id long, text string").schema)
    chunking.row_chunks(docs, 9)
    frame = pd.DataFrame({"id": range(500), "text": ["name: a, brand: b"] * 499 + [None]})
    out = list(docs.run([frame]))
    assert len(out) == 1 and out[0]["id"].nunique() == 499 and list(out[0].columns) == ["id", "chunk_index", "text", "chunk_size", "cut_type"]


def _buckets(weight, most, least):
    """The definition: every item left is scored for every place."""
    total = {k: sum(v.values()) for k, v in weight.items()}
    left, out, number = sorted((k for k in weight if total[k] > 0), key=lambda k: (-total[k], k)), {}, 0
    while left:
        grown, taken = dict(weight[left[0]]), [left.pop(0)]
        while left and len(taken) < most:
            score = lambda k: sum(w for e, w in weight[k].items() if e in grown) / max(1e-12, sum({**grown, **weight[k]}.values()))  # noqa: B023, E731
            best = min(left, key=lambda k: (-round(score(k), 9), k))
            if score(best) < least:
                break
            left.remove(best)
            taken.append(best)
            grown |= weight[best]
        out |= dict.fromkeys(taken, number)
        number += 1
    return out | {k: number + i // most for i, k in enumerate(sorted(k for k in weight if total[k] <= 0))}


@pytest.mark.parametrize("least", [0.0, 0.05, 0.3])
@pytest.mark.parametrize("own", [False, True])
def test_buckets_are_as_defined(least, own):
    rng = random.Random(7)
    for _ in range(20):
        idf = {f"e{i}": rng.choice([0.0, 0.5, 1.0, 1.7]) for i in range(12)}
        weight = {str(i): {e: rng.choice([0.5, 1.0]) if own else idf[e] for e in rng.sample(sorted(idf), rng.randrange(5))} for i in range(25)}
        items = Taken()
        consolidation.buckets(items, 4, least)
        out = items.run(pd.DataFrame({"group": "g", "id": list(weight), "entities": [list(w.items()) for w in weight.values()]}))
        assert dict(zip(out["id"], out["bucket"], strict=True)) == _buckets(weight, 4, least)


def test_buckets_look_only_at_items_that_share():
    looked = []

    class Entity(str):
        __slots__ = ()

        def __hash__(self):
            looked.append(1)
            return str.__hash__(self)

    items = Taken()
    consolidation.buckets(items, 5, 0.05)
    out = items.run(pd.DataFrame({"group": "g", "id": [f"i{k}" for k in range(600)], "entities": [[(Entity(f"e{k // 3}"), 1.0)] for k in range(600)]}))
    assert out["bucket"].nunique() == 200 and len(looked) < 600 * 30


@pytest.mark.parametrize("rounds", [0, 1, 7, None])
def test_pagerank_is_the_plain_power_method(spark, rounds):
    rng = random.Random(11)
    ids = [f"n{i}" for i in range(25)]
    edges = {(rng.choice(ids[:12]), rng.choice([*ids, "elsewhere"])) for _ in range(50)} | {("stranger", "n1")}
    frame = spark.createDataFrame([(a, b, r) for a, b in edges for r in "xy"], "source_id string, target_id string, relationship_name string")
    found = {r.id: r["rank"] for r in traversal.pagerank(graph.Graph(spark.createDataFrame([(i,) for i in ids], "id string"), frame), rounds, tolerance=1e-12).collect()}
    out = {i: [b for a, b in edges if a == i] for i in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(200 if rounds is None else rounds):
        base = (0.15 + 0.85 * sum(rank[i] for i in ids if not out[i])) / len(ids)
        rank = {i: base + 0.85 * sum(rank[a] / len(out[a]) for a in ids if i in out[a]) for i in ids}
    assert found == pytest.approx(rank, abs=1e-11)


def test_pagerank_writes_no_round_of_nodes_that_do_not_send(spark, monkeypatch):
    frame = spark.createDataFrame([("a", f"b{i}", "r") for i in range(200)] + [("b0", "a", "r")], "source_id string, target_id string, relationship_name string")
    sizes, put = [], traversal.written
    monkeypatch.setattr(traversal, "written", lambda df, name: (out := put(df, name), sizes.append(out.count()) if name == "ranks" else None)[0])
    traversal.pagerank(graph.Graph(graph.ends(frame), frame), 3)
    assert sizes == [2, 2, 2, 2]


def test_frequent_words_shuffle_texts_only(spark):
    docs = spark.createDataFrame([(1, "b a b c a d"), (1, "C c"), (2, None), (3, "x y"), (4, "..."), (None, "q")], "id long, text string")
    df = lexical.frequent_words(docs, 2, ())
    found = {(r.id, r.word, r.n, r["rank"]) for r in df.collect()}
    assert found == {(1, "c", 3, 1), (1, "b", 2, 2), (3, "x", 1, 1), (3, "y", 1, 2), (None, "q", 1, 1)}
    assert df._jdf.queryExecution().sparkPlan().toString().count("Window") == 0
    assert "word" not in "".join(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_quotes_meet_only_the_words_of_their_own_document(spark):
    # sixty documents that ask for as many starts of a word that all of them hold: 18,000 matches, 300 of them at home
    word = "".join(chr(97 + i % 26) for i in range(60))
    spans = spark.createDataFrame([(d, s, f"they say {word} {s}") for d in range(60) for s in range(5)] + [(None, 0, word)], "document int, span int, text string")
    told = spark.createDataFrame([(d, 0, f"y {word[: d + 1]}") for d in range(60)] + [(None, 0, "they say")], "document int, id int, quote string")
    assert sorted(tuple(r) for r in references.anchored(spans, told).collect()) == [(d, s, 0) for d in range(60) for s in range(5)]
    assert joined_rows(references.anchored(spans, told)) < 3_000


def test_words_with_one_letter_less_meet_no_similar_names(spark, monkeypatch):
    names = [f"{a} {b} {n}" for a in ("large ring", "small ring", "large rung") for b in ("standard", "economy") for n in range(12)]
    words = [n[: i % len(n)] + n[i % len(n) + 1 :] for i, n in enumerate(names)] + names[:3]
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    ratio = lambda k, w: difflib.SequenceMatcher(None, k, w).ratio()
    want = {w: max((ratio(k, w), k) for k in names)[::-1] for w in words}
    monkeypatch.setattr(ontology, "_closest", lambda *_: pytest.fail("no word is left for pairs of letters"))
    assert {r.word: (r.key, r.ratio) for r in ontology.close(frame(words), frame(names)).collect()} == want


def test_references_that_ask_the_same_are_asked_once(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"name {i % 2}") for i in range(40)], "id string, name string")
    refs = spark.createDataFrame([(f"r{i:02}", f"Name {i % 4}") for i in range(80)] + [("r00", "name 0"), ("two", "name 0"), ("two", "n7"), ("null", None)], "reference string, text string")
    seen = []

    def find(rows):
        seen.append({r.reference for r in rows.collect()})
        return references.by_name(nodes).find(rows)

    told = {r.reference: (r.outcome, r.targets) for r in references.cascade(refs, [references.by_id(nodes), references.Step("entity_name", find, 1.0, True)]).collect()}
    assert told == {f"r{i:02}": ("ambiguous", 20) if i % 4 < 2 else ("unresolved", 0) for i in range(80)} | {"two": ("resolved", 1), "null": ("unresolved", 0)}
    assert seen == [{"r00", "r01", "r02", "r03", "r04", "null"}]


@pytest.mark.parametrize("kind", ["int", "struct<a: string, b: int>"])
def test_nearest_by_blocks_is_all_pairs_ranked(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "ROWS_LEAST", 16)
    monkeypatch.setattr(nearest, "QUERIES_MOST", 8)
    monkeypatch.setattr(nearest, "CELLS", 64)
    rng = np.random.default_rng(4)
    v = [list(map(float, x)) for x in rng.integers(-1, 2, (90, 3))] + [None, [1.0, None, 0.0], [0.0, 0.0, 0.0], [0.5, float("nan"), 1.0]]
    name = (lambda i: i) if kind == "int" else (lambda i: (f"k{i % 7}", i))
    rows = spark.createDataFrame([(name(i), x) for i, x in enumerate(v)], f"id {kind}, vector array<double>")
    asked = spark.createDataFrame([(name(i), v[i]) for i in range(0, len(v), 4)] + [(name(1000), None)], f"query_id {kind}, vector array<double>")
    good = lambda x: x is not None and None not in x and np.isfinite(x).all()
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    for k, skip in ((5, False), (4, True), (200, False)):
        want = {}
        for q, x in [(i, v[i]) for i in range(0, len(v), 4)] + [(1000, None)]:
            far = [(round(1 - unit(x) @ unit(y), 6) + 0.0 if good(x) and good(y) else np.inf, name(i)) for i, y in enumerate(v) if not (skip and i == q)]
            want[name(q)] = [(i, d) for d, i in sorted(far)[:k]]
        got = {}
        for r in nearest.nearest(rows, asked, k, skip).orderBy("rank").collect():
            key = lambda x: tuple(x) if kind != "int" else x
            got.setdefault(key(r.query_id), []).append((key(r.id), np.inf if r.distance is None else round(r.distance, 6) + 0.0))
        assert got == want
    plan = nearest.nearest(rows, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_elements_of_a_file_and_triples_of_a_property_are_dealt_out(spark, tmp_path, monkeypatch):
    body = "".join(f'<rdf:Description rdf:about="#a{i}"><p rdf:resource="#b{i}"/></rdf:Description>' for i in range(9))
    (tmp_path / "one.xml").write_text(f'<rdf:RDF xmlns:rdf="{ontologies.RDF}" xmlns="x#" xml:base="y"><rdf:Description rdf:about="x#p"><rdf:type rdf:resource="{ontologies.OWL}ObjectProperty"/></rdf:Description>{body}</rdf:RDF>')
    plans, put = [], ontologies.written
    keep = lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(df, name))[1]
    for module in (ontologies, ontology):
        monkeypatch.setattr(module, "written", keep)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        told = ontology.attached(ontologies.rdf_xml(spark, str(tmp_path), ("rdf:Description",)), spark.createDataFrame([(f"y#a{i}",) for i in range(9)], "uri string"))
        assert {(r.source_id, r.relationship_name, r.target_id) for r in told.edges.collect()} == {(f"a{i}", "p", f"b{i}") for i in range(9)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = [x for plan in plans for x in re.findall(r"SortMergeJoin \[(\w+)#\d+L?(.*)", plan)]
    assert joined and not [x for x in joined if x[0] == "file" or x[0] == "predicate" and "_salt" not in x[1]]


def test_placing_writes_no_set_again(spark, monkeypatch):
    ids = [f"s{i:02}" for i in range(32)]
    rows = [(i, f"{i}/{k}", 1.0) for i in ids for k in range(6)]
    sizes, put = [], overlap.written
    monkeypatch.setattr(overlap, "written", lambda df, name: (out := put(df, name), sizes.append(out.count()) if name in ("sets", "placed", "best") else None)[0])
    found = overlap.placed(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(rows, "id string, entity string, weight double"), 4, 0.2, block=8)
    # four blocks: with all sets written after each it is 480 rows more
    assert sum(sizes) == 32 and found.sets.count() == len(rows) and {(r.id, r.bucket) for r in found.links.collect()} == {(i, f"0/{i}") for i in ids}


def test_walks_keep_no_set_of_steps(spark, monkeypatch):
    frame = spark.createDataFrame([("a", "b", r) for r in "xyz"] + [("c", "b", "x"), ("c", "d", "x")], "source_id string, target_id string, relationship_name string")
    plans, put = [], traversal.written
    monkeypatch.setattr(traversal, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(df, name))[1])
    found = traversal.reached(frame, spark.createDataFrame([("a",)], "id string"), 2)
    assert {(r.id, r.hops) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert len(plans) == 2 and not any(re.search(r"keys=\[a#\d+, b#\d+\]", plan) for plan in plans)


def test_evidence_of_a_query_is_brought_together_once(spark):
    triplets = spark.createDataFrame([(1, 0, "a", "b", "r"), (1, 1, "b", "c", "s"), (2, 0, "a", "b", "r")], "query_id int, rank int, source_id string, target_id string, relationship_name string")
    df = evidence.context_evidence(triplets, spark.createDataFrame([("a", "A")], "id string, name string"))
    assert [(r.query_id, r["rank"], r.kind, r.label) for r in df.orderBy("query_id", "rank").collect()] == [(1, 0, "graph_node", "A"), (1, 1, "graph_node", None), (1, 2, "graph_node", None), (1, 3, "graph_edge", None), (1, 4, "graph_edge", None), (2, 0, "graph_node", "A"), (2, 1, "graph_node", None), (2, 2, "graph_edge", None)]
    assert not re.search(r"hashpartitioning\(query_id#\d+, artifact_id#", df._jdf.queryExecution().executedPlan().toString())


def test_lookups_write_only_what_meets_an_anchor(spark, monkeypatch):
    passages = spark.createDataFrame([(f"p{i:02}", " ".join(f"w{i}x{k}" for k in range(200)) + (" the blue Ring rolls on" if i % 3 == 0 else " on rolls blue")) for i in range(12)] + [("p00", "other text"), (None, "the blue ring")], "passage string, text string")
    refs = spark.createDataFrame([("q", "E  blue ring ro"), ("w", "rolls blue sky on"), ("n", "nowhere at all, no")], "reference string, text string")
    sizes, put = {}, references.written
    monkeypatch.setattr(references, "written", lambda df, name: (out := put(df, name), sizes.update({name: sizes.get(name, 0) + out.count()}))[0])
    told = {r.reference: (r.strategy, r.target, r.targets) for r in references.cascade(refs, [references.by_quote(passages), references.by_words(passages)]).collect()}
    assert told == {"q": ("quote", "p00", 4), "w": ("lexical", "p00", 1), "n": (None, None, 0)}
    # the passages have some 2,400 words
    assert sum(sizes.values()) < 120


def test_links_go_to_their_neighbour_and_back_once(spark):
    rows = [(i % 7, i % 5) for i in range(60)] + [(None, 1), (3, None), (8, 1), (8, 1)]
    links = spark.createDataFrame(rows, "item int, entity long")
    df = consolidation.weighted_sets(links, "item", "entity")
    told, weight = {}, {r.entity: r.idf for r in consolidation.idf(links, "item", "entity").collect()}
    for i, e in rows:
        if e is not None:
            told.setdefault(i, {})[e] = weight[e]
    assert {r["item"]: r.entities for r in df.collect()} == told
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = consolidation.weighted_sets(links, "item", "entity")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # the third one counts the items
    assert plan.count("Exchange hashpartitioning(") == 3 and "Join" in plan and "SortMergeJoin" not in plan


def test_a_dataset_goes_to_all_users_before_the_next(spark, tmp_path):
    n = 300
    grants = spark.range(400).selectExpr("'g' as principal", "(id * 7919) % 1000003 as dataset")
    membership = spark.range(n).selectExpr("concat('u', id) as user", "'g' as principal")
    df = ingest.readable(grants, membership)
    rows = [r.dataset for r in df.collect()]
    assert len(rows) == 400 * n and sum(a != b for a, b in zip(rows, rows[1:], strict=False)) < 2 * 400
    df.write.parquet(str(tmp_path / "told"))
    assert sum(p.stat().st_size for p in (tmp_path / "told").glob("*.parquet")) < 400 * n / 5
