"""Ontologies, code snapshots and evidence against plain versions, and on odd rows."""

from __future__ import annotations

import difflib
import random
from collections import deque

from pyspark.sql import functions as F

from skeinlake.operators import codegraph, ontology
from skeinlake.plans import evidence
from skeinlake.sources import ontologies
from skeinlake.sources.ontologies import OWL, RDF, RDFS, SUBCLASS, TYPE

_FILE = f"""<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="{RDF}" xmlns:rdfs="{RDFS}" xmlns:owl="{OWL}"
    xmlns="http://x.org/v#" xml:base="http://x.org/v">
  <!-- no <owl:Class rdf:about="http://x.org/v#Ghost"/> -->
  <owl:Class rdf:about="http://x.org/v#Car"><rdfs:subClassOf rdf:resource="#Vehicle"/><rdfs:label xml:lang="en">Car &amp; van</rdfs:label></owl:Class>
  <owl:Class rdf:ID="Vehicle"/>
  <owl:ObjectProperty rdf:about="http://x.org/v#madeBy"/>
  <owl:NamedIndividual rdf:about="http://x.org/v#Audi A4" rdfs:comment="old">
    <rdf:type rdf:resource="http://x.org/v#Car"/><madeBy rdf:resource="http://x.org/v#VAG"/><madeBy rdf:resource="http://x.org/v#Audi"/>
    <rdfs:subClassOf><owl:Class rdf:about="http://x.org/v#Inner"><rdfs:subClassOf><owl:Class rdf:about="#Deep"/></rdfs:subClassOf></owl:Class></rdfs:subClassOf>
    <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x.org/v#madeBy"/></owl:Restriction></rdfs:subClassOf>
  </owl:NamedIndividual>
  <rdf:Description rdf:nodeID="n1"><madeBy rdf:nodeID="n2"/></rdf:Description>
</rdf:RDF>
"""


def _v(name):
    return f"http://x.org/v#{name}"


def test_rdf_xml(spark, tmp_path):
    (tmp_path / "a.owl").write_text(_FILE)
    rows = {tuple(r) for r in ontologies.rdf_xml(spark, str(tmp_path)).collect()}
    blank = {r[0] for r in rows if r[1] == f"{OWL}onProperty"}
    assert len(blank) == 1
    (blank,) = blank
    told = {
        (_v("Car"), TYPE, f"{OWL}Class"), (_v("Car"), SUBCLASS, _v("Vehicle")), (_v("Vehicle"), TYPE, f"{OWL}Class"), (_v("madeBy"), TYPE, f"{OWL}ObjectProperty"),
        (_v("Audi A4"), TYPE, f"{OWL}NamedIndividual"), (_v("Audi A4"), TYPE, _v("Car")), (_v("Audi A4"), _v("madeBy"), _v("VAG")), (_v("Audi A4"), _v("madeBy"), _v("Audi")),
        (_v("Audi A4"), SUBCLASS, _v("Inner")), (_v("Inner"), TYPE, f"{OWL}Class"), (_v("Inner"), SUBCLASS, _v("Deep")), (_v("Deep"), TYPE, f"{OWL}Class"),
        (_v("Audi A4"), SUBCLASS, blank), (blank, TYPE, f"{OWL}Restriction"), (blank, f"{OWL}onProperty", _v("madeBy")), ("_:n1", _v("madeBy"), "_:n2"),
    }
    assert rows == {(*t, False) for t in told} | {(_v("Car"), f"{RDFS}label", "Car & van", True), (_v("Audi A4"), f"{RDFS}comment", "old", True)}


def test_rdf_xml_without_elements(spark, tmp_path):
    (tmp_path / "a.owl").write_text(f'<rdf:RDF xmlns:rdf="{RDF}"/>')
    assert ontologies.rdf_xml(spark, str(tmp_path)).count() == 0


def test_n_triples(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<a> <p> <b> .\n_:x <p> _:y.z .\n<a> <q> "te\\"xt"@en . # said\n<a> <p> <b> .\n\n# nothing\n<a> <p> .\n<a> <q> "" .\n')
    rows = {tuple(r) for r in ontologies.n_triples(spark, str(tmp_path)).collect()}
    assert rows == {("a", "p", "b", False), ("_:x", "p", "_:y.z", False), ("a", "q", 'te\\"xt', True), ("a", "q", "", True)}


def test_close_is_difflib(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcd_") for _ in range(draw.randint(1, 14)))
    vocabulary = sorted({word() for _ in range(250)} | {"ab", "xyz"})
    words = sorted({word() for _ in range(120)} | {"axb", "a", "xz", "xy"} | {v[:3] + v[4:] for v in vocabulary[::5]} | {v[:2] + "c" + v[2:] for v in vocabulary[::7]} | {v[1:] for v in vocabulary[::9] if v[1:]})
    frame = lambda ws: spark.createDataFrame([(w,) for w in [*ws, None, ""]], "key string")
    found = {r["word"]: (r["key"], r["ratio"]) for r in ontology.close(frame(words), frame(vocabulary)).collect()}
    told = {}
    for w in words:
        best = difflib.get_close_matches(w, vocabulary, n=1, cutoff=0.8)
        if best:
            told[w] = (best[0], difflib.SequenceMatcher(None, best[0], w).ratio())
    assert found == told
    assert len(told) > 50
    assert ontology.close(frame([]), frame(vocabulary)).count() == 0


def _triples(spark, rows):
    return spark.createDataFrame([(*r, False) if len(r) == 3 else r for r in rows], "subject string, predicate string, object string, literal boolean")


def _walk(triples, start, individuals, directed):
    properties = {s for s, p, o in triples if p == TYPE and o == f"{OWL}ObjectProperty"}
    key = lambda u: u.split("#")[-1].lower().replace(" ", "_")
    hops, edges, queue = {start: 0}, set(), deque([start])
    while queue:
        at = queue.popleft()
        for s, p, o in triples:
            relation = "is_a" if p == SUBCLASS or p == TYPE and individuals else key(p) if p in properties else None
            for here, there in ((s, o), (o, s)):
                if relation and here == at and (here is s or relation != "is_a" and not directed):
                    edges.add((key(s), relation, key(o)))
                    if there not in hops:
                        hops[there] = hops[at] + 1
                        queue.append(there)
    return hops, edges


def test_attached_is_a_walk(spark):
    draw = random.Random(7)
    names = [f"u#N {i}" for i in range(30)]
    rows = {("u#likes", TYPE, f"{OWL}ObjectProperty"), ("u#knows", TYPE, f"{OWL}ObjectProperty")}
    rows |= {(n, TYPE, f"{OWL}Class") for n in names[:10]} | {(n, TYPE, draw.choice(names[:10])) for n in names[10:]}
    rows |= {(draw.choice(names[:10]), SUBCLASS, draw.choice(names[:10])) for _ in range(8)}
    rows |= {(draw.choice(names), draw.choice(["u#likes", "u#knows", "u#text"]), draw.choice(names)) for _ in range(20)}
    rows = sorted(rows)
    triples = _triples(spark, [*rows, *rows[:5], (names[20], "u#likes", names[0] + "x", True)])
    starts = spark.createDataFrame([(names[12],), (names[25],), (names[25],), (None,), ("u#nowhere",)], "uri string")
    for category, directed in (("individuals", True), ("individuals", False), ("classes", True)):
        found = ontology.attached(triples, starts, category, directed)
        nodes, edges = found.nodes.collect(), found.edges.collect()
        for start in (names[12], names[25], "u#nowhere"):
            hops, told = _walk(rows, start, category == "individuals", directed)
            assert {r["uri"]: r["hops"] for r in nodes if r["start"] == start} == hops
            assert sorted(tuple(r)[1:] for r in edges if r["start"] == start) == sorted(told)
    one = ontology.attached(triples, starts, apart=False)
    told = [_walk(rows, s, True, True) for s in (names[12], names[25], "u#nowhere")]
    assert {r["uri"] for r in one.nodes.collect()} == set().union(*(h for h, _ in told))
    assert sorted(tuple(r)[1:] for r in one.edges.collect()) == sorted(set().union(*(e for _, e in told)))


def test_lookup_and_matched(spark):
    triples = _triples(spark, [("u#Big Car", TYPE, f"{OWL}Class"), ("w#big car", TYPE, f"{OWL}Class"), ("v/audi/", TYPE, "u#Big Car"), ("z#other", TYPE, "q#nothing"), ("u#lit", TYPE, "u#Big Car", True)])
    found = ontology.lookup(triples)
    assert {tuple(r) for r in found.collect()} == {("classes", "big_car", "u#Big Car"), ("individuals", "audi", "v/audi/")}
    names = spark.createDataFrame([("Big car",), ("bigg car",), ("audi",), (None,), ("",), ("Big car",)], "name string")
    assert {tuple(r) for r in ontology.matched(names, found, "classes").collect()} == {("Big car", "big_car", "u#Big Car"), ("bigg car", "big_car", "u#Big Car")}
    assert {r["name"] for r in ontology.matched(names, found).collect()} == {"audi"}
    empty = _triples(spark, [])
    assert ontology.lookup(empty).count() == 0 and ontology.attached(empty, names.select(F.col("name").alias("uri")).limit(0)).nodes.count() == 0


def test_snapshot(spark, tmp_path):
    lines = ['{"kind": "symbol", "name": "p.A", "line": 3, "props": {"symbol_kind": "class"}}', '{"kind": "symbol", "name": "p.A", "line": 9, "repo": ""}', "", "  ", "{broken", "[1, 2]", '"text"', "null",
             '{"kind": "symbol", "name": "p.a", "line": true, "props": "no"}', '{"kind": "route", "name": 7}', '{"kind": "new", "name": "x"}', '{"kind": null, "name": "x"}', '{"kind": "insight", "name": "i", "repo": "other", "props": {"description": "d", "symbol_kind": "s"}}', '{"kind": "route", "name": ""}']
    (tmp_path / "facts.jsonl").write_text("\n".join(lines))
    facts, refused = codegraph.snapshot(spark, str(tmp_path), "here")
    assert refused.collect()[0]["lines"] == 4 and facts.count() == 8
    nodes = {(r["repo"], r["type"], r["name"], r["line"], r["symbol_kind"], r["description"]) for r in codegraph.mapped(facts).collect()}
    assert nodes == {("here", "CodeSymbol", "p.A", 3, "class", None), ("here", "CodeSymbol", "p.a", None, None, None), ("other", "CodeInsight", "i", None, None, "d"), ("here", "CodeRepository", "here", None, None, None), ("other", "CodeRepository", "other", None, None, None)}
    assert codegraph.mapped(facts).select("id").distinct().count() == 5
    assert {tuple(r) for r in codegraph.not_mapped(facts).collect()} == {("symbol", "repeated", 1), ("route", "no_name", 2), ("new", "unknown_kind", 1), (None, "unknown_kind", 1)}
    none = facts.limit(0)
    assert codegraph.mapped(none).count() == 0 and codegraph.not_mapped(none).count() == 0


def test_delta(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, repo string, name string, fact_hash string")
    edges = lambda rows: spark.createDataFrame(rows, "source_id string, target_id string, relationship_name string")
    before = frame([("a", "r", "A", "1"), ("b", "r", "B", "1"), ("c", "r", "C", None)])
    after = frame([("a", "r", "A", "1"), ("b", "r", "B", "2"), ("c", "r", "C", None), *((f"n{i:02}", "s", f"N{i:02}", "1") for i in range(25))])
    rows = {(r["repo"], r["change"]): (r["nodes"], r["edges"], r["samples"]) for r in codegraph.delta(before, after, edges([("a", "b", "x"), ("a", "b", "x"), ("z", "a", "x")]), edges([("a", "c", "x")])).collect()}
    assert rows == {("r", "updated"): (1, 0, ["B"]), ("s", "added"): (25, 0, [f"N{i:02}" for i in range(20)]), ("r", "added"): (0, 1, []), ("r", "removed"): (0, 1, [])}
    assert codegraph.delta(before, before, edges([]), edges([])).count() == 0


def test_impact_seeds_and_relations(spark):
    nodes = spark.createDataFrame(
        [("t", "r", "CodeSymbol", "struct", "pkg.Thing", "a/x.go", 1), ("new", "r", "CodeSymbol", "function", "pkg.NewThing", "b/y.go", 2), ("far", "q", "CodeSymbol", "function", "pkg.NewThing", "a/x.go", 3), ("m", "r", "CodeSymbol", "method", "m", None, None),
         ("f", "r", "CodeSymbol", "function", "pkg.F", "a/x.go", 5), ("u", "r", "CodeSymbol", "class", "Plain", "d/e/z.py", 6), ("nu", "r", "CodeSymbol", "function", "NewPlain", "d/e/w.py", 7), ("nv", "r", "CodeSymbol", "function", "NewPlain", "d/w.py", 8)],
        "id string, repo string, type string, symbol_kind string, name string, file string, line int")
    edges = spark.createDataFrame([("t", "m", "has_method"), ("t", "m", "has_method"), ("t", "gone", "has_method"), ("f", "m", "has_method"), ("t", "f", "calls"), ("t", "u", "calls"), (None, "m", "calls")], "source_id string, target_id string, relationship_name string")
    seeds = lambda *ids: {r["id"] for r in codegraph.impact_seeds(nodes, edges, spark.createDataFrame([(i,) for i in ids], "id string")).collect()}
    assert seeds("t") == {"t", "m", "new"} and seeds("f") == {"f"} and seeds("u", None, "missing") == {"u", "nu"} and seeds() == set()
    rows = [(r["id"], r["place"], r["relation"], r["target_id"]) for r in codegraph.relations(nodes, edges).orderBy("id", "place").collect()]
    assert rows == [("f", 0, "has_method", "m"), ("t", 0, "calls", "u"), ("t", 1, "calls", "f"), ("t", 2, "has_method", "m")]


def test_facts_for_entities(spark):
    hits = spark.createDataFrame([(1, "a", "one two", 0), (1, "b", "Document chunk mentions élan: a thing", 1), (1, "b", "again and again", 2), (1, "c", "c is here", 1), (1, "d", "d is here", 3), (1, None, "no id here", 0), (1, "e", None, 0), (2, "a", "two of them", 5), (2, "c", "two of those", 4)], "query_id int, id string, text string, rank int")
    shown = spark.createDataFrame([(1, "x", "d")], "query_id int, entity string, id string")
    rows = lambda df: sorted((r["query_id"], r["place"], r["id"], r["text"]) for r in df.collect())
    assert rows(evidence.facts_for_entities(hits, shown, 1, 2)) == [(1, 1, "b", "Élan: a thing"), (2, 1, "c", "two of those"), (2, 2, "a", "two of them")]
    scoped = spark.createDataFrame([(1, "c"), (2, "a")], "query_id int, id string")
    assert rows(evidence.facts_for_entities(hits, shown, 1, 2, scoped)) == [(1, 1, "c", "c is here"), (2, 1, "a", "two of them")]
    assert rows(evidence.facts_for_entities(hits, shown, 0, 0)) == [] and rows(evidence.facts_for_entities(hits.limit(0), shown, 3, 3)) == []


def test_context_evidence(spark):
    triplets = spark.createDataFrame([(1, 0, "b", "a", "r", "e1"), (1, 1, "a", "c", None, None), (1, 2, "b", "a", "r", "e1"), (1, 3, "c", None, "r", "e2"), (None, 0, "a", "b", "r", None), (2, 7, "a", "a", "s", None)], "query_id int, rank int, source_id string, target_id string, relationship_name string, edge_object_id string")
    nodes = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", " ")], "id string, name string")
    segments = spark.createDataFrame([("e1", "k2", 2), ("e1", "k1", 1), ("e1", "k1", 1), ("e9", "k3", 1), (None, "k4", 1)], "artifact_id string, chunk_id string, chunk_index int")
    told = [(r["query_id"], r["rank"], r["kind"], r["artifact_id"], r["label"]) for r in evidence.context_evidence(triplets, nodes, segments).orderBy("query_id", "rank").collect()]
    assert told[:6] == [(1, 0, "graph_node", "b", None), (1, 1, "graph_node", "a", "A"), (1, 2, "graph_node", "c", None), (1, 3, "graph_edge", "e1", None), (1, 4, "segment", "k1", None), (1, 5, "segment", "k2", None)]
    assert [t[:3] for t in told[6:]] == [(2, 0, "graph_node"), (2, 1, "graph_edge")]
    assert {tuple(r) for r in evidence.used_elements(triplets).collect()} == {(1, "node", "a"), (1, "node", "b"), (1, "node", "c"), (1, "edge", "e1"), (2, "node", "a")}
    assert evidence.context_evidence(triplets.limit(0), nodes).count() == 0
