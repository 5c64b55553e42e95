"""Clusters, curator batches and contradictions against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from skeinlake.operators import contradictions, distillation, evaluation
from skeinlake.operators.graph import Graph


def clustered(x, k, seed, rounds=50):
    """The same draws and steps over one array."""
    rng = np.random.default_rng(seed)
    centres = [x[int(rng.integers(len(x)))]]
    while len(centres) < min(k, len(x)):
        weight = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        draw = rng.random()
        at = int(np.searchsorted(np.cumsum(weight), draw * weight.sum(), "right")) if weight.sum() > 0 else int(draw * len(x))
        centres.append(x[min(at, len(x) - 1)])
    centres, label = np.array(centres), None
    for _ in range(rounds):
        new = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        centres = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
    return label


@pytest.mark.parametrize(("n", "k", "seed", "rounds"), [(150, 5, 0, 50), (90, 3, 7, 2), (12, 20, 1, 50)])
def test_kmeans_is_that_of_one_array(spark, n, k, seed, rounds):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 4)) + rng.integers(0, 4, (n, 1)) * 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)
    found, centres = evaluation.kmeans(rows, k, seed, rounds)
    assert [r.cluster for r in found.orderBy("id").collect()] == clustered(x, k, seed, rounds).tolist()
    assert len(centres) == min(k, n)


def test_kmeans_of_equal_odd_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [1.0]), (None, [1.0, 2.0])], "id long, vector array<double>")
    found, centres = evaluation.kmeans(rows, 2)
    assert {r.id: r.cluster for r in found.collect()} == {1: 0, 2: 0} and len(centres) == 2
    assert evaluation.kmeans(rows.where("false"), 2)[0].count() == 0


TURNS, ENTRIES = "session string, time string, position long, question string, answer string", "session string, time string, position long, id string, profile string, section string, content string"


def _session_log(spark):
    turns = [("long", f"{i:04}", i, f" q{i} \n x ", "a" * 3_000 if i == 7 else None) for i in range(100)]
    turns += [("s", "2", 1, "", " \t"), ("s", None, 2, "first", None), ("s", "2", 3, None, "yes"), (None, "1", 1, "nobody", "asked"), ("bare", "1", 1, "q", "a")]
    entries = [("s", "2", 1, "c1", "p", "x", "note " * 100), ("only", "1", 1, "c2", "p", "y", None), (None, "0", 1, "c3", "p", "z", "t"), ("long", "9", 1, "c4", "p", "z", "end")]
    return spark.createDataFrame(turns, TURNS).repartition(3), spark.createDataFrame(entries, ENTRIES)


def test_batches_of_a_timeline(spark):
    found = {(r.session, r.batch): r for r in distillation.curator_batches(*_session_log(spark)).collect()}
    assert [found["long", b].blocks for b in range(17)] == [6] * 16 + [5] and len([k for k in found if k[0] == "long"]) == 17
    blocks = [b for k in range(17) for b in found["long", k].text.split("\n\n")]
    assert blocks[0] == "User: q0 x\nAssistant: " and blocks[7] == "User: q7 x\nAssistant: " + "a" * 1_200 and blocks[-1] == "Candidate c4 [p/z]: end"
    assert found["s", 0].text == "User: first\nAssistant: \n\nUser: \nAssistant: yes\n\nCandidate c1 [p/x]: " + ("note " * 100)[:280]
    assert found["only", 0].text == "Candidate c2 [p/y]: " and found[None, 0].text == "Candidate c3 [p/z]: t\n\nUser: nobody\nAssistant: asked"


def test_how_sessions_end(spark):
    turns, entries = _session_log(spark)
    propose = lambda b: b.where("session is null or session <> 'only'").selectExpr("session", "concat('lesson ', batch % 2) as lesson")
    accept = lambda rows: rows.where("session is null or session <> 's'")
    told = {r.session: (r.status, r.documents) for r in distillation.distilled(turns, entries, propose, accept).collect()}
    assert told == {"long": ("completed", ["lesson 0", "lesson 1"]), "s": ("no_accepted_lessons", []), "only": ("no_proposed_lessons", []), None: ("completed", ["lesson 0"]), "bare": ("no_gated_entries", [])}
    assert distillation.distilled(turns.where("false"), entries.where("false"), propose, accept).count() == 0


@pytest.mark.parametrize(("per", "by"), [(2, ("source_id", "target_id")), (100, ("source_id", "target_id")), (3, ("source_id",))])
def test_every_pair_of_a_touched_fact_meets_once(spark, per, by):
    rng = np.random.default_rng(per)
    ids = [f"n{i}" for i in range(9)]
    edges = sorted({(ids[a], ids[b], r) for a, b, r in zip(rng.integers(0, 4, 60), rng.integers(0, 9, 60), rng.choice(["owns_it", "is", "contains"], 60), strict=True)})
    load = edges[::3]
    graph = Graph(spark.createDataFrame([(i, None if i == "n8" else "" if i == "n7" else i.upper()) for i in ids], "id string, name string"), spark.createDataFrame(edges + edges[:4] + [(None, "n1", "is"), ("n1", "n2", None)], "source_id string, target_id string, relationship_name string"))
    told = contradictions.facts(graph)
    known = [e for e in edges if e[2] != "contains" and not {e[0], e[1]} & {"n7", "n8"}]
    assert {(r.source_id, r.target_id, r.relationship_name): r.fact for r in told.collect()} == {e: f"{e[0].upper()} {e[2].replace('_', ' ')} {e[1].upper()}" for e in known}
    met = contradictions.batches(told, spark.createDataFrame(load, "source_id string, target_id string, relationship_name string"), by, per)
    assert all(len(r.touched) <= per and len(r.others) <= per for r in met.collect())
    every = lambda m: m.selectExpr("explode(touched) as first", "others").selectExpr("first", "explode(others) as second", "0.5 as confidence", "'r' as reason")
    found = contradictions.contradicting(met, every, 0.4).collect()
    text = {e: f"{e[0].upper()} {e[2].replace('_', ' ')} {e[1].upper()}" for e in known}
    ends = lambda e: {e[0]} if len(by) == 1 else {e[0], e[1]}
    want = set()
    for a in known:
        for b in known:
            if a in load and a != b and ends(a) & ends(b) and (a[0], a[1]) != (b[0], b[1]):
                x, y = sorted([a, b])
                want.add((x[0] if x[0] != y[0] else x[1], y[0] if x[0] != y[0] else y[1], text[x], text[y]))
    assert sorted((r.source_id, r.target_id, r.first_fact, r.second_fact) for r in found) == sorted(want)
    assert contradictions.contradicting(met, every, 0.6).count() == 0 and contradictions.batches(told.where("false"), graph.edges).count() == 0
