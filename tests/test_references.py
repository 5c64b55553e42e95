"""Quotes, cascades, languages, retrieval in rounds and centroids against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skeinlake.operators import consolidation, language, references
from skeinlake.plans import loops


def fold(text):
    return re.sub(r"[\x00-\x1f\x7f ]+", " ", (text or "").translate(str.maketrans("‘’“”", "''\"\""))).strip(" ").lower()


PASSAGES, PHRASES = "passage long, text string", "text string"


@pytest.mark.parametrize("seed", range(3))
def test_phrases_are_found_wherever_they_are_part_of_a_text(spark, seed):
    rng = random.Random(seed)
    words = ["a", "ab", "ba", "aba", "b", "bb", "“c”", "c'", "C"]
    text = lambda n: rng.choice([" ", ""]) + rng.choice([" ", "\n\t", "  "]).join(rng.choices(words, k=n))
    passages = [(i, text(rng.randrange(0, 30))) for i in range(40)]
    passages += [(3, "second text of one id ab"), passages[5], (None, "a b"), (90, None), (91, ""), (92, "x" * 3_000 + " a " + "y" * 3_000)]
    phrases = [text(rng.randrange(1, 6)) for _ in range(60)] + [None, "", "  ", "nowhere to be found", "xx", "x a y", "A", "text of"]
    found = references.phrase_matches(spark.createDataFrame(passages, PASSAGES).withColumnRenamed("x", "x").selectExpr("*", "1 as phrase", "2 as word"), spark.createDataFrame([(p,) for p in phrases], PHRASES))
    want = {(i, fold(p)) for i, t in passages if i is not None for p in phrases if fold(p) and fold(p) in fold(t)}
    got = [(r.passage, r.phrase) for r in found.collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_phrases_of_no_rows(spark):
    some, none = spark.createDataFrame([(1, "a b c")], PASSAGES), spark.createDataFrame([], PASSAGES)
    asked = spark.createDataFrame([("b",), ("a b c",)], PHRASES)
    assert references.phrase_matches(none, asked).count() == 0 and references.phrase_matches(some, asked.where("false")).count() == 0
    assert references.phrase_matches(some, asked).count() == 2


def test_assertions_lie_in_spans_of_their_own_document(spark):
    spans = spark.createDataFrame([("d", 1, "The Sum is due."), ("d", 2, "Nothing here"), ("e", 1, "the sum is due"), (None, 1, "the sum"), ("d", 3, None)], "document string, span int, text string")
    told = spark.createDataFrame([("d", "x", "sum is"), ("d", "y", " "), ("d", "z", None), ("e", "w", "HERE"), ("d", "x", "sum  IS"), ("d", "v", "the sum is due."), (None, "n", "sum")], "document string, id string, quote string")
    assert sorted((r.document, r.span, r.id) for r in references.anchored(spans, told).collect()) == [("d", 1, "v"), ("d", 1, "x")]


def test_a_cascade_asks_each_step_only_for_what_is_left(spark):
    nodes = spark.createDataFrame([("n1", "Acme"), ("n2", "acme "), ("n3", "Borg"), ("n4", None), ("n5", "")], "id string, name string")
    passages = spark.createDataFrame([("p1", "He said that Borg owes the lot"), ("p2", "he said THAT borg owes nothing"), ("p3", "owes nothing at all, said he"), ("p4", None)], "passage string, text string")
    refs = spark.createDataFrame([("id", "n3"), ("name", "borg"), ("open", "ACME"), ("quote", "said that  Borg"), ("words", "nothing he said owes"), ("none", "quite other words"), ("null", None), ("blank", " "), (None, "borg"), ("name", "borg")], "reference string, text string")
    asked = []

    def seen(step):
        def find(rows):
            asked.append({r.reference for r in rows.collect()})
            return step.find(rows)

        return references.Step(step.strategy, find, step.confidence, step.single)

    steps = [seen(s) for s in (references.by_id(nodes), references.by_name(nodes), references.by_quote(passages), references.by_words(passages, 0.75))]
    told = {r.reference: (r.outcome, r.strategy, r.target, r.targets) for r in references.cascade(refs, steps).collect()}
    rest = ("unresolved", None, None, 0)
    assert told == {"id": ("resolved", "existing_id", "n3", 1), "name": ("resolved", "entity_name", "n3", 1), "open": ("ambiguous", "entity_name", None, 2), "quote": ("resolved", "quote", "p1", 2), "words": ("resolved", "lexical", "p2", 1), "none": rest, "null": rest, "blank": rest}
    assert asked[3] == {"words", "none", "null", "blank"} and asked[0] == set(told)
    assert references.cascade(refs.where("false"), steps[:2]).count() == 0
    assert references.cascade(refs, []).count() == 8


def test_shared_words_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices("abcdefghij", weights=range(1, 11), k=rng.randrange(1, 8)))
    passages, refs = [(i, text()) for i in range(60)], [(i, text()) for i in range(60)]
    for least in (0.3, 0.5, 1.0):
        found = references.by_words(spark.createDataFrame(passages, PASSAGES), least).find(spark.createDataFrame(refs, "reference long, text string"))
        want = {}
        for r, t in refs:
            w = set(t.split())
            shared = [(-len(w & set(p.split())), i) for i, p in passages if len(w & set(p.split())) >= math.ceil(least * len(w) - 1e-9)]
            if shared:
                want[r] = min(shared)[1]
        assert {r.reference: r.target for r in found.collect()} == want


def _cells(text):
    out = []
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        c = [ord(x) for x in f" {word} "]
        out += [((c[i] * 31 + c[i + 1]) * 31 + c[i + 2]) % language.CELLS for i in range(len(c) - 2)]
    return out


def test_languages_are_those_of_plain_profiles(spark):
    rng = random.Random(1)
    letters = {"en": "etaoinshr", "fr": "esaitnruléà", "el": "αιοεστην"}
    text = lambda lang: " ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 8))) for _ in range(rng.randrange(3, 12)))
    rows = [(text(lang), lang) for _ in range(40) for lang in letters] + [("no language", None)]
    train, rest = rows[:60], rows[60:] + [("", "en"), (None, "fr"), ("12 !!", "en"), ("a", "en"), ("x" * 40_000, "en"), ("𝒳𝒴𝒵𝒳𝒴", "fr")]
    frame = lambda rs: spark.createDataFrame(rs, "text string, lang string")
    model = language.fit(frame(train), frame(rows[60:]))
    counts = {lang: Counter(c for t, g in train if g == lang for c in _cells(t)) for lang in letters}
    log = lambda lang, c: math.floor(math.log((counts[lang][c] + 0.5) / (counts[lang].total() + 0.5 * language.CELLS)) * 1000 + 0.5)
    for r in language.detected(frame(rest).selectExpr("*", "1 as scores_", "'k' as confidence_"), model).collect():
        c = _cells(r.text)
        told = sorted((-sum(log(lang, x) for x in c), lang) for lang in letters)
        if len(c) < language.LEAST:
            assert (r.detected_lang, r.confidence, r.margin, r.requires_translation) == ("unknown", 0.0, 0, False)
            continue
        best = 1 / sum(math.exp((told[0][0] - s) / 1000 / model.temperature) for s, _ in told)
        assert (r.detected_lang, r.margin) == (told[0][1], told[1][0] - told[0][0]) and r.confidence == pytest.approx(best)
        assert r.requires_translation == (r.detected_lang != "en" and r.confidence >= 0.8)


def test_languages_without_any_label(spark):
    bare = spark.createDataFrame([("some text here", None)], "text string, lang string")
    model = language.fit(bare, bare)
    assert [r.detected_lang for r in language.detected(bare, model).collect()] == ["unknown"]
    assert language.detected(bare.where("false"), model).count() == 0


EDGES = "source_id string, target_id string, relationship_name string"


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_queries_ask_on_until_nothing_is_new(spark, rounds):
    rng = random.Random(rounds)
    edges = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice("rs")) for _ in range(25)})
    frame = spark.createDataFrame(edges + edges[:3] + [("n1", None, "r"), (None, "n2", "r")], EDGES)
    queries = [(f"q{i}", f"n{i}") for i in range(0, 30, 4)] + [("far", "nowhere"), (None, "n1"), ("q0", "n0")]
    found = {(r.query_id, r.source_id, r.target_id, r.relationship_name): r.round for r in loops.extended(spark.createDataFrame(queries, "query_id string, id string"), loops.at_nodes(frame), loops.ends_of_new, rounds).collect()}
    want = {}
    for q, n in queries:
        ask = {n}
        for k in range(rounds + 1) if q else ():
            new = {e for e in edges if {e[0], e[1]} & ask and (q, *e) not in want}
            want |= {(q, *e): k for e in new}
            ask = {x for e in new for x in e[:2]}
    assert found == want


def test_parts_of_a_query_are_merged(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r")], EDGES)
    parts = spark.createDataFrame([("q", 2, "b"), ("q", 1, "c"), ("q", None, "a"), ("z", 1, "none"), (None, 1, "a"), ("q", 2, "b")], "query_id string, part int, id string")
    found = sorted((r.query_id, r.source_id, r.target_id, r.part) for r in loops.decomposed(parts, loops.at_nodes(edges)).collect())
    assert found == [("q", "a", "b", 2), ("q", "b", "c", 1), ("q", "c", "d", 1)]
    assert loops.decomposed(parts.where("false"), loops.at_nodes(edges)).count() == 0


def folded_centroids(old, rows, k):
    """Slots by group of one pass over sorted rows; ``old`` as given back."""
    slots = {g: list(s) for g, s in old.items()}
    seen = {(g, i) for g, s in slots.items() for _, _, ids in s for i in ids}
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    for g, i, v in sorted(rows):
        s = slots.setdefault(g, [])
        if (g, i) in seen or s and len(s[0][0]) != len(v):
            continue
        seen.add((g, i))
        u = unit(np.array(v))
        if len(s) < k:
            s.append((u, 1, [i]))
            continue
        j = max(range(len(s)), key=lambda j: float(u @ s[j][0]))
        c, n, ids = s[j]
        s[j] = (unit((c * n + u) / (n + 1)), n + 1, ids + [i])
    return slots


def test_centroids_grow_over_runs_as_in_one_pass_a_run(spark):
    rng = np.random.default_rng(2)
    rows = [(str(g), int(i), rng.normal(size=3).tolist()) for g in range(4) for i in rng.permutation(30 if g else 400)]
    rows += [("1", 7, [9.0, 9.0, 9.0]), ("2", 90, [0.0, 0.0, 0.0]), ("2", 91, [1.0])]
    odd = [(None, 1, [1.0, 2.0, 3.0]), ("1", None, [1.0, 2.0, 3.0]), ("1", 99, None), ("1", 98, [1.0, None, 2.0]), ("1", 97, [1.0, float("nan"), 2.0]), ("1", 96, [float("inf"), 0.0, 0.0])]
    frame = lambda rs: spark.createDataFrame(rs, "group string, id long, vector array<double>").repartition(3)
    half = [r for r in rows if r[1] % 3]
    first = consolidation.extended_centroids(None, frame(half + odd).selectExpr("*", "1 as slot", "2 as n"), 3)
    again = consolidation.extended_centroids(first, frame(rows), 3)
    want = folded_centroids({}, half, 3)
    for found, told in ((first, want), (again, folded_centroids(want, rows, 3))):
        got = {(r.group, r.slot): r for r in found[0].collect()}
        ids = {}
        for r in found[1].collect():
            ids.setdefault((r.group, r.slot), []).append(r.id)
        assert len(got) == sum(map(len, told.values()))
        for g, slots in told.items():
            for j, (c, n, members) in enumerate(slots):
                assert got[g, j].n == n == len(members) and np.allclose(got[g, j].vector, c) and sorted(ids[g, j]) == sorted(members)
    assert consolidation.extended_centroids(None, frame(rows).where("false"), 3)[0].count() == 0
