"""Training-data operators: brute force, round trips, held-out accuracy, and defined odd cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from skeinlake.llm import bestfit, decontaminate, htmltext, linerules, ngram, pii, quality, queries, simhash, toxicity, urlfilter

SF = Path("/root/testdata/sf0.001")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, "same words here and more of them"), (3, "same words here and more of them"), (None, "no id at all"), (4, "x" * 300_000), (5, "word " * 30_000), (6, "\n\n \t"), (7, "ünï ​code 𝒳 line\none more.")]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns with names that operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, length string")


def empty(spark):
    return odd(spark).where("false")


def labels(spark, column):
    return spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- decontamination


def passages():
    random.seed(5)
    words = ["".join(random.choice("aeioulrstn") for _ in range(random.randint(2, 7))) for _ in range(400)]
    return words, [" ".join(random.choice(words) for _ in range(30)) for _ in range(8)]


def test_leaks_are_found_and_others_are_not(spark):
    words, items = passages()
    random.seed(6)
    fill = lambda n: " ".join(random.choice(words) for _ in range(n))
    docs = [(i, fill(40) + ". " + (items[i % 8] if i % 3 == 0 else fill(30)) + ". " + fill(25)) for i in range(60)]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i % 8) for i in range(0, 60, 3)}


ASKED = "A farmer called Anna has 12 crates of apples and gives 5 kg to her brother Paul before Anna walks home"


def leaked(spark, item, *docs):
    found = decontaminate.matches(spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id int, text string"))
    return {r.doc_id: r for r in found.collect()}


def test_other_numbers_and_names_are_the_same_question(spark):
    same = [
        "Well. A farmer called Berta has 40 crates of apples and gives 7 lbs to her brother Karl before Berta walks home now",
        "Well. A farmer called Mary Jane has twenty one crates of apples and gives seven to her brother Karl Heinz before Mary Jane walks home now",
    ]
    found = leaked(spark, ASKED, *same)
    assert found.keys() == {0, 1} and all(r.cover > 0.9 and r.n_slots >= 5 and r.n_changed >= 4 for r in found.values())


def test_one_value_stands_for_one_value(spark):
    item = "then Anna sees Anna and Paul greets Paul then Anna meets Paul at noon with Anna and Paul"
    assert leaked(spark, item, "x y. then Berta sees Berta and Karl greets Karl then Berta meets Karl at noon with Berta and Karl", "x y. then Berta sees Karl and Emil greets Dora then Hans meets Ida at noon with Lena and Otto").keys() == {0}


def test_a_verbatim_copy_is_a_leak_whatever_its_words_are(spark):
    numbers = " ".join(str(7 * k) for k in range(30))
    short = "Anna pays 3 euros"
    long = " ".join(f"word{k}" for k in range(59))
    assert leaked(spark, numbers, f"so {numbers} it is").keys() == {0}
    assert leaked(spark, short, f"we say that {short.lower()} in all", "nobody pays anything").keys() == {0}
    assert leaked(spark, long, "and " + " ".join(f"word{k}" for k in range(25)), "and " + " ".join(f"word{k}" for k in range(15))).keys() == {0}


def brute_leaks(docs, items):
    """Cover by template and word windows of every document by every item, without hashes, joins or bitmaps."""
    def tokens(text):
        t = decontaminate.Templates([text.encode()])
        words = [(w.encode().strip(decontaminate._STRIP) or w.encode()).decode().lower() for w in text.split()]
        return words, [(None if lit else kind, words[lo] if lit else int(v), int(lo), int(hi)) for lit, kind, v, lo, hi in zip(t.literal, t.token.tolist(), t.value, t.low, t.high, strict=True)]

    out = {}
    sides = [{k: tokens(v) for k, v in x.items()} for x in (docs, items)]
    for i, (iw, it) in sides[1].items():
        if len(iw) < decontaminate.MIN_ITEM:
            continue
        for d, (dw, dt) in sides[0].items():
            rows = []
            n = min(8, len(iw))
            for p in range(len(dw) - n + 1):
                rows += [(p, q, q, q + n, 0, False, [], []) for q in range(len(iw) - n + 1) if dw[p : p + n] == iw[q : q + n]]
            n = min(8, len(it))
            shape = lambda x: [k if k is not None else v for k, v, *_ in x]
            for q in range(len(it) - n + 1):
                mine = it[q : q + n]
                if 8 * sum(k is None for k, *_ in mine) < 4 * n:
                    continue
                for p in range(len(dt) - n + 1):
                    if shape(dt[p : p + n]) == shape(mine):
                        bits = sum((k is not None) << j for j, (k, *_) in enumerate(mine))
                        rows.append((p, q, mine[0][2], mine[-1][3], bits, True, [v for _, v, *_ in mine], [v for _, v, *_ in dt[p : p + n]]))
            if rows:
                cover, _, _, longest = decontaminate.judged(rows, len(iw))
                if cover >= 0.5 or longest >= 20:
                    out[d, i] = cover
    return out


def test_the_join_finds_what_comparing_all_finds(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["Anna", "Paul", "7", "nine", "kg", "walks", "to", "the", "house.", "with", "red", "apples", "and", "goes", "home", "Berlin"]) for _ in range(n))
    items = {k: say(rng.randint(3, 20)) for k in range(25)}
    docs = {k: say(rng.randint(0, 15)) + " " + (items[k % 25] if k % 2 else say(12)) + " " + say(rng.randint(0, 15)) for k in range(60)}
    found = decontaminate.matches(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id int, text string")).collect()
    expected = brute_leaks(docs, items)
    assert len(expected) > 20 and {(r.doc_id, r.item_id): round(r.cover, 9) for r in found} == {k: round(v, 9) for k, v in expected.items()}


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too few"), (None, "same words here and more of them"), (5, "same words here and more of them")], "item_id int, text string")
    found = decontaminate.matches(odd(spark), bench).collect()
    assert sorted((r.doc_id, str(r.item_id)) for r in found) == [(3, "5"), (3, "5"), (3, "None"), (3, "None")]
    assert decontaminate.matches(empty(spark), bench).count() == 0
    assert decontaminate.matches(odd(spark), bench.where("false")).count() == 0
    kept = decontaminate.without_leaks(odd(spark), bench)
    assert kept.count() == len(ODD) - 2 and kept.columns == odd(spark).columns


# ---------------------------------------------------------------- personal data


def brute_spans(t):
    out = {k: [] for k in pii.KINDS}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_base_spans_are_those_of_the_patterns():
    random.seed(1)
    for _ in range(20_000):
        t = "".join(random.choice("a@.1-+ (2)9b@..55 ") for _ in range(random.randint(1, 40)))
        base, both = pii.all_spans(t)
        assert base == brute_spans(t)
        assert all(set(base[k]) <= set(both[k]) for k in pii.KINDS)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail john.doe [at] example (dot) com now", "email", "john.doe [at] example (dot) com"),
        ("mail jane at example.com", "email", "jane at example.com"),
        ("mail john @ example.com", "email", "john @ example.com"),
        ("john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("from 10 dot 0 dot 0 dot 1 on", "ip", "10 dot 0 dot 0 dot 1"),
        ("is one nine two dot one six eight dot one dot seven", "ip", "one nine two dot one six eight dot one dot seven"),
        ("plus 4 four 1 one 2 two 3 three 4 four", "phone", "plus 4 four 1 one 2 two 3 three 4 four"),
        ("write to bob at example dot org please", "email", "bob at example dot org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("jo​hn@example.com", "email", "jo​hn@example.com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("４２４２４２４２４２４２４２４２", "card", "４２４２４２４２４２４２４２４２"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    found = [text[a:b] for a, b in pii.all_spans(text)[1][kind]]
    assert source in found
    assert source not in pii.redacted(text)


@pytest.mark.parametrize("text", ["look at example.com today", "we met at noon at. the dot com", "one of the two, or three", "look at this point here"])
def test_prose_is_left_alone(text):
    assert pii.redacted(text) == text


def test_long_runs_are_linear():
    for t in ("a" * 400_000, "1" * 400_000, "a." * 200_000, "a@" * 100_000, "at " * 100_000, "a dot " * 60_000, "1 dot 1 x " * 40_000, " \t" * 200_000, "1 1 " * 100_000):
        pii.all_spans(t)


def test_pii_of_odd_rows(spark):
    rows = pii.find(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id in (1, 2))
    out = pii.redact(odd(spark))
    assert out.columns == odd(spark).columns and out.where("text is null").count() == 1 and pii.find(empty(spark)).count() == 0


# ---------------------------------------------------------------- line rules


def test_repeated_words_are_brute_force():
    random.seed(2)
    docs = [[random.choice([b"a", b"b"]) for _ in range(random.randint(0, 60))] for _ in range(200)]
    for ws, n in zip(docs, linerules.repeated_words(docs), strict=True):
        at = collections.defaultdict(list)
        for i in range(len(ws) - 7):
            at[tuple(ws[i : i + 8])].append(i)
        assert n == len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)})


def test_counts_are_those_of_the_contract(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in linerules.judge(documents(spark)).collect():
        t = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_navigation_goes_and_prose_stays():
    page = b"Home | News | Sport | Weather\nThis is a sentence that goes on for some words and then ends.\nAll rights reserved. Terms of use apply.\nAnother sentence follows the first one here.\nMenu\nLogin\nHelp"
    text, before, after, removed = linerules.cleaned(page)
    assert text.count(b"\n") == 1 and removed == 5 and after < before


def test_line_rules_of_odd_rows(spark):
    rows = linerules.judge(odd(spark)).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows)
    assert linerules.judge(empty(spark)).count() == 0 and linerules.clean_texts(odd(spark)).count() == 0


# ---------------------------------------------------------------- html


def test_article_is_all_that_stays():
    html = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies and so on, a long notice that could look like text if nobody knew better.</div>
    <article><header><h1>The&nbsp;title</h1></header><p>First <b>bold</b>
      words &amp; more.<p>Second &lt;one&gt;<br>here<div class="ad">buy</div><ul><li>a<li>b</ul></article>
    <section id="comments"><p>I disagree with all of this, says a reader at some length, and goes on and on about it.</p></section><footer>&copy; x</footer></body></html>"""
    assert htmltext.main_text(html) == "The title\nFirst bold words & more.\nSecond <one> here\na\nb"


def test_without_an_article_the_distribution_decides():
    menu = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(20))
    body = "".join(f"<p>{'Some words of a paragraph. ' * 6}{i}</p>" for i in range(4))
    found = htmltext.main_text(f"<body>{menu}{body}{menu}</body>")
    assert found.count("\n") == 3 and "Link" not in found


def test_the_distribution_trims_an_article_and_keeps_what_lies_between():
    links = "<ul>" + "".join(f"<li><a href={k}>Entry {k}</a>" for k in range(4)) + "</ul>"
    text = f"<article>{links}<h1><a href=/>Title</a></h1><p class='share-price'>Prices rose.</p><p><a href=x>Most of this paragraph is one link</a> here</p><div class='ad-box'>Buy</div><p>End.</p>{links}</article>"
    assert htmltext.main_text(text) == "Title\nPrices rose.\nMost of this paragraph is one link here\nEnd."


def test_a_short_tail_of_the_same_container_stays():
    body = "".join(f"<p>{'Some words of a paragraph. ' * 6}{i}</p>" for i in range(3))
    advert = "".join(f"<div><a href={k}>Offer {k}</a></div>" for k in range(4))
    assert htmltext.main_text(f"<body><div>{body}{advert}<p>So it ends.</p></div></body>").endswith("\nSo it ends.")


def test_hostile_nesting_takes_linear_time():
    began = time.perf_counter()
    for n in (20_000,):
        for page in ("<b>" * n + "</i>" * n, "<b>" * n + "<div></div>" * n, "<li><b>" * n, "<i>" * n + "<b></i>" * n, "<p><b>" * n):
            htmltext.main_text(page)
    assert time.perf_counter() - began < 20


def test_surge_and_dive_are_brute_force(spark):
    for (html,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        lines = [x for x in htmltext.lines_of(html or "") if not x.beside]
        lines = [x for x in lines if x.inside] or lines
        w = [htmltext.weight(x) for x in lines]
        for surge in (0, 80, 400):
            kept, on = set(), False
            for k in range(len(w)):
                ahead = w[k] + (w[k + 1] if k + 1 < len(w) else 0) + (w[k + 2] if k + 2 < len(w) else 0)
                on = ahead > 0 and (on or ahead > surge)
                if on:
                    kept.add(k)
            found = {k for a, b in htmltext.surges(w, 3, surge) for k in range(a, b + 1)}
            assert found <= kept and {k for k in kept if w[k]} <= found


@pytest.mark.parametrize(("html", "text"), [("", ""), ("plain", "plain"), ("<p>short", "short"), ("<article><p>a", "a"), ("<script>x", ""), ("<!-- a", ""), ("<p>a<!-- <p>no</p> -->b</p>", "ab"), ("<div hidden>x</div><p>y</p>", "y")])
def test_broken_markup(html, text):
    assert htmltext.main_text(html) == text


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>ü</p>"), (2, "u", "<p>ü</p>")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in htmltext.extract(pages).collect()) == [("1", "", 0), ("2", "ü", 1), ("2", "ü", 1), ("None", "", 0)]
    long = spark.createDataFrame([(1, "u", "<p>" + "word " * 60_000 + "</p>", "x", 3)], "page_id long, url string, html string, text int, n_chars int".replace("text int", "text string"))
    assert htmltext.extract(long).first().n_chars == 5 * 60_000 - 1
    assert htmltext.extract(long.where("false")).count() == 0


# ---------------------------------------------------------------- language model


def brute_scores(rows, weights):
    tokens = [[*t.encode().lower().split(), b""] for _, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows]
    one, two, three, starts = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for ts, use in zip(tokens, train, strict=True):
        if use:
            padded = [b"", b"", *ts]
            one.update(ts)
            two.update(zip(padded[1:], ts, strict=False))
            three.update(zip(padded, padded[1:], ts, strict=False))
            starts += 1
    n, v = sum(one.values()), len(one)
    k1, k2 = weights

    def step(u, h, w, first):
        alone = (one[w] + 0.5) / (n + 0.5 * (v + 1))
        short = (two[h, w] + k1 * alone) / (one[h] + k1)
        return (three[u, h, w] + k2 * short) / ((starts if first else two[u, h]) + k2), alone

    out = []
    for ts in tokens:
        padded = [b"", b"", *ts]
        found = [step(u, h, w, k == 0) for k, (u, h, w) in enumerate(zip(padded, padded[1:], ts, strict=False))]
        out.append((len(ts), sum(one[w] > 0 for w in ts), sum(math.log10(a) for _, a in found), sum(math.log10(p) for p, _ in found)))
    return n, out


def random_rows(n):
    rng = random.Random(4)
    return [(i, " ".join(rng.choice(["a", "B", "cc", "ddd", "É"] if i % 5 else [f"rare{rng.randrange(90)}", "a"]) for _ in range(rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 30, 3_000])
def test_scores_are_brute_force_in_one_block_or_many(spark, block):
    rows = random_rows(150)
    n, expected = brute_scores(rows, (7.0, 2.0))
    found = {r.doc_id: r for r in ngram.score(spark.createDataFrame(rows, "doc_id long, text string"), block, (7.0, 2.0)).collect()}
    for (i, _), (tokens, known, base, score) in zip(rows, expected, strict=True):
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_a_state_s_arcs_and_failure_arc_sum_to_one():
    texts = [b"a b a c", b"b b a", b"c a b a b", b""]
    hashes, sizes = ngram._hashes(texts)
    grams, starts = ngram._grams(hashes, sizes), np.cumsum(sizes) - sizes
    totals = {k: np.unique(x, return_counts=True)[1] for k, x in grams.items()}
    n, v = len(hashes), len(totals["one"])
    automaton = ngram.Automaton(grams, totals, starts, n, v, (3.0, 2.0))
    alone = (totals["one"] + 0.5) / (n + 0.5 * (v + 1))
    assert alone.sum() + 0.5 / (n + 0.5 * (v + 1)) == pytest.approx(1)
    _, words = np.unique(grams["one"], return_inverse=True)
    level = automaton.levels[1]
    for state in set(automaton.states[1].tolist()):
        arcs = {int(a): int(w) for a, w, s in zip(automaton.arcs[1], words, automaton.states[1], strict=True) if s == state}
        others = 1 - sum(alone[w] for w in arcs.values())
        assert sum(10 ** level.arc[a] for a in arcs) + 10 ** level.failure[state] * others == pytest.approx(1)


def test_blocks_ask_no_more_rows_than_they_have_n_grams():
    for blocks in (4, 16, 64, 4_096):
        table = pa.table({"block": [0, 0], "text": ["a b c d", "a b"], "held_out": [False, True]})
        asked = ngram._asked(blocks)(table)
        assert asked.num_rows <= min(blocks, 5 + 7 + 8)


def test_language_model_of_odd_rows(spark):
    assert ngram.score(odd(spark)).count() == len(ODD) and ngram.score(empty(spark)).count() == 0


@pytest.mark.parametrize("keys", [[], [5], [0, 1, 2], [0, 2**64 - 1], [3, 2**40, 2**63]])
def test_packed_keys_come_back(keys):
    assert ngram._unpacked(ngram._packed(np.array(keys, np.uint64))).tolist() == keys
    assert ngram._counts(ngram._squeezed(np.array([k % 1000 for k in keys], np.int64))).tolist() == [k % 1000 for k in keys]


# ---------------------------------------------------------------- url filters


def test_url_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    told = con.sql(queries.OP6_SQL)
    df = queries.op6_temporal_url_filter(spark, str(SF))
    names = sorted(df.columns)
    plain = lambda rows, of: sorted(tuple(str(r[of.index(c)]) for c in names) for r in rows)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(told.fetchall(), told.columns)


def test_entries_hold_from_their_day_until_the_next(spark):
    e = spark.createDataFrame([("b.org", "add", "2024-01-10"), ("b.org", "remove", "2024-03-01"), ("a.b.org/x", "add", "2024-02-01"), ("c.net", "remove", "2024-01-01"), (None, "add", "2024-01-01"), ("b.org", "add", "2024-05-01"), ("b.org", "remove", "2024-05-01")], "key string, action string, day string").select("key", "action", F.col("day").cast("timestamp").alias("listed_at"))
    urls = [(1, "http://a.b.org/", "2024-01-09"), (2, "http://A.b.org:80/", "2024-01-10"), (3, "http://a.b.org/X/y?z", "2024-02-29"), (4, "http://b.org", "2024-03-01"), (5, "https://u@c.net/", "2024-06-01"), (6, None, "2024-01-10"), (7, "http://b.org", None), (8, "xb.org", "2024-01-10"), (9, "http://xb.org", "2024-01-10"), (10, "http://b.org", "2024-06-01"), (2, "http://A.b.org:80/", "2024-01-10")]
    c = spark.createDataFrame(urls, "page_id int, url string, day string").select("page_id", "url", F.col("day").cast("timestamp").alias("fetched_at"))
    found = urlfilter.filtered(c, e).collect()
    assert len(found) == len(urls)
    assert sorted((r.page_id, r.rule) for r in found if r.blocked) == [(2, "b.org"), (2, "b.org"), (3, "a.b.org/x")]
    assert urlfilter.filtered(c.where("false"), e).count() == 0 and urlfilter.filtered(c, e.where("false")).where("blocked").count() == 0


def test_url_filter_of_odd_rows(spark):
    """Very long addresses, repeated captures, and extra columns named as those of the result and of the join."""
    long = "http://a.b.org/" + "x/" * 50_000
    rows = [(1, long, "2024-02-01", "h", "r", 1, "k"), (1, long, "2024-02-01", "h", "r", 1, "k"), (2, "http://" + "y." * 2_000 + "b.org/", "2024-02-01", "h", "r", 1, "k"), (None, "", "2024-02-01", None, None, None, None)]
    c = spark.createDataFrame(rows, "page_id int, url string, day string, host string, rule string, _n int, key string").withColumn("fetched_at", F.col("day").cast("timestamp"))
    e = spark.createDataFrame([("b.org", "add", "2024-01-10", 1, "u")], "key string, action string, day string, _month int, url string").withColumn("listed_at", F.col("day").cast("timestamp"))
    found = urlfilter.filtered(c, e)
    assert found.columns == ["page_id", "url", "fetched_at", "host", "blocked", "rule", "since"]
    assert sorted((str(r.page_id), r.blocked, str(r.rule)) for r in found.collect()) == [("1", True, "b.org"), ("1", True, "b.org"), ("2", True, "b.org"), ("None", False, "None")]


# ---------------------------------------------------------------- classifiers


def test_quality_on_held_out_labels(spark):
    docs, marks = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.score(docs, quality.fit(docs, marks)).where("held_out").join(marks, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert found >= 0.8


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert any({i, j} == {0, 1} for i, j, *_ in model.pairs) and ((model.score(x) >= 0.5) == y).mean() > 0.95


def test_classifiers_of_odd_rows(spark):
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(odd(spark), labels(spark, column))
        rows = module.score(odd(spark), model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        nothing = module.fit(odd(spark), labels(spark, column).where("false"))
        assert module.score(odd(spark), nothing).count() == len(ODD) and module.score(empty(spark), nothing).count() == 0
    kept = quality.score(odd(spark), quality.Gam(), keep=True)
    assert kept.count() == len(ODD) and kept.columns == odd(spark).columns


def test_toxic_windows_are_nearer_to_the_toxic_dictionary(spark):
    random.seed(8)
    words = ["".join(random.choice("aeioulrstn") for _ in range(random.randint(2, 9))) for _ in range(300)]
    say = lambda bad: " ".join(random.choice(words) for _ in range(60)) + (" vexatious grimbold" if bad else "")
    rows = [(i, say(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, marks)).join(marks, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.95 * len(found)


@pytest.mark.skipif(not SF.exists(), reason="the tables are not here")
def test_a_few_toxic_labels_teach_something(spark):
    marks = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null")
    found = toxicity.score(documents(spark), toxicity.fit(documents(spark), marks)).join(marks, "doc_id").collect()
    assert len({r.score for r in found}) > 2
    assert sum(r.predicted for r in found if r.toxic) >= 0.5 * sum(r.toxic for r in found)
    assert sum(r.predicted for r in found if not r.toxic) <= 0.05 * len(found)


# ---------------------------------------------------------------- packing


def checked(counts, capacity):
    runs, bins = bestfit.plan(dict(counts), capacity)
    placed, ranks = collections.defaultdict(list), collections.Counter()
    for length, rank, number, first, offset in runs:
        assert rank == ranks[length]
        ranks[length] += number
        for k in range(number):
            placed[first + k].append((offset, length))
    assert dict(ranks) == {k: v for k, v in counts.items() if v} and len(placed) == bins
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in pieces) <= 2
    return bins


def test_plans_are_whole_and_gapless():
    random.seed(1)
    for _ in range(300):
        capacity = random.choice([10, 50, 97])
        counts = {n: random.randint(0, 6) for n in range(1, capacity + 1) if random.random() < 0.5}
        bins = checked(counts, capacity)
        assert bins >= math.ceil(sum(k * v for k, v in counts.items()) / capacity)


def test_equal_lengths_cost_nothing():
    runs, bins = bestfit.plan({1000: 10**9, 3000: 10**9, 96: 10**9}, 4096)
    assert bins == 10**9 and len(runs) < 20


def test_packing_is_a_round_trip(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bestfit.pack(docs, TOKENIZER).collect()
    tokenizer = bestfit.WordIds(TOKENIZER).tokenizer
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for i, parts in by_doc.items():
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1]
        for r in sorted(parts, key=lambda r: r.piece):
            cut = ids[r.start : r.start + r.length]
            assert r.start == 4096 * r.piece and len(cut) == min(4096, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
        assert sum(r.length for r in parts) == len(ids)
    for pieces in by_bin.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_bin) <= 1.02 * math.ceil(sum(r.length for r in rows) / 4096) + 1


@pytest.mark.parametrize("text", ["Don't stop, it's 3.14!", "İstanbul ǅ ﬁ", "étude a b\x1cc", "x" * 500, "… «quoted» — dash", "foo,bar. (baz) [qux]...", "Hİ. Hİ", "\u0958."])
def test_word_ids_are_those_of_the_text(text):
    ids = bestfit.WordIds(TOKENIZER)
    assert ids.batch([text.encode()])[0].tolist() == [*ids.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_word_ids_of_any_letter_before_any_mark():
    ids, rng = bestfit.WordIds(TOKENIZER), random.Random(7)
    letters = [chr(c) for c in range(0x3000) if chr(c).isalpha()]
    words = [c + rng.choice(bestfit._TAIL) for c in letters] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) + "".join(rng.choice(bestfit._TAIL) for _ in range(rng.randint(0, 3))) for _ in range(10_000)]
    for w, found in zip(words, ids.batch([w.encode() for w in words]), strict=True):
        assert found.tolist() == [*ids.tokenizer.encode(w, add_special_tokens=False).ids, 1]


def test_packing_of_odd_rows(spark):
    rows = bestfit.pack(odd(spark), TOKENIZER).collect()
    assert sum(r.length == 1 for r in rows) == 3 and {r.doc_id for r in rows} == {i for i, _ in ODD}
    assert bestfit.pack(empty(spark), TOKENIZER).count() == 0


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_are_brute_force(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(fps)
    for a in keys:
        for b in keys:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for r in simhash.near_duplicates(documents(spark)).collect():
        assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == root(r.doc_id)


def test_every_close_pair_meets_at_an_anchor():
    rng = random.Random(3)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        met = False
        for k in range(2):
            halves = np.array([x >> 32 * k & 0xFFFFFFFF, y >> 32 * k & 0xFFFFFFFF], np.uint64)
            index, anchor, home = simhash.anchors(halves)
            at = [set(anchor[index == i].tolist()) for i in range(2)]
            homes = [set(anchor[(index == i) & home].tolist()) for i in range(2)]
            assert all(len(h) == 1 for h in homes)
            met |= homes[0] <= at[1] or homes[1] <= at[0]
        assert met


def test_large_groups_link_like_small_ones():
    rng = random.Random(4)
    start = rng.getrandbits(64)
    near = {start}
    for _ in range(400):
        near.add(rng.choice(sorted(near)) ^ (1 << rng.randrange(64)))
    a, b = simhash._breadth_first(np.array(sorted(near), np.uint64))
    assert len(a) == len(near) - 1 and all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b, strict=True))


def test_near_duplicates_of_odd_rows(spark):
    found = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd(spark)).collect()}
    assert {(1, "0" * 16, 1), (2, "0" * 16, 1), (6, "0" * 16, 1)} <= found
    assert simhash.near_duplicates(odd(spark)).count() == len(ODD) and simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(odd(spark)).where("doc_id in (1, 2, 3, 6)").select("doc_id").collect() in ([(1,), (3,)], [(3,), (1,)])


def test_rows_that_share_an_id_or_have_none_stay_apart(spark):
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, say(1), 5), (1, say(2), 5), (None, say(3), 5), (None, say(4), 5), (7, say(1), 5), (9, say(4), 5), (9, say(4), 5)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, key int"))
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", say(1)), ("1", say(2)), ("None", say(3)), ("9", say(4))])


def test_components_of_a_hub_and_a_path(spark):
    edges = [(0, k) for k in range(1, 500)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    found = dict(simhash.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {k: 0 for k in range(500)} | {k: 1000 for k in range(1000, 1041)}


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and docs.count() >= sizes[-1] > 0


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_pipeline_stages_of_odd_rows(spark, rows):
    """Nulls, empty and very long texts, repeated rows, no rows at all, and extra columns named as operators name theirs."""
    import corpus_pipeline

    clash = ["fp", "length", "_id", "label", "block", "_row", "_kept_id", "key", "piece", "item"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(clash))) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{c}` int' for c in clash)}")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        alone = stage(spark, docs, str(SF))
        if name == corpus_pipeline.STAGES[-1][0]:
            placed = alone.collect()
            assert sorted(str(r.doc_id) for r in placed if r.piece == 0) == sorted(str(i) for i, _ in rows)
        else:
            assert alone.columns == columns and alone.count() <= len(rows)
            assert {r.doc_id for r in alone.select("doc_id").collect()} <= {i for i, _ in rows}
    if rows:
        assert len(corpus_pipeline.benchmark_filter(spark, docs, str(SF)).collect()) == len(rows)
        assert sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.pii_redaction(spark, docs, str(SF)).collect()) == sorted((str(i), str(t)) for i, t in rows)


def test_decoration_is_told_from_the_end_of_a_word():
    assert all(map(linerules.decorated, (b"##", b"a**", b"x!!", b"a!!.", b"##,.?", b"!!,!", b"a<>;")))
    assert not any(map(linerules.decorated, (b"", b"a", b"#", b"a#", b"x!", b"!,!", b"##a", b"a.,")))
    assert linerules.line_fails([b"*" * 3_000_000 + b"a", b"word"]) == ""


def test_sentences_may_speak_of_links():
    prose = b"They tell their readers to click here whenever the privacy policy of a service has been changed in the last year.".split()
    assert linerules.line_fails(prose) == "" and linerules.line_fails(prose[:-1] + [b"year"]) == "boilerplate"
    assert linerules.line_fails(b"Click here to read more.".split()) == "boilerplate"


def test_ranges_are_visited_where_keys_are():
    rng = np.random.default_rng(3)
    for bits in (48, 64):
        keys = np.unique(rng.integers(0, 1 << bits, 500, dtype=np.uint64))
        for ranges in (1, 7, 1 << 31):
            cuts = ngram._cuts(keys, ranges, bits)
            assert len(cuts) <= min(ranges, len(keys)) and list(cuts) == sorted(cuts) and max(cuts) < ranges
            assert [x for a, b in cuts.values() for x in range(a, b)] == list(range(len(keys)))
    assert ngram._cuts(keys[:0], 9, 64) == {}
