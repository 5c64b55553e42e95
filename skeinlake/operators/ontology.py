"""Ontologies: names found in them, exactly or closely, and what follows from the nodes found.

triples are (subject, predicate, object, literal) as ``sources.ontologies`` reads them. Nodes are known by their key, the
last part of their URI in lower case with ``_`` for spaces.

Defined cases: names that are null or have an empty key match nothing; of nodes with one key the smallest URI
counts; texts are no nodes and are not walked to; repeated names and triples count once; empty tables give empty results.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skeinlake.functions.shared import release, written
from skeinlake.sources.ontologies import OWL, SUBCLASS, TYPE

IS_A = "is_a"
#: Letters of the longest words that meet keys by what is left without a letter.
STRUCK = 64
#: Tasks that the triples of one property are dealt to.
SALTS = 64


def key(uri: Column) -> Column:
    last = F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(F.regexp_replace(uri, "/+$", ""), "/", -1))
    return folded(last)


def folded(name: Column) -> Column:
    return F.trim(F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def lookup(triples: DataFrame) -> DataFrame:
    """category (classes, individuals), key, uri: declared classes, and what has one of them as its type."""
    typed = triples.where((F.col("predicate") == TYPE) & ~F.col("literal"))
    classes = typed.where(F.col("object") == f"{OWL}Class").select(F.col("subject").alias("uri")).distinct()
    members = typed.join(classes.select(F.col("uri").alias("object")), "object", "left_semi").select(F.col("subject").alias("uri"))
    both = classes.withColumn("category", F.lit("classes")).unionByName(members.withColumn("category", F.lit("individuals")))
    return both.groupBy("category", key(F.col("uri")).alias("key")).agg(F.min("uri").alias("uri")).where("key <> ''")


@F.pandas_udf(DoubleType())
def _ratio(candidate: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, c, w).ratio() for c, w in zip(candidate, word, strict=True)], dtype="float64")


def _grams(keys: DataFrame) -> DataFrame:
    """key, gram: pairs of letters numbered within a key; short keys whole, and keys of three letters with each letter struck out."""
    n = F.length("key")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr("key", i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    split = keys.select("key", F.explode(pairs).alias("pair"))
    each = split.withColumn("k", F.row_number().over(Window.partitionBy("key", "pair").orderBy("pair"))).select("key", F.concat_ws(" ", "pair", "k").alias("gram"))
    left = lambda *at: F.concat(*(F.substr("key", F.lit(i), F.lit(1)) for i in at))
    struck = F.when(n <= 2, F.array("key")).when(n == 3, F.array_distinct(F.array(left(1, 2), left(1, 3), left(2, 3))))
    return each.withColumn("short", F.lit(False)).unionByName(keys.select("key", F.explode(struck).alias("gram")).withColumn("short", F.lit(True)))


def _first_grams(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each key the rarest grams, so many that a key with a ratio of 0.8 or more has to share one.

    With T letters in both keys, a ratio of 0.8 means 0.4 T letters matched or more, 0.2 T letters unmatched or fewer, so at
    most 0.2 T + 1 runs and at least 0.2 T - 1 common pairs; the other key has at least two thirds of the letters.
    """
    n = F.length("key")
    common = F.greatest(F.lit(1), F.ceil((n + F.ceil(2 * n / 3)) / 5 - 1 - 1e-9))
    w = Window.partitionBy("key").orderBy("count", "gram")
    ranked = grams.where("not short").join(counts, "gram").withColumn("k", F.row_number().over(w)).where(F.col("k") <= n - 1 - common + 1)
    return ranked.select("key", "gram").unionByName(grams.where("short").select("key", F.concat(F.lit("/"), "gram").alias("gram")))


def _struck(keys: DataFrame, name: str) -> DataFrame:
    """The key as ``name``, and ``left``: the key without one of its letters, each way once."""
    without = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.concat(F.substr("key", F.lit(1), i - 1), F.substr("key", i + 1)))
    return keys.select("key", F.explode(F.array_distinct(without)).alias("left")).withColumnRenamed("key", name)


def _one_letter(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, best (ratio, key) of words whose closest key is the word itself or has one letter more or less, for certain.

    With n letters in a word, every other key leaves two letters or more unmatched, so its ratio is n / (n + 1) at most.
    Keys with one letter struck out are as many as letters, so this is done for words up to STRUCK letters.
    """
    w, v = words.where(F.length("key") <= STRUCK), vocabulary.where(F.length("key") <= STRUCK + 1)
    equal = w.join(v, "key").withColumn("word", F.col("key")).select("word", "key")
    longer = _struck(v, "key").join(w.withColumnRenamed("key", "left"), "left").withColumnRenamed("left", "word").select("word", "key")
    shorter = _struck(w, "word").join(v.withColumnRenamed("key", "left"), "left").withColumnRenamed("left", "key").select("word", "key")
    pairs = equal.unionByName(longer).unionByName(shorter).distinct()
    best = pairs.withColumn("ratio", _ratio("key", "word")).groupBy("word").agg(F.max(F.struct("ratio", "key")).alias("best"))
    n = F.length("word")
    return best.where((F.col("best.ratio") >= 0.8) & (F.col("best.ratio") > n / (n + 1) + 1e-9))


def close(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, key, ratio: for each word (column key) the nearest key of the vocabulary with a ratio of 0.8 or more; ties to the greatest key.

    The ratio is difflib's. Words whose closest key differs in one letter more or less are settled by joins on what is left of
    a key without the letter. For the others, only pairs that share one of their rarest pairs of letters, and whose lengths allow the ratio,
    are candidates. Common pairs bound a candidate's ratio (T letters, g common pairs: 2 (g + T + 1) / 3 T); a word's candidate
    with the best bound is compared first, then those whose bound is not below what that one has.
    """
    w, v = words.select("key").where("key <> ''").distinct(), vocabulary.select("key").where("key <> ''").distinct()
    settled = written(_one_letter(w, v), "close-settled")
    rest = written(w.join(settled.select(F.col("word").alias("key")), "key", "left_anti"), "close-rest")
    found = settled.select("word", "best")
    if not rest.isEmpty():
        found = found.unionByName(_closest(rest, v))
    return found.select("word", "best.key", "best.ratio")


def _closest(w: DataFrame, v: DataFrame) -> DataFrame:
    """word, best (ratio, key), by common pairs of letters."""
    gw, gv = _grams(w), _grams(v)
    counts = gw.unionByName(gv).where("not short").groupBy("gram").agg(F.count("*").alias("count"))
    all_of = lambda keys, grams, name: keys.join(grams.where("not short").groupBy("key").agg(F.collect_list("gram").alias("grams")), "key", "left").select(F.col("key").alias(name), F.coalesce("grams", F.array().cast("array<string>")).alias(f"{name}_grams"))
    pairs = _first_grams(gw, counts).withColumnRenamed("key", "word").join(_first_grams(gv, counts), "gram").where("least(length(word), length(key)) * 2.5 >= length(word) + length(key)")
    total = F.length("word") + F.length("key")
    common = F.size(F.array_intersect("word_grams", "key_grams"))
    bound = F.least(2 * (common + total + 1) / (3 * total), 2 * F.least(F.length("word"), F.length("key")) / total)
    bounded = pairs.select("word", "key").distinct().join(all_of(w, gw, "word"), "word").join(all_of(v, gv, "key"), "key").select("word", "key", bound.alias("bound"))
    candidates = written(bounded.where(F.col("bound") >= 0.8 - 1e-9), "close")
    first = candidates.groupBy("word").agg(F.max_by("key", "bound").alias("key")).withColumn("ratio", _ratio("key", "word"))
    first = written(first, "close-first")
    rest = candidates.join(first.select("word", F.col("key").alias("_key"), F.col("ratio").alias("_ratio")), "word").where((F.col("bound") >= F.col("_ratio") - 1e-9) & (F.col("key") != F.col("_key")))
    scored = first.unionByName(rest.select("word", "key", _ratio("key", "word").alias("ratio"))).where("ratio >= 0.8")
    return scored.groupBy("word").agg(F.max(F.struct("ratio", "key")).alias("best"))


def matched(names: DataFrame, found: DataFrame, category: str = "individuals") -> DataFrame:
    """name, key, uri of the names (column name) that a category of ``lookup`` knows: by equal key, else by the closest one."""
    known = found.where(F.col("category") == category).select("key", "uri")
    asked = names.select("name").dropna().distinct().withColumn("word", folded(F.col("name"))).where("word <> ''")
    exact = asked.join(known.select(F.col("key").alias("word"), "uri"), "word", "left")
    rest = exact.where("uri is null").select("name", "word")
    near = rest.join(close(rest.select(F.col("word").alias("key")), known), "word").join(known, "key").select("name", "key", "uri")
    return exact.where("uri is not null").select("name", F.col("word").alias("key"), "uri").unionByName(near)


@dataclass(frozen=True)
class Attached:
    """nodes(start, uri, key, category, hops) and edges(start, source_id, relationship_name, target_id), ends as keys."""

    nodes: DataFrame
    edges: DataFrame


def attached(triples: DataFrame, starts: DataFrame, category: str = "individuals", directed: bool = True, apart: bool = True) -> Attached:
    """All that follows from the starts (column uri): types (for individuals), superclasses, and declared object properties.

    Undirected, object properties are followed both ways. ``apart`` gives each start a graph of its own; otherwise there is
    one graph of all starts, with a null ``start``, whose size is bounded by the ontology's. A round joins only the nodes
    that the round before has found.
    """
    follows = triples.where(~F.col("literal"))
    declared = follows.where((F.col("predicate") == TYPE) & (F.col("object") == f"{OWL}ObjectProperty")).select(F.col("subject").alias("predicate")).distinct()
    up = follows.where(F.col("predicate").isin(SUBCLASS, TYPE) if category == "individuals" else F.col("predicate") == SUBCLASS)
    is_a = up.select("subject", "object", F.lit(IS_A).alias("relationship_name"))
    # one property may have nearly all triples: they are dealt to SALTS tasks
    dealt = follows.withColumn("_salt", F.pmod(F.hash("subject", "object"), F.lit(SALTS)))
    by = dealt.join(declared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["predicate", "_salt"], "left_semi").select("subject", "object", key(F.col("predicate")).alias("relationship_name"))
    step = lambda df, at, to: df.select(F.col(at).alias("uri"), F.col(to).alias("next"), "subject", "object", "relationship_name")
    steps = step(is_a.unionByName(by), "subject", "object")
    if not directed:
        steps = steps.unionByName(step(by, "object", "subject"))
    steps = written(steps.distinct(), "ontology")
    start = F.col("uri") if apart else F.lit(None).cast("string")
    front = starts.select(start.alias("start"), "uri").dropna(subset=["uri"]).distinct().withColumn("hops", F.lit(0))
    rounds, edges = [written(front, "attached")], []
    while True:
        front = rounds[-1]
        gone = written(front.join(steps, "uri").select("start", "next", "subject", "object", "relationship_name"), "attached-edges")
        found = reduce(DataFrame.unionByName, rounds).select(F.col("start").alias("_s"), F.col("uri").alias("_u"))
        fresh = gone.select("start", F.col("next").alias("uri")).distinct()
        fresh = written(fresh.join(found, F.col("_s").eqNullSafe(F.col("start")) & (F.col("_u") == F.col("uri")), "left_anti").withColumn("hops", F.lit(len(rounds))), "attached")
        edges.append(gone)
        if fresh.isEmpty():
            release(fresh)
            break
        rounds.append(fresh)
    known = lookup(triples).select("uri", "category").groupBy("uri").agg(F.min("category").alias("category"))
    nodes = reduce(DataFrame.unionByName, rounds).join(known, "uri", "left")
    ends = reduce(DataFrame.unionByName, edges).select("start", key(F.col("subject")).alias("source_id"), "relationship_name", key(F.col("object")).alias("target_id"))
    return Attached(nodes.select("start", "uri", key(F.col("uri")).alias("key"), F.coalesce("category", F.lit("unknown")).alias("category"), "hops"), ends.distinct())
