"""Lexical search over an inverted index built by the query itself.

Only the postings of the query terms are counted and shuffled. Top-k per query is a row_number filter, which Spark applies in each
partition before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.text import STOP_WORDS, bm25_idf, bm25_term, tokens, word_set


def postings(docs: DataFrame, stop_words: Iterable[str] = STOP_WORDS, of: DataFrame | None = None) -> DataFrame:
    """id, term, frequency, length: documents without a token are left out; with ``of`` (term), so is every other term, before the shuffle."""
    split = docs.select("id", tokens(F.col("text"), stop_words).alias("t"))
    each = split.select("id", F.size("t").alias("length"), F.explode("t").alias("term"))
    each = each if of is None else each.join(of.select("term").distinct(), "term", "left_semi")
    return each.groupBy("id", "term", "length").agg(F.count("*").alias("frequency"))


def _query_terms(queries: DataFrame, stop_words: Iterable[str]) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text"), stop_words))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """query_id, id, score of the documents with at least one query term (each counted once)."""
    terms = _query_terms(queries, stop_words)
    found = postings(docs, stop_words, terms)
    stats = docs.select(F.size(tokens(F.col("text"), stop_words)).alias("n")).where("n > 0").agg(F.count("*").alias("documents"), F.avg("n").alias("mean_length"))
    containing = found.groupBy("term").agg(F.count("*").alias("df"))
    scored = found.join(containing, "term").crossJoin(F.broadcast(stats))  # one row
    part = bm25_term(bm25_idf(F.col("documents"), F.col("df")), F.col("frequency"), F.col("length"), F.col("mean_length"))
    return terms.join(scored.select("term", "id", part.alias("part")), "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def top_k(scores: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k documents of each query, ties by id; documents without a score fill up with 0, in order of id.

    Of the first 2k ids at least k are unscored wherever fewer than k are scored, so the
    fill needs no more than those.
    """
    first = docs.select("id").distinct().orderBy("id").limit(2 * k)
    fill = queries.select("query_id").crossJoin(F.broadcast(first)).join(scores.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id")
    return scores.unionByName(fill).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def jaccard(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score: Jaccard of token sets for pairs that share a token."""
    of = lambda df, key: df.select(key, F.array_distinct(tokens(F.col("text"))).alias("t")).select(key, F.size("t").alias("n"), F.explode("t").alias("term"))
    d, q = of(docs, "id"), of(queries, "query_id").withColumnRenamed("n", "m")
    shared = d.join(q, "term").groupBy("query_id", "id", "n", "m").agg(F.count("*").alias("both"))
    return shared.select("query_id", "id", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("score"))


def jaccard_multiset(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score: sum of smaller over sum of larger counts, for pairs that share a token."""
    of = lambda df, key: df.select(key, tokens(F.col("text")).alias("t")).select(key, F.size("t").alias("size"), F.explode("t").alias("term")).groupBy(key, "size", "term").agg(F.count("*").alias("c"))
    d, q = of(docs, "id"), of(queries, "query_id").withColumnsRenamed({"c": "b", "size": "size_q"})
    shared = d.join(q, "term").groupBy("query_id", "id", "size", "size_q").agg(F.sum(F.least("c", "b")).alias("low"))
    return shared.select("query_id", "id", (F.col("low") / (F.col("size") + F.col("size_q") - F.col("low"))).alias("score"))


def keyword_overlap(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, overlap: distinct shared words of two letters or more, where there is one."""
    q = queries.select("query_id", F.explode(word_set(F.col("text"))).alias("term"))
    return rows.select("id", F.explode(word_set(F.col("text"))).alias("term")).join(q, "term").groupBy("query_id", "id").agg(F.count("*").alias("overlap"))


def frequent_words(docs: DataFrame, n: int, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """The n most frequent words of each document, ties by first place.

    The texts of an id meet, and its words are sorted and counted within the row: texts travel once, counts of words never do.
    """
    own = docs.groupBy("id").agg(F.collect_list("text").alias("texts"))
    places = F.flatten(F.transform("texts", lambda x: F.transform(tokens(x, stop_words), lambda w, at: F.struct(w.alias("word"), at.alias("at")))))
    placed = own.select("id", F.sort_array(places).alias("s")).where(F.size("s") > 0)
    word = lambda i: F.get("s", i)["word"]
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (word(i) != word(i - 1)))
    runs = placed.select("id", "s", starts.alias("starts"))
    counted = F.transform("starts", lambda i, k: F.struct((i - F.coalesce(F.get("starts", k + 1), F.size("s"))).alias("less"), F.get("s", i)["at"].alias("first"), word(i).alias("word")))
    top = runs.select("id", F.posexplode(F.slice(F.sort_array(counted), 1, n)).alias("k", "w"))
    return top.select("id", F.col("w.word").alias("word"), (-F.col("w.less")).cast("long").alias("n"), (F.col("k") + 1).alias("rank"))


def token_f1(pairs: DataFrame, answer: str = "answer", golden: str = "golden") -> DataFrame:
    """``pairs`` (with id) and f1 of token multisets; both empty is 1, one empty 0."""
    of = lambda c, n: pairs.select("id", F.explode(tokens(F.col(c))).alias("term")).groupBy("id", "term").agg(F.count("*").alias(n))
    shared = of(answer, "a").join(of(golden, "g"), ["id", "term"]).groupBy("id").agg(F.sum(F.least("a", "g")).alias("common"))
    a, g = F.size(tokens(F.col(answer))), F.size(tokens(F.col(golden)))
    common = F.coalesce("common", F.lit(0))
    return pairs.join(shared, "id", "left").withColumn("f1", F.when(a + g == 0, 1.0).otherwise(2 * common / (a + g))).drop("common")
