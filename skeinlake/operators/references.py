"""Resolving references: quotes found in passages through word positions, and an ordered cascade of steps.

Passages become rows (passage, piece, position, word). A quote is looked up by one of its words, the rarest of
those that have to occur whole; the rows it meets there say where the quote would start. Those places are brought back to
their passage, each text once, and the words that lie there are held against the quote. So only rows that meet an
anchor leave their task, a common word of a quote is never looked up where a rarer one is there, and what is looked up is
written first, so that Spark sees how small it is. The first word of a quote may be the end of a longer one, and the last
word the start of one, as in a search for a part of a text; quotes of one or two words have no whole word and
meet the passages' vocabulary by letters first, each distinct word once.

A cascade asks its steps in order, and each step only for what those before left.

Defined cases: text is folded as ``folded_quote`` does; null and blank quotes are nowhere; null and empty passages
hold nothing; passages without an id are left out; rows of one passage id with different texts are texts of
their own, repeated rows count once; of other columns none is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.shared import release, written
from skeinlake.functions.text import folded_quote, tokens

#: How a word of a quote has to occur: whole, as the end or the start of a word, or anywhere in one.
WHOLE, END, START, PART = "whole", "end", "start", "part"
#: Letters by which words of short quotes meet the vocabulary.
GRAM = 3


def word_positions(folded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """passage, piece, position, word, and the columns of ``by``, of passages as lists of words."""
    return folded.select(*by, "passage", "piece", F.posexplode("words").alias("position", "word")).where("word <> ''")


def _phrase_words(phrases: DataFrame, by: Sequence[str]) -> DataFrame:
    """phrase, size, offset, word, role, and the columns of ``by``."""
    words = phrases.select(*by, "phrase", F.split("phrase", " ").alias("w")).select(*by, "phrase", F.size("w").alias("size"), F.posexplode("w").alias("offset", "word"))
    role = F.when(F.col("size") == 1, PART).when(F.col("offset") == 0, END).when(F.col("offset") == F.col("size") - 1, START).otherwise(WHOLE)
    return words.withColumn("role", role)


def _fits(role: Column, asked: Column, found: Column) -> Column:
    return F.when(role == WHOLE, asked == found).when(role == END, F.endswith(found, asked)).when(role == START, F.startswith(found, asked)).otherwise(F.contains(found, asked))


def _letters(role: Column, word: Column, size: Column) -> Column:
    """Where a word that fits may have the ``size`` letters by which it is asked: at its end, at its start, or anywhere."""
    n = F.length(word)
    anywhere = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.substring(word, i, size))
    return F.when(n < size, F.array().cast("array<string>")).when(role == END, F.array(F.substring(word, n - size + 1, size))).when(role == START, F.array(F.substring(word, F.lit(1), size))).otherwise(F.array_distinct(anywhere))


def _anchors(words: DataFrame, index: DataFrame, by: Sequence[str]) -> DataFrame:
    """phrase, offset, word, and the columns of ``by``: where to look each phrase up. Phrases with a whole word that occurs nowhere have none."""
    whole = words.where(F.col("role") == WHOLE)
    # only words that are asked for are counted
    counted = index.select(*by, "word").join(whole.select(*by, "word").distinct(), [*by, "word"], "left_semi").groupBy(*by, "word").agg(F.count("*").alias("frequency"))
    whole = whole.join(counted, [*by, "word"], "left")
    w = Window.partitionBy(*by, "phrase").orderBy(F.coalesce("frequency", F.lit(0)), "offset")
    rarest = whole.withColumn("k", F.row_number().over(w)).where("k = 1 and frequency is not null").select(*by, "phrase", "offset", "word")
    longest = Window.partitionBy(*by, "phrase").orderBy(F.desc(F.length("word")), "offset")
    short = words.where("size <= 2").withColumn("k", F.row_number().over(longest)).where("k = 1").select(*by, "phrase", "offset", "role", F.col("word").alias("asked"))
    size = F.least(F.length("asked"), F.lit(GRAM))
    at = F.when(F.col("role") == END, F.length("asked") - size + 1).otherwise(1)
    short = short.withColumn("size", size).withColumn("gram", F.substring("asked", at, size))
    # three roles by three sizes at most, so words are cut only as something asks for them
    kinds = short.select(*by, "role", "size").distinct().groupBy(*by).agg(F.collect_list(F.struct("role", "size")).alias("kinds")).where("size(kinds) > 0")
    met = lambda df: df.join(kinds, list(by)) if by else df.crossJoin(F.broadcast(kinds))
    known = met(met(index.select(*by, "word")).select(*by, "word").distinct())
    known = known.select(*by, "word", F.explode("kinds").alias("kind")).select(*by, "word", "kind.role", "kind.size")
    known = known.select(*by, "word", "role", "size", F.explode(_letters(F.col("role"), F.col("word"), F.col("size"))).alias("gram"))
    fitting = short.join(known, [*by, "role", "size", "gram"]).where(_fits(F.col("role"), F.col("asked"), F.col("word")))
    return rarest.unionByName(fitting.select(*by, "phrase", "offset", "word").distinct())


def phrase_matches(passages: DataFrame, phrases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """passage, phrase, and the columns of ``by``: each distinct folded phrase (column text) with all passages whose folded text holds it.

    Of columns ``by`` passages and phrases have equal values: a phrase is looked up among the words of its own ones only.
    """
    words = F.split(folded_quote(F.col("text")), " ").alias("words")
    folded = written(passages.where("passage is not null").select(*by, "passage", F.xxhash64("text").alias("piece"), words), "folded")
    index = word_positions(folded, by)
    asked = written(_phrase_words(phrases.select(*by, folded_quote(F.col("text")).alias("phrase")).where("phrase <> ''").distinct(), by), "phrases")
    anchors = written(_anchors(asked, index, by), "anchors")
    starts = index.join(anchors, [*by, "word"]).select(*by, "passage", "piece", F.struct("phrase", (F.col("position") - F.col("offset")).alias("start")).alias("at")).where("at.start >= 0")
    places = written(starts.groupBy(*by, "passage", "piece").agg(F.collect_set("at").alias("places")), "starts")
    # as many words as the quote has: it can only lie in them with its blanks on theirs
    there = lambda at: F.array_join(F.slice("words", at["start"] + 1, F.size(F.split(at["phrase"], " "))), " ")
    held = F.filter("places", lambda at: F.contains(there(at), at["phrase"]))
    found = folded.join(places, [*by, "passage", "piece"]).select(*by, "passage", F.explode(F.array_distinct(F.transform(held, lambda at: at["phrase"]))).alias("phrase"))
    return found.distinct()


def anchored(spans: DataFrame, assertions: DataFrame) -> DataFrame:
    """document, span, id: the assertions (document, id, quote) whose quote lies in a span (document, span, text) of their document.

    Quotes are looked up within their document, so copies of a conversation don't meet each other.
    """
    asked = assertions.where("document is not null").select("document", "id", folded_quote(F.col("quote")).alias("phrase")).where("phrase <> ''")
    inside = phrase_matches(spans.where("document is not null").select("document", F.struct("span").alias("passage"), "text"), asked.select("document", F.col("phrase").alias("text")), ["document"])
    return inside.select("document", "passage.span", "phrase").join(asked, ["document", "phrase"]).select("document", "span", "id").distinct()


@dataclass(frozen=True)
class Step:
    """One step of a cascade: ``find`` takes references (reference, text, ...) and returns (reference, target).

    ``single``: several targets leave a reference ambiguous; it doesn't go on to later steps either.
    """

    strategy: str
    find: Callable[[DataFrame], DataFrame]
    confidence: float = 1.0
    single: bool = False


def cascade(references: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """reference, outcome, strategy, target, targets, confidence of each distinct reference (column reference, not null).

    outcome: resolved, ambiguous (then target is null) or unresolved; ``target`` is the smallest of the
    targets, whose number ``targets`` says. References of one id with several texts are asked with all of them.
    """
    rows = written(references.where("reference is not null").distinct(), "references")
    others = F.struct(*(c for c in references.columns if c != "reference"))
    # references with one row that ask the same are asked once, as the smallest of them
    told = rows.groupBy("reference").agg(F.count("*").alias("n"), F.first(others).alias("asked"))
    single = told.where("n = 1")
    alike = single.join(single.groupBy("asked").agg(F.min("reference").alias("as")), "asked").select("reference", "as")
    alike = written(alike.unionByName(told.where("n > 1").select("reference", F.col("reference").alias("as"))), "alike")
    left = written(rows.join(alike.where("reference = as").select("reference"), "reference", "left_semi"), "references")
    out = None
    for step in steps:
        found = step.find(left).where("reference is not null and target is not null").groupBy("reference").agg(F.min("target").alias("target"), F.count_distinct("target").alias("targets"))
        dark = (F.col("targets") > 1) & F.lit(step.single)
        told = written(found.select("reference", F.when(dark, "ambiguous").otherwise("resolved").alias("outcome"), F.lit(step.strategy).alias("strategy"), F.when(~dark, F.col("target")).alias("target"), "targets", F.lit(step.confidence).alias("confidence")), "resolved")
        out = told if out is None else out.unionByName(told)
        before, left = left, written(left.join(told.select("reference"), "reference", "left_anti"), "references")
        release(before)
    rest = left.select("reference", F.lit("unresolved").alias("outcome"), F.lit(None).cast("string").alias("strategy"), F.lit(None).alias("target"), F.lit(0).cast("long").alias("targets"), F.lit(0.0).alias("confidence")).distinct()
    out = rest if out is None else out.unionByName(rest.withColumn("target", F.col("target").cast(out.schema["target"].dataType)))
    return alike.select("reference", "as").join(out.withColumnRenamed("reference", "as"), "as").drop("as")


def by_id(nodes: DataFrame) -> Step:
    """The text is the id of a node already."""
    return Step("existing_id", lambda refs: refs.join(nodes.select(F.col("id").alias("text")).distinct(), "text").select("reference", F.col("text").alias("target")))


def by_name(nodes: DataFrame) -> Step:
    """The folded text is the folded name of a node; several nodes of that name leave it open."""
    named = nodes.select(F.col("id").alias("target"), folded_quote(F.col("name")).alias("phrase")).where("phrase <> ''").distinct()
    return Step("entity_name", lambda refs: refs.select("reference", folded_quote(F.col("text")).alias("phrase")).join(named, "phrase").select("reference", "target"), 1.0, single=True)


def by_quote(passages: DataFrame, confidence: float = 0.9) -> Step:
    """Passages (passage, text) that hold the text."""
    def find(refs: DataFrame) -> DataFrame:
        asked = refs.select("reference", folded_quote(F.col("text")).alias("phrase"))
        return asked.join(phrase_matches(passages, refs.select("text")), "phrase").select("reference", F.col("passage").alias("target"))

    return Step("quote", find, confidence)


def by_words(passages: DataFrame, least: float = 0.5, confidence: float = 0.6) -> Step:
    """The passage that shares most distinct words with the text, ``least`` of them at least; ties to the smallest passage.

    A passage that holds that many of n words holds one of the n - ceil(least * n) + 1 rarest ones, so
    only these are looked up, and common words only where a passage has been met already.
    """
    def find(refs: DataFrame) -> DataFrame:
        asked = refs.select("reference", F.array_distinct(tokens(F.col("text"))).alias("w")).groupBy("reference").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w"))
        asked = written(asked, "asked")
        words = asked.select("reference", F.size("w").alias("size"), F.explode("w").alias("word"))
        known = written(words.select("word").distinct(), "words")
        # of each passage the words that some reference has
        told = passages.where("passage is not null").select("passage", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).join(known, "word", "left_semi")
        held = written(told.groupBy("passage").agg(F.collect_set("word").alias("held")), "held")
        each = held.select("passage", F.explode("held").alias("word"))
        need = F.ceil(F.col("size") * F.lit(least) - 1e-9)
        w = Window.partitionBy("reference").orderBy(F.coalesce("frequency", F.lit(0)), "word")
        rare = words.join(each.groupBy("word").agg(F.count("*").alias("frequency")), "word", "left").withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("size") - need + 1)
        rare = written(rare.select("reference", "word"), "rare")
        met = each.join(rare, "word").groupBy("passage").agg(F.collect_set("reference").alias("references"))
        pairs = held.join(met, "passage").select("passage", "held", F.explode("references").alias("reference")).join(asked, "reference")
        shared = pairs.select("reference", "passage", F.size("w").alias("size"), F.size(F.array_intersect("held", "w")).alias("n")).where(F.col("n") >= need)
        return shared.groupBy("reference").agg(F.min_by("passage", F.struct(-F.col("n"), "passage")).alias("target"))

    return Step("lexical", find, confidence)
