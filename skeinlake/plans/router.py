"""Chooses a search type for a query by weighted rules, as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT, LEAST, NEGATION_WINDOW = "HYBRID_COMPLETION", 2.0, 20
# fixed values: patterns, the search type each speaks for, and its weight
NEGATION = r"(?i)\b(not|n't|no|never|without|lack)\b"
RULES = [
    (r"(^MATCH\s|^RETURN\s|^CREATE\s|^MERGE\s|--\(|\)--)", "CYPHER", 10.0),
    (r"(?i)\b(coding rules?|code review|best practice|lint(ing|er)?|refactor(ing)?)\b", "CODING_RULES", 5.0),
    (r"(?i)\b(def |return |async |await |import |class \w+\(|\.py\b|function\s+\w+\()", "CODING_RULES", 1.0),
    (r'^"[^"]+"$', "CHUNKS_LEXICAL", 8.0),
    (r"(?i)\b(exact|verbatim|literal|word.for.word)\b", "CHUNKS_LEXICAL", 4.0),
    (r"(?i)\b(summarize|summary|overview|outline|tl;?dr|gist|main points?|key takeaways?|high.?level)\b", "GRAPH_SUMMARY_COMPLETION", 5.0),
    (r"(?i)\b(why|explain|reasoning|step.by.step|chain of thought)\b", "GRAPH_COMPLETION_COT", 4.0),
    (r"(?i)\b(because|therefore|consequently)\b", "GRAPH_COMPLETION_COT", 2.0),
    (r"(?i)\b(how (is|are|does|do)\s+\w+\s+(related|connected|linked))\b", "GRAPH_COMPLETION_CONTEXT_EXTENSION", 5.0),
    (r"(?i)\b(what (connects|links|ties)|path between|degree of separation)\b", "GRAPH_COMPLETION_CONTEXT_EXTENSION", 5.0),
    (r"(?i)\b(connection|relationship|related to|linked to)\b", "GRAPH_COMPLETION_CONTEXT_EXTENSION", 3.0),
    (r"(?i)\b(when|before|after|during|since|until)\b", "TEMPORAL", 3.0),
    (r"(?i)\b(timeline|chronolog|era|decade|century)\b", "TEMPORAL", 4.0),
    (r"\b\d{4}s?\b", "TEMPORAL", 3.0),
    (r"(?i)\bbetween\s+\d{4}\s+and\s+\d{4}\b", "TEMPORAL", 6.0),
]
TYPES = list(dict.fromkeys(t for _, t, _ in RULES))


def _fires(text: Column, pattern: str) -> Column:
    """Whether the first match of a pattern has no negation in the 20 characters before it."""
    at = F.regexp_instr(text, F.lit(pattern))
    before = F.substring(text, F.greatest(F.lit(1), at - NEGATION_WINDOW), F.least(at - 1, F.lit(NEGATION_WINDOW)))
    return (at > 0) & ~before.rlike(NEGATION)


def routed(queries: DataFrame, text: str = "text") -> DataFrame:
    """``queries`` with search_type, confidence, runner_up and runner_up_score; ties go to the type whose rule comes first.

    Where the best score is too low for its type, the default is taken and that type is the
    runner-up; without a second type the runner-up is the default with score 0.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    score = lambda kind: sum((F.when(_fires(t, p), w).otherwise(0.0) for p, k, w in RULES if k == kind), F.lit(0.0))
    scores = F.array(*(F.struct(score(k).alias("s"), F.lit(-n).alias("n"), F.lit(k).alias("k")) for n, k in enumerate(TYPES)))
    with_best = queries.withColumn("_r", F.slice(F.sort_array(F.filter(scores, lambda x: x["s"] > 0), asc=False), 1, 2))
    best, second = F.try_element_at("_r", F.lit(1)), F.try_element_at("_r", F.lit(2))
    none, weak = F.size("_r") == 0, best["s"] < LEAST
    return with_best.select(
        *queries.columns,
        F.when(none | weak, DEFAULT).otherwise(best["k"]).alias("search_type"),
        F.when(none, LEAST).otherwise(best["s"]).alias("confidence"),
        F.when(weak, best["k"]).otherwise(F.coalesce(second["k"], F.lit(DEFAULT))).alias("runner_up"),
        F.when(weak, best["s"]).otherwise(F.coalesce(second["s"], F.lit(0.0))).alias("runner_up_score"),
    )
