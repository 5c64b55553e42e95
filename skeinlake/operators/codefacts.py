"""Facts about code: faceted lookup, names that resolve to one fact, bounded walks, findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.shared import written
from skeinlake.functions.text import match_tier
from skeinlake.operators.graph import both_ways


def _whole_or(column: str, value: str, part: Column) -> Column:
    return (F.lower(column) == value.lower()) | part


def matching(facts: DataFrame, kind: str | None = None, file: str | None = None, name: str | None = None, repo: str | None = None, properties: dict[str, str | None] | None = None) -> DataFrame:
    """Facts by kind, file (whole or prefix), name (whole or part, any case), repository and dotted properties.

    A property with value None has to exist; others have to equal the value as text.
    ``properties`` are read from the JSON text in the column of that name.
    """
    if kind is not None:
        facts = facts.where(F.col("type") == kind)
    if file is not None:
        facts = facts.where(F.col("file").startswith(file))
    if name is not None:
        facts = facts.where(_whole_or("name", name, F.lower("name").contains(name.lower())))
    if repo is not None:
        facts = facts.where(F.col("repo") == repo)
    for path, value in (properties or {}).items():
        found = F.try_variant_get(F.try_parse_json("properties"), f"$.{path}", "string")
        facts = facts.where(found.isNotNull() if value is None else found == value)
    return facts


def related(facts: DataFrame, edges: DataFrame, relationship: str) -> DataFrame:
    """Facts from which an edge of that relation goes out."""
    out = edges.where(F.col("relationship_name") == relationship).select(F.col("source_id").alias("id"))
    return facts.join(out, "id", "left_semi")


def paged(facts: DataFrame, order: Sequence[str | Column], offset: int, limit: int) -> DataFrame:
    """A page in a total order, each row with the number of all matches and whether more follow."""
    total = facts.agg(F.count("*").alias("total"))
    page = facts.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def resolved_name(facts: DataFrame, term: str) -> DataFrame:
    """The facts of the best tier for a term with their number: one row means that the term resolves."""
    tiers = facts.withColumn("tier", match_tier(F.col("name"), F.lit(term))).where("tier > 0")
    best = tiers.agg(F.max("tier").alias("best"))
    kept = tiers.join(F.broadcast(best), F.col("tier") == F.col("best"))
    return kept.drop("best").crossJoin(F.broadcast(kept.agg(F.count("*").alias("candidates"))))


def bounded_walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, most: int, direction: str = "forward", relations: Sequence[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """id, hops of up to ``most`` nodes near the seeds, by hops, then id; nodes beyond the cap are not walked from.

    Other types than ``types`` are walked through and left out of the result.
    """
    chosen = edges if relations is None else edges.where(F.col("relationship_name").isin(*relations))
    steps = {"forward": chosen.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), "backward": chosen.select(F.col("target_id").alias("a"), F.col("source_id").alias("b")), "both": both_ways(chosen)}[direction].distinct()
    found = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        room = most - found.count()
        if room <= 0:
            break
        front = found.where(F.col("hops") == hop - 1).select(F.col("id").alias("a"))
        new = steps.join(front, "a", "left_semi").select(F.col("b").alias("id")).distinct().join(found, "id", "left_anti").orderBy("id").limit(room)
        found = written(found.unionByName(new.withColumn("hops", F.lit(hop))), "walk")
    return found if types is None else found.join(nodes.where(F.col("type").isin(*types)).select("id"), "id", "left_semi")


def findings(rows: DataFrame, evidence: DataFrame, least: float = 0.0, source: str | None = None, informational: bool = True) -> DataFrame:
    """Findings by confidence (none last) with their pieces of evidence in order."""
    kept = rows.where((F.coalesce("confidence", F.lit(0.0)) >= least) & (F.lit(informational) | ~F.coalesce("informational", F.lit(False))))
    if source is not None:
        kept = kept.where(F.col("source") == source)
    pieces = evidence.groupBy("finding_id").agg(F.array_sort(F.collect_list("text")).alias("evidence"))
    return kept.join(pieces, "finding_id", "left").orderBy(F.desc_nulls_last("confidence"), "finding_id")


def locator_spans(docs: DataFrame, kind: str, longest: int) -> DataFrame:
    """id, number, from, to of each ``kind N`` heading at a line's start, up to the next one or ``longest`` characters."""
    pattern = rf"(?im)^{kind}\s+([0-9]+)\b"
    starts = docs.select("id", F.length("text").alias("size"), "text", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count("text", F.lit(pattern))))).alias("k"), F.regexp_extract_all("text", F.lit(pattern), 1).alias("numbers"), F.split("text", pattern).alias("between")).where(F.size("numbers") > 0)
    headings = F.regexp_extract_all(F.col("text"), F.lit(rf"({pattern})"), 1)
    before = F.aggregate(F.slice("between", 1, F.col("k")), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(headings, 1, F.col("k") - 1), F.lit(0), lambda s, x: s + F.length(x))
    placed = starts.select("id", F.element_at("numbers", F.col("k")).cast("int").alias("number"), before.alias("from"), "size")
    after = F.lead("from").over(Window.partitionBy("id").orderBy("from"))
    return placed.withColumn("to", F.least(F.coalesce(after, "size"), F.col("from") + longest)).select("id", "number", "from", "to")
