"""Retrieval plans: scored triplets, fused chunk and summary ranks, merged lists, facts, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.weights import importance_factor, reciprocal_rank, rrf_constant, weighed_distance
from skeinlake.operators.graph import Graph, both_ways


def scored_triplets(graph: Graph, node_hits: DataFrame, edge_hits: DataFrame, k: int, feedback_influence: float = 0.0) -> DataFrame:
    """The k edges of each query with the smallest sum of weighed distances of both ends and the edge.

    node_hits(query_id, id, distance, collection): of several collections the last wins.
    edge_hits(query_id, edge_type, distance): a hit counts for all edges with that text.
    What no search found has the penalty distance. Edges without any hit are all equally bad;
    they enter only where fewer than k have one, in the order of their keys.
    """
    nodes = node_hits.groupBy("query_id", "id").agg(F.max_by("distance", "collection").alias("distance"))
    types = edge_hits.groupBy("query_id", "edge_type").agg(F.min("distance").alias("distance"))
    known = lambda df, c, d: df[c] if c in df.columns else F.lit(d).cast("double")
    side = lambda p: graph.nodes.select(F.col("id").alias(f"{p}_id"), known(graph.nodes, "importance_weight", 0.5).alias(f"{p}_importance"), known(graph.nodes, "feedback_weight", 0.5).alias(f"{p}_feedback"))
    edges = graph.edges.select("source_id", "target_id", "relationship_name", known(graph.edges, "feedback_weight", 0.5).alias("edge_feedback")).join(side("source"), "source_id").join(side("target"), "target_id")
    key = ["query_id", "source_id", "target_id", "relationship_name"]
    at = lambda p: nodes.select("query_id", F.col("id").alias(f"{p}_id"))
    if feedback_influence > 0:
        of = lambda p: edges.join(at(p), f"{p}_id").select(*key)
    else:
        # of a node's edges of one relation whose other end is not hit, only the k with the cheapest other end
        # can be among the best: an edge with both ends hit never costs more than it would with one
        def of(p: str) -> DataFrame:
            other = "target" if p == "source" else "source"
            w = Window.partitionBy(f"{p}_id", "relationship_name").orderBy(-F.col(f"{other}_importance"), *key[1:])
            first = edges.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
            return first.select(*key[1:]).join(at(p), f"{p}_id").select(*key)

    both_hit = edges.select(*key[1:]).join(at("source"), "source_id").join(at("target"), ["query_id", "target_id"]).select(*key)
    by_type = edges.join(types.select("query_id", F.col("edge_type").alias("relationship_name")), "relationship_name").select(*key)
    queries = node_hits.select("query_id").unionByName(edge_hits.select("query_id")).distinct()
    first = edges.orderBy(*key[1:]).limit(4 * k).select(*key[1:])
    candidates = both_hit.unionByName(of("source")).unionByName(of("target")).unionByName(by_type).unionByName(queries.crossJoin(F.broadcast(first)).select(*key)).distinct()
    d = lambda p: nodes.select("query_id", F.col("id").alias(f"{p}_id"), F.col("distance").alias(f"{p}_distance"))
    full = candidates.join(edges, key[1:]).join(d("source"), ["query_id", "source_id"], "left").join(d("target"), ["query_id", "target_id"], "left").join(types.select("query_id", F.col("edge_type").alias("relationship_name"), F.col("distance").alias("edge_distance")), ["query_id", "relationship_name"], "left")
    part = lambda p: weighed_distance(F.col(f"{p}_distance"), F.col(f"{p}_importance"), F.col(f"{p}_feedback"), feedback_influence)
    score = part("source") + part("target") + weighed_distance(F.col("edge_distance"), F.lit(0.5), F.col("edge_feedback"), feedback_influence)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6), *key[1:])
    return full.select(*key, score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fused(chunks: DataFrame, summaries: DataFrame, k: int, importance: bool = True) -> DataFrame:
    """id, rrf, score, rank of chunks by reciprocal ranks of both lists (id, rank from 0), times importance."""
    constant = rrf_constant(k)
    c = chunks.select("id", F.col("rank").alias("vector_rank"), (F.col("importance_weight") if "importance_weight" in chunks.columns else F.lit(None).cast("double")).alias("importance"))
    both = c.join(summaries.select("id", F.col("rank").alias("summary_rank")), "id", "full")
    rrf = reciprocal_rank(F.col("vector_rank"), constant) + reciprocal_rank(F.col("summary_rank"), constant)
    scored = both.select("id", rrf.alias("rrf"), (rrf * (importance_factor(F.col("importance")) if importance else F.lit(1.0))).alias("score"), F.least("vector_rank", "summary_rank").alias("least"))
    return scored.orderBy(F.desc(F.round("score", 9)), F.desc(F.round("rrf", 9)), "least", "id").limit(k).select("id", "rrf", "score")


def merged(primary: DataFrame, secondary: DataFrame, k: int, reserve: int = 0) -> DataFrame:
    """id, rank: what both lists (id, rank) hold, then the primary's, then the secondary's, ``reserve`` places kept for the last."""
    p, s = primary.select("id", F.col("rank").alias("p")), secondary.select("id", F.col("rank").alias("s"))
    tier = F.when(F.col("p").isNotNull() & F.col("s").isNotNull(), 0).when(F.col("p").isNotNull(), 1).otherwise(2)
    placed = p.join(s, "id", "full").select("id", tier.alias("tier"), F.coalesce("p", "s").alias("at"))
    best = lambda df, n: df.orderBy("tier", "at", "id").limit(n)
    only = placed.where("tier = 2").orderBy("at", "id").limit(reserve)
    head = best(placed.join(only.select("id"), "id", "left_anti"), k - reserve) if reserve else best(placed, k)
    chosen = head.unionByName(only) if reserve else head
    # the reserve that the secondary does not fill goes back to the rest
    spare = best(placed.join(chosen.select("id"), "id", "left_anti"), k) if reserve else None
    ranked = chosen.withColumn("late", F.lit(0))
    if spare is not None:
        ranked = ranked.unionByName(spare.withColumn("late", F.lit(1)))
    # at most 2k rows by now
    w = Window.orderBy("late", "tier", "at", "id")
    kept = ranked.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return kept.select("id", F.row_number().over(Window.orderBy("tier", "at", "id")).alias("rank"))


def conversational_reserve(limit: int) -> int:
    return 0 if limit <= 2 else max(1, limit // 3)


def facts(hits: DataFrame, shown: DataFrame, k: int, least_words: int = 3) -> DataFrame:
    """text, distance: edge texts by distance, not among those shown, of three words or more, once each."""
    fresh = hits.join(shown.select("text"), "text", "left_anti").where(F.size(F.split(F.trim("text"), r"\s+")) >= least_words)
    return fresh.groupBy("text").agg(F.min("distance").alias("distance")).orderBy("distance", "text").limit(k)


def entity_lane(graph: Graph, hits: DataFrame, most: int) -> DataFrame:
    """For each hit entity (id, rank) its edges, type edges first, then by key, at most ``most``."""
    by = lambda here: graph.edges.join(hits.select(F.col("id").alias(here), "rank"), here).select(F.col(here).alias("entity"), "rank", "source_id", "target_id", "relationship_name")
    every = by("source_id").unionByName(by("target_id")).distinct()
    w = Window.partitionBy("entity").orderBy(F.when(F.col("relationship_name") == "is_a", 0).otherwise(1), "source_id", "target_id", "relationship_name")
    return every.withColumn("edge_rank", F.row_number().over(w)).where(F.col("edge_rank") <= most)


def in_period(moments: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Moments (id, at) within inclusive bounds; a missing bound is open."""
    if start is not None:
        moments = moments.where(F.col("at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        moments = moments.where(F.col("at") <= F.lit(end).cast("timestamp"))
    return moments


def events_near(graph: Graph, moments: DataFrame, event_type: str = "Event") -> DataFrame:
    """Distinct events within two undirected steps of the moments."""
    one = both_ways(graph.edges).distinct()
    first = one.join(moments.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    second = one.join(first.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
    near = first.unionByName(second).distinct()
    return graph.nodes.where(F.col("type") == event_type).join(near, "id", "left_semi")


def lines(triplets: DataFrame) -> DataFrame:
    """value: ``a --[relation]--> b`` of each triplet."""
    return triplets.select(F.concat(F.col("source_name"), F.lit(" --["), F.col("relationship_name"), F.lit("]--> "), F.col("target_name")).alias("value"))
