"""What an answer rests on: facts beside entities, elements used, evidence in order.

Triplets are (query_id, rank, source_id, target_id, relationship_name), hits are (query_id, id, text, rank).

Defined cases: triplets with a null end or query, and hits without an id or text, are left out; a triplet without a relation
gives its nodes and no edge; an element counts once a query, at its first place; ties of ranks go by id; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.ids import edge_id

# fixed values: the sentence that a chunk's mention of an entity has, and the fewest words of a fact
MENTION = "Document chunk mentions "
FACT_WORDS = 3


def shown_fact(text: Column) -> Column:
    """A mention without its sentence's beginning, in a capital; other facts as they are."""
    rest = F.substr(text, F.lit(len(MENTION) + 1))
    return F.when(F.startswith(text, F.lit(MENTION)), F.concat(F.upper(F.substr(rest, F.lit(1), F.lit(1))), F.substr(rest, F.lit(2)))).otherwise(text)


def facts_for_entities(hits: DataFrame, entity_edges: DataFrame, k: int, edge_budget: int, scoped: DataFrame | None = None) -> DataFrame:
    """query_id, id, text, place (from 1): the best k facts of each query that its entities' edges (query_id, entity, id) don't show already.

    ``scoped`` (query_id, id) are the facts that edges in the queries' node sets express: with it only these count, and k stays k.
    Without it, a query none of whose entities was found spends the edges' budget on facts.
    """
    rows = hits.dropna(subset=["query_id", "id", "text"])
    if scoped is not None:
        rows = rows.join(scoped.select("query_id", "id"), ["query_id", "id"], "left_semi")
    fresh = rows.where(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= FACT_WORDS).join(entity_edges.select("query_id", "id"), ["query_id", "id"], "left_anti")
    once = fresh.groupBy("query_id", "id").agg(F.min(F.struct("rank", "text")).alias("best")).select("query_id", "id", "best.rank", "best.text")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
    most = F.lit(k)
    if scoped is None and edge_budget != k:
        found = entity_edges.select("query_id").distinct().withColumn("found", F.lit(True))
        placed = placed.where(F.col("place") <= max(k, edge_budget)).join(found, "query_id", "left")
        most = F.when(F.coalesce("found", F.lit(False)), k).otherwise(edge_budget)
    return placed.where(F.col("place") <= most).select("query_id", "id", shown_fact(F.col("text")).alias("text"), "place")


def _read(triplets: DataFrame) -> DataFrame:
    return triplets.dropna(subset=["query_id", "source_id", "target_id"])


def used_elements(triplets: DataFrame) -> DataFrame:
    """query_id, kind (node, edge), id: what the triplets of each query touch; edges by ``edge_object_id`` where they have one."""
    rows = _read(triplets)
    nodes = rows.select("query_id", F.lit("node").alias("kind"), F.explode(F.array("source_id", "target_id")).alias("id"))
    if "edge_object_id" not in triplets.columns:
        return nodes.distinct()
    return nodes.unionByName(rows.where("edge_object_id is not null").select("query_id", F.lit("edge").alias("kind"), F.col("edge_object_id").alias("id"))).distinct()


def context_evidence(triplets: DataFrame, nodes: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """query_id, rank (from 0), kind, artifact_id, label, source_id, target_id, relationship_name: what a context shows, in order.

    First the nodes as they appear (a triplet's source before its target), then the edges, then, where ``segments``
    (artifact_id of an edge, chunk_id, chunk_index) are given, the chunks that support the edges, as kind ``segment``.
    """
    # a triplet goes to its query's task once, instead of both ends and the edge one by one
    rows = _read(triplets).repartition("query_id")
    ends = rows.select("query_id", F.explode(F.array(F.struct(F.col("rank"), F.lit(0).alias("side"), F.col("source_id").alias("artifact_id")), F.struct("rank", F.lit(1).alias("side"), F.col("target_id").alias("artifact_id")))).alias("e")).select("query_id", "e.*")
    shown = ends.groupBy("query_id", "artifact_id").agg(F.min(F.struct("rank", "side")).alias("first"))
    labels = nodes.select(F.col("id").alias("artifact_id"), F.col("name").alias("label")).dropDuplicates(["artifact_id"])
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    of_nodes = shown.join(labels, "artifact_id", "left").select("query_id", F.lit(0).alias("part"), F.struct("first.rank", "first.side", F.lit(0).alias("at")).alias("order"), *none("tie"), F.lit("graph_node").alias("kind"), "artifact_id", F.nullif(F.trim("label"), F.lit("")).alias("label"), *none("source_id", "target_id", "relationship_name"))
    own = F.col("edge_object_id") if "edge_object_id" in triplets.columns else F.lit(None).cast("string")
    edges = rows.where(F.trim("relationship_name") != "").select("query_id", "rank", "source_id", "target_id", "relationship_name", F.coalesce(own, edge_id(F.col("source_id"), F.col("relationship_name"), F.col("target_id"))).alias("artifact_id"))
    once = edges.groupBy("query_id", "artifact_id").agg(F.min(F.struct("rank", "source_id", "target_id", "relationship_name")).alias("e"))
    of_edges = once.select("query_id", F.lit(1).alias("part"), F.struct(F.col("e.rank"), F.lit(0).alias("side"), F.lit(0).alias("at")).alias("order"), *none("tie"), F.lit("graph_edge").alias("kind"), "artifact_id", *none("label"), "e.source_id", "e.target_id", "e.relationship_name")
    parts = of_nodes.unionByName(of_edges)
    if segments is not None:
        supports = once.join(segments.dropna(subset=["artifact_id", "chunk_id"]).select("artifact_id", "chunk_id", "chunk_index").distinct(), "artifact_id")
        parts = parts.unionByName(supports.select("query_id", F.lit(2).alias("part"), F.struct(F.col("e.rank"), F.lit(0).alias("side"), F.col("chunk_index").alias("at")).alias("order"), F.concat_ws(" ", "artifact_id", "chunk_id").alias("tie"), F.lit("segment").alias("kind"), F.col("chunk_id").alias("artifact_id"), *none("label", "source_id", "target_id", "relationship_name")))
    w = Window.partitionBy("query_id").orderBy("part", "order", "tie", "artifact_id")
    return parts.select("query_id", (F.row_number().over(w) - 1).alias("rank"), "kind", "artifact_id", "label", "source_id", "target_id", "relationship_name")
