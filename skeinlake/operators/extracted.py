"""Graphs extracted from chunks: matched with an ontology, brought together, and without containers.

nodes(chunk, id, name, type) and edges(chunk, source_id, target_id, relationship_name) are what a model read in each
chunk. A chunk's nodes and edges are brought together once, as lists, and what is asked within a chunk is asked there; the
ontology is written before it is joined, so that Spark sees its size. All else are joins on keys; a name or container that a
third of all chunks have is one row of the side it is joined to, so Spark can broadcast or split it.

Defined cases: nodes without an id and edges with a null end or relation are left out; names are compared
folded (``folded_quote``), and blank ones match nothing; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.shared import release, written
from skeinlake.functions.text import folded_quote
from skeinlake.operators.graph import KEY, Graph


@dataclass(frozen=True)
class Canonical:
    """``nodes`` and ``edges`` under their canonical ids, and ``counts``: chunk, nodes, dropped_nodes, edges, dropped_edges.

    ``chunks`` has the first two as lists, a row for each chunk.
    """

    nodes: DataFrame
    edges: DataFrame
    counts: DataFrame
    chunks: DataFrame


def _gathered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """chunk, nodes, edges: the distinct nodes (chunk, node) and edges (chunk, edge) of each chunk. Those without a chunk don't meet."""
    rows = nodes.withColumn("apart", F.lit(False)).unionByName(edges.withColumn("apart", F.col("chunk").isNull()), allowMissingColumns=True)
    return rows.groupBy("chunk", "apart").agg(F.collect_set("node").alias("nodes"), F.collect_set("edge").alias("edges")).drop("apart")


def _edges(edges: DataFrame) -> DataFrame:
    return edges.dropna(subset=list(KEY)).select("chunk", F.struct(*KEY).alias("edge"))


def canonical(nodes: DataFrame, edges: DataFrame, ontology: DataFrame, strict: bool = False) -> Canonical:
    """Nodes whose name the ontology (id, name) knows take its id and name; ``ontology_valid`` says which.

    Of several entries with one folded name the smallest id counts. ``strict`` drops nodes without a match, and edges at them.
    Edges follow their nodes within a chunk; ends that the chunk has no node for stay as they are, and go when strict.
    """
    known = ontology.where("id is not null").select(folded_quote(F.col("name")).alias("key"), F.struct("id", "name").alias("entry")).where("key <> ''").groupBy("key").agg(F.min("entry").alias("entry"))
    read = nodes.where("id is not null").withColumn("key", folded_quote(F.col("name"))).join(written(known, "ontology"), "key", "left")
    told = _gathered(read.select("chunk", F.struct("id", "name", "type", "entry").alias("node")), _edges(edges))
    valid = lambda n: n["entry"].isNotNull()
    kept = F.filter("nodes", valid) if strict else F.col("nodes")
    told = told.withColumn("kept", kept)
    # a node of several rows goes to the first entry, else it stays
    ways = F.array_sort(F.transform("kept", lambda n: F.struct(n["id"].alias("old"), (~valid(n)).alias("bare"), F.coalesce(n["entry"]["id"], n["id"]).alias("new"))))
    told = told.withColumn("ways", ways)
    first = F.filter("ways", lambda w, i: (i == 0) | (F.get("ways", i - 1)["old"] != w["old"]))
    told = told.withColumn("names", F.map_from_entries(F.transform(first, lambda w: F.struct(w["old"], w["new"]))))
    to = lambda end: F.try_element_at("names", end)
    both = F.filter("edges", lambda e: to(e["source_id"]).isNotNull() & to(e["target_id"]).isNotNull()) if strict else F.col("edges")
    told = told.withColumn("moved", F.transform(both, lambda e: F.struct(F.coalesce(to(e["source_id"]), e["source_id"]).alias("source_id"), F.coalesce(to(e["target_id"]), e["target_id"]).alias("target_id"), e["relationship_name"].alias("relationship_name"))))
    # edges are counted before ends meet under one id
    size = lambda c: F.size(c).cast("long")
    counts = told.select("chunk", size("nodes").alias("nodes"), (size("nodes") - size("kept")).alias("dropped_nodes"), size("edges").alias("edges"), (size("edges") - size("moved")).alias("dropped_edges"))
    named: Column = F.transform("kept", lambda n: F.struct(F.coalesce(n["entry"]["id"], n["id"]).alias("id"), F.when(valid(n), n["entry"]["name"]).otherwise(n["name"]).alias("name"), n["type"].alias("type"), valid(n).alias("ontology_valid")))
    chunks = told.select("chunk", F.array_distinct(named).alias("nodes"), F.array_distinct("moved").alias("edges"))
    each = lambda c: chunks.select("chunk", F.explode(c).alias("x")).select("chunk", "x.*")
    return Canonical(each("nodes"), each("edges"), counts, chunks)


def integrated(nodes: DataFrame, edges: DataFrame, existing: DataFrame) -> tuple[Graph, DataFrame]:
    """One graph of all chunks' graphs, and owners: (chunk, source_id, target_id, relationship_name) of what each chunk gave.

    A node that several chunks have is taken from the first of them. Edges need both ends among the chunk's own nodes. Each
    chunk contains its nodes. Edges that the graph has already (``existing``) are not added again, but are owned.
    """
    had = nodes.where("id is not null").select("chunk", F.struct("id", "name", "type").alias("node"))
    return integrated_chunks(_gathered(had, _edges(edges)), existing)


def integrated_chunks(chunks: DataFrame, existing: DataFrame) -> tuple[Graph, DataFrame]:
    """``integrated`` of chunks with lists of their nodes and edges (chunk, nodes, edges), a row for each."""
    told = chunks.where("chunk is not null")
    had = told.select("chunk", F.explode("nodes").alias("n"))
    first = had.groupBy("n.id").agg(F.min(F.struct("chunk", "n.name", "n.type")).alias("n")).select("id", "n.name", "n.type")
    told = told.select("chunk", "edges", F.array_distinct("nodes.id").alias("ends"))
    within = F.filter("edges", lambda e: F.array_contains("ends", e["source_id"]) & F.array_contains("ends", e["target_id"]))
    contains = F.transform("ends", lambda i: F.struct(F.col("chunk").cast("string").alias("source_id"), i.alias("target_id"), F.lit("contains").alias("relationship_name")))
    owners = told.select("chunk", F.explode(F.concat(within, contains)).alias("e")).select("chunk", "e.*")
    new = owners.select(*KEY).distinct().join(existing.select(*KEY).distinct(), list(KEY), "left_anti")
    return Graph(first, new), owners


def unwrapped(graph: Graph, containers: DataFrame) -> Graph:
    """The graph without its containers (column id): an edge to one goes to all it holds, through containers inside it.

    What a container holds are the targets of its edges; its other relations go with it. The edge keeps the relation by which the container was
    reached. Containers that hold each other in a circle hold what the others of the circle do; an empty one is reached by nothing.
    Each round follows only the edges that still end in a container, once for each container they have come to.
    """
    boxes = containers.select("id").where("id is not null").distinct()
    edges = graph.edges.select(*KEY).dropna().distinct()
    holds = edges.join(boxes, F.col("source_id") == F.col("id"), "left_semi").select(F.col("source_id").alias("box"), F.col("target_id").alias("inner")).distinct()
    outer = edges.join(boxes, F.col("source_id") == F.col("id"), "left_anti")
    is_box = lambda df: df.join(boxes.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*KEY)
    done = [outer.join(boxes.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*KEY)]
    front = written(is_box(outer), "unwrapped")
    met = [front]
    while not front.isEmpty():
        step = front.join(holds, F.col("target_id") == F.col("box")).select("source_id", F.col("inner").alias("target_id"), "relationship_name").distinct()
        seen = met[0]
        for part in met[1:]:
            seen = seen.unionByName(part)
        fresh = written(step.join(seen, list(KEY), "left_anti").select(*KEY), "unwrapped")
        done.append(fresh.join(boxes.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*KEY))
        front = written(is_box(fresh), "unwrapped")
        met.append(front)
        if len(met) > 8:
            old, met = met, [written(seen.unionByName(front), "unwrapped")]
            front_table = front
            front = written(front_table, "unwrapped")
            for part in old:
                release(part)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return Graph(graph.nodes.join(boxes, "id", "left_anti"), out.distinct())
