"""Set operations on a property graph of two tables.

nodes(id, name, type, ...) and edges(source_id, target_id, relationship_name, ...). All are
equi-joins, semi-joins and aggregations; ids given by a caller come as DataFrames, so that
Spark decides from their size how to join them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.ids import edge_id
from skeinlake.functions.text import edge_text

KEY = ["source_id", "target_id", "relationship_name"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def induced(self, ids: DataFrame) -> Graph:
        """The nodes among ``ids`` (column id) and the edges with both ends there."""
        keep = ids.select("id").distinct()
        return Graph(self.nodes.join(keep, "id", "left_semi"), semi(semi(self.edges, "source_id", keep), "target_id", keep))

    def filtered(self, attributes: Mapping[str, Sequence]) -> Graph:
        """Nodes whose attributes all have one of the given values, with induced edges."""
        condition = F.lit(True)
        for name, values in attributes.items():
            condition &= F.col(name).isin(*values)
        return self.induced(self.nodes.where(condition))

    def touching(self, ids: DataFrame) -> Graph:
        """Edges with either end in ``ids`` and all their end nodes; isolated ids are left out."""
        keep = ids.select("id").distinct()
        edges = touching(self.edges, keep)
        return Graph(self.nodes.join(ends(edges), "id", "left_semi"), edges)

    def node_set(self, node_type: str, names: Sequence[str], every: bool = False) -> Graph:
        """The nodes of a type with given names, and what is adjacent to any (or to every) one of them that exists."""
        primary = self.nodes.where((F.col("type") == node_type) & F.col("name").isin(*names)).select("id").distinct()
        pairs = both_ways(self.edges).join(primary.withColumnRenamed("id", "a"), "a").where("a <> b")
        near = pairs.groupBy(F.col("b").alias("id")).agg(F.countDistinct("a").alias("n"))
        if every:
            near = near.join(F.broadcast(primary.agg(F.count("*").alias("wanted"))), F.col("n") == F.col("wanted"))
        return self.induced(primary.unionByName(near.select("id")))

    def triplets(self) -> DataFrame:
        """Each edge with the names and types of both ends; edges without an end node are left out."""
        side = lambda p: self.nodes.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("type").alias(f"{p}_type"))
        return self.edges.join(side("source"), "source_id").join(side("target"), "target_id")

    def degree(self) -> DataFrame:
        """id, degree: edges at each node, a loop counting twice; nodes without an edge are left out."""
        return self.edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))

    def disconnected(self) -> DataFrame:
        return self.nodes.join(ends(self.edges), "id", "left_anti")


def semi(edges: DataFrame, side: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Edges whose ``side`` is in (or, as left_anti, not in) ids."""
    return edges.join(ids.select(F.col("id").alias(side)), side, how).select(*edges.columns)


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end in ids: an OR of two equi-joins, each edge once."""
    first = semi(edges, "source_id", ids)
    return first.unionByName(semi(semi(edges, "source_id", ids, "left_anti"), "target_id", ids))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b for each edge in both directions."""
    return edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b")))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """a, b: distinct neighbours in either direction of each id, itself at a loop."""
    return both_ways(edges).join(ids.select(F.col("id").alias("a")), "a", "left_semi").distinct()


def directed_neighbours(edges: DataFrame, ids: DataFrame, forward: bool = True, relationship: str | None = None) -> DataFrame:
    """id, neighbour: successors or predecessors, by relationship if one is given."""
    here, there = ("source_id", "target_id") if forward else ("target_id", "source_id")
    chosen = edges if relationship is None else edges.where(F.col("relationship_name") == relationship)
    return semi(chosen, here, ids.select("id")).select(F.col(here).alias("id"), F.col(there).alias("neighbour")).distinct()


def existing(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Which of the asked triples exist."""
    return asked.join(edges.select(*KEY), KEY, "left_semi").select(*KEY).distinct()


def page(triplets: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of triplets in the order of their keys."""
    return triplets.orderBy(*KEY).offset(offset).limit(limit)


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Stored and new rows with one row a key: the new one, of several new ones the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if order else F.lit(1))
    last = new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return stored.join(last.select(*keys), list(keys), "left_anti").select(*stored.columns).unionByName(last.select(*stored.columns))


def inserted_if_new(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows and those new ones whose key is not stored."""
    return stored.unionByName(new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def updated(stored: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """One column set where ``values`` (key, column) has a value."""
    new = values.select(F.col(key).alias("_key"), F.col(column).alias("_new")).dropDuplicates(["_key"])
    return stored.join(new, stored[key] == new["_key"], "left").withColumn(column, F.coalesce("_new", column)).drop("_key", "_new")


def deleted(graph: Graph, ids: DataFrame) -> Graph:
    """Without the nodes in ids and all their edges."""
    gone = ids.select("id").distinct()
    return Graph(graph.nodes.join(gone, "id", "left_anti"), semi(semi(graph.edges, "source_id", gone, "left_anti"), "target_id", gone, "left_anti"))


def edges_deleted(edges: DataFrame, triples: DataFrame) -> DataFrame:
    return edges.join(triples.select(*KEY).distinct(), KEY, "left_anti").select(*edges.columns)


def refs_attached(df: DataFrame, ids: DataFrame, refs: Sequence[str], key: str = "id", column: str = "source_refs") -> DataFrame:
    """Provenance references added as a set to the rows in ids."""
    mark = ids.select(F.col(key).alias("_key"), F.lit(True).alias("_hit")).distinct()
    add = F.array_union(F.coalesce(column, F.array().cast("array<string>")), F.array(*map(F.lit, refs)))
    return df.join(mark, df[key] == mark["_key"], "left").withColumn(column, F.when(F.col("_hit"), add).otherwise(F.col(column))).drop("_key", "_hit")


def refs_removed(df: DataFrame, refs: Sequence[str], column: str = "source_refs") -> DataFrame:
    """References removed; ``orphaned`` tells the rows that are left with none."""
    left = F.array_except(column, F.array(*map(F.lit, refs)))
    return df.withColumn("orphaned", (F.size(column) > 0) & (F.size(left) == 0)).withColumn(column, left)


def tags_removed(df: DataFrame, tags: Sequence[str], column: str = "belongs_to_set") -> DataFrame:
    return df.withColumn(column, F.array_except(column, F.array(*map(F.lit, tags))))


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def with_defaults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with id, neutral weight and a sentence for text where they have none."""
    name = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"_{side}"))
    spoken = F.replace(F.col("relationship_name"), F.lit("_"), F.lit(" "))
    sentence = F.concat(F.coalesce("_source", "source_id"), F.lit(" "), spoken, F.lit(" "), F.coalesce("_target", "target_id"), F.lit("."))
    own = F.col("edge_text") if "edge_text" in edges.columns else F.lit(None).cast("string")
    joined = edges.join(name("source"), "source_id", "left").join(name("target"), "target_id", "left")
    return joined.select(*KEY, edge_id(F.col("source_id"), F.col("relationship_name"), F.col("target_id")).alias("edge_object_id"), edge_text(own, sentence).alias("edge_text"), F.lit(0.5).alias("feedback_weight"))


def edge_types(edges: DataFrame) -> DataFrame:
    """Distinct edge texts with their number."""
    text = edge_text(F.col("edge_text"), F.col("relationship_name")) if "edge_text" in edges.columns else F.col("relationship_name")
    return edges.groupBy(text.alias("edge_type")).agg(F.count("*").alias("number_of_edges"))


def superseded(edges: DataFrame, functional: Sequence[str]) -> DataFrame:
    """Marks edges of functional relations whose subject has a later target: by time as text, then position.

    Needs ``updated_at`` (text) and ``position``; edges to the winner's target are not marked.
    """
    w = Window.partitionBy("source_id", "relationship_name")
    win = F.max(F.struct("updated_at", "position", "target_id")).over(w)["target_id"]
    several = F.min("target_id").over(w) != F.max("target_id").over(w)
    return edges.withColumn("superseded", F.col("relationship_name").isin(*functional) & several & (F.col("target_id") != win))


def repointed(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges that change when ids are replaced (remap: id, canonical), without loops that arise."""
    to = lambda side: remap.select(F.col("id").alias(side), F.col("canonical").alias(f"_{side}"))
    new = edges.join(to("source_id"), "source_id", "left").join(to("target_id"), "target_id", "left")
    s, t = F.coalesce("_source_id", "source_id"), F.coalesce("_target_id", "target_id")
    changed = F.col("_source_id").isNotNull() | F.col("_target_id").isNotNull()
    return new.where(changed & (s != t)).select(s.alias("source_id"), t.alias("target_id"), "relationship_name").distinct()


def rolled_up(edges: DataFrame, module: DataFrame) -> DataFrame:
    """Edges between modules (module: id, module), inner ones dropped, counted by relationship."""
    of = lambda side: module.select(F.col("id").alias(f"{side}_id"), F.col("module").alias(f"{side}_module"))
    lifted = edges.join(of("source"), "source_id").join(of("target"), "target_id").where("source_module <> target_module")
    return lifted.groupBy("source_module", "target_module", "relationship_name").agg(F.count("*").alias("number_of_edges"))


def type_schema(graph: Graph, top: int) -> DataFrame:
    """Relations between node types with their number; types beyond the ``top`` most frequent are one 'other'."""
    kinds = graph.nodes.groupBy("type").agg(F.count("*").alias("n"))
    kept = kinds.orderBy(F.desc("n"), "type").limit(top).select("type", F.col("type").alias("kept"))
    named = graph.nodes.join(kept, "type", "left").select("id", F.coalesce("kept", F.lit("other")).alias("kind"))
    of = lambda side: named.select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"))
    return graph.edges.join(of("source"), "source_id").join(of("target"), "target_id").groupBy("source_kind", "relationship_name", "target_kind").agg(F.count("*").alias("number_of_edges"))


def exclusive(owned: DataFrame, item: str, owner: str) -> DataFrame:
    """(item, owner) of items with one owner only: what goes when the owner goes."""
    return owned.select(item, owner).distinct().groupBy(item).agg(F.count("*").alias("_n"), F.min(owner).alias(owner)).where("_n = 1").select(item, owner)
