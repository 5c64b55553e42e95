"""Facts of a load that may contradict others: candidates in bounded batches, a judge, edges.

A fact is an edge between two named nodes that isn't structural. Facts that this load has touched meet all
facts they share a node with. At a node both sides are cut into runs of PER_RUN facts, as many as its degree
asks for, and a batch is a run of touched facts with a run of all facts; so a hub's facts are dealt to many
batches of one size, and no task or row holds them all. Runs come from one range sort over all facts by node,
not from a window over a node.

A model judges batches; a function from DataFrame to DataFrame stands in for it.

Defined cases: nodes with a null or empty name, and edges with a null end or relation, make no facts; a repeated
edge is one fact; a pair found at both of its nodes, or in either order, counts once, with its highest confidence
(then the first reason by text); pairs between the same two nodes link nothing and are left out; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.shared import numbered
from skeinlake.operators.graph import KEY, Graph

#: Relations that say how the graph was built, not what is so.
STRUCTURAL = ("contains", "is_part_of", "made_from", "exists_in", "contradicts")
PER_RUN = 100


def facts(graph: Graph, structural: Sequence[str] = STRUCTURAL) -> DataFrame:
    """source_id, target_id, relationship_name, fact: the text of every edge between named nodes."""
    named = graph.nodes.where(F.coalesce(F.col("name"), F.lit("")) != "").groupBy("id").agg(F.min("name").alias("name"))
    side = lambda c: named.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    edges = graph.edges.where(~F.col("relationship_name").isin(*structural)).select(*KEY).distinct()
    text = F.concat_ws(" ", "source_name", F.replace("relationship_name", F.lit("_"), F.lit(" ")), "target_name")
    return edges.join(side("source"), "source_id").join(side("target"), "target_id").select(*KEY, text.alias("fact"))


def _runs(rows: DataFrame, per: int) -> DataFrame:
    """Rows (node, ...) with their run within the node, from 0."""
    placed = numbered(rows, "node", *KEY)
    first = placed.groupBy("node").agg(F.min("n").alias("first"))
    return placed.join(first, "node").withColumn("run", F.floor((F.col("n") - F.col("first")) / per)).drop("n", "first")


def batches(told: DataFrame, load: DataFrame, by: Sequence[str] = ("source_id", "target_id"), per: int = PER_RUN) -> DataFrame:
    """node, touched_run, run, touched, others: facts of the load (edges by their key), and all facts at one of their nodes.

    ``by`` says by which ends facts have to meet: facts about one subject only, or about one object too.
    """
    fact = F.struct(*KEY, "fact")
    ends = F.explode(F.array(*(F.struct(F.lit(c).alias("end"), F.col(c).alias("node")) for c in by)))
    spread = lambda df: df.select(ends.alias("e"), *KEY, "fact").select(F.concat_ws(":", "e.end" if len(by) == 1 else F.lit("any"), "e.node").alias("node"), *KEY, "fact").distinct()
    new = told.join(load.select(*KEY).distinct(), list(KEY), "left_semi")
    here = spread(new)
    around = spread(told).join(here.select("node").distinct(), "node", "left_semi")
    gather = lambda rows, run, name: _runs(rows, per).groupBy("node", F.col("run").alias(run)).agg(F.array_sort(F.collect_list(fact)).alias(name))
    return gather(here, "touched_run", "touched").join(gather(around, "run", "others"), "node").select("node", "touched_run", "run", "touched", "others")


def contradicting(met: DataFrame, judge: Callable[[DataFrame], DataFrame], least: float = 0.0) -> DataFrame:
    """source_id, target_id, relationship_name (contradicts), first_fact, second_fact, confidence, reason.

    ``judge`` takes batches and returns (first, second, confidence, reason), with facts as they stand in the
    batch. The edge links the subjects where they differ, else the objects.
    """
    found = judge(met).where(F.col("confidence") >= least).select("first", "second", "confidence", "reason")
    a, b = F.least("first", "second"), F.greatest("first", "second")
    pairs = found.select(a.alias("a"), b.alias("b"), "confidence", "reason").where(~F.col("a").eqNullSafe(F.col("b")))
    once = pairs.groupBy("a", "b").agg(F.max("confidence").alias("confidence"), F.min_by("reason", F.struct(-F.col("confidence"), "reason")).alias("reason"))
    differ = F.col("a.source_id") != F.col("b.source_id")
    end = lambda x: F.when(differ, F.col(f"{x}.source_id")).when(F.col("a.target_id") != F.col("b.target_id"), F.col(f"{x}.target_id"))
    linked = once.select(end("a").alias("source_id"), end("b").alias("target_id"), F.lit("contradicts").alias("relationship_name"), F.col("a.fact").alias("first_fact"), F.col("b.fact").alias("second_fact"), "confidence", "reason")
    return linked.where("source_id is not null")


def same_subject_other_object(met: DataFrame) -> DataFrame:
    """A judge for relations that can hold only one value: equal subject and relation, another object."""
    pairs = met.select(F.explode("touched").alias("first"), "others").select("first", F.explode(F.filter("others", lambda o: (o["source_id"] == F.col("first.source_id")) & (o["relationship_name"] == F.col("first.relationship_name")) & (o["target_id"] != F.col("first.target_id")))).alias("second"))
    return pairs.select("first", "second", F.lit(1.0).alias("confidence"), F.lit("one value only").alias("reason"))
