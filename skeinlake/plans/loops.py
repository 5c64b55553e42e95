"""Retrieval in rounds: a batch of queries asks on until nothing new comes, or asks in parts.

Every round joins only what the round before found: a query that got no new triplet asks no more. What a model
would write in between (the next question, the parts of a question) is a function from DataFrame to DataFrame.

A triplet is (source_id, target_id, relationship_name). Defined cases: triplets with a null in their key and queries
without an id are left out; a triplet counts once for a query, at its first round or part; no queries or no
triplets give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.shared import release, written
from skeinlake.operators.graph import KEY

Retrieve = Callable[[DataFrame], DataFrame]
_ROW = ("query_id", *KEY)


def _known(triplets: DataFrame) -> DataFrame:
    return triplets.select(*_ROW).dropna()


def extended(queries: DataFrame, retrieve: Retrieve, follow: Callable[[DataFrame, DataFrame], DataFrame], rounds: int = 4) -> DataFrame:
    """query_id, triplet, round: what each query finds, then what its follow-up questions find that is new.

    ``retrieve`` takes questions (with query_id) and returns triplets; ``follow`` takes the triplets of the queries
    that still go on, and those of the last round, and returns their next questions.
    """
    new = written(_known(retrieve(queries)).distinct().withColumn("round", F.lit(0)), "extended")
    parts = [new]
    for n in range(1, rounds + 1):
        found = reduce(DataFrame.unionByName, parts)
        going = found.join(new.select("query_id").distinct(), "query_id", "left_semi")
        fresh = _known(retrieve(follow(going, new))).distinct().join(found.select(*_ROW), list(_ROW), "left_anti")
        new = written(fresh.withColumn("round", F.lit(n)), "extended")
        if new.isEmpty():
            release(new)
            break
        parts.append(new)
    return reduce(DataFrame.unionByName, parts)


def decomposed(parts: DataFrame, retrieve: Retrieve) -> DataFrame:
    """query_id, triplet, part: what the parts (query_id, part, ...) of each query find, each triplet with the first part that finds it.

    The parts are asked as one batch: ``retrieve`` sees them as questions whose query_id is (query_id, part).
    """
    asked = parts.where("query_id is not null and part is not null").withColumn("query_id", F.struct("query_id", "part"))
    found = _known(retrieve(asked)).select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.part").alias("part"), *KEY)
    return found.groupBy("query_id", *KEY).agg(F.min("part").alias("part"))


def at_nodes(edges: DataFrame) -> Retrieve:
    """Retrieval of the edges at the nodes (column id) that a question names."""
    def retrieve(questions: DataFrame) -> DataFrame:
        asked = questions.select("query_id", "id").distinct()
        end = lambda c: edges.join(asked.withColumnRenamed("id", c), c).select(*_ROW)
        return end("source_id").unionByName(end("target_id"))

    return retrieve


def ends_of_new(found: DataFrame, new: DataFrame) -> DataFrame:
    """Follow-up questions that name both ends of the last triplets."""
    return new.select("query_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
