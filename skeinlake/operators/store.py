"""Look-ups and upkeep of stored nodes, edges, vectors, sessions and provenance. All joins are on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.shared import written
from skeinlake.operators.graph import KEY, Graph

#: A source reference names its dataset, data item and run.
SEPARATOR = "/"


def is_empty(graph: Graph) -> DataFrame:
    """One row: whether there is no node."""
    return graph.nodes.limit(1).agg((F.count("*") == 0).alias("is_empty"))


def reference(dataset: Column, data: Column, run: Column) -> Column:
    return F.concat_ws(SEPARATOR, dataset, data, run)


def with_reference(rows: DataFrame, key: str, column: str = "source_refs") -> DataFrame:
    """Rows that hold a source reference."""
    return rows.where(F.array_contains(column, key))


def references_of(rows: DataFrame, keys: Sequence[str], dataset: str | None = None, run: str | None = None, column: str = "source_refs") -> DataFrame:
    """keys and the sorted references of a dataset, or of a run; rows without any are left out."""
    part = 0 if dataset is not None else 2
    mine = F.filter(column, lambda r: F.split(r, SEPARATOR)[part] == (dataset if dataset is not None else run))
    return rows.select(*keys, F.array_sort(F.array_distinct(mine)).alias("refs")).where(F.size("refs") > 0)


def delete_data(rows: DataFrame, asked: DataFrame, keys: Sequence[str], fields: Sequence[str], column: str = "source_refs") -> DataFrame:
    """What deleting needs to know of the asked rows: keys, indexed fields, and the parts of their references."""
    part = lambda k, name: F.array_sort(F.array_distinct(F.transform(column, lambda r: F.split(r, SEPARATOR)[k]))).alias(name)
    asked_for = rows.join(asked.select(*keys).distinct(), list(keys), "left_semi")
    return asked_for.select(*keys, *fields, F.col(column), part(0, "datasets"), part(1, "data"), part(2, "runs"))


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows (vectors, turns, sessions) but those with an id in ``ids``."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def pruned(collections: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Collections that stay when all others are dropped."""
    return collections.where(F.col("collection").isin(*keep)) if keep else collections.where("false")


def noted(stored: DataFrame, values: DataFrame) -> DataFrame:
    """Metadata (key, value): the new value of each key, or the stored one."""
    new = values.dropDuplicates(["key"]).select("key", F.col("value").alias("_new"), F.lit(True).alias("_set"))
    return stored.join(new, "key", "full_outer").select("key", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def orphaned_labels(owned: DataFrame, dataset: str) -> DataFrame:
    """Labels of node sets that only this dataset has: owned(dataset, label)."""
    return owned.groupBy("label").agg((F.min("dataset") == F.max("dataset")).alias("alone"), F.min("dataset").alias("dataset")).where(F.col("alone") & (F.col("dataset") == dataset)).select("label")


def deletion_counts(owned: DataFrame, dataset: str) -> DataFrame:
    """kind, n of what goes with a dataset, owned by it alone: owned(kind, id, dataset)."""
    mine = owned.groupBy("kind", "id").agg(F.min("dataset").alias("a"), F.max("dataset").alias("b")).where((F.col("a") == dataset) & (F.col("b") == dataset))
    return mine.groupBy("kind").agg(F.count("*").alias("n"))


def statistics(entries: DataFrame) -> DataFrame:
    """entity_type, entries, entities and activities of a provenance log; a row with null type for all."""
    return entries.cube("entity_type").agg(F.count("*").alias("entries"), F.countDistinct("entity_id").alias("entities"), F.countDistinct("activity_id").alias("activities"))


def lineage(parents: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, hops: what the seeds come from, over parents(id, parent), breadth first up to ``depth``."""
    found = written(seeds.select("id", F.lit(0).alias("hops")).distinct(), "lineage")
    front = found
    for hop in range(1, depth + 1):
        step = parents.join(front.select("id"), "id").select(F.col("parent").alias("id")).distinct()
        front = written(step.join(found.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops")), "lineage")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def revisions(entries: DataFrame) -> DataFrame:
    """The versions of each entity, oldest first, numbered from 1, with the number of the last."""
    w = Window.partitionBy("entity_id").orderBy("last_updated", "sequence")
    return entries.withColumn("revision", F.row_number().over(w)).withColumn("latest", F.count("*").over(Window.partitionBy("entity_id")))


def ended(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """Sessions with the asked terminal status, where they still run; a status that is terminal stays."""
    new = asked.select("session_id", F.col("status").alias("_new")).dropDuplicates(["session_id"])
    return sessions.join(new, "session_id", "left").withColumn("status", F.when(F.col("status") == "running", F.coalesce("_new", "status")).otherwise(F.col("status"))).drop("_new")


def unused(items: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Items last accessed longer ago than ``minutes``, or never."""
    return items.where(F.col("last_accessed").isNull() | (F.col("last_accessed") < now - F.make_interval(mins=F.lit(minutes))))


def touched(items: DataFrame, used: DataFrame, key: str = "id") -> DataFrame:
    """Items with the last time they were used, where that is later than what they have."""
    last = used.groupBy(key).agg(F.max("used_at").alias("_used"))
    return items.join(last, key, "left").withColumn("last_accessed", F.greatest("last_accessed", "_used")).drop("_used")


def descriptions(members: DataFrame) -> DataFrame:
    """cluster, text: the distinct non-empty descriptions of a cluster in the order of its members."""
    kept = members.where(F.trim("description") != "").groupBy("cluster", F.trim("description").alias("d")).agg(F.min("position").alias("p"))
    return kept.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "\n").alias("text"))


def nearest_to_seeds(nodes: DataFrame, edges: DataFrame, hops: DataFrame, most: int) -> Graph:
    """The ``most`` nodes nearest to the seeds (hops: id, hops), then by position, and the edges among them."""
    kept = nodes.join(hops, "id", "left").orderBy(F.asc_nulls_last("hops"), "position").limit(most).drop("hops")
    return Graph(kept, Graph(kept, edges).induced(kept).edges)


def best_events(events: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k events of least distance; those without one come last."""
    return events.join(scores, "id", "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf")))).orderBy("distance", "id").limit(k)


def subqueries(rows: DataFrame, most: int = 5) -> DataFrame:
    """Rows with ``subqueries`` trimmed, without blanks and repeats, the first ``most`` as they come; the query itself where none is left."""
    bare = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    clean = F.slice(F.array_distinct(F.filter(F.transform("subqueries", bare), lambda s: s != "")), 1, most)
    query = F.when(bare(F.col("query")) == "", F.col("query")).otherwise(bare(F.col("query")))
    return rows.withColumn("subqueries", F.when(F.size(clean) > 0, clean).otherwise(F.array(query)))


def placed_in_buckets(distances: DataFrame, buckets: DataFrame, most: int, threshold: float) -> DataFrame:
    """item, bucket: of the buckets with room whose mean distance is within the threshold, the nearest, then the smaller."""
    mean = distances.groupBy("item", "bucket").agg(F.avg("distance").alias("mean"))
    open_ = mean.join(buckets.where(F.col("size") < most), "bucket").where(F.col("mean") <= threshold)
    w = Window.partitionBy("item").orderBy("mean", "size", "bucket")
    return open_.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("item", "bucket", "mean")


def set_key(found: DataFrame, group: str, item: str) -> DataFrame:
    """group, key: a text for each set of items that does not depend on their order."""
    return found.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("key"))


def title(text: Column, words: int, frequent: Column, most: int) -> Column:
    """The first words of a text, and its most frequent ones in brackets."""
    return F.concat(F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, words), " "), F.lit("... ["), F.array_join(F.slice(frequent, 1, most), ", "), F.lit("]"))


def edges_of(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """The asked edges."""
    return edges.join(keys.select(*KEY).distinct(), KEY, "left_semi")
