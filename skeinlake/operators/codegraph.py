"""Snapshots of code as a graph: facts read from lines, nodes with stable ids, what a load changed, what a change touches.

facts: (place, repo, kind, name, file, line, end_line, id, props as JSON text). nodes: (id, repo, kind, type, name, file, line,
end_line, symbol_kind, description, properties, fact_hash). edges: (source_id, target_id, relationship_name).

Defined cases: lines that are no JSON object are left out and counted; facts without a name, or of a kind nobody names,
give no node and are counted; of facts with one repository, kind and name the first in the snapshot counts; relations to nodes that
are not there are left out; empty snapshots give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlake.functions import ids
from skeinlake.operators.graph import KEY

# fixed values: what facts of a kind become, and the symbols that have methods and constructors
TYPES = {
    "route": "ApiEndpoint", "association": "CodeAssociation", "extraction": "CodeExtractionAccount", "insight": "CodeInsight", "intent": "CodeIntent",
    "lint": "CodeLintFinding", "module": "CodeModule", "service": "CodeService", "symbol": "CodeSymbol", "test_ref": "CodeTestReference",
    "file_ref": "CodeFileReference", "dependency": "ExternalDependency",
}
TYPE_SYMBOLS = ("struct", "class", "interface", "type")
SAMPLE = 20  # names shown of what a load added, updated or removed


def snapshot(spark: SparkSession, path: str, repo: str) -> tuple[DataFrame, DataFrame]:
    """(facts, refused) of a snapshot's lines of JSON; ``repo`` is the repository of facts that name none. refused: one row, lines."""
    lines = spark.read.text(path).select(F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"), F.trim("value").alias("value")).where("value <> ''")
    read = lines.withColumn("fact", F.try_parse_json("value")).withColumn("ok", F.coalesce(F.startswith(F.schema_of_variant("fact"), F.lit("OBJECT")), F.lit(False)))
    # a field of another type than it should have counts as missing
    typed = lambda name, kind: F.when(F.schema_of_variant(F.variant_get("fact", f"$.{name}", "variant")) == kind, F.variant_get("fact", f"$.{name}", "string"))
    number = lambda name: typed(name, "BIGINT").cast("int")
    props = F.variant_get("fact", "$.props", "variant")
    told = F.when(F.startswith(F.schema_of_variant(props), F.lit("OBJECT")), F.to_json(props)).otherwise("{}")
    facts = read.where("ok").select("place", F.coalesce(F.nullif(typed("repo", "STRING"), F.lit("")), F.lit(repo)).alias("repo"), typed("kind", "STRING").alias("kind"), typed("name", "STRING").alias("name"), typed("file", "STRING").alias("file"), number("line").alias("line"), number("end_line").alias("end_line"), typed("id", "STRING").alias("id"), told.alias("props"))
    return facts, read.agg(F.count_if(~F.col("ok")).alias("lines"))


def node_id(repo: Column, kind: Column, name: Column) -> Column:
    return ids.uuid5(F.to_json(F.array(F.lit("code"), repo, kind, name)))


def _property(name: str) -> Column:
    return F.try_variant_get(F.parse_json("props"), f"$.{name}", "string")


def mapped(facts: DataFrame, types: Mapping[str, str] = TYPES) -> DataFrame:
    """Nodes of the facts whose kind ``types`` names, and a node of type CodeRepository for each repository."""
    kinds = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    named = facts.where("name <> ''").withColumn("type", F.element_at(kinds, F.col("kind"))).where("type is not null")
    first = named.groupBy("repo", "kind", "name").agg(F.min_by(F.struct("type", "file", "line", "end_line", "id", "props"), "place").alias("f")).select("repo", "kind", "name", "f.*")
    told = F.when(F.col("kind") == "insight", _property("description"))
    symbol = F.when(F.col("type") == "CodeSymbol", _property("symbol_kind"))
    content = F.sha2(F.to_json(F.struct("repo", "kind", "name", "file", "line", "end_line", "id", "props")), 256)
    nodes = first.select(node_id(F.col("repo"), F.col("kind"), F.col("name")).alias("id"), "repo", "kind", "type", "name", "file", "line", "end_line", symbol.alias("symbol_kind"), told.alias("description"), F.col("props").alias("properties"), content.alias("fact_hash"))
    roots = facts.select("repo").distinct().select(node_id(F.col("repo"), F.lit("repository"), F.col("repo")).alias("id"), "repo", F.lit("repository").alias("kind"), F.lit("CodeRepository").alias("type"), F.col("repo").alias("name"))
    return nodes.unionByName(roots, allowMissingColumns=True)


def not_mapped(facts: DataFrame, types: Mapping[str, str] = TYPES) -> DataFrame:
    """kind, reason, facts: how many facts gave no node of their own, by kind and reason (unknown_kind, no_name, repeated)."""
    known = F.coalesce(F.col("kind").isin(*types), F.lit(False))
    groups = facts.groupBy("kind", known.alias("known"), "repo", F.when(known & (F.col("name") != ""), F.col("name")).alias("name")).agg(F.count("*").alias("n"))
    reason = F.when(~F.col("known"), "unknown_kind").when(F.col("name").isNull(), "no_name").otherwise("repeated")
    lost = F.when(reason == "repeated", F.col("n") - 1).otherwise(F.col("n"))
    return groups.groupBy("kind", reason.alias("reason")).agg(F.sum(lost).alias("facts")).where("facts > 0")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, repo, name, change of nodes: added, updated (another fact_hash), removed."""
    sides = before.select("id", "repo", "name", F.col("fact_hash").alias("old")).join(after.select("id", F.col("repo").alias("_repo"), F.col("name").alias("_name"), F.col("fact_hash").alias("new"), F.lit(True).alias("here")), "id", "full")
    was, now = F.col("name").isNotNull(), F.coalesce("here", F.lit(False))
    what = F.when(~was, "added").when(~now, "removed").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    return sides.select("id", F.coalesce("_repo", "repo").alias("repo"), F.coalesce("_name", "name").alias("name"), what.alias("change")).where("change is not null")


def delta(before: DataFrame, after: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> DataFrame:
    """repo, change, nodes, edges, samples: what a load did to each repository; samples are the first ``SAMPLE`` names.

    An edge belongs to the repository of its source. Repositories without a change have no row.
    """
    nodes = changed(before, after)
    w = Window.partitionBy("repo", "change").orderBy("name", "id")
    first = nodes.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= SAMPLE).groupBy("repo", "change").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "name"))), lambda x: x["name"]).alias("samples"))
    counted = nodes.groupBy("repo", "change").agg(F.count("*").alias("nodes"))
    gone = lambda a, b, what: a.select(*KEY).distinct().join(b.select(*KEY), list(KEY), "left_anti").withColumn("change", F.lit(what))
    homes = before.select("id", "repo").unionByName(after.select("id", "repo")).groupBy(F.col("id").alias("source_id")).agg(F.min("repo").alias("repo"))
    moved = gone(edges_after, edges_before, "added").unionByName(gone(edges_before, edges_after, "removed"))
    of_edges = moved.join(homes, "source_id").groupBy("repo", "change").agg(F.count("*").alias("edges"))
    full = counted.join(first, ["repo", "change"]).join(of_edges, ["repo", "change"], "full")
    return full.select("repo", "change", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def _package(name: Column, file: Column) -> Column:
    """What stands before a name's last dot, else the file's folder (the file, where it has none)."""
    dotted = F.regexp_extract(name, r"(?s)^(.*)\.", 1)
    return F.when(F.contains(name, F.lit(".")), dotted).otherwise(F.regexp_replace(F.coalesce(file, F.lit("")), "(?s)/[^/]*$", ""))


def impact_seeds(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """id: the targets, and of those that are types their methods and their package's constructor ``New<Type>`` in the same repository."""
    at = nodes.select("id", "repo", "type", "symbol_kind", "name", "file", _package(F.col("name"), F.col("file")).alias("package"))
    chosen = at.join(targets.select("id").distinct(), "id", "left_semi")
    types = chosen.where((F.col("type") == "CodeSymbol") & F.col("symbol_kind").isin(*TYPE_SYMBOLS))
    methods = edges.where("relationship_name = 'has_method'").join(types.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).join(at.select("id"), "id", "left_semi")
    short = F.regexp_extract("name", r"(?s)([^.]*)$", 1)
    made = F.when(F.contains("name", F.lit(".")), F.concat("package", F.lit(".New"), short)).otherwise(F.concat(F.lit("New"), short))
    wanted = types.select("repo", "package", made.alias("name")).distinct()
    constructors = at.join(wanted, ["repo", "package", "name"], "left_semi").select("id")
    return chosen.select("id").unionByName(methods).unionByName(constructors).distinct()


def relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, place, relation, target_id, target: the relations of each fact in order (from 0), by relation, then target's name, file, line and id.

    A row a relation, so a fact that everything refers to is not one row. ``place`` is the number in that order within the fact.
    """
    target = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"))
    here = edges.select(*KEY).dropna().distinct().join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(target, "target_id")
    w = Window.partitionBy("source_id").orderBy("relationship_name", F.coalesce("target", F.lit("")), "file", "line", "target_id")
    return here.select(F.col("source_id").alias("id"), (F.row_number().over(w) - 1).alias("place"), F.col("relationship_name").alias("relation"), "target_id", "target")
