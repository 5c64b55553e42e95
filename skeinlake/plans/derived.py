"""A property graph, vectors and logs derived from the plain tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def graph(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("region", "nation", "customer", "supplier", "part")) -> Graph:
    """Nodes of the given kinds and the edges among them: in_region, in_nation, supplies (distinct pairs)."""
    read = lambda n: table(spark, sf_dir, n)
    node = lambda df, kind, key, name, group=None: df.select(_key(kind, key).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), (F.col(group) if group else F.lit(None).cast("string")).alias("node_set"))
    edge = lambda df, a, b, r: df.select(a.alias("source_id"), b.alias("target_id"), F.lit(r).alias("relationship_name"))
    nodes = {
        "region": lambda: node(read("region"), "region", "r_regionkey", "r_name"),
        "nation": lambda: node(read("nation"), "nation", "n_nationkey", "n_name"),
        "customer": lambda: node(read("customer"), "customer", "c_custkey", "c_name", "c_mktsegment"),
        "supplier": lambda: node(read("supplier"), "supplier", "s_suppkey", "s_name"),
        "part": lambda: node(read("part"), "part", "p_partkey", "p_name", "p_brand"),
    }
    edges = {
        ("nation", "region"): lambda: edge(read("nation"), _key("nation", "n_nationkey"), _key("region", "n_regionkey"), "in_region"),
        ("customer", "nation"): lambda: edge(read("customer"), _key("customer", "c_custkey"), _key("nation", "c_nationkey"), "in_nation"),
        ("supplier", "nation"): lambda: edge(read("supplier"), _key("supplier", "s_suppkey"), _key("nation", "s_nationkey"), "in_nation"),
        ("supplier", "part"): lambda: edge(read("lineitem").select("l_suppkey", "l_partkey").distinct(), _key("supplier", "l_suppkey"), _key("part", "l_partkey"), "supplies"),
    }
    all_nodes = all_edges = None
    for kind in kinds:
        all_nodes = nodes[kind]() if all_nodes is None else all_nodes.unionByName(nodes[kind]())
    for pair, make in edges.items():
        if set(pair) <= set(kinds):
            all_edges = make() if all_edges is None else all_edges.unionByName(make())
    return Graph(all_nodes, all_edges)


SQL_NODES = {
    "region": "SELECT 'region:' || r_regionkey AS id, r_name AS name, 'region' AS type, NULL::VARCHAR AS node_set FROM region",
    "nation": "SELECT 'nation:' || n_nationkey AS id, n_name AS name, 'nation' AS type, NULL::VARCHAR AS node_set FROM nation",
    "customer": "SELECT 'customer:' || c_custkey AS id, c_name AS name, 'customer' AS type, c_mktsegment AS node_set FROM customer",
    "supplier": "SELECT 'supplier:' || s_suppkey AS id, s_name AS name, 'supplier' AS type, NULL::VARCHAR AS node_set FROM supplier",
    "part": "SELECT 'part:' || p_partkey AS id, p_name AS name, 'part' AS type, p_brand AS node_set FROM part",
}
SQL_EDGES = {
    ("nation", "region"): "SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'in_region' AS relationship_name FROM nation",
    ("customer", "nation"): "SELECT 'customer:' || c_custkey AS source_id, 'nation:' || c_nationkey AS target_id, 'in_nation' AS relationship_name FROM customer",
    ("supplier", "nation"): "SELECT 'supplier:' || s_suppkey AS source_id, 'nation:' || s_nationkey AS target_id, 'in_nation' AS relationship_name FROM supplier",
    ("supplier", "part"): "SELECT DISTINCT 'supplier:' || l_suppkey AS source_id, 'part:' || l_partkey AS target_id, 'supplies' AS relationship_name FROM lineitem",
}


def sql_graph(kinds: tuple[str, ...] = ("region", "nation", "customer", "supplier", "part")) -> str:
    """``nodes`` and ``edges`` as common table expressions, without the WITH."""
    nodes = " UNION ALL ".join(SQL_NODES[k] for k in kinds)
    edges = " UNION ALL ".join(v for k, v in SQL_EDGES.items() if set(k) <= set(kinds))
    return f"nodes AS ({nodes}), edges AS ({edges})"


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vector, collection: embeddings as vectors of parts (odd vec_id: as suppliers), by key modulo the tables' sizes."""
    v = table(spark, sf_dir, "embeddings")
    sizes = {k: table(spark, sf_dir, k).count() for k in ("part", "supplier")}
    part = v.select(F.concat(F.lit("part:"), F.pmod("vec_id", F.lit(sizes["part"])).cast("string")).alias("id"), F.col("embedding").alias("vector"), F.lit("Part_name").alias("collection"), "vec_id")
    supplier = v.select(F.concat(F.lit("supplier:"), F.pmod("vec_id", F.lit(sizes["supplier"])).cast("string")).alias("id"), F.col("embedding").alias("vector"), F.lit("Supplier_name").alias("collection"), "vec_id")
    return part.unionByName(supplier)


def feedback_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """element_id, qa_id, score, position: events as rated uses of an element (user modulo 50), score 1 to 5 by event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.pmod("user_id", F.lit(50)).alias("element_id"), F.col("event_id").alias("qa_id"), (F.pmod("event_id", F.lit(5)) + 1).cast("int").alias("score"), F.col("event_id").alias("position"))
