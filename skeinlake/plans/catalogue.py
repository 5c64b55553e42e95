"""The registered queries: each operator applied to whole tables, with the same in SQL where SQL can say it.

A query is a function of (spark, sf_dir); ``SQL`` holds DuckDB statements over the same
tables. Search queries ask with every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlake.functions import ids, moments, text, vector, weights
from skeinlake.functions.shared import written
from skeinlake.operators import chunking, consolidation, evaluation, graph, ingest, lexical, nearest, sessions, traversal
from skeinlake.plans import retrieval, router, stages
from skeinlake.plans.derived import feedback_uses, node_vectors, sql_graph, table
from skeinlake.plans.derived import graph as derived_graph
from skeinlake.sources import exports, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SMALL = ("region", "nation", "customer", "supplier")
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"


def _tok(column: str, stop: bool = False) -> str:
    found = _TOKENS.format(c=f"coalesce({column}, '')")
    return f"list_filter({found}, lambda w: w NOT IN ({_STOP}))" if stop else found


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _ids(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "id string")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


# ---------------------------------------------------------------- identity and construction


_UUID = "concat_ws('-', substr(h,1,8), substr(h,9,4), '5' || substr(h,14,3), CASE substr(h,17,1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h,18,3), substr(h,21,12))"
_SHA = "sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode({}))"


@query(f"""
WITH n AS (SELECT n_nationkey AS key, {_SHA.format("'Nation:' || replace(replace(lower(n_name), ' ', '_'), '''', '')")} AS h FROM nation),
     p AS (SELECT p_partkey AS key, {_SHA.format("'Part:' || replace(replace(lower(p_name), ' ', '_'), '''', '') || '|' || replace(replace(lower(p_brand), ' ', '_'), '''', '')")} AS h FROM part)
SELECT 'nation' AS kind, key::BIGINT AS key, {_UUID} AS node_id FROM n UNION ALL SELECT 'part', key, {_UUID} FROM p""")
def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("key"), ids.node_id("Nation", F.col("n_name")).alias("node_id"))
    return nation.unionByName(table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), ids.node_id("Part", F.col("p_name"), F.col("p_brand")).alias("node_id")))


@query(f"""
WITH {sql_graph()}, e AS (SELECT e.*, a.name AS an, b.name AS bn, {_SHA.format("replace(replace(lower(source_id || relationship_name || target_id), ' ', '_'), '''', '')")} AS h
  FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id)
SELECT source_id, target_id, relationship_name, {_UUID} AS edge_object_id, an || ' ' || replace(relationship_name, '_', ' ') || ' ' || bn || '.' AS edge_text, 0.5::DOUBLE AS feedback_weight FROM e""")
def edge_defaults(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    return graph.with_defaults(g.edges, g.nodes)


@query("SELECT 'supplier:' || l_suppkey AS source_id, 'part:' || l_partkey AS target_id, min(l_orderkey * 10 + l_linenumber)::BIGINT AS first_position FROM lineitem GROUP BY ALL")
def edges_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_position"))
    return li.groupBy("source_id", "target_id").agg(F.min("first_position").alias("first_position"))


@query(f"WITH {sql_graph()} SELECT relationship_name AS edge_type, count(*) AS number_of_edges FROM edges GROUP BY 1")
def edge_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_types(derived_graph(spark, sf).edges)


@query("""
SELECT 'part:' || p_partkey AS row_id, column_name, value FROM (
  UNPIVOT (SELECT p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part) ON p_name, p_brand, p_type, p_size INTO NAME column_name VALUE value)""")
def unpivot_cells(spark: SparkSession, sf: str) -> DataFrame:
    return files.cells(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "part", "p_partkey")


@query("""
WITH e AS (
  SELECT 'region:' || r_regionkey AS s, 'table:region' AS t, 'is_part_of' AS r FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'table:nation', 'is_part_of' FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'table:supplier', 'is_part_of' FROM supplier
  UNION ALL SELECT 'region:' || r_regionkey, 'value:region.r_name=' || r_name, 'r_name' FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'value:nation.n_name=' || n_name, 'n_name' FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'value:supplier.s_name=' || s_name, 's_name' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'n_regionkey' FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 's_nationkey' FROM supplier)
SELECT s AS source_id, t AS target_id, r AS relationship_name FROM e""")
def relational_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda n, *c: table(spark, sf, n).select(*c)
    tables = {"region": read("region", "r_regionkey", "r_name"), "nation": read("nation", "n_nationkey", "n_name", "n_regionkey"), "supplier": read("supplier", "s_suppkey", "s_name", "s_nationkey")}
    return files.table_graph(tables, {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey"}, {("nation", "n_regionkey"): "region", ("supplier", "s_nationkey"): "nation"})[1]


@query("SELECT (row_number() OVER (ORDER BY n_nationkey))::BIGINT AS number, 'Row ' || row_number() OVER (ORDER BY n_nationkey) || ':' || chr(10) || 'n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', n_regionkey: ' || n_regionkey || chr(10) AS text FROM nation")
def csv_row_render(spark: SparkSession, sf: str) -> DataFrame:
    return files.rendered(table(spark, sf, "nation"), "n_nationkey")


@query("SELECT source_kind, relationship_name, target_kind, count(*) AS number_of_edges FROM (WITH " + sql_graph() + ", k AS (SELECT type FROM nodes GROUP BY type ORDER BY count(*) DESC, type LIMIT 3) SELECT coalesce(a.type, 'other') AS source_kind, relationship_name, coalesce(b.type, 'other') AS target_kind FROM edges JOIN nodes x ON x.id = source_id JOIN nodes y ON y.id = target_id LEFT JOIN k a ON a.type = x.type LEFT JOIN k b ON b.type = y.type) GROUP BY ALL")
def type_schema_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return graph.type_schema(derived_graph(spark, sf), 3)


# ---------------------------------------------------------------- graph filters and joins


@query(f"WITH {sql_graph()}, k AS (SELECT id FROM nodes WHERE type IN ('nation','region')) SELECT e.* FROM edges e WHERE source_id IN (FROM k) AND target_id IN (FROM k)")
def attribute_filtered_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return derived_graph(spark, sf).filtered({"type": ["nation", "region"]}).edges


@query(f"WITH {sql_graph()} SELECT * FROM edges WHERE source_id IN ('nation:1','nation:7','part:3') OR target_id IN ('nation:1','nation:7','part:3')")
def id_filtered_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return derived_graph(spark, sf).touching(_ids(spark, "nation:1", "nation:7", "part:3")).edges


_NODESET = f"""
WITH {sql_graph()}, p AS (SELECT id FROM nodes WHERE type = 'nation' AND name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 7))),
b AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
n AS (SELECT b AS id, count(DISTINCT a) AS c FROM b WHERE a IN (FROM p) AND a <> b GROUP BY 1),
k AS (SELECT id FROM p UNION SELECT id FROM n WHERE {{}})
SELECT id, name, type FROM nodes WHERE id IN (SELECT id FROM k)"""


def _node_set(spark: SparkSession, sf: str, every: bool) -> DataFrame:
    names = [r[0] for r in table(spark, sf, "nation").where("n_nationkey in (1, 7)").select("n_name").collect()]
    return derived_graph(spark, sf).node_set("nation", names, every).nodes.select("id", "name", "type")


@query(_NODESET.format("true"))
def nodeset_or(spark: SparkSession, sf: str) -> DataFrame:
    return _node_set(spark, sf, False)


@query(_NODESET.format("c = (SELECT count(*) FROM p)"))
def nodeset_and(spark: SparkSession, sf: str) -> DataFrame:
    return _node_set(spark, sf, True)


@query(f"WITH {sql_graph()} SELECT DISTINCT a, b FROM (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges) WHERE a LIKE 'supplier:%'")
def neighbours_of_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    return graph.neighbours(g.edges, g.nodes.where("type = 'supplier'"))


@query(f"WITH {sql_graph()} SELECT target_id AS id, source_id AS neighbour FROM edges WHERE relationship_name = 'in_nation'")
def predecessors_by_label(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    return graph.directed_neighbours(g.edges, g.nodes.where("type = 'nation'"), False, "in_nation")


@query(f"WITH {sql_graph()} SELECT source_id AS id, target_id AS neighbour FROM edges WHERE source_id LIKE 'nation:%'")
def successors_of_nations(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    return graph.directed_neighbours(g.edges, g.nodes.where("type = 'nation'"))


@query(f"WITH {sql_graph()} SELECT e.*, a.name AS source_name, a.type AS source_type, b.name AS target_name, b.type AS target_type FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id")
def connections(spark: SparkSession, sf: str) -> DataFrame:
    return derived_graph(spark, sf).triplets()


@query(f"WITH {sql_graph()} SELECT e.*, a.name AS source_name, a.type AS source_type, b.name AS target_name, b.type AS target_type FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id ORDER BY source_id, target_id, relationship_name LIMIT 100 OFFSET 200")
def triplet_page(spark: SparkSession, sf: str) -> DataFrame:
    return graph.page(derived_graph(spark, sf).triplets(), 200, 100)


@query(f"WITH {sql_graph()}, a AS (SELECT 'supplier:' || s_suppkey AS source_id, 'nation:' || s_nationkey AS target_id, 'in_nation' AS relationship_name FROM supplier UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:0', 'in_nation' FROM supplier) SELECT DISTINCT source_id, target_id, relationship_name FROM a SEMI JOIN edges USING (source_id, target_id, relationship_name)")
def has_edges(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    ask = lambda to: s.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("source_id"), to.alias("target_id"), F.lit("in_nation").alias("relationship_name"))
    return graph.existing(derived_graph(spark, sf).edges, ask(F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string"))).unionByName(ask(F.lit("nation:0"))))


@query(f"WITH {sql_graph()} SELECT id FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id HAVING count(*) = 1")
def degree_one(spark: SparkSession, sf: str) -> DataFrame:
    return derived_graph(spark, sf).degree().where("degree = 1").select("id")


@query(f"WITH {sql_graph()} SELECT id, name, type FROM nodes WHERE id NOT IN (SELECT source_id FROM edges UNION ALL SELECT target_id FROM edges)")
def disconnected_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return derived_graph(spark, sf).disconnected().select("id", "name", "type")


@query(f"WITH {sql_graph()}, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1) SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 25")
def seeds_by_degree(spark: SparkSession, sf: str) -> DataFrame:
    return derived_graph(spark, sf).degree().orderBy(F.desc("degree"), "id").limit(25)


@query("SELECT l_partkey AS item, min(l_suppkey) AS owner FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def exclusively_owned(spark: SparkSession, sf: str) -> DataFrame:
    return graph.exclusive(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("owner")), "item", "owner")


@query(f"WITH {sql_graph()} SELECT * FROM edges WHERE source_id NOT IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal < 0) AND target_id NOT IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal < 0)")
def detach_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.deleted(derived_graph(spark, sf), gone).edges


@query("SELECT o_custkey AS id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, -1, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def upsert_last_write(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("version"), F.lit("none").alias("status"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return graph.upserted(stored, new, ["id"], "version")


@query("SELECT c_custkey AS id, list_sort(list_distinct(['base', c_mktsegment])) AS refs, c_mktsegment = 'BUILDING' AS orphaned FROM customer")
def source_refs(spark: SparkSession, sf: str) -> DataFrame:
    start = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array("c_mktsegment").alias("source_refs"))
    orphans = graph.refs_removed(start, ["BUILDING"]).select("id", "orphaned")
    return graph.refs_attached(start, start.select("id"), ["base"]).join(orphans, "id").select("id", F.array_sort("source_refs").alias("refs"), "orphaned")


@query("""
WITH f AS (SELECT 'customer:' || o_custkey AS s, 'status:' || o_orderstatus AS t, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS p FROM orders),
w AS (SELECT s, arg_max(t, day || lpad(p::VARCHAR, 12, '0')) AS t, count(DISTINCT t) AS n FROM f GROUP BY s)
SELECT f.p AS position, f.s AS source_id, f.t AS target_id, n > 1 AND f.t <> w.t AS superseded FROM f JOIN w USING (s)""")
def supersede(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("status:"), "o_orderstatus").alias("target_id"), F.lit("has_status").alias("relationship_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.col("o_orderkey").alias("position"))
    return graph.superseded(o, ["has_status"]).select("position", "source_id", "target_id", "superseded")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) IS NULL OR o_orderdate > TIMESTAMP '1996-06-01'")
def valid_at(spark: SparkSession, sf: str) -> DataFrame:
    closed = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return table(spark, sf, "orders").where(moments.valid_at(closed, F.lit("1996-06-01").cast("timestamp"))).select("o_orderkey", "o_orderdate")


@query("""
WITH m AS (SELECT 'supplier:' || l_suppkey AS s, 'part:' || l_partkey AS t FROM lineitem GROUP BY ALL),
a AS (SELECT m.*, 'nation:' || s_nationkey AS sm, p_brand AS tm FROM m JOIN supplier ON m.s = 'supplier:' || s_suppkey JOIN part ON m.t = 'part:' || p_partkey)
SELECT sm AS source_module, tm AS target_module, 'supplies' AS relationship_name, count(*) AS number_of_edges FROM a GROUP BY ALL""")
def edge_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("module"))
    p = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("module"))
    return graph.rolled_up(derived_graph(spark, sf, ("supplier", "part")).edges, s.unionByName(p))


# ---------------------------------------------------------------- traversal


_WALK = """
WITH RECURSIVE g AS (WITH {graph} SELECT source_id, target_id FROM edges),
b AS (SELECT source_id AS a, target_id AS b FROM g UNION SELECT target_id, source_id FROM g),
w(id, hops) AS (SELECT 'region:1', 0 UNION SELECT b.b, w.hops + 1 FROM w JOIN b ON b.a = w.id WHERE w.hops < {depth})
SELECT id, min(hops)::INT AS hops FROM w GROUP BY id"""


@query(_WALK.format(graph=sql_graph(), depth=3))
def khop(spark: SparkSession, sf: str) -> DataFrame:
    """Three steps around a region: its nations, their customers and suppliers, and all parts these supply."""
    return traversal.reached(derived_graph(spark, sf).edges, _ids(spark, "region:1"), 3)


@query(f"""
WITH RECURSIVE g AS (WITH {sql_graph()} SELECT source_id, target_id FROM edges), t AS (SELECT r_regionkey FROM region),
w(id, hops) AS (SELECT 'region:1', 0 UNION SELECT source_id, hops + 1 FROM w JOIN g ON target_id = id WHERE hops < 2)
SELECT hops::INT AS hops, split_part(id, ':', 1) AS type, count(*) AS n FROM (SELECT id, min(hops) AS hops FROM w GROUP BY id) WHERE hops > 0 GROUP BY ALL""")
def impact_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    return traversal.impact(g.edges, _ids(spark, "region:1"), g.nodes, 2)


@query("""
SELECT 0 AS step, 'customer:5' AS id UNION ALL SELECT 1, 'nation:' || c_nationkey FROM customer WHERE c_custkey = 5
UNION ALL SELECT 2, 'region:' || n_regionkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey = 5""")
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    region = table(spark, sf, "customer").where("c_custkey = 5").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()[0]
    return traversal.shortest_path(g.edges, "customer:5", f"region:{region}")


#: Parts join the trees of regions: each node with the smallest region that can be reached from it.
_PLACED = f"""
WITH RECURSIVE {sql_graph()},
h AS (SELECT DISTINCT l_partkey AS p, n_regionkey AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
j AS (SELECT DISTINCT x.r AS a, y.r AS b FROM h x JOIN h y USING (p)),
w(a, b) AS (SELECT r_regionkey, r_regionkey FROM region UNION SELECT w.a, j.b FROM w JOIN j ON j.a = w.b),
c AS (SELECT a AS r, 'region:' || min(b) AS region FROM w GROUP BY 1),
placed AS (SELECT 'region:' || r AS id, region FROM c UNION ALL SELECT 'nation:' || n_nationkey, region FROM nation JOIN c ON r = n_regionkey
UNION ALL SELECT 'customer:' || c_custkey, region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN c ON r = n_regionkey
UNION ALL SELECT 'supplier:' || s_suppkey, region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN c ON r = n_regionkey
UNION ALL SELECT 'part:' || p_partkey, min(region) FROM part LEFT JOIN h ON p = p_partkey LEFT JOIN c USING (r) GROUP BY p_partkey)"""


@query(_PLACED + " SELECT id, region FROM placed")
def component_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the whole graph; each is told by the smallest region that it holds, null if it holds none."""
    placed = traversal.components(derived_graph(spark, sf))
    region = placed.where("id like 'region:%'").groupBy("component").agg(F.min("id").alias("region"))
    return placed.join(region, "component", "left").select("id", "region")


@query(f"""{_PLACED}, n AS (SELECT count(*) AS n FROM nodes), m AS (SELECT count(*) AS m, count_if(source_id = target_id) AS l FROM edges),
s AS (SELECT count(*) AS size FROM placed GROUP BY coalesce(region, id))
SELECT n AS num_nodes, m AS num_edges, round(2 * m / n, 6) AS mean_degree, round(m / (n * (n - 1)), 9) AS density, (SELECT count(*) FROM s) AS num_components, (SELECT max(size) FROM s)::BIGINT AS largest_component, l AS num_selfloops FROM n, m""")
def graph_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.graph_metrics(derived_graph(spark, sf)).withColumn("mean_degree", F.round("mean_degree", 6)).withColumn("density", F.round("density", 9))


def _pagerank_sql(rounds: int) -> str:
    """So many steps, each kept: more than the ranks need to stand to 1e-9."""
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{k-1} WHERE id NOT IN (SELECT source_id FROM o)) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g.got, 0) AS rank FROM nodes n LEFT JOIN (SELECT target_id, sum(rank / c) AS got FROM d JOIN o USING (source_id) JOIN r{k-1} ON id = source_id GROUP BY 1) g ON g.target_id = n.id)")
    nodes, edges = sql_graph().split(", edges AS (")
    return f"WITH {nodes.replace('nodes AS (', 'nodes AS MATERIALIZED (', 1)}, edges AS ({edges}, d AS MATERIALIZED (SELECT DISTINCT source_id, target_id FROM edges), o AS MATERIALIZED (SELECT source_id, count(*) AS c FROM d GROUP BY 1), " + ", ".join(steps) + f" SELECT id, round(rank, 6) AS rank FROM r{rounds}"


@query(_pagerank_sql(60))
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """The whole graph, until the ranks stand to nine places."""
    return traversal.pagerank(derived_graph(spark, sf), tolerance=1e-9).select("id", F.round("rank", 6).alias("rank"))


@query()
def pagerank_converged(spark: SparkSession, sf: str) -> DataFrame:
    """The whole graph, until the ranks stand to six places."""
    return traversal.pagerank(derived_graph(spark, sf))


@query()
def pagerank_hubs(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    return traversal.hubs(g, traversal.pagerank(g), 20)


@query("""
WITH op AS (SELECT DISTINCT 'order:' || l_orderkey AS o, 'part:' || l_partkey AS p FROM lineitem), os AS (SELECT DISTINCT 'order:' || l_orderkey AS o, 'supplier:' || l_suppkey AS s FROM lineitem),
ps AS (SELECT DISTINCT 'part:' || l_partkey AS p, 'supplier:' || l_suppkey AS s FROM lineitem), x AS (SELECT o, p, s FROM op JOIN os USING (o) JOIN ps USING (p, s)),
t AS (SELECT id, count(*) AS t FROM (SELECT unnest([o, p, s]) AS id FROM x) GROUP BY 1),
d AS (SELECT id, count(*) AS d FROM (SELECT unnest([o, p]) AS id FROM op UNION ALL SELECT unnest([o, s]) FROM os UNION ALL SELECT unnest([p, s]) FROM ps) GROUP BY 1)
SELECT id, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN t USING (id)""")
def clustering_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """On the graph of all orders, parts and suppliers that share a line item; its triangles take one of each."""
    kinds = {"order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"}
    key = {kind: F.col(c) * len(kinds) + i for i, (kind, c) in enumerate(kinds.items())}  # whole numbers: half of what travels as text
    li = table(spark, sf, "lineitem")
    pair = lambda a, b: li.select(key[a].alias("source_id"), key[b].alias("target_id"), F.lit("with").alias("relationship_name"))
    edges = pair("order", "part").unionByName(pair("order", "supplier")).unionByName(pair("part", "supplier"))
    nodes = li.select(F.explode(F.array(*key.values())).alias("id")).distinct()
    kind = F.pmod("id", F.lit(len(kinds)))
    named = F.concat(F.get(F.array(*map(F.lit, kinds)), kind.cast("int")), F.lit(":"), F.expr(f"(id - pmod(id, {len(kinds)})) div {len(kinds)}").cast("string"))
    return traversal.clustering(graph.Graph(nodes, edges)).select(named.alias("id"), F.round("coefficient", 6).alias("coefficient"))


# ---------------------------------------------------------------- lexical search


@query(f"""
WITH t AS (SELECT doc_id, unnest({_tok('text', True)}) AS term FROM documents), w AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t GROUP BY 1)
SELECT * FROM w""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.postings(_documents(spark, sf)).groupBy("term").agg(F.sum("frequency").alias("n"), F.count("*").alias("documents"))


_BM25 = f"""
WITH d AS (SELECT doc_id AS id, {_tok('text', True)} AS t FROM documents), c AS (SELECT id, len(t) AS n, t FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, avg(n) AS mean FROM c), p AS (SELECT id, n, unnest(t) AS term FROM c), f AS (SELECT id, n, term, count(*) AS tf FROM p GROUP BY ALL),
i AS (SELECT term, count(*) AS df FROM f GROUP BY 1), q AS (SELECT item_id AS query_id, unnest(list_distinct({_tok('text', True)})) AS term FROM benchmark WHERE item_id % 20 = 0),
x AS (SELECT query_id, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score FROM q JOIN f USING (term) JOIN i USING (term), s GROUP BY 1, 2)
"""


@query(_BM25 + "SELECT query_id, id, round(score, 6) AS score FROM x")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(_documents(spark, sf), _asked(spark, sf)).withColumn("score", F.round("score", 6))


@query(_BM25 + "SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM x) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    d, q = _documents(spark, sf), _asked(spark, sf)
    return lexical.top_k(written(lexical.bm25(d, q), "scores"), d, q, 10).withColumn("score", F.round("score", 6))


@query(f"""
WITH d AS (SELECT doc_id AS id, unnest(list_distinct({_tok('text')})) AS term, len(list_distinct({_tok('text')})) AS n FROM documents),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_tok('text')})) AS term, len(list_distinct({_tok('text')})) AS m FROM benchmark WHERE item_id % 20 = 0)
SELECT query_id, id, round(count(*) / (any_value(n) + any_value(m) - count(*)), 6) AS score FROM d JOIN q USING (term) GROUP BY 1, 2""")
def jaccard_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.jaccard(_documents(spark, sf), _asked(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""
WITH d AS (SELECT id, term, count(*) AS c, any_value(n) AS n FROM (SELECT doc_id AS id, unnest({_tok('text')}) AS term, len({_tok('text')}) AS n FROM documents) GROUP BY 1, 2),
q AS (SELECT query_id, term, count(*) AS c, any_value(m) AS m FROM (SELECT item_id AS query_id, unnest({_tok('text')}) AS term, len({_tok('text')}) AS m FROM benchmark WHERE item_id % 20 = 0) GROUP BY 1, 2)
SELECT query_id, id, round(sum(least(d.c, q.c)) / (any_value(n) + any_value(m) - sum(least(d.c, q.c))), 6) AS score FROM d JOIN q USING (term) GROUP BY 1, 2""")
def jaccard_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.jaccard_multiset(_documents(spark, sf), _asked(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""
WITH w AS (SELECT conv_id * 1000 + turn AS id, unnest(list_filter(list_distinct({_tok('text')}), lambda x: length(x) >= 2)) AS term FROM conversations),
q AS (SELECT item_id AS query_id, unnest(list_filter(list_distinct({_tok('text')}), lambda x: length(x) >= 2)) AS term FROM benchmark WHERE item_id % 20 = 0)
SELECT query_id, id, count(*) AS overlap FROM w JOIN q USING (term) GROUP BY 1, 2""")
def session_keyword_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return lexical.keyword_overlap(rows, _asked(spark, sf))


@query(f"""
WITH t AS (SELECT doc_id AS id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (SELECT doc_id, {_tok('text', True)} AS w FROM documents)),
c AS (SELECT id, word, count(*) AS n, min(k) AS first FROM t GROUP BY 1, 2)
SELECT id, word, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 3""")
def frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.frequent_words(_documents(spark, sf), 3)


@query(f"""
WITH p AS (SELECT conv_id * 1000 + turn AS id, text AS answer, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS golden FROM conversations),
k AS (SELECT id, {_tok('answer')} AS a, {_tok('golden')} AS g, (lower(trim(answer)) = lower(trim(golden)))::DOUBLE AS em FROM p WHERE golden IS NOT NULL),
x AS (SELECT id, term, count(*) AS c FROM (SELECT id, unnest(a) AS term FROM k) GROUP BY ALL), y AS (SELECT id, term, count(*) AS c FROM (SELECT id, unnest(g) AS term FROM k) GROUP BY ALL),
s AS (SELECT id, sum(least(x.c, y.c)) AS shared FROM x JOIN y USING (id, term) GROUP BY 1)
SELECT id, em AS exact_match, round(CASE WHEN len(a) + len(g) = 0 THEN 1 ELSE 2 * coalesce(shared, 0) / (len(a) + len(g)) END, 6) AS f1 FROM k LEFT JOIN s USING (id)""")
def em_f1(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf, "conversations").withColumn("golden", F.lead("text").over(w)).where("golden is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"), "golden")
    return lexical.token_f1(pairs).select("id", text.exact_match(F.col("answer"), F.col("golden")).alias("exact_match"), F.round("f1", 6).alias("f1"))


@query("SELECT p_partkey AS id, CASE WHEN lower(p_name) = 'widget' THEN 3 WHEN ends_with(lower(p_name), '.widget') OR ends_with(lower(p_name), '/widget') THEN 2 WHEN contains(lower(p_name), 'widget') THEN 1 ELSE -1 END AS tier FROM part")
def match_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.match_tier(F.col("p_name"), F.lit("Widget")).alias("tier"))


_ROUTE_RULES = [(p.replace("(?i)", ""), "i" if p.startswith("(?i)") else "c", t, w) for p, t, w in router.RULES]


def _route_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hits = ", ".join(f"CASE WHEN regexp_matches(t, {quote(p)}, '{o}') AND NOT regexp_matches(right(split_part(t, regexp_extract(t, {quote(p)}, 0, '{o}'), 1), 20), {quote(router.NEGATION.replace('(?i)', ''))}, 'i') THEN {w} ELSE 0 END AS h{k}" for k, (p, o, _, w) in enumerate(_ROUTE_RULES))
    scores = ", ".join(f"{' + '.join(f'h{k}' for k, r in enumerate(_ROUTE_RULES) if r[2] == kind)} AS s{n}" for n, kind in enumerate(router.TYPES))
    best = "greatest(" + ", ".join(f"s{n}" for n in range(len(router.TYPES))) + ")"
    pick = "CASE " + " ".join(f"WHEN s{n} = best THEN '{k}'" for n, k in enumerate(router.TYPES)) + " END"
    return f"WITH q AS (SELECT conv_id, turn, trim(text) AS t FROM conversations), h AS (SELECT conv_id, turn, {hits} FROM q), s AS (SELECT conv_id, turn, {scores} FROM h), b AS (SELECT *, {best} AS best FROM s) SELECT conv_id, turn, CASE WHEN best < 2 THEN '{router.DEFAULT}' ELSE {pick} END AS search_type, (CASE WHEN best = 0 THEN 2 ELSE best END)::DOUBLE AS confidence FROM b"


@query(_route_sql())
def router_scores(spark: SparkSession, sf: str) -> DataFrame:
    return router.routed(table(spark, sf, "conversations")).select("conv_id", "turn", "search_type", "confidence")


# ---------------------------------------------------------------- vectors


_PAIRS = "SELECT q.vec_id AS query_id, v.vec_id AS id, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0"


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


@query(f"SELECT query_id, id, round(distance, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), id) AS rank FROM ({_PAIRS})) WHERE rank <= 10")
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.nearest(_vectors(spark, sf), _vector_queries(spark, sf), 10).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 15")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    one = _vectors(spark, sf).where("id = 0").select(F.col("id").alias("query_id"), "vector")
    return nearest.scored(_vectors(spark, sf), one).select("id", F.round("distance", 6).alias("distance")).orderBy("distance", "id").limit(15)


@query(f"SELECT query_id, id, round(distance, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), id) AS rank FROM ({_PAIRS} AND v.label IN (1, 3))) WHERE rank <= 5")
def knn_tagged(spark: SparkSession, sf: str) -> DataFrame:
    tagged = _vectors(spark, sf).withColumn("belongs_to_set", F.array(F.col("label").cast("string")))
    return nearest.nearest(nearest.tagged(tagged, ["1", "3"]), _vector_queries(spark, sf), 5).withColumn("distance", F.round("distance", 6))


_BASIS = "b AS (SELECT vec_id AS slot, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 4)"
_COORDS = "(SELECT list(list_cosine_similarity(v.embedding::DOUBLE[], b.e) ORDER BY slot) FROM b)"


@query(f"WITH {_BASIS}, c AS (SELECT vec_id AS id, {_COORDS} AS c FROM embeddings v) SELECT id, round(c[1], 6) AS c0, round(c[2], 6) AS c1, round(c[3], 6) AS c2, round(c[4], 6) AS c3 FROM c")
def truth_coords(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    found = nearest.coordinates(v.select("id", "vector"), v.where("id < 4").select(F.col("id").alias("slot"), "vector"))
    return found.select("id", *(F.round(F.col("coords")[k], 6).alias(f"c{k}") for k in range(4)))


@query(f"""
WITH {_BASIS}, c AS (SELECT vec_id AS id, {_COORDS} AS c FROM embeddings v), q AS (SELECT list_transform(c, lambda x: greatest(x, 0)) AS q FROM c WHERE id = 7)
SELECT id, round(0.75 + 0.5 * CASE WHEN list_sum(q) > 0 THEN greatest(0, least(1, list_inner_product(c, q) / list_sum(q))) ELSE 0.5 END, 6) AS factor FROM c, q""")
def truth_factors(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    found = nearest.coordinates(v.select("id", "vector"), v.where("id < 4").select(F.col("id").alias("slot"), "vector"))
    one = found.where("id = 7").select(F.col("coords").alias("q"))
    return found.crossJoin(F.broadcast(one)).select("id", F.round(vector.truth_factor(F.col("coords"), F.col("q")), 6).alias("factor"))


@query()
def learning_centroids(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return consolidation.first_k_centroids(v.select(F.col("label").cast("string").alias("group"), "id", "vector"), 3)


@query()
def vector_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with one of eight clusters."""
    return evaluation.kmeans(_vectors(spark, sf), 8)[0]


# ---------------------------------------------------------------- retrieval


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    v = node_vectors(spark, sf)
    found = nearest.nearest(v.select(F.struct("id", "collection").alias("id"), "vector"), _vector_queries(spark, sf), 100)
    return found.select("query_id", F.col("id.id").alias("id"), "distance", F.col("id.collection").alias("collection"))


_TRIPLET = f"""
WITH {sql_graph(("supplier", "part"))}, v AS (
  SELECT 'part:' || vec_id % (SELECT count(*) FROM part) AS id, embedding::DOUBLE[] AS e, 'Part_name' AS c FROM embeddings UNION ALL
  SELECT 'supplier:' || vec_id % (SELECT count(*) FROM supplier), embedding::DOUBLE[], 'Supplier_name' FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.id, v.c, 1 - list_cosine_similarity(v.e, q.embedding::DOUBLE[]) AS d FROM v, embeddings q WHERE q.vec_id % 20 = 0),
h AS (SELECT query_id, id, d, c FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), id, c) AS k FROM s) WHERE k <= 100),
n AS (SELECT query_id, id, arg_max(d, c || lpad((1000000 - round(d, 6) * 100000)::BIGINT::VARCHAR, 12, '0')) AS d FROM h GROUP BY 1, 2),
q AS (SELECT DISTINCT query_id FROM n),
t AS (SELECT q.query_id, e.*, 1.5 * coalesce(a.d, 6.5) + 1.5 * coalesce(b.d, 6.5) + 1.5 * 6.5 AS score FROM q CROSS JOIN edges e LEFT JOIN n a ON a.query_id = q.query_id AND a.id = source_id LEFT JOIN n b ON b.query_id = q.query_id AND b.id = target_id)
SELECT query_id, source_id, target_id, relationship_name, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6), source_id, target_id, relationship_name) AS rank FROM t) WHERE rank <= 5"""


@query(_TRIPLET)
def triplet_topk(spark: SparkSession, sf: str) -> DataFrame:
    # the hits of a query (100 at most) and the edges are read several times: stored tables, as in an engine that has ingested them
    hits = written(_hits(spark, sf).groupBy("query_id", "id", "collection").agg(F.min("distance").alias("distance")), "hits")
    none = spark.createDataFrame([], "query_id long, edge_type string, distance double")
    g = derived_graph(spark, sf, ("supplier", "part"))
    stored = graph.Graph(g.nodes, written(g.edges, "edges"))
    return retrieval.scored_triplets(stored, hits, none, 5).withColumn("score", F.round("score", 6))


@query("""
WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank, p_size / 50 AS w FROM part QUALIFY rank < 20),
b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS rank FROM part QUALIFY rank < 10),
f AS (SELECT coalesce(a.id, b.id) AS id, coalesce(1 / (41 + a.rank), 0) + coalesce(1 / (41 + b.rank), 0) AS rrf, coalesce(w, 0.5) AS w, least(a.rank, b.rank) AS l FROM a FULL JOIN b ON a.id = b.id)
SELECT id, round(rrf, 9) AS rrf, round(rrf * (0.75 + 0.5 * greatest(0, least(1, w))), 9) AS score FROM f ORDER BY score DESC, rrf DESC, l, id LIMIT 10""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    a = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")) - 1)
    b = p.orderBy(F.desc("p_size"), "p_partkey").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p_size"), "p_partkey")) - 1)
    out = retrieval.fused(a.select(F.col("p_partkey").alias("id"), "rank", (F.col("p_size") / 50).alias("importance_weight")), b.select(F.col("p_partkey").alias("id"), "rank"), 10)
    return out.select("id", F.round("rrf", 9).alias("rrf"), F.round("score", 9).alias("score"))


@query("""
WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS p FROM part QUALIFY p <= 12),
b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS s FROM part QUALIFY s <= 12),
m AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN 0 WHEN p IS NOT NULL THEN 1 ELSE 2 END AS tier, coalesce(p, s) AS place FROM a FULL JOIN b ON a.id = b.id),
o AS (SELECT * FROM m WHERE tier = 2 ORDER BY place, id LIMIT 3), r AS (SELECT * FROM m WHERE id NOT IN (SELECT id FROM o) ORDER BY tier, place, id LIMIT 7)
SELECT id, (row_number() OVER (ORDER BY tier, place, id))::INT AS rank FROM (FROM o UNION ALL FROM r)""")
def merge_ranked(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    a = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(12).select(F.col("p_partkey").alias("id"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))
    b = p.orderBy("p_partkey").limit(12).select(F.col("p_partkey").alias("id"), F.row_number().over(Window.orderBy("p_partkey")).alias("rank"))
    return retrieval.merged(a, b, 10, retrieval.conversational_reserve(10))


@query("""
WITH h AS (SELECT p_name || ' ' || p_type || ' ' || p_brand AS text, p_retailprice / 10000 AS distance FROM part),
s AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS text FROM part WHERE p_size < 5)
SELECT text, min(distance) AS distance FROM h WHERE text NOT IN (FROM s) AND len(regexp_split_to_array(trim(text), '\\s+')) >= 3 GROUP BY 1 ORDER BY 2, 1 LIMIT 20""".replace("\\\\", "\\"))
def facts_select(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    p = table(spark, sf, "part")
    return retrieval.facts(p.select(t.alias("text"), (F.col("p_retailprice") / 10000).alias("distance")), p.where("p_size < 5").select(t.alias("text")), 20)


_EVENT_GRAPH = "SELECT event_id, user_id, date_trunc('day', ts) AS day FROM events"


@query("""
WITH d AS (SELECT DISTINCT 'day:' || strftime(ts, '%Y-%m-%d') AS id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND date_trunc('day', ts) <= TIMESTAMP '2024-01-07')
SELECT DISTINCT 'event:' || event_id AS id FROM events WHERE 'day:' || strftime(ts, '%Y-%m-%d') IN (FROM d)""")
def temporal_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("event"), F.concat(F.lit("day:"), F.date_format("ts", "yyyy-MM-dd")).alias("day"), F.date_trunc("day", "ts").alias("at"))
    g = graph.Graph(e.select(F.col("event").alias("id"), F.lit("Event").alias("type")), e.select(F.col("event").alias("source_id"), F.col("day").alias("target_id"), F.lit("at").alias("relationship_name")))
    days = retrieval.in_period(e.select(F.col("day").alias("id"), "at").distinct(), "2024-01-05", "2024-01-07")
    return retrieval.events_near(g, days).select("id")


# ---------------------------------------------------------------- consolidation


@query(r"""
WITH k AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part), c AS (SELECT k, min(id) AS cluster FROM k WHERE k <> '' GROUP BY 1)
SELECT id, coalesce(cluster, id) AS cluster FROM k LEFT JOIN c USING (k)""")
def consolidate_names(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("type"))
    return consolidation.clusters(e, consolidation.name_links(e))


@query(r"""
WITH k AS (SELECT p_partkey AS id, p_name AS name, p_size AS created_at, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part),
d AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1),
r AS (SELECT k, k.id, row_number() OVER (PARTITION BY k ORDER BY coalesce(degree, 0) DESC, created_at NULLS LAST, name, k.id) AS n FROM k LEFT JOIN d ON d.id = k.id),
m AS (SELECT k.id, r.id AS canonical FROM k JOIN r ON r.k = k.k AND n = 1)
SELECT DISTINCT 'supplier:' || l_suppkey AS source_id, 'part:' || canonical AS target_id, 'supplies' AS relationship_name FROM lineitem JOIN m ON m.id = l_partkey""")
def repointed_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("type"), F.col("p_size").alias("created_at"))
    degree = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_suppkey").distinct().groupBy("id").agg(F.count("*").alias("degree"))
    best = consolidation.canonical(e, consolidation.clusters(e, consolidation.name_links(e)), degree)
    remap = best.select(F.concat(F.lit("part:"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("part:"), F.col("canonical").cast("string")).alias("canonical"))
    return graph.repointed(derived_graph(spark, sf, ("supplier", "part")).edges, remap)


_OVERLAP = """
WITH l AS (SELECT DISTINCT l_suppkey AS item, l_partkey AS e FROM lineitem), n AS (SELECT count(DISTINCT item) AS n FROM l),
i AS (SELECT e, ln(n / count(*)) AS idf FROM l, n GROUP BY e, n), k AS (SELECT item, e, idf FROM l JOIN i USING (e) WHERE idf > 0), t AS (SELECT item, sum(idf) AS t FROM k GROUP BY 1),
s AS (SELECT x.item AS a, y.item AS b, sum(x.idf) AS s FROM k x JOIN k y ON x.e = y.e AND x.item < y.item GROUP BY 1, 2)
SELECT a, b, round(s / (ta.t + tb.t - s), 6) AS score FROM s JOIN t ta ON ta.item = a JOIN t tb ON tb.item = b WHERE s / (ta.t + tb.t - s) >= 0.05 - 1e-9"""


@query(_OVERLAP)
def idf_weighted_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by the parts that they supply."""
    links = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("entity"))
    return consolidation.weighted_overlap(links, "item", "entity", 0.05).withColumn("score", F.round("score", 6))


@query("WITH l AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT s AS entity, round(ln((SELECT count(DISTINCT p) FROM l) / count(*)), 6) AS idf FROM l GROUP BY 1")
def supplier_idf(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("entity"))
    return consolidation.idf(links, "item", "entity").withColumn("idf", F.round("idf", 6))


@query()
def summary_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by the parts that they supply; a nation's suppliers are a group."""
    links = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("entity"))
    group = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("group"))
    items = consolidation.weighted_sets(links, "id", "entity").join(group, "id").select("group", F.col("id").cast("string").alias("id"), "entities")
    return consolidation.buckets(items, 5, 0.05)


# ---------------------------------------------------------------- sessions and evaluation


@query("""
WITH RECURSIVE e AS (SELECT user_id % 50 AS element_id, event_id % 5 + 1 AS score, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS k FROM events),
w(element_id, k, weight) AS (SELECT DISTINCT element_id, 0::BIGINT, 0.5::DOUBLE FROM e UNION ALL SELECT w.element_id, e.k, round(greatest(0, least(1, weight + 0.1 * ((score - 1) / 4 - weight))), 4) FROM w JOIN e ON e.element_id = w.element_id AND e.k = w.k + 1)
SELECT element_id, round(arg_max(weight, k), 3) AS weight, max(k)::INT AS n FROM w GROUP BY 1""")
def feedback_ema(spark: SparkSession, sf: str) -> DataFrame:
    """Three places of the result: at the fifth, the engines round halves of binary fractions differently."""
    return sessions.feedback_weights(feedback_uses(spark, sf)).withColumn("weight", F.round("weight", 3))


@query("SELECT user_id % 50 AS element_id, count(DISTINCT event_id)::DOUBLE AS weight FROM events WHERE user_id % 50 < 40 GROUP BY 1")
def frequency_weights(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.range(40).select(F.col("id").alias("element_id"))
    return sessions.frequency_weights(feedback_uses(spark, sf), known)


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started_at, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sessions(table(spark, sf, "events"), "user_id", "ts", "2 hours")


@query("SELECT user_id, CASE WHEN user_id % 3 <> 0 AND epoch(TIMESTAMP '2024-01-31' - max(ts)) > 172800 THEN 'abandoned' WHEN user_id % 3 <> 0 THEN 'running' ELSE 'ended' END AS status FROM events GROUP BY 1")
def session_status(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    status = F.when(F.col("user_id") % 3 != 0, "running").otherwise("ended")
    return last.select("user_id", sessions.effective_status(status, F.col("last_seen"), F.lit("2024-01-31").cast("timestamp"), 172_800).alias("status"))


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def last_turns(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.latest(table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "event_type", "ts")


@query("SELECT event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.latest(table(spark, sf, "events"), "event_type", [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id", "ts")


@query("""
WITH p(model, i, o) AS (VALUES ('click', 0.5, 1.0), ('view', 0.1, 0.2), ('purchase', 2.0, 4.0))
SELECT user_id AS user, event_type AS agent, count(*) AS calls, sum(event_id % 100)::BIGINT AS tokens_in, sum(event_id % 7)::BIGINT AS tokens_out, round(sum(coalesce((event_id % 100 * i + event_id % 7 * o) / 1000, 0)), 6)::DOUBLE AS cost
FROM events LEFT JOIN p ON model = event_type GROUP BY ALL""")
def cost_by_user_agent(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("agent"), F.col("event_type").alias("model"), (F.col("event_id") % 100).alias("tokens_in"), (F.col("event_id") % 7).alias("tokens_out"))
    prices = spark.createDataFrame([("click", 0.5, 1.0), ("view", 0.1, 0.2), ("purchase", 2.0, 4.0)], "model string, price_in double, price_out double")
    return sessions.usage(e, prices).withColumn("cost", F.round("cost", 6))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS sequence, sha256(user_id || chr(31) || event_id || chr(31) || '"' || event_type || '"') AS own FROM events),
stored AS (SELECT *, CASE WHEN event_id % 97 = 5 THEN 'spoilt checksum' ELSE own END AS checksum FROM e),
linked AS (SELECT *, lag(checksum) OVER (PARTITION BY user_id ORDER BY sequence) AS before FROM stored),
kept AS (SELECT *, CASE WHEN before IS NOT NULL AND event_id % 89 = 3 THEN 'spoilt link' ELSE before END AS previous FROM linked WHERE event_id % 83 <> 7),
seen AS (SELECT *, lag(checksum) OVER w AS really, lag(sequence) OVER w AS number FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY sequence))
SELECT user_id AS entity_id, sequence, CASE WHEN checksum <> own THEN 'checksum' WHEN previous IS DISTINCT FROM really THEN 'link' WHEN number IS NOT NULL AND sequence <> number + 1 THEN 'gap' ELSE 'ok' END AS verdict FROM seen""")
def hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A chain per user with checksums spoilt at some events, links at others, and some events taken out."""
    w = Window.partitionBy("entity_id").orderBy("sequence")
    e = table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), "event_id", "event_type").withColumn("sequence", F.row_number().over(Window.partitionBy("entity_id").orderBy("event_id")))
    own = sessions.checksum(["entity_id", "event_id", "event_type"])
    stored = e.withColumn("checksum", F.when(F.col("event_id") % 97 == 5, F.lit("spoilt checksum")).otherwise(own)).withColumn("previous_checksum", F.lag("checksum").over(w))
    spoilt = stored.withColumn("previous_checksum", F.when(F.col("previous_checksum").isNotNull() & (F.col("event_id") % 89 == 3), F.lit("spoilt link")).otherwise(F.col("previous_checksum")))
    return sessions.chain_checked(spoilt.where("event_id % 83 <> 7"), ["entity_id", "event_id", "event_type"]).select("entity_id", "sequence", "verdict")


@query("""
WITH s AS (SELECT event_type AS question_type, user_id % 4 AS run, value AS score FROM events),
r AS (SELECT question_type, run, avg(score) AS m FROM s GROUP BY ALL), o AS (SELECT run, avg(score) AS m FROM s GROUP BY ALL)
SELECT question_type, round(avg(score), 6) AS mean, (SELECT round(stddev_samp(m), 6) FROM r WHERE r.question_type = s.question_type) AS run_std, (SELECT count(*) FROM r WHERE r.question_type = s.question_type) AS runs FROM s GROUP BY question_type
UNION ALL SELECT NULL, round(avg(score), 6), (SELECT round(stddev_samp(m), 6) FROM o), (SELECT count(*) FROM o) FROM s""")
def runs_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").select(F.col("event_type").alias("question_type"), (F.col("user_id") % 4).cast("string").alias("run"), F.col("value").alias("score"))
    return evaluation.across_runs(s).select("question_type", F.round("mean", 6).alias("mean"), F.round("run_std", 6).alias("run_std"), "runs")


@query()
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "labels").select(F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double"))).alias("metric", "score"))
    return evaluation.bootstrap(scores, 1000)


@query("WITH t AS (SELECT len(regexp_split_to_array(trim(text), ' +')) AS tokens FROM documents) SELECT count(*) AS chunks, sum(tokens)::BIGINT AS tokens_in, count(*) * 150 AS summary_tokens, sum(greatest(256, 0.5 * tokens))::DOUBLE AS graph_tokens, sum(greatest(256, 0.5 * tokens))::DOUBLE * 20 AS reasoning_tokens FROM t")
def dry_run_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.dry_run(_documents(spark, sf).select(F.size(F.split(F.trim("text"), " +")).alias("tokens")))


# ---------------------------------------------------------------- chunks, content, pages


@query("""
WITH p AS (SELECT doc_id AS id, list_filter(regexp_extract_all(text, '[^ .;!?…。！？]*(?: |[.;!?…。！？] *|$)'), lambda x: length(x) > 0) AS w FROM documents)
SELECT id, len(w)::INT AS pieces, len(list_filter(w, lambda x: regexp_matches(x, '[.;!?…。！？] *$')))::INT AS sentence_ends FROM p""")
def word_pieces(spark: SparkSession, sf: str) -> DataFrame:
    w = chunking.pieces(F.col("text"))
    return _documents(spark, sf).select("id", F.size(w).alias("pieces"), F.size(F.filter(w, lambda x: x.rlike("[.;!?…。！？] *$"))).alias("sentence_ends"))


@query()
def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.identified(chunking.paragraph_chunks(_documents(spark, sf), 128))


@query()
def overlapping_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.overlapping_chunks(_documents(spark, sf), 128, 0.25)


@query("SELECT doc_id AS id, text AS joined FROM documents")
def chunks_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraph chunks joined again: the documents themselves."""
    return chunking.paragraph_chunks(_documents(spark, sf), 128).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), "").alias("joined"))


@query(r"""
WITH l AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+$')) AS t, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+$'), 1) AS k FROM documents)
SELECT id, (k - 1)::INT AS chunk_index, (sum(length(t)) OVER w - length(t))::BIGINT AS start, (sum(length(t)) OVER w)::BIGINT AS "end" FROM l WINDOW w AS (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.regexp_extract_all("text", F.lit(r"([^\n]*\n|[^\n]+$)"), 1)
    chunks = _documents(spark, sf).select("id", F.posexplode(lines).alias("chunk_index", "text"))
    return chunking.offsets(chunks).select("id", "chunk_index", "start", "end")


@query("SELECT p_partkey AS id, 0 AS chunk_index, 'name: ' || p_name || ', brand: ' || p_brand || ', type: ' || p_type AS text, 9 AS chunk_size, 'row_end' AS cut_type FROM part")
def row_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rendered = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("name: "), "p_name", F.lit(", brand: "), "p_brand", F.lit(", type: "), "p_type").alias("text"))
    return chunking.row_chunks(rendered, 9)


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).groupBy(ids.content_hash(F.col("text")).alias("content_hash")).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages".replace("\\\\", "\\"))
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return files.page_parts(table(spark, sf, "pages"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.plain_html(F.col("html")).alias("text"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events WHERE (json_extract(props, '$.k'))::BIGINT >= 50")
def property_path(spark: SparkSession, sf: str) -> DataFrame:
    k = F.try_variant_get(F.parse_json("props"), "$.k", "long")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k >= 50")


# ---------------------------------------------------------------- exports


_IRI = "'<http://x/' || regexp_replace({}, '[^A-Za-z0-9:_.\\-]', '_', 'g') || '>'"


@query(f"""
WITH {sql_graph()} SELECT {_IRI.format('id')} AS subject, 'rdf:type' AS predicate, {_IRI.format('type')} AS object FROM nodes
UNION ALL SELECT {_IRI.format('id')}, 'rdfs:label', '"' || name || '"' FROM nodes WHERE name IS NOT NULL
UNION ALL SELECT {_IRI.format('source_id')}, {_IRI.format('relationship_name')}, {_IRI.format('target_id')} FROM edges""")
def rdf_triples(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    return exports.triples(g.nodes, g.edges, "http://x/")


@query(f"""
WITH {sql_graph()} SELECT 1 AS part, 'MERGE (n {{id: ''' || id || '''}}) SET n.name = ''' || coalesce(name, '') || ''', n.type = ''' || type || ''';' AS value FROM nodes
UNION ALL SELECT 2, 'MATCH (a {{id: ''' || source_id || '''}}), (b {{id: ''' || target_id || '''}}) MERGE (a)-[:`' || relationship_name || '`]->(b);' FROM edges""")
def merge_script(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    return exports.merge_script(g.nodes, g.edges)


_XML = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""
WITH {sql_graph()} SELECT 0 AS part, '{exports.GRAPHML_HEAD.replace(chr(10), "' || chr(10) || '")}' AS value
UNION ALL SELECT 1, '<node id="' || {_XML.format('id')} || '"><data key="name">' || {_XML.format("coalesce(name, '')")} || '</data><data key="type">' || {_XML.format('type')} || '</data></node>' FROM nodes
UNION ALL SELECT 2, '<edge source="' || {_XML.format('source_id')} || '" target="' || {_XML.format('target_id')} || '"><data key="relationship">' || {_XML.format('relationship_name')} || '</data></edge>' FROM edges
UNION ALL SELECT 3, '{exports.GRAPHML_TAIL}'""")
def graphml_lines(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    return exports.graphml(g.nodes, g.edges)


@query(f"WITH {sql_graph()} SELECT {_IRI.format('a.source_id')} AS who, {_IRI.format('b.target_id')} AS region FROM edges a JOIN edges b ON a.target_id = b.source_id WHERE a.relationship_name = 'in_nation' AND b.relationship_name = 'in_region'")
def triple_pattern(spark: SparkSession, sf: str) -> DataFrame:
    g = derived_graph(spark, sf)
    return exports.matched(exports.triples(g.nodes, g.edges, "http://x/"), [("?who", "<http://x/in_nation>", "?n"), ("?n", "<http://x/in_region>", "?region")]).select("who", "region")


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def incremental_items(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("data_id"), "user_id", "event_type")
    done = e.where("event_type = 'view'").select("data_id", F.lit("load").alias("pipeline"))
    return stages.not_done(e, done, "load").select(F.col("data_id").alias("event_id"), "user_id")


@query("SELECT p_partkey AS id, round(0.5 + (p_size / 50 - 0.5) * pow(0.9, p_partkey % 10), 6) AS weight FROM part")
def preference_decay(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(weights.idle_decay(F.col("p_size") / 50, 0.1, F.col("p_partkey") % 10), 6).alias("weight"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return triplet_topk(spark, sf)


# ---------------------------------------------------------------- ingestion


@query("SELECT 'part_name' AS collection, 'part:' || p_partkey AS id, p_name AS text FROM part UNION ALL SELECT 'part_node_set', 'part:' || p_partkey, p_brand FROM part UNION ALL SELECT 'nation_name', 'nation:' || n_nationkey, n_name FROM nation")
def index_collections(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.collections(derived_graph(spark, sf).nodes, {"part": ["name", "node_set"], "nation": ["name"]})


@query(f"WITH {sql_graph()} SELECT e.*, trim(a.name) || '-›' || relationship_name || '-›' || trim(b.name) AS text FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id")
def triplet_texts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.triplet_texts(derived_graph(spark, sf).triplets())


@query("""
WITH f AS (SELECT p_partkey AS id, p_name || ' ' || p_size % 7 AS name, p_brand AS repo FROM part), r AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, CASE WHEN l_linenumber = 1 THEN l_partkey ELSE -1 END AS target_id, name AS target_name, repo FROM lineitem JOIN f ON id = l_partkey),
n AS (SELECT name, count(*) AS n, min(id) AS i FROM f GROUP BY 1), m AS (SELECT name, repo, count(*) AS m, min(id) AS j FROM f GROUP BY 1, 2)
SELECT ref_id, CASE WHEN f.id IS NOT NULL THEN f.id WHEN n = 1 THEN i WHEN m = 1 THEN j END AS fact_id, CASE WHEN f.id IS NOT NULL THEN 'id' WHEN n = 1 THEN 'name' WHEN m = 1 THEN 'repo' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS told_by
FROM r LEFT JOIN f ON f.id = r.target_id LEFT JOIN n ON n.name = target_name LEFT JOIN m ON m.name = target_name AND m.repo = r.repo""")
def resolved_references(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", (F.col("p_size") % 7).cast("string")).alias("name"), F.col("p_brand").alias("repo"))
    li = table(spark, sf, "lineitem").join(facts, F.col("l_partkey") == F.col("id"))
    refs = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).otherwise(F.lit(-1)).alias("target_id"), F.col("name").alias("target_name"), "repo")
    return ingest.resolved(refs, facts)


@query("""
WITH g AS (SELECT 'nation:' || s_nationkey AS principal, s_suppkey AS dataset FROM supplier UNION SELECT 'role:' || p_brand, p_partkey FROM part WHERE p_size = 1),
m AS (SELECT c_custkey AS u, 'nation:' || c_nationkey AS principal FROM customer UNION SELECT c_custkey, 'role:Brand#' || c_custkey % 25 FROM customer)
SELECT DISTINCT 'user:' || u AS user, dataset FROM m JOIN g USING (principal)""")
def readable_datasets(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    user = F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("user")
    grants = table(spark, sf, "supplier").select(F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("principal"), F.col("s_suppkey").alias("dataset")).unionByName(table(spark, sf, "part").where("p_size = 1").select(F.concat(F.lit("role:"), "p_brand").alias("principal"), F.col("p_partkey").alias("dataset")))
    membership = c.select(user, F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("principal")).unionByName(c.select(user, F.concat(F.lit("role:Brand#"), (F.col("c_custkey") % 25).cast("string")).alias("principal")))
    return ingest.readable(grants, membership)


@query("SELECT min(o_custkey) AS document, l_partkey AS entity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey HAVING count(DISTINCT o_custkey) = 1")
def owned_entities(spark: SparkSession, sf: str) -> DataFrame:
    contains = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))
    return ingest.owned_subgraph(contains, table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("document")))


@query("""
WITH r AS (SELECT l_suppkey AS edge_id, l_orderkey * 10 + l_linenumber AS evidence_id, l_extendedprice AS score FROM lineitem)
SELECT edge_id, evidence_id, score FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY score DESC, evidence_id) AS k FROM r) WHERE k <= 3 ORDER BY score DESC, edge_id, evidence_id LIMIT 50""")
def edge_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("edge_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_extendedprice").alias("score"))
    return ingest.evidence(rows, 3, 50)


@query("""
WITH l AS (SELECT p_partkey AS id, 'size' AS source, p_size::DOUBLE AS score FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_size > 10), t AS (SELECT source, max(score) AS top FROM l GROUP BY 1),
b AS (SELECT id, max(score / top) AS score, list_sort(list(DISTINCT source)) AS sources FROM l JOIN t USING (source) GROUP BY 1)
SELECT id, round(score, 6) AS score, array_to_string(sources, '+') AS sources FROM b ORDER BY round(score, 9) DESC, id LIMIT 30""")
def merged_candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    lists = p.select(F.col("p_partkey").alias("id"), F.lit("size").alias("source"), F.col("p_size").cast("double").alias("score")).unionByName(p.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.lit("price").alias("source"), F.col("p_retailprice").alias("score")))
    return ingest.candidates(lists, 30).select("id", F.round("score", 6).alias("score"), F.array_join("sources", "+").alias("sources"))


@query("""
SELECT c.o_orderkey AS order_a, d.o_orderkey AS order_b, c.o_orderstatus || '/' || d.o_orderstatus AS sets, c.o_orderstatus <> d.o_orderstatus AS disjoint
FROM orders c JOIN orders d ON d.o_orderkey = c.o_orderkey + 1 WHERE c.o_orderstatus <> d.o_orderstatus""")
def cross_set_edges(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("node_set"))
    edges = o.select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit("next").alias("relationship_name"))
    found = ingest.across_sets(edges, ingest.set_membership(o, edges))
    return found.select(F.col("source_id").alias("order_a"), F.col("target_id").alias("order_b"), F.concat_ws("/", F.array_join("source_sets", ","), F.array_join("target_sets", ",")).alias("sets"), "disjoint")


@query("""
SELECT CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN x IS NOT DISTINCT FROM y THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n
FROM (SELECT o_orderkey AS a, o_orderstatus AS x FROM orders WHERE o_orderkey % 5 <> 0) s FULL JOIN (SELECT o_orderkey AS b, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS y FROM orders WHERE o_orderkey % 3 <> 0) l ON a = b GROUP BY 1""")
def mark_and_sweep(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    loaded = o.where("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return ingest.swept(o.where("o_orderkey % 5 <> 0"), loaded, "o_orderkey", "o_orderstatus")


@query(r"""
WITH l AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+$')) AS t, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+$'), 1) AS k FROM documents),
c AS (SELECT id, k - 1 AS k, sum(length(t)) OVER w - length(t) AS s, sum(length(t)) OVER w AS e FROM l WINDOW w AS (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT id, k::INT AS chunk_index FROM c WHERE s < 100 + id % 300 AND e > 50 + id % 200""")
def span_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    chunks = chunking.offsets(d.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([^\n]*\n|[^\n]+$)"), 1)).alias("chunk_index", "text")))
    spans = d.select("id", (50 + F.col("id") % 200).alias("from"), (100 + F.col("id") % 300).alias("to"))
    return chunking.overlapping_span(chunks, spans).select("id", "chunk_index")
