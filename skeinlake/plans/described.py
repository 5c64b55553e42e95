"""Registered queries of ontologies, code snapshots and the evidence of answers, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions.shared import shared_dir
from skeinlake.operators import codegraph, ontology
from skeinlake.plans import evidence
from skeinlake.plans.catalogue import query
from skeinlake.plans.derived import graph as derived_graph
from skeinlake.plans.derived import sql_graph, table
from skeinlake.sources import ontologies

_V = "http://example.org/v#"
_ROOT = f'rdf:RDF xmlns:rdf="{ontologies.RDF}" xmlns:rdfs="{ontologies.RDFS}" xmlns:owl="{ontologies.OWL}" xmlns="{_V}"'


def _ontology(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of RDF/XML written from the tables: regions over nations as classes, suppliers as members, what came back to them."""
    name = lambda kind, c: F.concat(F.lit(f"{_V}{kind}_"), F.col(c).cast("string"))
    row = lambda df, about, kind=None, above=None, part=None: df.select(about.alias("_rdf:about"), *(F.struct(v.alias("_rdf:resource")).alias(k) if v is not None else F.lit(None).cast("struct<`_rdf:resource`:string>").alias(k) for k, v in (("rdf:type", kind), ("rdfs:subClassOf", above), ("Returned_Part", part))))
    owl = lambda n: F.lit(f"{ontologies.OWL}{n}")
    rows = row(table(spark, sf, "region"), name("Region", "r_regionkey"), kind=owl("Class"))
    rows = rows.unionByName(row(table(spark, sf, "nation"), name("Nation", "n_nationkey"), kind=owl("Class"), above=name("Region", "n_regionkey")))
    for kind in (owl("NamedIndividual"), name("Nation", "s_nationkey")):
        rows = rows.unionByName(row(table(spark, sf, "supplier"), name("Supplier", "s_suppkey"), kind=kind))
    pairs = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    rows = rows.unionByName(row(pairs, name("Supplier", "l_suppkey"), part=name("Part", "l_partkey")))
    rows = rows.unionByName(row(spark.range(1), F.lit(f"{_V}Returned_Part"), kind=owl("ObjectProperty")))
    path = f"{shared_dir(spark).rstrip('/')}/ontology-{uuid.uuid4().hex}"
    rows.write.format("xml").option("validateName", False).option("rootTag", _ROOT).option("rowTag", "rdf:Description").save(path)
    return ontologies.rdf_xml(spark, path, ("rdf:Description",))


@query("""
WITH s AS (SELECT s_suppkey, 'supplier_' || s_suppkey AS k, 'nation_' || s_nationkey AS n, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT k AS start_key, k AS source_id, 'is_a' AS relationship_name, n AS target_id FROM s UNION SELECT k, k, 'is_a', 'namedindividual' FROM s
UNION SELECT k, n, 'is_a', 'region_' || n_regionkey FROM s UNION SELECT k, n, 'is_a', 'class' FROM s UNION SELECT k, 'region_' || n_regionkey, 'is_a', 'class' FROM s
UNION SELECT k, k, 'returned_part', 'part_' || l_partkey FROM s JOIN lineitem ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'""")
def ontology_attached(spark: SparkSession, sf: str) -> DataFrame:
    """What an ontology in RDF/XML says of each supplier, asked for by name."""
    triples = _ontology(spark, sf)
    names = table(spark, sf, "supplier").select(F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("name"))
    starts = ontology.matched(names, ontology.lookup(triples)).select("uri")
    told = ontology.attached(triples, starts).edges
    return told.select(ontology.key(F.col("start")).alias("start_key"), "source_id", "relationship_name", "target_id")


@query("""
WITH s AS (SELECT 'supplier_' || s_suppkey AS k, 'nation_' || s_nationkey AS n, 'region_' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT k AS key, 'individuals' AS category, 0 AS hops FROM s UNION SELECT n, 'classes', 1 FROM s UNION SELECT r, 'classes', 2 FROM s
UNION SELECT 'class', 'unknown', 2 FROM s UNION SELECT 'namedindividual', 'unknown', 1 FROM s UNION SELECT 'part_' || l_partkey, 'unknown', 1 FROM lineitem WHERE l_returnflag = 'R'""")
def ontology_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The one graph of all suppliers in the ontology, by hops."""
    triples = _ontology(spark, sf)
    starts = ontology.lookup(triples).where("category = 'individuals'")
    return ontology.attached(triples, starts, apart=False).nodes.select("key", "category", "hops")


@query()
def closest_part_names(spark: SparkSession, sf: str) -> DataFrame:
    """word, key, ratio: part names of odd keys with a letter left out, and the closest of all part names."""
    names = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type"), "p_size").alias("key"))
    cut = F.pmod("p_partkey", F.length("key")).cast("int")
    words = names.where("p_partkey % 2 = 1").select(F.concat(F.substr("key", F.lit(1), cut), F.substr("key", cut + 2)).alias("key"))
    return ontology.close(words, names)


def _snapshot(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as a snapshot's lines in their order, some of them broken, written and read back."""
    e = table(spark, sf, "events").withColumn("k", F.pmod("event_id", F.lit(11)))
    name = F.when(F.col("k") == 3, F.lit(None)).otherwise(F.concat(F.lit("pkg"), F.pmod("user_id", F.lit(5)).cast("string"), F.lit(".F"), F.col("user_id").cast("string")))
    kind = F.when(F.col("event_type") == "click", "symbol").when(F.col("event_type") == "error", "insight").otherwise(F.col("event_type"))
    told = F.to_json(F.struct(kind.alias("kind"), name.alias("name"), F.concat(F.lit("repo"), F.pmod("user_id", F.lit(2)).cast("string")).alias("repo"), F.concat(F.lit("src/"), F.col("event_type")).alias("file"), F.col("event_id").alias("line"), F.struct(F.lit("class").alias("symbol_kind"), F.format_number("value", 2).alias("description")).alias("props")))
    line = F.when(F.col("k") == 5, F.lit('{"kind": "symbol"')).when(F.col("k") == 7, F.lit("[1]")).otherwise(told)
    path = f"{shared_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    e.orderBy("event_id").select(line.alias("value")).write.text(path)
    return codegraph.snapshot(spark, path, "here")


_FACTS = """
f AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'symbol' WHEN 'error' THEN 'insight' ELSE event_type END AS kind, CASE WHEN event_id % 11 <> 3 THEN 'pkg' || user_id % 5 || '.F' || user_id END AS name,
  'repo' || user_id % 2 AS repo, event_type, value FROM events WHERE event_id % 11 NOT IN (5, 7))"""


@query(f"""
WITH {_FACTS}
SELECT repo, kind, name, CASE kind WHEN 'symbol' THEN 'CodeSymbol' ELSE 'CodeInsight' END AS type, min(event_id)::INT AS line, CASE kind WHEN 'symbol' THEN 'class' END AS symbol_kind,
  CASE kind WHEN 'insight' THEN format('{{:,.2f}}', arg_min(value, event_id)) END AS description
FROM f WHERE kind IN ('symbol', 'insight') AND name IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT repo, 'repository', repo, 'CodeRepository', NULL::INT, NULL, NULL FROM f""")
def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of a snapshot whose facts are the events."""
    return codegraph.mapped(_snapshot(spark, sf)[0]).select("repo", "kind", "name", "type", "line", "symbol_kind", "description")


@query(f"""
WITH {_FACTS}, g AS (SELECT kind, kind IN ('symbol', 'insight') AS known, repo, CASE WHEN kind IN ('symbol', 'insight') THEN name END AS name, count(*) AS n FROM f GROUP BY 1, 2, 3, 4)
SELECT * FROM (SELECT kind, CASE WHEN NOT known THEN 'unknown_kind' WHEN name IS NULL THEN 'no_name' ELSE 'repeated' END AS reason, sum(CASE WHEN known AND name IS NOT NULL THEN n - 1 ELSE n END)::BIGINT AS facts FROM g GROUP BY 1, 2) WHERE facts > 0
UNION ALL SELECT 'line', 'no_object', count(*) FROM events WHERE event_id % 11 IN (5, 7)""")
def code_facts_refused(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines and facts of the snapshot gave no node, by reason."""
    facts, refused = _snapshot(spark, sf)
    return codegraph.not_mapped(facts).unionByName(refused.select(F.lit("line").alias("kind"), F.lit("no_object").alias("reason"), F.col("lines").alias("facts")))


def _loads(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Nodes and edges of two loads: parts by their last price in a period, and who shipped them."""
    items = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    out = []
    for kept in ("l_shipdate < timestamp'1996-01-01'", "l_shipdate >= timestamp'1995-06-01'"):
        rows = items.where(f"{kept} and l_quantity > 40")
        out.append(rows.groupBy(F.col("l_partkey").cast("string").alias("id"), F.col("p_brand").alias("repo"), F.concat_ws(" ", "p_name", "p_partkey").alias("name")).agg(F.max("l_quantity").cast("int").cast("string").alias("fact_hash")))
        out.append(rows.select(F.col("l_partkey").cast("string").alias("source_id"), F.col("l_suppkey").cast("string").alias("target_id"), F.lit("shipped").alias("relationship_name")))
    return out


@query("""
WITH i AS (SELECT *, p_name || ' ' || p_partkey AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40),
b AS (SELECT l_partkey AS id, p_brand AS repo, name, max(l_quantity) AS h FROM i WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2, 3),
a AS (SELECT l_partkey AS id, p_brand AS repo, name, max(l_quantity) AS h FROM i WHERE l_shipdate >= TIMESTAMP '1995-06-01' GROUP BY 1, 2, 3),
n AS (SELECT id, coalesce(a.repo, b.repo) AS repo, coalesce(a.name, b.name) AS name, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL JOIN b USING (id) WHERE a.h IS DISTINCT FROM b.h),
eb AS (SELECT DISTINCT p_brand AS repo, l_partkey, l_suppkey FROM i WHERE l_shipdate < TIMESTAMP '1996-01-01'), ea AS (SELECT DISTINCT p_brand AS repo, l_partkey, l_suppkey FROM i WHERE l_shipdate >= TIMESTAMP '1995-06-01'),
e AS (SELECT 'added' AS change, repo, count(*) AS edges FROM (FROM ea EXCEPT FROM eb) GROUP BY 2 UNION ALL SELECT 'removed', repo, count(*) FROM (FROM eb EXCEPT FROM ea) GROUP BY 2),
c AS (SELECT repo, change, count(*) AS nodes, array_to_string(list_sort(list(name))[1:20], ',') AS samples FROM n GROUP BY 1, 2)
SELECT repo, change, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, coalesce(samples, '') AS samples FROM c FULL JOIN e USING (repo, change)""")
def code_delta(spark: SparkSession, sf: str) -> DataFrame:
    """What the second load changed against the first, by brand."""
    b, eb, a, ea = _loads(spark, sf)
    return codegraph.delta(b, a, eb, ea).withColumn("samples", F.array_join("samples", ","))


@query("""
WITH n AS (SELECT p_partkey AS id, p_brand AS repo, p_type AS package, p_type || '.' || CASE WHEN p_partkey % 3 = 0 THEN 'New' ELSE '' END || p_size AS name, p_partkey % 3 = 1 AS type FROM part),
t AS (SELECT * FROM n WHERE id % 4 = 0), y AS (SELECT * FROM t WHERE type)
SELECT 'part:' || id AS id FROM t UNION SELECT 'part:' || n.id FROM n JOIN y ON n.repo = y.repo AND n.name = y.package || '.New' || split_part(y.name, '.', 2)
UNION SELECT 'supplier:' || l_suppkey FROM lineitem JOIN y ON id = l_partkey""")
def impact_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth part with what stands for its methods and constructors."""
    p = table(spark, sf, "part")
    part = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    supplier = lambda c: F.concat(F.lit("supplier:"), F.col(c).cast("string"))
    name = F.concat("p_type", F.lit("."), F.when(F.pmod("p_partkey", F.lit(3)) == 0, "New").otherwise(""), F.col("p_size").cast("string"))
    nodes = p.select(part("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.lit("CodeSymbol").alias("type"), F.when(F.pmod("p_partkey", F.lit(3)) == 1, "class").otherwise("function").alias("symbol_kind"), name.alias("name"), F.lit("a/b.py").alias("file"))
    nodes = nodes.unionByName(table(spark, sf, "supplier").select(supplier("s_suppkey").alias("id"), F.lit("").alias("repo"), F.lit("CodeSymbol").alias("type"), F.lit("method").alias("symbol_kind"), F.col("s_name").alias("name"), F.lit("a/b.py").alias("file")))
    edges = table(spark, sf, "lineitem").select(part("l_partkey").alias("source_id"), supplier("l_suppkey").alias("target_id"), F.lit("has_method").alias("relationship_name"))
    return codegraph.impact_seeds(nodes, edges, p.where("p_partkey % 4 = 0").select(part("p_partkey").alias("id")))


@query(f"""
WITH {sql_graph(("nation", "supplier", "part"))}
SELECT source_id AS id, (row_number() OVER (PARTITION BY source_id ORDER BY relationship_name, n.name, target_id) - 1)::INT AS place, relationship_name AS relation, target_id, n.name AS target FROM edges JOIN nodes n ON n.id = target_id""")
def fact_relations(spark: SparkSession, sf: str) -> DataFrame:
    """The relations of suppliers in the order in which a view shows them."""
    known = derived_graph(spark, sf, ("nation", "supplier", "part"))
    return codegraph.relations(known.nodes.withColumn("file", F.lit("")).withColumn("line", F.lit(None).cast("int")), known.edges)


_HITS = """
h AS (SELECT o_custkey % 50 AS query_id, l_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Document chunk mentions ' ELSE '' END || p_name || ' ' || p_brand AS text, min(l_orderkey) AS rank
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT c_custkey % 50 AS query_id, c_nationkey * 3 AS id FROM customer WHERE c_custkey % 50 < 30)"""
_FACT = "CASE WHEN starts_with(text, 'Document chunk mentions ') THEN upper(text[25:25]) || text[26:] ELSE text END"


def _hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    text = F.concat(F.when(F.pmod("p_size", F.lit(2)) == 0, evidence.MENTION).otherwise(""), "p_name", F.lit(" "), "p_brand")
    hits = rows.groupBy(F.pmod("o_custkey", F.lit(50)).alias("query_id"), F.col("l_partkey").alias("id"), text.alias("text")).agg(F.min("l_orderkey").alias("rank"))
    shown = table(spark, sf, "customer").where("c_custkey % 50 < 30").select(F.pmod("c_custkey", F.lit(50)).alias("query_id"), (F.col("c_nationkey") * 3).cast("long").alias("id"), F.lit("e").alias("entity")).distinct()
    return hits, shown


@query(f"""
WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS place FROM h WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM s))
SELECT query_id, id, {_FACT} AS text, place::INT AS place FROM r WHERE place <= CASE WHEN query_id IN (SELECT query_id FROM s) THEN 5 ELSE 12 END""")
def facts_beside_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of fifty queries: five where entities were found, else as many as the edges' budget allows."""
    return evidence.facts_for_entities(*_hits(spark, sf), 5, 12)


@query(f"""
WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS place FROM h WHERE id % 7 = query_id % 7 AND (query_id, id) NOT IN (SELECT (query_id, id) FROM s))
SELECT query_id, id, {_FACT} AS text, place::INT AS place FROM r WHERE place <= 5""")
def facts_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    hits, shown = _hits(spark, sf)
    return evidence.facts_for_entities(hits, shown, 5, 12, scoped=hits.where("id % 7 = query_id % 7"))


_SHOWN = "t AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, 'supplier:' || l_suppkey AS source_id, 'part:' || l_partkey AS target_id, CASE WHEN l_linenumber <> 4 THEN 'ships' END AS relationship_name, l_returnflag = 'R' AS r, l_linenumber AS n FROM lineitem)"


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    own = F.when(F.col("l_returnflag") == "R", F.concat_ws("/", "l_suppkey", "l_partkey"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), text("supplier", "l_suppkey").alias("source_id"), text("part", "l_partkey").alias("target_id"), F.when(F.col("l_linenumber") != 4, "ships").alias("relationship_name"), own.alias("edge_object_id"))


@query(f"""
WITH {_SHOWN} SELECT query_id, 'node' AS kind, source_id AS id FROM t UNION SELECT query_id, 'node', target_id FROM t
UNION SELECT query_id, 'edge', split_part(source_id, ':', 2) || '/' || split_part(target_id, ':', 2) FROM t WHERE r""")
def used_elements(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes and edges that each order's lines, taken as triplets, touch."""
    return evidence.used_elements(_shown(spark, sf))


@query(f"""
WITH {_SHOWN}, x AS (SELECT query_id, source_id AS id, rank * 2 AS p FROM t UNION ALL SELECT query_id, target_id, rank * 2 + 1 FROM t), nodes AS (SELECT query_id, id, min(p) AS p FROM x GROUP BY 1, 2),
names AS (SELECT 'part:' || p_partkey AS id, p_name AS label FROM part UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier),
e AS (SELECT query_id, source_id, target_id, relationship_name, min(rank) AS p FROM t WHERE relationship_name IS NOT NULL GROUP BY 1, 2, 3, 4),
every AS (SELECT query_id, 0 AS part, p, 0 AS n, 'graph_node' AS kind, label, NULL AS source_id, NULL AS target_id, NULL AS relationship_name, id AS segment, id AS tie FROM nodes LEFT JOIN names USING (id)
UNION ALL SELECT query_id, 1, p, 0, 'graph_edge', NULL, source_id, target_id, relationship_name, NULL, source_id || ' ' || target_id FROM e
UNION ALL SELECT query_id, 2, e.p, l_linenumber, 'segment', NULL, NULL, NULL, NULL, 'chunk ' || l_orderkey || ' ' || l_linenumber, source_id || ' ' || target_id FROM e JOIN lineitem ON source_id = 'supplier:' || l_suppkey AND target_id = 'part:' || l_partkey AND l_orderkey % 5 = 0 AND l_orderkey = query_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY part, p, n, tie) - 1)::INT AS rank, kind, label, source_id, target_id, relationship_name, segment FROM every""")
def context_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What each order's lines, taken as a context, show: nodes, edges, and the chunks of every fifth order that support the edges."""
    known = derived_graph(spark, sf, ("supplier", "part"))
    rows = _shown(spark, sf).drop("edge_object_id").withColumn("edge_object_id", F.concat_ws(" ", "query_id", "source_id", "target_id"))
    chunk = F.concat_ws(" ", F.lit("chunk"), "query_id", "rank")
    segments = rows.where("query_id % 5 = 0").select(F.col("edge_object_id").alias("artifact_id"), chunk.alias("chunk_id"), F.col("rank").alias("chunk_index"))
    told = evidence.context_evidence(rows, known.nodes, segments)
    return told.select("query_id", "rank", "kind", "label", "source_id", "target_id", "relationship_name", F.when(F.col("kind") != "graph_edge", F.col("artifact_id")).alias("segment"))
