"""Sinks: a graph as JSON lines, GraphML, a merge script or triples, each line by an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAPHML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="node" attr.name="name" attr.type="string"/><key id="type" for="node" attr.name="type" attr.type="string"/><key id="relationship" for="edge" attr.name="relationship" attr.type="string"/><graph edgedefault="directed">'
GRAPHML_TAIL = "</graph></graphml>"


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _literal(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """value: one JSON object per node and edge."""
    return nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value")).unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *edges.columns)).alias("value")))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, value: the lines of a GraphML file; written in order of part."""
    spark = nodes.sparkSession
    node = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="name">'), _xml(F.coalesce("name", F.lit(""))), F.lit('</data><data key="type">'), _xml(F.col("type")), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), _xml(F.col("source_id")), F.lit('" target="'), _xml(F.col("target_id")), F.lit('"><data key="relationship">'), _xml(F.col("relationship_name")), F.lit("</data></edge>"))
    ends = spark.createDataFrame([(0, GRAPHML_HEAD), (3, GRAPHML_TAIL)], "part int, value string")
    return ends.unionByName(nodes.select(F.lit(1).alias("part"), node.alias("value"))).unionByName(edges.select(F.lit(2).alias("part"), edge.alias("value")))


def merge_script(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, value: MERGE statements for nodes, then for edges."""
    node = F.concat(F.lit("MERGE (n {id: "), _quoted(F.col("id")), F.lit("}) SET n.name = "), _quoted(F.coalesce("name", F.lit(""))), F.lit(", n.type = "), _quoted(F.col("type")), F.lit(";"))
    edge = F.concat(F.lit("MATCH (a {id: "), _quoted(F.col("source_id")), F.lit("}), (b {id: "), _quoted(F.col("target_id")), F.lit("}) MERGE (a)-[:`"), F.replace("relationship_name", F.lit("`"), F.lit("``")), F.lit("`]->(b);"))
    return nodes.select(F.lit(1).alias("part"), node.alias("value")).unionByName(edges.select(F.lit(2).alias("part"), edge.alias("value")))


def triples(nodes: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    """subject, predicate, object: type and label of nodes, and relations."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.regexp_replace(c, r"[^A-Za-z0-9:_.\-]", "_"), F.lit(">"))
    kind = nodes.select(iri(F.col("id")).alias("subject"), F.lit("rdf:type").alias("predicate"), iri(F.col("type")).alias("object"))
    label = nodes.where("name is not null").select(iri(F.col("id")).alias("subject"), F.lit("rdfs:label").alias("predicate"), _literal(F.col("name")).alias("object"))
    relation = edges.select(iri(F.col("source_id")).alias("subject"), iri(F.col("relationship_name")).alias("predicate"), iri(F.col("target_id")).alias("object"))
    return kind.unionByName(label).unionByName(relation)


def matched(graph_triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a basic graph pattern: terms that begin with ? are variables; each pattern is a join."""
    out = None
    for s, p, o in patterns:
        part = graph_triples
        names: dict[str, str] = {}
        for column, term in (("subject", s), ("predicate", p), ("object", o)):
            if not term.startswith("?"):
                part = part.where(F.col(column) == term)
            elif term[1:] in names:
                part = part.where(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        part = part.select(*(F.col(c).alias(v) for v, c in names.items()))
        if out is None:
            out = part
        elif shared := sorted(set(out.columns) & set(part.columns)):
            out = out.join(part, shared)
        else:
            raise ValueError("each pattern has to share a variable with those before it")
    return out


def write_lines(df: DataFrame, path: str) -> None:
    """Writes value lines in order of part, one file per run of parts."""
    (df.orderBy("part") if "part" in df.columns else df).select("value").write.mode("overwrite").text(path)
