"""Ontologies as triples: RDF/XML by Spark's XML reader, N-Triples by lines.

triples: (subject, predicate, object, literal); names are whole URIs, ``literal`` says that the object is a text.
Elements are read into variants, so no schema is known before and none is inferred; a large file is cut at its elements.

Defined cases: an element without a name gets one from its file and content (``_:`` and a digest), so equal ones are one; members of a collection are
objects of the property itself; a repeated triple counts once; prefixes are those that the same file declares
anywhere (of several meanings the smallest), unknown ones stay as they are; lines that are no triples are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions.shared import written

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
TYPE, SUBCLASS = f"{RDF}type", f"{RDFS}subClassOf"
ELEMENTS = ("owl:Class", "owl:ObjectProperty", "owl:NamedIndividual", "rdf:Description")

_LINE = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s.]+(?:\.[^\s.]+)*)|"((?:[^"\\]|\\.)*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
_FIELDS = "map<string,variant>"


def n_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of files with one triple a line; escapes in texts stay as written."""
    part = lambda n: F.regexp_extract("value", _LINE, n)
    found = spark.read.text(path).where(F.col("value").rlike(_LINE))
    name = F.concat(part(4), part(5))
    return found.select(F.concat(part(1), part(2)).alias("subject"), part(3).alias("predicate"), F.when(name != "", name).otherwise(part(6)).alias("object"), (name == "").alias("literal")).distinct()


def _namespaces(spark: SparkSession, path: str) -> DataFrame:
    """file, ns: the prefixes that each file declares, with its base under ``xml:base``."""
    declared = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").rlike("xmlns|xml:base"))
    told = declared.select("file", F.explode(F.regexp_extract_all("value", F.lit(r"""((?:xmlns(?::[\w.-]+)?|xml:base)\s*=\s*["'][^"']*["'])"""), 1)).alias("one"))
    pairs = told.select("file", F.regexp_replace(F.regexp_extract("one", r"^([^\s=]+)", 1), "^xmlns:?", "").alias("prefix"), F.regexp_extract("one", r"""["']([^"']*)["']$""", 1).alias("uri"))
    once = pairs.groupBy("file", "prefix").agg(F.min("uri").alias("uri"))
    return once.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "uri"))).alias("ns"))  # a schema's prefixes


def _expanded(name: Column) -> Column:
    """A prefixed name as a URI by the row's ``ns``."""
    prefix = F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1)).otherwise("")
    uri = F.element_at("ns", prefix)
    return F.when(uri.isNull(), name).otherwise(F.concat(uri, F.substring_index(name, ":", -1)))


def _against_base(name: Column) -> Column:
    return F.when(name.rlike("^(#|$)"), F.concat(F.coalesce(F.element_at("ns", F.lit("xml:base")), F.lit("")), name)).otherwise(name)


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", _FIELDS)


def _each(value: Column) -> Column:
    return F.explode(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value)))


def _text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def _named(rows: DataFrame) -> DataFrame:
    """Adds ``subject`` to node elements (file, ns, tag, node)."""
    at = lambda a: F.element_at("fields", F.lit(f"_rdf:{a}")).cast("string")
    digest = F.sha1(F.concat_ws("|", "file", "tag", F.to_json("node")))
    subject = F.coalesce(_against_base(at("about")), _against_base(F.concat(F.lit("#"), at("ID"))), F.concat(F.lit("_:"), at("nodeID")), F.concat(F.lit("_:"), digest))
    return rows.withColumn("fields", F.coalesce(_fields(F.col("node")), F.create_map().cast(_FIELDS))).withColumn("subject", subject)


def _told(level: DataFrame) -> DataFrame:
    """file, subject, predicate, object, literal, name, inner: a triple of each value of the elements (file, ns, tag, node, above, by), or the elements inside it.

    One pass: an element's type and its link to the element above it go as fields without a value.
    """
    nodes = _named(level)
    own = lambda name, there: F.when(there, F.array(F.struct(F.lit(name).alias("key"), F.lit(None).cast("variant").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:variant>>"))
    entries = F.concat(own("", F.col("tag") != "rdf:Description"), own("/", F.col("above").isNotNull()), F.map_entries("fields"))
    fields = nodes.select("file", "ns", "tag", "above", "by", "subject", F.explode(entries).alias("e")).select("*", F.col("e.key").alias("name"), F.col("e.value").alias("whole")).drop("e")
    name = F.col("name")
    attribute, own_tag, link = name.startswith("_"), name == "", name == "/"
    many = F.when(attribute | own_tag | link, F.array("whole")).otherwise(F.coalesce(F.try_variant_get("whole", "$", "array<variant>"), F.array("whole")))
    values = fields.select("*", F.explode(many).alias("value")).drop("whole")
    values = values.withColumn("fields", F.when(~(attribute | own_tag | link), _fields(F.col("value"))))
    refers = F.coalesce(_against_base(F.element_at("fields", F.lit("_rdf:resource")).cast("string")), F.concat(F.lit("_:"), F.element_at("fields", F.lit("_rdf:nodeID")).cast("string")))
    inner = F.map_filter(F.coalesce("fields", F.create_map().cast(_FIELDS)), lambda k, v: ~k.startswith("_"))
    values = values.withColumn("refers", refers).withColumn("inner", inner)
    plain = attribute & (name != "_VALUE") & ~name.rlike("^_(rdf|xml|xmlns):|^_xmlns$")
    text = F.when(F.col("fields").isNull(), _text(F.col("value"))).otherwise(F.element_at("fields", F.lit("_VALUE")).cast("string"))
    empty, below = F.size("inner") == 0, F.col("refers").isNull() & (F.size("inner") > 0)
    kind = F.when(own_tag, "type").when(link, "link").when(plain, "note").when(attribute, None).when(F.col("refers").isNotNull(), "name").when(empty, "text").otherwise("inner")
    values = values.withColumn("kind", kind).where("kind is not null")
    is_ = lambda *of: F.col("kind").isin(*of)
    predicate = F.when(is_("type"), TYPE).when(is_("link"), _expanded(F.col("by"))).when(is_("note"), _expanded(F.substr("name", F.lit(2)))).when(is_("name", "text"), _expanded(name))
    object_ = F.when(is_("type"), _expanded(F.col("tag"))).when(is_("link"), F.col("subject")).when(is_("note"), F.col("value").cast("string")).when(is_("name"), F.col("refers")).when(is_("text"), F.coalesce(text, F.lit("")))
    subject = F.when(is_("link"), F.col("above")).otherwise(F.col("subject"))
    return values.select("file", subject.alias("subject"), predicate.alias("predicate"), object_.alias("object"), is_("note", "text").alias("literal"), "name", F.when(is_("inner") & below, F.to_json("inner")).alias("inner"))


def rdf_xml(spark: SparkSession, path: str, elements: Sequence[str] = ELEMENTS) -> DataFrame:
    """Triples of RDF/XML files. ``elements`` are the names of elements, as written, that describe something at the top.

    Elements inside others are read wherever they are. Each name in ``elements`` is a scan of the files.
    """
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).option("singleVariantColumn", "node").load(path).select(F.col("_metadata.file_path").alias("file"), F.lit(tag).alias("tag"), "node")
    ns = written(_namespaces(spark, path), "prefixes")
    # a row a file: its elements are not brought together in one task
    placed = lambda df: df.join(F.broadcast(ns), "file", "left").withColumn("ns", F.coalesce("ns", F.create_map().cast("map<string,string>")))
    none = F.lit(None).cast("string")
    level = reduce(DataFrame.unionByName, [read(tag) for tag in elements]).withColumn("node", F.parse_json(F.to_json("node"))).select("*", none.alias("above"), none.alias("by"))
    parts = []
    while True:
        told = written(_told(placed(level)), "elements")
        parts.append(told.where("inner is null").select("subject", "predicate", "object", "literal"))
        children = told.where("inner is not null").select("file", F.col("subject").alias("above"), F.col("name").alias("by"), F.explode(_fields(F.parse_json("inner"))).alias("tag", "many"))
        if children.isEmpty():
            break
        level = children.select("file", "tag", _each(F.col("many")).alias("node"), "above", "by")
    return written(reduce(DataFrame.unionByName, parts).distinct(), "triples")
