"""Registered queries of store writes, references, names, spans and rows of sessions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions import ids, moments, text, vector
from skeinlake.operators import chunking, codefacts, graph, ingest, sessions, store, traversal
from skeinlake.plans import retrieval
from skeinlake.plans.catalogue import query
from skeinlake.plans.derived import graph as derived_graph
from skeinlake.plans.derived import sql_graph, table

_SHIPS = "'supplier:' || l_suppkey AS source_id, 'part:' || l_partkey AS target_id, 'ships' AS relationship_name"


def _ships(spark: SparkSession, sf: str, *columns: str | Column) -> DataFrame:
    items = table(spark, sf, "lineitem")
    return items.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"), F.lit("ships").alias("relationship_name"), *columns)


@query(f"""
WITH e AS (SELECT {_SHIPS}, l_orderkey * 10 + l_linenumber AS version, l_quantity AS quantity, l_shipdate >= TIMESTAMP '1995-01-01' AS late FROM lineitem)
SELECT source_id, target_id, relationship_name, max(version) AS version, arg_max(quantity, version) AS quantity FROM e
WHERE late OR (source_id, target_id) NOT IN (SELECT (source_id, target_id) FROM e WHERE late) GROUP BY 1, 2, 3, late""")
def edges_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """The last shipment of each supplier and part: those from 1995 on replace what is stored."""
    rows = _ships(spark, sf, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"), F.col("l_quantity").alias("quantity"), "l_shipdate")
    late = F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")
    stored = graph.upserted(rows.where("false"), rows.where(~late), list(graph.KEY), "version")
    return graph.upserted(stored, rows.where(late), list(graph.KEY), "version").drop("l_shipdate")


@query("""
SELECT c_custkey AS id, coalesce(w, 0.5) AS weight FROM customer LEFT JOIN (SELECT o_custkey, round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 4) AS w FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def node_weights_set(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' weights, set to their share of filled orders where they have orders."""
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 4).alias("weight"))
    return graph.updated(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(0.5).alias("weight")), new, "id", "weight")


@query(f"SELECT DISTINCT {_SHIPS} FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')")
def edge_triples_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """What suppliers ship and nobody has returned."""
    rows = _ships(spark, sf, "l_returnflag")
    return graph.edges_deleted(rows.select(*graph.KEY).distinct(), rows.where("l_returnflag = 'R'"))


@query("SELECT c_custkey AS id, c_mktsegment <> 'BUILDING' AS has_segment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'all' ELSE 'all,' || c_mktsegment END AS tags FROM customer")
def tags_taken_off(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("all"), "c_mktsegment").alias("belongs_to_set"))
    return graph.tags_removed(rows, ["BUILDING"]).select("id", (F.size("belongs_to_set") > 1).alias("has_segment"), F.array_join("belongs_to_set", ",").alias("tags"))


_EDGE_REFS = f"SELECT {_SHIPS}, list_sort(list_distinct(list(l_returnflag || '/' || l_orderkey % 7 || '/run' || l_linenumber))) AS source_refs FROM lineitem GROUP BY 1, 2, 3"


def _edge_refs(spark: SparkSession, sf: str) -> DataFrame:
    ref = store.reference(F.col("l_returnflag"), F.pmod("l_orderkey", F.lit(7)).cast("string"), F.concat(F.lit("run"), F.col("l_linenumber").cast("string")))
    return _ships(spark, sf, ref.alias("ref")).groupBy(*graph.KEY).agg(F.array_sort(F.collect_set("ref")).alias("source_refs"))  # 3 x 7 x 7 at most


@query(f"SELECT source_id, target_id, relationship_name FROM ({_EDGE_REFS}) WHERE list_contains(source_refs, 'R/3/run1')")
def edges_by_source_ref(spark: SparkSession, sf: str) -> DataFrame:
    return store.with_reference(_edge_refs(spark, sf), "R/3/run1").select(*graph.KEY)


@query(f"SELECT source_id, target_id, relationship_name, array_to_string(list_filter(source_refs, lambda r: split_part(r, '/', 1) = 'R'), ',') AS refs FROM ({_EDGE_REFS}) WHERE len(list_filter(source_refs, lambda r: split_part(r, '/', 1) = 'R')) > 0")
def edge_refs_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return store.references_of(_edge_refs(spark, sf), graph.KEY, dataset="R").select(*graph.KEY, F.array_join("refs", ",").alias("refs"))


@query(f"SELECT source_id, target_id, relationship_name, array_to_string(list_filter(source_refs, lambda r: split_part(r, '/', 3) = 'run2'), ',') AS refs FROM ({_EDGE_REFS}) WHERE len(list_filter(source_refs, lambda r: split_part(r, '/', 3) = 'run2')) > 0")
def edge_refs_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return store.references_of(_edge_refs(spark, sf), graph.KEY, run="run2").select(*graph.KEY, F.array_join("refs", ",").alias("refs"))


@query(f"SELECT source_id, target_id, array_to_string(list_filter(source_refs, lambda r: r <> 'N/0/run1'), ',') AS refs, source_refs = ['N/0/run1'] AS orphaned FROM ({_EDGE_REFS})")
def edge_refs_removed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.refs_removed(_edge_refs(spark, sf), ["N/0/run1"]).select("source_id", "target_id", F.array_join("source_refs", ",").alias("refs"), "orphaned")


@query(f"SELECT source_id, target_id, relationship_name, array_to_string(list_sort(list_distinct(list_transform(source_refs, lambda r: split_part(r, '/', 2)))), ',') AS data FROM ({_EDGE_REFS}) WHERE list_contains(source_refs, 'A/1/run3')")
def edge_delete_data(spark: SparkSession, sf: str) -> DataFrame:
    """What deleting has to know of the edges that one reference marks."""
    rows = _edge_refs(spark, sf)
    return store.delete_data(rows, store.with_reference(rows, "A/1/run3"), graph.KEY, ()).select(*graph.KEY, F.array_join("data", ",").alias("data"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS from_text, epoch_us(ts) // 1000000 * 1000 AS from_number, epoch_us(ts) // 1000000 * 1000 AS from_parts FROM events")
def event_moments(spark: SparkSession, sf: str) -> DataFrame:
    """An event's time read from text, from epoch seconds, and from its parts."""
    ts = F.col("ts")
    parts = moments.epoch_ms(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts))
    at = lambda c: F.unix_millis(moments.parsed(c).cast("timestamp"))
    return table(spark, sf, "events").select("event_id", at(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("from_text"), at(F.unix_timestamp(ts).cast("string")).alias("from_number"), parts.alias("from_parts"))


@query("SELECT p_partkey, p_size AS value FROM part")
def roman_values(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of parts, written as Roman numerals and read back."""
    digits = lambda one, five, ten: F.array(*(F.lit(d.replace("1", one).replace("5", five).replace("0", ten)) for d in ("", "1", "11", "111", "15", "5", "51", "511", "5111", "10")))
    size = F.col("p_size")
    written = F.concat(F.get(digits("X", "L", "C"), F.floor(size / 10).cast("int")), F.get(digits("I", "V", "X"), F.pmod(size, F.lit(10))))
    return table(spark, sf, "part").select("p_partkey", text.roman_value(F.lower(written)).alias("value"))


@query(r"""
WITH t AS (SELECT conv_id, turn, lower(trim(regexp_replace(translate(coalesce(text, ''), '‘’“”', '''''""'), '[[:cntrl:]\s]+', ' ', 'g'))) AS t, text FROM conversations),
q AS (SELECT conv_id, turn + 1 AS turn, lower(trim(regexp_replace(translate(array_to_string(string_split(coalesce(text, ''), ' ')[1:2], ' '), '‘’“”', '''''""'), '[[:cntrl:]\s]+', ' ', 'g'))) AS q FROM conversations)
SELECT conv_id, turn, q <> '' AND contains(t, q) AS quoted FROM t JOIN q USING (conv_id, turn)""")
def quotes_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each turn says the first two words of the turn before."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("quote"))
    return rows.join(before, ["conv_id", "turn"]).select("conv_id", "turn", text.quote_found(F.col("quote"), F.col("text")).alias("quoted"))


@query("""
WITH d AS (SELECT doc_id AS id, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0),
c AS (SELECT id, i AS chunk_index, i * 500 AS b, least(n, (i + 1) * 500) AS e, n // 3 AS f, n // 3 + 700 AS t FROM (SELECT id, n, unnest(range((n + 499) // 500)) AS i FROM d))
SELECT id, f AS "from", t AS "to", arg_max(chunk_index, (least(e, t) - greatest(b, f)) * 1000000 - chunk_index) AS chunk_index FROM c WHERE b < t AND e > f GROUP BY 1, 2, 3""")
def anchor_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document, in chunks of 500 characters, the chunk that covers most of a span from its first third on."""
    docs = table(spark, sf, "documents").where("length(text) > 0").select(F.col("doc_id").alias("id"), "text", F.length("text").alias("n"))
    cut = docs.select("id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 500).cast("int"))).alias("chunk_index"))
    chunks = cut.select("id", "chunk_index", F.substring("text", F.col("chunk_index") * 500 + 1, F.lit(500)).alias("text"))
    third = F.floor(F.col("n") / 3)
    return chunking.anchor(chunking.offsets(chunks), docs.select("id", third.alias("from"), (third + 700).alias("to")))


@query("SELECT doc_id, sha1(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(n_chars::VARCHAR, ''))[1:16] AS fingerprint FROM documents")
def reference_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ids.reference_fingerprint(F.col("lang"), F.col("source"), F.col("n_chars")).alias("fingerprint"))


@query("""
SELECT vec_id AS id, round(CASE WHEN label = 3 THEN greatest(0, s - 0.25) ELSE s END, 6) AS score FROM (SELECT vec_id, label, greatest(0, least(1, 1 - (1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))))) AS s FROM embeddings)""")
def penalised_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors by their similarity to the first one, those of one label with a penalty."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    first = rows.where("id = 0").select(F.col("v").alias("q"))
    scored = rows.crossJoin(F.broadcast(first)).select("id", vector.similarity(1 - vector.cosine(F.col("v"), F.col("q"))).alias("score"))  # one row is broadcast
    return ingest.penalised(scored, rows.where("label = 3"), 0.25).select("id", F.round("score", 6).alias("score"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND starts_with('user/' || user_id, 'user/1') AND json_extract_string(props, '$.k') = '3'")
def code_facts_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Events as facts: by kind, file prefix and a property."""
    facts = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file"), F.col("props").alias("properties"))
    return codefacts.matching(facts, kind="click", file="user/1", properties={"k": "3"}).select("id")


@query("""
WITH f AS (SELECT c_custkey AS id, CASE WHEN lower(c_name) = 'customer#000000001' THEN 3 WHEN contains(lower(c_name), '00000001') THEN 1 ELSE -1 END AS tier FROM customer)
SELECT id, 1 AS tier, (SELECT count(*) FROM f WHERE tier > 0) AS candidates FROM f WHERE tier > 0""")
def name_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of the best tier for a part of a name, with their number."""
    facts = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return codefacts.resolved_name(facts, "00000001").select("id", "tier", "candidates")


@query("SELECT o_custkey AS label FROM orders GROUP BY 1 HAVING min(o_orderpriority) = '1-URGENT' AND max(o_orderpriority) = '1-URGENT'")
def labels_of_one_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Customers all of whose orders are urgent."""
    return store.orphaned_labels(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").alias("label")), "1-URGENT")


@query(f"""
WITH {sql_graph(("region", "nation", "customer", "supplier"))},
hops AS (SELECT id, CASE type WHEN 'region' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END AS hops FROM nodes),
kept AS (SELECT id FROM hops ORDER BY hops, id LIMIT 80)
SELECT source_id, target_id, relationship_name FROM edges WHERE source_id IN (FROM kept) AND target_id IN (FROM kept)""")
def truncated_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """The edges among the eighty nodes nearest to the regions."""
    known = derived_graph(spark, sf, ("region", "nation", "customer", "supplier"))
    hops = traversal.reached(known.edges, known.nodes.where("type = 'region'"), 3)
    return store.nearest_to_seeds(known.nodes.withColumn("position", F.col("id")), known.edges, hops, 80).edges


@query("SELECT user_id AS qa_id, arg_max(event_id % 7, event_id) AS score FROM events WHERE event_id % 7 BETWEEN 1 AND 5 GROUP BY 1")
def last_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.ratings(table(spark, sf, "events").select(F.col("user_id").alias("qa_id"), F.pmod("event_id", F.lit(7)).alias("score"), F.col("event_id").alias("position")))


@query("""
WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, turn FROM r WHERE k <= 2 OR contains(text, '?')""")
def recent_or_found_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The last two turns of each conversation, and those that ask something."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("conv_id").alias("session_id"), F.concat_ws(":", "conv_id", "turn").alias("qa_id"), F.col("turn").alias("position"), "text")
    return sessions.recent_or_found(rows, rows.where(F.contains("text", F.lit("?"))), 2).select("conv_id", "turn")


@query(f"""
WITH {sql_graph(("nation", "supplier", "part"))}, hits AS (SELECT 'supplier:' || s_suppkey AS entity, s_suppkey AS rank FROM supplier WHERE s_suppkey % 20 = 0),
every AS (SELECT DISTINCT entity, rank, source_id, target_id, relationship_name FROM hits JOIN edges ON source_id = entity OR target_id = entity)
SELECT *, row_number() OVER (PARTITION BY entity ORDER BY source_id, target_id, relationship_name) AS edge_rank FROM every QUALIFY edge_rank <= 5""")
def entity_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The first five edges of every twentieth supplier."""
    known = derived_graph(spark, sf, ("nation", "supplier", "part"))
    hits = table(spark, sf, "supplier").where("s_suppkey % 20 = 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("rank"))
    return retrieval.entity_lane(known, hits, 5)


@query("SELECT l_orderkey::VARCHAR AS key, max(l_linenumber)::VARCHAR AS value FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey::VARCHAR, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def metadata_noted(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' status as stored metadata, replaced by the number of their last item."""
    stored = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"))
    new = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.max("l_linenumber").cast("string").alias("value"))
    return store.noted(stored, new)
