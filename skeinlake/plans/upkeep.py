"""Registered queries of look-ups, upkeep and incremental chunking, beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.operators import chunking, incremental, lexical, nearest, store
from skeinlake.plans.catalogue import query
from skeinlake.plans.derived import graph as derived_graph
from skeinlake.plans.derived import sql_graph, table

_OWNED = "SELECT 'customer:' || c_custkey AS id, list_sort(list_distinct([c_mktsegment || '/' || c_nationkey || '/run' || (c_custkey % 5), 'base/' || c_custkey || '/run' || (c_custkey % 3)])) AS source_refs FROM customer"


def _owned(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with two source references each: of their segment and of the base."""
    c = table(spark, sf, "customer")
    text = lambda x: x.cast("string")
    refs = F.array(store.reference(F.col("c_mktsegment"), text(F.col("c_nationkey")), F.concat(F.lit("run"), text(F.col("c_custkey") % 5))), store.reference(F.lit("base"), text(F.col("c_custkey")), F.concat(F.lit("run"), text(F.col("c_custkey") % 3))))
    return c.select(F.concat(F.lit("customer:"), text(F.col("c_custkey"))).alias("id"), F.array_sort(refs).alias("source_refs"))


@query(f"SELECT id FROM ({_OWNED}) WHERE list_contains(source_refs, 'BUILDING/3/run1')")
def nodes_by_source_ref(spark: SparkSession, sf: str) -> DataFrame:
    return store.with_reference(_owned(spark, sf), "BUILDING/3/run1").select("id")


@query(f"SELECT id, list_aggregate(list_filter(source_refs, lambda r: split_part(r, '/', 1) = 'BUILDING'), 'string_agg', ',') AS refs FROM ({_OWNED}) WHERE len(list_filter(source_refs, lambda r: split_part(r, '/', 1) = 'BUILDING')) > 0")
def refs_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return store.references_of(_owned(spark, sf), ["id"], dataset="BUILDING").select("id", F.array_join("refs", ",").alias("refs"))


@query(f"SELECT id, list_aggregate(list_filter(source_refs, lambda r: split_part(r, '/', 3) = 'run2'), 'string_agg', ',') AS refs FROM ({_OWNED}) WHERE len(list_filter(source_refs, lambda r: split_part(r, '/', 3) = 'run2')) > 0")
def refs_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return store.references_of(_owned(spark, sf), ["id"], run="run2").select("id", F.array_join("refs", ",").alias("refs"))


@query(f"SELECT id, list_aggregate(list_sort(list_distinct(list_transform(source_refs, lambda r: split_part(r, '/', 1)))), 'string_agg', ',') AS datasets, list_aggregate(list_sort(list_distinct(list_transform(source_refs, lambda r: split_part(r, '/', 3)))), 'string_agg', ',') AS runs FROM ({_OWNED}) WHERE id IN (SELECT 'customer:' || o_custkey FROM orders WHERE o_orderstatus = 'P')")
def node_delete_data(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id"))
    return store.delete_data(_owned(spark, sf), asked, ["id"], []).select("id", F.array_join("datasets", ",").alias("datasets"), F.array_join("runs", ",").alias("runs"))


@query("SELECT count(*) = 0 AS is_empty FROM region")
def graph_is_empty(spark: SparkSession, sf: str) -> DataFrame:
    return store.is_empty(derived_graph(spark, sf))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def vectors_without(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return store.without(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), gone)


@query("SELECT kind, count(*) AS n FROM (SELECT kind, id FROM (SELECT 'part' AS kind, l_partkey AS id, l_suppkey % 3 AS d FROM lineitem UNION ALL SELECT 'order', l_orderkey, l_suppkey % 3 FROM lineitem) GROUP BY ALL HAVING min(d) = 1 AND max(d) = 1) GROUP BY 1")
def deletion_counts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    of = lambda kind, c: li.select(F.lit(kind).alias("kind"), F.col(c).alias("id"), (F.col("l_suppkey") % 3).cast("string").alias("dataset"))
    return store.deletion_counts(of("part", "l_partkey").unionByName(of("order", "l_orderkey")), "1")


@query("SELECT event_type AS entity_type, count(*) AS entries, count(DISTINCT user_id) AS entities, count(DISTINCT event_id % 10) AS activities FROM events GROUP BY CUBE (event_type)")
def provenance_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return store.statistics(table(spark, sf, "events").select(F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), (F.col("event_id") % 10).alias("activity_id")))


@query(f"""
WITH RECURSIVE {sql_graph()},
parents AS (SELECT target_id AS id, source_id AS p FROM edges WHERE relationship_name = 'supplies' UNION ALL SELECT source_id AS id, target_id AS p FROM edges WHERE relationship_name <> 'supplies'),
up AS (SELECT 'part:' || p_partkey AS id, 0 AS hops FROM part WHERE p_size = 1 UNION SELECT p, hops + 1 FROM up JOIN parents USING (id) WHERE hops < 3)
SELECT id, min(hops)::INT AS hops FROM up GROUP BY 1""")
def lineage_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    e = derived_graph(spark, sf).edges
    down = F.col("relationship_name") == "supplies"
    parents = e.select(F.when(down, F.col("target_id")).otherwise(F.col("source_id")).alias("id"), F.when(down, F.col("source_id")).otherwise(F.col("target_id")).alias("parent"))
    seeds = table(spark, sf, "part").where("p_size = 1").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return store.lineage(parents, seeds, 3)


@query("SELECT o_custkey AS entity_id, o_orderkey AS sequence, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS revision, count(*) OVER (PARTITION BY o_custkey) AS latest FROM orders")
def revision_history(spark: SparkSession, sf: str) -> DataFrame:
    return store.revisions(table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("sequence"), F.col("o_orderdate").alias("last_updated"))).select("entity_id", "sequence", "revision", "latest")


@query("SELECT user_id AS session_id, CASE WHEN user_id % 3 = 0 THEN 'failed' WHEN user_id % 2 = 0 THEN 'completed' ELSE 'running' END AS status FROM events GROUP BY 1")
def sessions_ended(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "events").select(F.col("user_id").alias("session_id")).distinct()
    stored = found.withColumn("status", F.when(F.col("session_id") % 3 == 0, "failed").otherwise("running"))
    return store.ended(stored, found.where("session_id % 2 = 0").withColumn("status", F.lit("completed")))


@query("SELECT user_id AS id, max(ts) AS last_accessed FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30' - INTERVAL 1440 MINUTE")
def unused_data(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("used_at"))
    items = e.select("id").distinct().withColumn("last_accessed", F.lit(None).cast(e.schema["used_at"].dataType))
    return store.unused(store.touched(items, e), F.lit("2024-01-30").cast("timestamp"), 1_440).select("id", "last_accessed")


@query("SELECT p_brand AS cluster, string_agg(t, chr(10) ORDER BY p) AS text FROM (SELECT p_brand, trim(p_type) AS t, min(p_partkey) AS p FROM part WHERE trim(p_type) <> '' GROUP BY 1, 2) GROUP BY 1")
def united_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return store.descriptions(table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), F.col("p_type").alias("description"), F.col("p_partkey").alias("position")))


@query("SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 1.0 / (1 + doc_id) ELSE 'inf'::DOUBLE END AS distance FROM labels WHERE doc_id IS NOT NULL ORDER BY 2, 1 LIMIT 25")
def best_events(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "labels").where("doc_id is not null").select(F.col("doc_id").alias("id"), "toxic")
    return store.best_events(found.select("id"), found.where("toxic = 1").select("id", (F.lit(1.0) / (F.col("id") + 1)).alias("distance")), 25)


@query(r"""
WITH split AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM conversations),
first AS (SELECT conv_id, turn, text, list_filter(s, lambda x, i: list_position(s, x) = i)[:5] AS s FROM split)
SELECT conv_id, turn, CASE WHEN len(s) > 0 THEN list_aggregate(s, 'string_agg', '|') WHEN regexp_matches(text, '\S') THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE text END AS subqueries FROM first""")
def normalised_subqueries(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of every turn as sub-queries: the first five different ones, in their order."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("query"), F.split("text", r"\.").alias("subqueries"))
    found = store.subqueries(rows)
    return found.select("conv_id", "turn", F.when(F.col("subqueries")[0].isNotNull(), F.array_join("subqueries", "|")).alias("subqueries"))


@query("SELECT p_partkey AS item, 'b' || l_suppkey AS bucket, round(mean, 9) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY mean, size, 'b' || l_suppkey) AS k FROM (SELECT l_partkey AS p_partkey, l_suppkey, avg(l_discount::DOUBLE) AS mean, l_suppkey % 7 AS size FROM lineitem GROUP BY 1, 2) WHERE size < 6 AND mean <= 0.04) WHERE k = 1")
def placed_in_buckets(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    bucket = F.concat(F.lit("b"), F.col("l_suppkey").cast("string"))
    sizes = li.select(bucket.alias("bucket"), (F.col("l_suppkey") % 7).alias("size")).distinct()
    return store.placed_in_buckets(li.select(F.col("l_partkey").alias("item"), bucket.alias("bucket"), F.col("l_discount").cast("double").alias("distance")), sizes, 6, 0.04).withColumn("mean", F.round("mean", 9))


@query("SELECT l_orderkey, string_agg(k, ',' ORDER BY k) AS key FROM (SELECT DISTINCT l_orderkey, l_suppkey::VARCHAR AS k FROM lineitem) GROUP BY 1")
def candidate_set_keys(spark: SparkSession, sf: str) -> DataFrame:
    return store.set_key(table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("k")), "l_orderkey", "k")


@query()
def text_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The first seven words and the three most frequent of each document."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    top = lexical.frequent_words(docs, 3).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("w"))
    return docs.join(top, "id", "left").select("id", store.title(F.col("text"), 7, F.coalesce("w", F.array().cast("array<string>")), 3).alias("title"))


# ---------------------------------------------------------------- incremental chunking


_EDITED = "CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'One more sentence.' WHEN doc_id % 3 = 1 THEN substr(text, 1, (length(text) // 2)::INT) || ' INSERTED ' || substr(text, (length(text) // 2)::INT + 1) ELSE text END"


def _edited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents with an edited text, and the chunks of the old one."""
    half = F.floor(F.length("text") / 2).cast("int")
    new = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nOne more sentence."))).when(F.col("doc_id") % 3 == 1, F.concat(F.substring("text", F.lit(1), half), F.lit(" INSERTED "), F.substring("text", half + 1, F.length("text")))).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").where("length(text) > 1").select(F.col("doc_id").alias("id"), F.col("text").alias("old_text"), new.alias("new_text"))
    return docs, chunking.paragraph_chunks(docs.select("id", F.col("old_text").alias("text")), 100)


@query(f"SELECT doc_id AS id, sha256({_EDITED}) AS content FROM documents WHERE length(text) > 1")
def incremental_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """The updated chunks of each edited document join to its new text."""
    found = incremental.updated_documents(*_edited(spark, sf), 100)
    joined = F.array_join(F.transform("chunks", lambda x: x["text"]), "")
    return found.select("id", F.sha2(F.encode(joined, "UTF-8"), 256).alias("content"))


@query("SELECT doc_id AS id, 1::BIGINT AS regions FROM documents WHERE length(text) > 1 AND doc_id % 3 <> 2")
def incremental_regions(spark: SparkSession, sf: str) -> DataFrame:
    """One region for each document with its one edit, none for the others."""
    return incremental.plan(*_edited(spark, sf)).groupBy("id").agg(F.count("*").alias("regions"))


# ---------------------------------------------------------------- similarity of all to all


@query("SELECT query_id, id, round(1 - distance, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM embeddings v, embeddings q WHERE v.vec_id <> q.vec_id)) WHERE rank <= 10 AND round(1 - distance, 6) >= 0.2")
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every vector, at 0.2 or more: each row is a query."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = nearest.nearest_of_all(vectors, 10, within=0.800001)
    return found.select("query_id", "id", F.round(1 - F.col("distance"), 6).alias("similarity")).where("similarity >= 0.2")


@query()
def vector_consolidation(spark: SparkSession, sf: str) -> DataFrame:
    """id, cluster, links: vectors with a neighbour at 0.9 or more are one class."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest.similarity_classes(vectors, 10, 0.9)

