"""Registered queries of what grows: hierarchies, placements, batches, clusters, contradictions, references, languages, retrieval in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.operators import consolidation, context, contradictions, distillation, extracted, language, overlap, references, sessions
from skeinlake.operators.graph import Graph
from skeinlake.plans import loops, upkeep
from skeinlake.plans.catalogue import query
from skeinlake.plans.derived import graph as derived_graph
from skeinlake.plans.derived import sql_graph, table


@query()
def context_index(spark: SparkSession, sf: str) -> DataFrame:
    """level, child, parent: the hierarchy over all vectors, of eight at most, at a mean distance of 0.7 or less."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return context.build(vectors, 8, 0.7).links


@query()
def graph_placement(spark: SparkSession, sf: str) -> DataFrame:
    """id, bucket: all orders in buckets of twenty at most, by the parts they share, weighted by rarity."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("entity")).distinct()
    weights = consolidation.idf(rows, "id", "entity").withColumnRenamed("idf", "weight")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return overlap.placed(orders, rows.join(weights, "entity"), 20, 0.25).links


def _log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as turns (a user's text and the assistant's next to it) and as context entries (what the system said)."""
    rows = table(spark, sf, "conversations")
    answer = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    time = lambda c: F.lpad(c.cast("string"), 9, "0")
    asked = rows.where("role = 'user'").join(answer, ["conv_id", "turn"], "left")
    turns = asked.select(F.col("conv_id").alias("session"), time(F.col("turn")).alias("time"), F.col("turn").alias("position"), F.col("text").alias("question"), "answer")
    said = rows.where("role = 'system'").select(F.col("conv_id").alias("session"), time(F.col("turn")).alias("time"), F.col("turn").alias("position"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("id"), F.lit("chat").alias("profile"), F.lit("system").alias("section"), F.col("text").alias("content"))
    return turns, said


_BATCHES = r"""
WITH plain AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations),
blocks AS (
  SELECT q.conv_id, q.turn, 0 AS kind, 'User: ' || q.t[:1200] || chr(10) || 'Assistant: ' || coalesce(a.t, '')[:1200] AS block
  FROM plain q LEFT JOIN plain a ON a.role = 'assistant' AND a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND (q.t <> '' OR coalesce(a.t, '') <> '')
  UNION ALL SELECT conv_id, turn, 1, 'Candidate s' || turn || ' [chat/system]: ' || t[:280] FROM plain WHERE role = 'system'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind, block) - 1 AS k FROM blocks)
SELECT conv_id AS session, (k // 6)::INT AS batch, count(*) AS blocks, string_agg(block, chr(10) || chr(10) ORDER BY k) AS text FROM placed GROUP BY 1, 2"""


@query(_BATCHES)
def curator_batches(spark: SparkSession, sf: str) -> DataFrame:
    return distillation.curator_batches(*_log(spark, sf))


@query(f"""
SELECT session, CASE WHEN max(text LIKE '%Candidate s%') THEN 'completed' ELSE 'no_gated_entries' END AS status,
       count(*) FILTER (text LIKE '%Candidate s%') AS documents
FROM ({_BATCHES}) GROUP BY 1""")
def distilled_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """How each session ends if each batch with a candidate gives one lesson and all lessons are accepted."""
    lessons = lambda batches: batches.where("text like '%Candidate s%'").select("session", F.concat(F.lit("Batch "), F.col("batch").cast("string")).alias("lesson"))
    return distillation.distilled(*_log(spark, sf), lessons, lambda found: found).select("session", "status", F.size("documents").cast("long").alias("documents"))


@query("""
WITH facts AS (SELECT l_suppkey AS s, l_returnflag AS flag, bool_or(l_shipdate >= TIMESTAMP '1998-06-01') AS touched FROM lineitem GROUP BY 1, 2),
pairs AS (SELECT DISTINCT s, least(a.flag, b.flag) AS f, greatest(a.flag, b.flag) AS g FROM facts a JOIN facts b USING (s) WHERE a.touched AND a.flag <> b.flag)
SELECT 'flag:' || f AS source_id, 'flag:' || g AS target_id, s_name || ' ships as ' || f AS first_fact, s_name || ' ships as ' || g AS second_fact FROM pairs JOIN supplier ON s_suppkey = s""")
def contradicting_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers ship as one flag only, says the judge; facts that the last months' items touch meet all facts about their supplier."""
    items, key = table(spark, sf, "lineitem"), lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edge = (key("supplier:", "l_suppkey").alias("source_id"), key("flag:", "l_returnflag").alias("target_id"), F.lit("ships_as").alias("relationship_name"))
    nodes = table(spark, sf, "supplier").select(key("supplier:", "s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(items.select(edge[1].alias("id"), F.col("l_returnflag").alias("name")).distinct())
    told = contradictions.facts(Graph(nodes, items.select(*edge)))
    met = contradictions.batches(told, items.where("l_shipdate >= timestamp'1998-06-01'").select(*edge), ("source_id",))
    return contradictions.contradicting(met, contradictions.same_subject_other_object).select("source_id", "target_id", "first_fact", "second_fact")


_FOLD = r"""lower(trim(regexp_replace(translate({}, '‘’“”', '''''""'), '[[:cntrl:]\s]+', ' ', 'g')))"""
_QUOTED = f"""
WITH asked AS (SELECT item_id, {_FOLD.format("text")} AS q FROM benchmark), held AS (SELECT doc_id, {_FOLD.format("text")} AS t FROM documents)
SELECT DISTINCT doc_id, item_id FROM asked JOIN held ON contains(t, q) WHERE q <> ''"""


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("passage"), "text")


@query(_QUOTED)
def quoted_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark item word by word, after folding."""
    items = table(spark, sf, "benchmark").select("item_id", references.folded_quote(F.col("text")).alias("phrase"))
    return references.phrase_matches(_passages(spark, sf), items.select(F.col("phrase").alias("text"))).join(items, "phrase").select(F.col("passage").alias("doc_id"), "item_id").distinct()


@query(r"""
WITH cited AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '[[:cntrl:]\s]+', ' ', 'g'))) AS t FROM conversations WHERE role <> 'user'),
quotes AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '[[:cntrl:]\s]+', ' ', 'g'))) AS t FROM conversations WHERE role = 'user'),
part AS (SELECT conv_id, turn, array_to_string(string_split(t, ' ')[1:2], ' ') AS q FROM quotes)
SELECT DISTINCT c.conv_id, c.turn AS span, p.turn AS assertion FROM cited c JOIN part p ON c.conv_id = p.conv_id AND contains(c.t, p.q) WHERE p.q <> ''""")
def anchored_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that hold the first two words of one of the conversation's questions."""
    rows = table(spark, sf, "conversations")
    first = F.array_join(F.slice(F.split(references.folded_quote(F.col("text")), " "), 1, 2), " ")
    asked = rows.where("role = 'user'").select(F.col("conv_id").alias("document"), F.col("turn").alias("id"), first.alias("quote"))
    spans = rows.where("role <> 'user'").select(F.col("conv_id").alias("document"), F.col("turn").alias("span"), "text")
    return references.anchored(spans, asked).select(F.col("document").alias("conv_id"), "span", F.col("id").alias("assertion"))


_NAMES = f"SELECT p_partkey::VARCHAR AS id, {_FOLD.format('p_name')} AS q FROM part"
_WORDS = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'))"


@query(f"""
WITH refs AS (SELECT 'part' || p_partkey AS reference, p_name AS text FROM part UNION ALL SELECT 'item' || item_id, text FROM benchmark),
folded AS (SELECT reference, text, {_FOLD.format("text")} AS q FROM refs),
named AS (SELECT reference, count(DISTINCT id) AS targets, min(id) AS target FROM folded JOIN ({_NAMES}) n USING (q) WHERE q <> '' GROUP BY 1),
rest AS (SELECT * FROM folded WHERE reference NOT IN (SELECT reference FROM named)),
quoted AS (SELECT reference, count(DISTINCT doc_id) AS targets, min(doc_id::VARCHAR) AS target FROM rest JOIN (SELECT doc_id, {_FOLD.format("text")} AS t FROM documents) d ON contains(t, q) WHERE q <> '' GROUP BY 1),
last AS (SELECT reference, {_WORDS.format("text")} AS w FROM rest WHERE reference NOT IN (SELECT reference FROM quoted)),
asked AS (SELECT reference, len(w) AS size, unnest(w) AS word FROM last),
held AS (SELECT doc_id::VARCHAR AS id, unnest({_WORDS.format("text")}) AS word FROM documents),
shared AS (SELECT reference, id, size, count(*) AS n FROM asked JOIN held USING (word) GROUP BY ALL HAVING 2 * count(*) >= size),
lexical AS (SELECT reference, id AS target FROM shared QUALIFY row_number() OVER (PARTITION BY reference ORDER BY n DESC, id) = 1)
SELECT reference, CASE WHEN targets > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome, 'entity_name' AS strategy, CASE WHEN targets = 1 THEN target END AS target, targets FROM named
UNION ALL SELECT reference, 'resolved', 'quote', target, targets FROM quoted
UNION ALL SELECT reference, 'resolved', 'lexical', target, 1 FROM lexical
UNION ALL SELECT reference, 'unresolved', NULL, NULL, 0 FROM last WHERE reference NOT IN (SELECT reference FROM lexical)""")
def reference_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Part names and benchmark items as references: to a part of that name, a document that quotes them, or that shares most words."""
    parts = table(spark, sf, "part")
    refs = parts.select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("reference"), F.col("p_name").alias("text"))
    refs = refs.unionByName(table(spark, sf, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("reference"), "text"))
    nodes = parts.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    passages = _passages(spark, sf).withColumn("passage", F.col("passage").cast("string"))
    steps = [references.by_id(nodes), references.by_name(nodes), references.by_quote(passages), references.by_words(passages)]
    return references.cascade(refs, steps).drop("confidence")


@query(r"""
WITH coded AS (SELECT doc_id, lang, list_transform(string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) || ' ', ''), lambda x: unicode(x)::BIGINT) AS c FROM documents),
met AS (SELECT doc_id, lang, c, unnest(range(2, len(c))) AS i FROM coded),
cells AS (SELECT doc_id, lang, ((c[i - 1] * 31 + c[i]) * 31 + c[i + 1]) % 4096 AS cell FROM met WHERE c[i] <> 32),
counts AS (SELECT lang, cell, count(*) AS n FROM cells WHERE lang IS NOT NULL AND doc_id % 5 > 1 GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY 1),
logs AS (SELECT t.lang, g.cell, round(ln((coalesce(n, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * 4096)) * 1000)::BIGINT AS v FROM totals t CROSS JOIN (SELECT unnest(range(4096)) AS cell) g LEFT JOIN counts k ON k.lang = t.lang AND k.cell = g.cell),
scores AS (SELECT doc_id, l.lang, sum(v)::BIGINT AS score, count(*) AS triples FROM cells d JOIN logs l USING (cell) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS k, score - lead(score) OVER w AS margin FROM scores WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, lang))
SELECT d.doc_id, d.doc_id % 5 = 0 AS held_out, CASE WHEN triples >= 5 THEN r.lang ELSE 'unknown' END AS detected_lang, CASE WHEN triples >= 5 THEN coalesce(margin, 0) ELSE 0 END AS margin
FROM documents d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND r.k = 1""")
def detected_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document by profiles learnt on three folds of five and calibrated on one."""
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang")
    fold = F.pmod("doc_id", F.lit(5))
    model = language.fit(rows.where(fold > 1), rows.where(fold == 1))
    return language.detected(rows, model).select("doc_id", (fold == 0).alias("held_out"), "detected_lang", "margin")


@query(f"""
WITH {sql_graph(("region", "nation", "customer", "supplier"))}
SELECT target_id AS query_id, source_id, target_id, relationship_name, 0 AS round FROM edges WHERE relationship_name = 'in_region'
UNION ALL SELECT r.target_id, e.source_id, e.target_id, e.relationship_name, 1 FROM edges r JOIN edges e ON e.target_id = r.source_id WHERE r.relationship_name = 'in_region'""")
def extended_context(spark: SparkSession, sf: str) -> DataFrame:
    """From each region: the triplets at it, then at the ends of those, until no round brings anything new."""
    known = derived_graph(spark, sf, ("region", "nation", "customer", "supplier"))
    asked = known.nodes.where("type = 'region'").select(F.col("id").alias("query_id"), "id")
    return loops.extended(asked, loops.at_nodes(known.edges), loops.ends_of_new)


@query(f"""
WITH {sql_graph(("region", "nation", "customer", "supplier"))}, parts AS (SELECT n_regionkey AS q, n_nationkey AS part FROM nation)
SELECT 'region:' || q AS query_id, source_id, target_id, relationship_name, min(part)::BIGINT AS part FROM parts JOIN edges ON 'nation:' || part IN (source_id, target_id) GROUP BY ALL""")
def decomposed_queries(spark: SparkSession, sf: str) -> DataFrame:
    """A region's question in parts, one for each of its nations; each triplet once, with the first part that finds it."""
    known = derived_graph(spark, sf, ("region", "nation", "customer", "supplier"))
    parts = table(spark, sf, "nation").select(F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("query_id"), F.col("n_nationkey").cast("long").alias("part"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    return loops.decomposed(parts, loops.at_nodes(known.edges))


@query()
def extended_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids per label from the vectors with an odd id, extended by all vectors."""
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    first = consolidation.extended_centroids(None, rows.where("id % 2 = 1"), 3)
    return consolidation.extended_centroids(first, rows, 3)[0]


@query()
def capped_links(spark: SparkSession, sf: str) -> DataFrame:
    """Similar vectors linked best first, three links a vector at most."""
    pairs = upkeep.similar_pairs(spark, sf).select(F.lit("all").alias("group"), F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("similarity").alias("score"))
    return consolidation.capped_per_node(pairs, 3)


@query("""
WITH s AS (SELECT user_id, max(ts) AS last_activity_at, count(*) AS calls, CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'completed' END AS effective_status FROM events GROUP BY 1),
seen AS (SELECT * FROM s WHERE (user_id % 3 = 0 OR user_id % 7 = 2) AND effective_status = 'failed')
SELECT user_id::VARCHAR AS session_id, calls, (SELECT count(*) FROM seen) AS total FROM seen ORDER BY calls DESC, user_id::VARCHAR LIMIT 20 OFFSET 5""")
def session_page(spark: SparkSession, sf: str) -> DataFrame:
    """The sixth to twenty-fifth of the failed sessions that three owners in nine or one data set in seven make visible, most calls first."""
    events = table(spark, sf, "events")
    rows = events.groupBy("user_id").agg(F.max("ts").alias("last_activity_at"), F.count("*").alias("calls"), F.when(F.bool_or(F.col("event_type") == "error"), "failed").otherwise("completed").alias("effective_status"))
    rows = rows.withColumn("session_id", F.col("user_id").cast("string")).withColumn("dataset_id", F.pmod("user_id", F.lit(7)))
    owners = events.select("user_id").distinct().where("user_id % 3 = 0")
    return sessions.listed(rows, owners, rows.select("dataset_id").where("dataset_id = 2"), None, "failed", "calls", True, 5, 20).select("session_id", "calls", "total")


def _read_graphs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges that each order tells (supplier ships part), and an ontology of the large parts' names."""
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk"), "l_suppkey", "l_partkey")
    suppliers, parts = table(spark, sf, "supplier"), table(spark, sf, "part")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    nodes = items.select("chunk", "l_suppkey").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("chunk", key("supplier", "l_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"))
    nodes = nodes.unionByName(items.select("chunk", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("chunk", key("part", "l_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("type")))
    ontology = parts.where("p_size > 25").select(F.concat(F.lit("term:"), F.col("p_partkey").cast("string")).alias("id"), F.upper("p_name").alias("name"))
    return nodes, items.select("chunk", key("supplier", "l_suppkey").alias("source_id"), key("part", "l_partkey").alias("target_id"), F.lit("ships").alias("relationship_name")), ontology


_READ = """
onto AS (SELECT lower(p_name) AS key, min('term:' || p_partkey) AS term FROM part WHERE p_size > 25 GROUP BY 1),
terms AS (SELECT p_partkey, term FROM part LEFT JOIN onto ON lower(p_name) = key),
items AS (SELECT DISTINCT l_orderkey AS chunk, l_suppkey, l_partkey, term FROM lineitem JOIN terms ON p_partkey = l_partkey)"""


@query(f"""
WITH {_READ}
SELECT chunk, count(DISTINCT l_suppkey) + count(DISTINCT l_partkey) AS nodes, count(DISTINCT l_suppkey) + count(DISTINCT l_partkey) FILTER (term IS NULL) AS dropped_nodes, count(*) AS edges, count(*) AS dropped_edges FROM items GROUP BY 1""")
def strict_ontology_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What an ontology of part names drops in each order's graph: all suppliers, and so all edges."""
    return extracted.canonical(*_read_graphs(spark, sf), strict=True).counts


@query(f"""
WITH {_READ},
moved AS (SELECT DISTINCT chunk, 'supplier:' || l_suppkey AS source_id, coalesce(term, 'part:' || l_partkey) AS target_id FROM items),
owned AS (SELECT source_id, target_id, 'ships' AS relationship_name FROM moved UNION SELECT chunk::VARCHAR, source_id, 'contains' FROM moved UNION SELECT chunk::VARCHAR, target_id, 'contains' FROM moved)
SELECT * FROM owned EXCEPT SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'ships' FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01'""")
def integrated_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges that all orders' graphs add to those of the years before 1995, with parts under their terms."""
    nodes, edges, ontology = _read_graphs(spark, sf)
    told = extracted.canonical(nodes, edges, ontology)
    old = table(spark, sf, "lineitem").where("l_shipdate < timestamp'1995-01-01'").select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"), F.lit("ships").alias("relationship_name"))
    return extracted.integrated_chunks(told.chunks, old)[0].edges


@query("""
WITH held AS (SELECT n_nationkey, n_regionkey FROM nation), inner_nodes AS (SELECT c_nationkey AS n, 'customer:' || c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 'supplier:' || s_suppkey FROM supplier)
SELECT DISTINCT 'region:' || n_regionkey AS source_id, id AS target_id, 'holds' AS relationship_name FROM held JOIN inner_nodes ON n = n_nationkey""")
def unwrapped_nations(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as containers: regions hold what their nations hold."""
    known = derived_graph(spark, sf, ("region", "nation", "customer", "supplier"))
    down = known.edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("holds").alias("relationship_name"))
    return extracted.unwrapped(Graph(known.nodes, down), known.nodes.where("type = 'nation'")).edges
