"""Session logs: feedback, usage, status and selection of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions.weights import FEEDBACK_RATE, feedback_step, idle_decay, rating
from skeinlake.operators.codefacts import paged


def latest(rows: DataFrame, key: str, order: list[Column | str], n: int = 1) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def sessions(events: DataFrame, user: str, time: str, gap: str) -> DataFrame:
    """user, start, end, n: runs of events less than ``gap`` apart."""
    found = events.groupBy(user, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("last_seen"))
    return found.select(user, F.col("w.start").alias("started_at"), "last_seen", "n")


def effective_status(status: Column, last_seen: Column, now: Column, idle_seconds: int) -> Column:
    """A running session that was idle for longer counts as abandoned."""
    idle = F.unix_timestamp(now) - F.unix_timestamp(last_seen) > idle_seconds
    return F.when((status == "running") & idle, F.lit("abandoned")).otherwise(status)


def listed(rows: DataFrame, owners: DataFrame | None = None, datasets: DataFrame | None = None, since: Column | None = None, status: str | None = None, order: str = "last_activity_at", descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of sessions (session_id, user_id, dataset_id, last_activity_at, effective_status, ...) with the number of all that match.

    Seen are sessions of ``owners`` (user_id) or of ``datasets`` (dataset_id); without both, all. Rows without
    a value to sort by come last; ties go by session_id.
    """
    if owners is not None or datasets is not None:
        seen = F.lit(False)
        for ids, key in ((owners, "user_id"), (datasets, "dataset_id")):
            if ids is not None:
                rows = rows.join(ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn(f"_{key}", F.lit(True)), key, "left")
                seen = seen | F.coalesce(F.col(f"_{key}"), F.lit(False))
        rows = rows.where(seen).drop("_user_id", "_dataset_id")
    if since is not None:
        rows = rows.where(F.col("last_activity_at") >= since)
    if status is not None:
        rows = rows.where(F.col("effective_status") == status)
    return paged(rows, [F.desc_nulls_last(order) if descending else F.asc_nulls_last(order), F.asc("session_id")], offset, limit)


def ratings(rows: DataFrame) -> DataFrame:
    """qa_id, score: the last valid rating (1 to 5) of each turn by ``position``."""
    return rows.where(F.col("score").between(1, 5)).groupBy("qa_id").agg(F.max_by("score", "position").alias("score"))


def feedback_weights(used: DataFrame, start: float = 0.5, rate: float = FEEDBACK_RATE) -> DataFrame:
    """element_id, weight, n after all rated uses (element_id, qa_id, score, position), one per turn, in order.

    The fold rounds at every step, so it needs each element's ratings in order: an array per
    element of (position, score), 12 bytes a rating.
    """
    once = used.groupBy("element_id", "qa_id").agg(F.min("position").alias("position"), F.min_by("score", "position").alias("score"))
    ordered = once.groupBy("element_id").agg(F.array_sort(F.collect_list(F.struct("position", "score"))).alias("r"))
    return ordered.select("element_id", F.aggregate("r", F.lit(start), lambda w, x: feedback_step(w, x["score"], rate)).alias("weight"), F.size("r").alias("n"))


def frequency_weights(used: DataFrame, known: DataFrame) -> DataFrame:
    """element_id, weight: one for each turn that used a known element."""
    return used.join(known.select("element_id"), "element_id", "left_semi").select("element_id", "qa_id").distinct().groupBy("element_id").agg(F.count("*").cast("double").alias("weight"))


def preferences(turns: DataFrame, rate: float, decay: float, prune: float) -> DataFrame:
    """user, node, weight: ratings pull a preference, idle turns let it drift back; near-neutral ones are dropped.

    turns(user, node, turn, score): score is null where the turn was not rated.
    """
    last = turns.groupBy("user").agg(F.max("turn").alias("now"))
    rated = turns.where("score is not null").groupBy("user", "node").agg(F.array_sort(F.collect_list(F.struct("turn", "score"))).alias("r"))
    begin = F.struct(F.lit(0.5).alias("w"), F.lit(None).cast("long").alias("at"))
    step = lambda s, x: F.struct((idle_decay(s["w"], decay, F.greatest(F.lit(0), F.coalesce(x["turn"] - s["at"] - 1, F.lit(0)))) * (1 - rate) + rate * rating(x["score"])).alias("w"), x["turn"].cast("long").alias("at"))
    folded = rated.join(last, "user").withColumn("s", F.aggregate("r", begin, step))
    return folded.select("user", "node", idle_decay(F.col("s.w"), decay, F.greatest(F.lit(0), F.col("now") - F.col("s.at"))).alias("weight")).where(F.abs(F.col("weight") - 0.5) >= prune)


def usage(events: DataFrame, prices: DataFrame) -> DataFrame:
    """user, agent, calls, tokens and cost by price per thousand tokens; unknown models cost nothing."""
    priced = events.join(prices, "model", "left").withColumn("cost", F.coalesce((F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1000, F.lit(0.0)))
    return priced.groupBy("user", "agent").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))


def ranker_score(section: Column, confidence: Column, entry: Column, query: Column, helped: Column, harmed: Column, priority: Column, recency: Column) -> Column:
    """Score of a context entry: section, confidence, share of its words in the query, net help, priority, recency."""
    overlap = F.when(F.size(entry) > 0, F.size(F.array_intersect(entry, query)) / F.size(entry)).otherwise(0.0)
    net = F.greatest(F.lit(-3), F.least(F.lit(3), helped - harmed))
    return 10 * section + 5 * confidence + 4 * overlap + 2 * net + priority + 0.5 * recency


def under_budget(entries: DataFrame, section_budget: int, total_budget: int) -> DataFrame:
    """Per key, entries taken by score while they fit both budgets; one that does not fit is skipped."""
    listed = entries.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "entry_id", "section", "size"))).alias("e"))
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")).alias("by"), F.array().cast("array<string>").alias("kept"))

    def take(s: Column, x: Column) -> Column:
        before = F.coalesce(F.try_element_at(s["by"], x["section"]), F.lit(0).cast("long"))
        fits = (before + x["size"] <= section_budget) & (s["used"] + x["size"] <= total_budget)
        by = F.map_concat(F.map_filter(s["by"], lambda k, _: k != x["section"]), F.create_map(x["section"], (before + x["size"]).cast("long")))
        return F.struct(F.when(fits, s["used"] + x["size"]).otherwise(s["used"]).cast("long").alias("used"), F.when(fits, by).otherwise(s["by"]).alias("by"), F.when(fits, F.concat(s["kept"], F.array(x["entry_id"]))).otherwise(s["kept"]).alias("kept"))

    return listed.select("key", F.aggregate("e", begin, take)["kept"].alias("kept"))


def recent_or_found(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """The last n turns of each session with those a search found, once each, in order."""
    w = Window.partitionBy("session_id").orderBy(F.desc("position"))
    hit = found.select("qa_id").distinct().withColumn("_hit", F.lit(True))
    return rows.withColumn("_k", F.row_number().over(w)).join(hit, "qa_id", "left").where((F.col("_k") <= n) | F.col("_hit")).drop("_k", "_hit")


def chain_checked(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of a hash chain with a verdict: wrong checksum, broken link, gap, or ok."""
    w = Window.partitionBy("entity_id").orderBy("sequence")
    own = checksum(fields)
    before, number = F.lag("checksum").over(w), F.lag("sequence").over(w)
    verdict = F.when(F.col("checksum") != own, "checksum").when(~F.col("previous_checksum").eqNullSafe(before), "link").when(number.isNotNull() & (F.col("sequence") != number + 1), "gap").otherwise("ok")
    return rows.withColumn("verdict", verdict)


def checksum(fields: list[str]) -> Column:
    """SHA-256 of the fields, each as compact JSON (a null is not the text "null"), joined by the unit separator."""

    def part(f: str) -> Column:
        json = F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"})
        return F.substring(json, F.lit(6), F.length(json) - 6)

    return F.sha2(F.encode(F.concat_ws("\x1f", *map(part, fields)), "UTF-8"), 256)
