"""Distilling finished sessions: their timeline in batches, lessons proposed and accepted, documents.

A session's blocks get their numbers from one range sort over all sessions by (session, time), less the
number of the session's first block; so no session, however long, is held by a task, and only the
few blocks of a batch are brought together.

Models propose and judge lessons; functions from DataFrame to DataFrame stand in for them.

Defined cases: null texts are empty; turns without question and answer have no block; of equal times, turns come
before entries, then position and text decide; rows without a session are the session null; white space
is that of ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.shared import numbered

#: Blocks of a batch, and the characters kept of a question, an answer and an entry.
PER_BATCH, QUESTION, ANSWER, ENTRY = 6, 1_200, 1_200, 280


def _plain(text: str, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")), 1, most)


def timeline(turns: DataFrame, entries: DataFrame) -> DataFrame:
    """session, time, kind, position, block of turns (session, time, position, question, answer) and entries (session, time, position, id, profile, section, content)."""
    question, answer = _plain("question", QUESTION), _plain("answer", ANSWER)
    said = turns.where((question != "") | (answer != "")).select("session", "time", F.lit(0).alias("kind"), "position", F.concat(F.lit("User: "), question, F.lit("\nAssistant: "), answer).alias("block"))
    noted = entries.select("session", "time", F.lit(1).alias("kind"), "position", F.concat(F.lit("Candidate "), F.col("id"), F.lit(" ["), F.col("profile"), F.lit("/"), F.col("section"), F.lit("]: "), _plain("content", ENTRY)).alias("block"))
    return said.unionByName(noted)


def curator_batches(turns: DataFrame, entries: DataFrame, per: int = PER_BATCH) -> DataFrame:
    """session, batch (from 0), blocks, text: each session's timeline in runs of ``per`` blocks."""
    rows = numbered(timeline(turns, entries), "session", F.coalesce("time", F.lit("")), "kind", "position", "block")
    first = rows.groupBy(F.col("session").alias("_s")).agg(F.min("n").alias("first"))
    placed = rows.join(first, F.col("session").eqNullSafe(F.col("_s"))).withColumn("batch", F.floor((F.col("n") - F.col("first")) / per).cast("int"))
    met = placed.groupBy("session", "batch").agg(F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b"))
    return met.select("session", "batch", "blocks", F.array_join(F.col("b.block"), "\n\n").alias("text"))


def distilled(turns: DataFrame, entries: DataFrame, propose: Callable[[DataFrame], DataFrame], accept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """session, status, documents: how distilling ends for each session.

    Only sessions with entries go on. ``propose`` turns batches (session, batch, text) into lessons (session,
    lesson), ``accept`` keeps some of them; equal lessons of a session count once.
    """
    asked = turns.select("session").unionByName(entries.select("session")).distinct()
    gated = entries.select(F.col("session").alias("_s")).distinct()
    same = F.col("session").eqNullSafe(F.col("_s"))
    proposed = propose(curator_batches(turns, entries).join(gated, same, "left_semi")).select("session", "lesson").distinct()
    kept = accept(proposed).select("session", "lesson").distinct().groupBy(F.col("session").alias("_k")).agg(F.array_sort(F.collect_list("lesson")).alias("documents"))
    told = asked.join(gated, same, "left").withColumn("gated", F.col("_s").isNotNull() | F.col("session").isNull() & F.lit(not gated.where("_s is null").isEmpty())).drop("_s")
    some = proposed.select(F.col("session").alias("_p")).distinct().withColumn("some", F.lit(True))
    met = told.join(some, F.col("session").eqNullSafe(F.col("_p")), "left").join(kept, F.col("session").eqNullSafe(F.col("_k")), "left")
    status = F.when(~F.col("gated"), "no_gated_entries").when(F.col("some").isNull(), "no_proposed_lessons").when(F.col("documents").isNull(), "no_accepted_lessons").otherwise("completed")
    return met.select("session", status.alias("status"), F.coalesce("documents", F.array().cast("array<string>")).alias("documents"))
