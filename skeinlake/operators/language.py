"""Which language a text is in: profiles of letter triples learnt from labelled texts, and calibrated confidence.

A word is written with a blank on both sides; its triples of characters are hashed to a fixed number of cells,
so a profile is one array of log-probabilities per language and all profiles together are one row of bounded
size. Scoring is one expression per text: no join and no shuffle, and no Python. Learning counts the triples
of a text within its row and shuffles one row per text, cell and language at most, added up before the shuffle.

Log-probabilities are whole thousandths, so that sums do not depend on their order.

Confidence: the posterior of the profiles at a temperature, by which the loss on labelled texts that the
profiles did not see is smallest.

Defined cases: a text with fewer than ``least`` letter triples (null and empty ones too) is ``unknown`` with
confidence 0; ties go to the first language by name; rows without a language teach nothing; without any
labelled text every text is unknown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that triples are hashed to, and letter triples a text needs.
CELLS, LEAST = 4_096, 5
TEMPERATURES = (1, 2, 5, 10, 20, 50, 100, 200, 500)


def cells(text: Column, size: int = CELLS) -> Column:
    """The cell of each letter triple of a text, in order, repeats kept: words and a blank on both sides of each."""
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))
    codes = F.transform(F.filter(F.split(spaced, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    middles = lambda a: F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a) - 2)), lambda i: F.get(a, i) != 32)
    cell = lambda a, i: F.pmod((F.get(a, i - 1) * 31 + F.get(a, i)) * 31 + F.get(a, i + 1), F.lit(size)).cast("int")
    return F.get(F.transform(F.array(codes), lambda a: F.transform(middles(a), lambda i: cell(a, i))), F.lit(0))  # one array, so that codes are made once


@dataclass(frozen=True)
class Profiles:
    """``row``: one row with ``profiles``, an array of (lang, logs) by language; ``temperature`` of the posterior."""

    row: DataFrame
    temperature: float = 1.0


def profiles(texts: DataFrame, size: int = CELLS) -> DataFrame:
    """One row: an array of (lang, logs) from texts (text, lang), with 0.5 added to every count."""
    counted = texts.where("lang is not null").select("lang", F.explode(cells(F.col("text"), size)).alias("cell")).groupBy("lang", "cell").agg(F.count("*").alias("n"))
    per = counted.groupBy("lang").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("counts"))  # at most ``size`` entries
    log = lambda c: F.round(F.log((F.coalesce(F.element_at("counts", c), F.lit(0)) + 0.5) / (F.col("total") + 0.5 * size)) * 1000).cast("long")
    logs = per.select("lang", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), log).alias("logs"))
    return logs.agg(F.array_sort(F.collect_list(F.struct("lang", "logs"))).alias("profiles"))


def scores(texts: DataFrame, learnt: DataFrame, size: int = CELLS) -> DataFrame:
    """The rows with ``triples`` (their number) and ``scores``: an array of (score, lang) from best to worst."""
    best = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["lang"] < b["lang"], -1).when(a["lang"] > b["lang"], 1).otherwise(0)
    found = texts.withColumn("_cells", cells(F.col("text"), size)).crossJoin(F.broadcast(learnt))  # one row of a fixed size per language
    score = lambda p: F.aggregate("_cells", F.lit(0).cast("long"), lambda s, c: s + F.get(p["logs"], c))
    told = F.transform("profiles", lambda p: F.struct(score(p).alias("score"), p["lang"].alias("lang")))
    return found.withColumn("triples", F.size("_cells")).withColumn("scores", F.array_sort(told, best)).drop("_cells", "profiles")


def _posterior(temperature: float | Column) -> Column:
    """The best language's share: scores are thousandths of a natural logarithm."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    top = F.get("scores", F.lit(0))["score"]
    return 1 / F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp((x["score"] - top) / (1000.0 * t)))


def fit(train: DataFrame, calibrate: DataFrame, size: int = CELLS) -> Profiles:
    """Profiles from ``train`` (text, lang), and the temperature with the smallest loss on ``calibrate``: one row goes to the driver."""
    learnt = profiles(train, size)
    told = scores(calibrate.where("lang is not null").select("text", F.col("lang").alias("_lang")), learnt, size).where(F.col("triples") >= LEAST)
    share = lambda t: F.coalesce(F.aggregate(F.filter("scores", lambda x: x["lang"] == F.col("_lang")), F.lit(0.0), lambda s, x: s + F.exp((x["score"] - F.get("scores", F.lit(0))["score"]) / (1000.0 * t))), F.lit(0.0)) * _posterior(t)
    losses = told.agg(*(F.avg(-F.log(F.greatest(share(float(t)), F.lit(1e-9)))).alias(str(t)) for t in TEMPERATURES)).first()
    known = {t: losses[str(t)] for t in TEMPERATURES if losses[str(t)] is not None and not math.isnan(losses[str(t)])}
    return Profiles(learnt, float(min(known, key=lambda t: (known[t], t))) if known else 1.0)


def detected(texts: DataFrame, model: Profiles, target: str = "en", threshold: float = 0.8, size: int = CELLS, least: int = LEAST) -> DataFrame:
    """The rows with detected_lang, confidence, margin (best less second score) and requires_translation."""
    told = scores(texts, model.row, size)
    known = (F.col("triples") >= least) & (F.size("scores") > 0)
    top = F.get("scores", F.lit(0))
    out = told.withColumn("detected_lang", F.when(known, top["lang"]).otherwise("unknown")).withColumn("confidence", F.when(known, _posterior(model.temperature)).otherwise(0.0))
    margin = F.when(known, top["score"] - F.coalesce(F.get("scores", F.lit(1))["score"], top["score"])).otherwise(F.lit(0).cast("long"))
    return out.withColumn("margin", margin).withColumn("requires_translation", known & (F.col("detected_lang") != target) & (F.col("confidence") >= threshold)).drop("scores", "triples")
