"""Scores of answers, pooled over questions and runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.shared import numbered
from skeinlake.operators.nearest import items as usable


def pooled(scores: DataFrame) -> DataFrame:
    """metric, mean, n over all scores that are there."""
    return scores.where("score is not null").groupBy("metric").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))


def across_runs(scores: DataFrame) -> DataFrame:
    """question_type (null: all), mean over everything, and the sample deviation of the run means (null below two runs)."""
    runs = scores.where("score is not null").rollup("question_type", "run").agg(F.avg("score").alias("m"), F.grouping_id().alias("g"))
    by_type = scores.where("score is not null").groupBy("question_type", "run").agg(F.avg("score").alias("m")).groupBy("question_type").agg(F.stddev_samp("m").alias("run_std"), F.count("*").alias("runs"))
    over = scores.where("score is not null").groupBy("run").agg(F.avg("score").alias("m")).agg(F.stddev_samp("m").alias("run_std"), F.count("*").alias("runs")).withColumn("question_type", F.lit(None).cast("string"))
    mean = runs.where("g in (1, 3)").select("question_type", F.col("m").alias("mean"))
    spread = by_type.unionByName(over.select(*by_type.columns))
    return mean.join(spread, mean["question_type"].eqNullSafe(spread["question_type"])).select(mean["question_type"], "mean", "run_std", "runs")


def bootstrap(scores: DataFrame, samples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """metric, mean, low, high: percentile interval of resampled means, one task per metric.

    Scores are one per question of a benchmark: a bounded group.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(frame["score"].to_numpy())
        rng = np.random.default_rng(seed)
        means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(samples)])
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({"metric": [frame["metric"].iloc[0]], "mean": [x.mean()], "low": [low], "high": [high]})

    return scores.where("score is not null").select("metric", "score").groupBy("metric").applyInPandas(run, "metric string, mean double, low double, high double")


def dry_run(chunks: DataFrame, minimum: int = 256, summary: int = 150, graph_share: float = 0.5, reasoning: int = 20) -> DataFrame:
    """One row: calls and tokens that building from these chunks (tokens) would take."""
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_in"), (F.count("*") * summary).alias("summary_tokens"), F.coalesce(F.sum(F.greatest(F.lit(float(minimum)), graph_share * F.col("tokens"))), F.lit(0.0)).alias("graph_tokens")).withColumn("reasoning_tokens", F.col("graph_tokens") * reasoning)


def _apart(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    out = np.empty((len(v), len(centres)))
    for at in range(0, len(v), 1_024):
        out[at : at + 1_024] = ((v[at : at + 1_024, None, :] - centres) ** 2).sum(axis=2)
    return out


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _drawn(rows: DataFrame, n: int, centres: np.ndarray, uniform: float) -> int:
    """The number (from 0) of the row that a uniform draw picks, by squared distance to the nearest centre.

    Rows are summed by runs of about sqrt(n); the run that the draw falls into is then looked at row
    by row, so that about sqrt(n) numbers come to the driver twice.
    """
    run_rows = max(1, round(n**0.5))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"n": batch.column(0), "w": pa.array(_apart(_rows(batch), centres).min(axis=1))})

    def place(found: list, at: float) -> tuple[int, float]:
        ends = np.cumsum([r["w"] for r in found])
        k = min(int(np.searchsorted(ends, at, "right")), len(found) - 1)
        return found[k]["k"], at - (ends[k - 1] if k else 0.0)

    weighed = rows.mapInArrow(weigh, "n long, w double")
    runs = weighed.groupBy(F.floor(F.col("n") / run_rows).alias("k")).agg(F.sum("w").alias("w")).orderBy("k").collect()
    total = sum(r["w"] for r in runs)
    if total <= 0:
        return min(int(uniform * n), n - 1)
    run, rest = place(runs, uniform * total)
    within = rows.where(F.col("n").between(run * run_rows, (run + 1) * run_rows - 1)).mapInArrow(weigh, "n long, w double").select(F.col("n").alias("k"), "w").orderBy("k").collect()
    return place(within, rest)[0]


def _step(centres: np.ndarray, before: np.ndarray | None):
    """Per batch and cluster: rows, their sum, and how many were elsewhere before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _rows(batch)
                label = _apart(v, centres).argmin(axis=1)
                moved = np.ones(len(v), bool) if before is None else label != _apart(v, before).argmin(axis=1)
                found = np.unique(label)
                yield pa.record_batch({"c": pa.array(found, pa.int32()), "n": pa.array([int((label == c).sum()) for c in found]), "moved": pa.array([int(moved[label == c].sum()) for c in found]), "s": pa.array([v[label == c].sum(axis=0).tolist() for c in found], pa.list_(pa.float64()))})

    return run


def kmeans(vectors: DataFrame, k: int, seed: int = 0, rounds: int = 50) -> tuple[DataFrame, np.ndarray]:
    """id, cluster of vectors (id, vector), and the centres.

    Centres start as rows drawn one by one, with chances in proportion to the squared distance to the
    nearest drawn so far; then rows join the nearest centre (of equal ones the first) and centres become
    means, until no row moves or ``rounds`` are over. A centre without rows stays. Rows are numbered by id, so
    the result does not depend on how they are dealt; centres and their sums are all that meets on the driver.

    Rows that ``nearest.items`` leaves out are left out; lengths are kept as they are; with fewer
    rows than ``k`` there are that many clusters, without any none.
    """
    known = usable(vectors, scaled=False).select("id", "v")
    rows = numbered(known, "id").select((F.col("n") - 1).alias("n"), "v", "id")
    n = rows.count()
    if not n:
        return rows.select("id", F.lit(0).alias("cluster")), np.zeros((0, 0))
    width = len(rows.first()["v"])
    take = lambda at: np.array(rows.where(F.col("n") == at).first()["v"], np.float64)
    rng = np.random.default_rng(seed)
    centres = take(int(rng.integers(n)))[None, :]
    for _ in range(1, min(k, n)):
        centres = np.vstack([centres, take(_drawn(rows.select("n", "v"), n, centres, rng.random()))])
    before = None
    for _ in range(rounds):
        sums = rows.select("n", "v").mapInArrow(_step(centres, before), "c int, n long, moved long, s array<double>")
        found = sums.groupBy("c").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"), F.array(*(F.sum(F.col("s")[j]) for j in range(width))).alias("s")).collect()
        if not sum(r["moved"] for r in found):
            break
        before, centres = centres, centres.copy()
        for r in found:
            centres[r["c"]] = np.array(r["s"]) / r["n"]
    last = centres if before is None else before
    kind = vectors.schema["id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"id": batch.column(2), "cluster": pa.array(_apart(_rows(batch), last).argmin(axis=1), pa.int32())})

    return rows.mapInArrow(label, f"id {kind}, cluster int"), last


def principal_plane(vectors: DataFrame) -> DataFrame:
    """id, x, y: the first two principal components (their signs are arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    found = PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("p"))
    return found.select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def default_k(n: int) -> int:
    """Number of clusters for n vectors."""
    return min(12, max(2, round((n / 2) ** 0.5)))
