"""Toxicity by compression distance.

A window (one word, lower-cased, without outer punctuation) is compressed with a zstandard
dictionary trained on toxic text and with one trained on ordinary text; the distance is the
difference of the two lengths. A document is told by how many of its windows lie above each
of a row of thresholds, on the distance itself and on its share of the window's length; the
weights of these counts are calibrated on the sample by logistic regression.

Two things make the distance tell anything on short windows. The toxic dictionary is trained
on the windows that mark toxic text (in a share of the toxic documents ahead of that of the
others), the ordinary one on those that do not; trained on all windows, both hold the same
common words (measured on the small tables: recall 0.6 at a false-positive rate of 0.4). And
each window is framed by a carrier that both dictionaries hold, since zstandard starts no match
in the last bytes of a block and stores a block raw that it shortens by a byte or two.

How far ahead a window has to be depends on how many labels there are, so it is learnt: each
of LEVELS, down to every window of a toxic document, is tried on folds of the sample with
dictionaries trained on the other folds, and the one of least log loss is taken. At all but
the first level the weights are calibrated on the same counts, which no document's own words
have gone into.

Defined cases: a null text is empty and has no windows; without labelled toxic rows (or
without others, or without any window in the toxic ones) every score is the share of toxic
labels (0 if there are none); repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import crc_fold, map_pieces, pieces, texts, whole_text, written
from skeinlake.llm.labelled import SAMPLE_ROWS, labelled_sample

LEVEL = 3
TRAINED_BYTES = 16_384
#: The most telling windows, appended whole to the trained part of each dictionary.
TOXIC_BYTES, ORDINARY_BYTES = 8_192, 32_768
CARRIER = bytes(range(200, 232))
#: Calibrated thresholds: bytes of distance, and distance as a share of the framed window.
THRESHOLDS = np.array([3, 4, 5, 6, 7, 8])
SHARES = np.array([0.3, 0.35, 0.4, 0.45, 0.5, 0.6])
#: Windows a dictionary is trained on at most, the most telling first.
VOCABULARY = 4_000
#: Toxic documents that hold a marked window, and standard errors by which its share of the toxic documents
#: exceeds that of the others, to choose from; at the last, every window of a toxic document counts as marked.
LEVELS = ((6, 5.0), (3, 4.0), (2, 3.0), (1, -np.inf))
#: Parts of the sample, each scored with dictionaries of the others to choose the level and calibrate.
FOLDS = 4
_STRIP = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MEMO = 400_000
COUNTS = [*(f"d{t}" for t in THRESHOLDS), *(f"s{round(100 * t)}" for t in SHARES)]


@dataclass
class Model:
    """What the executors need: two dictionaries, and the weights of the standardised counts."""

    prior: float
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def windows(text: bytes) -> list[bytes]:
    """The words of a text without outer punctuation."""
    return [x for w in text.lower().split() if (x := w.strip(_STRIP))]


def _framed(window: bytes) -> bytes:
    return b" %b " % window


def _dictionary(telling: list[tuple[bytes, int]], most: int) -> bytes:
    """Trained on each window as often as documents have it (64 times at most), then the windows, then the carrier."""
    try:
        trained = zstandard.train_dictionary(TRAINED_BYTES, [_framed(w) for w, n in telling for _ in range(min(n, 64))]).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the windows themselves
        trained = b""
    return trained + b"".join(_framed(w) for w, _ in reversed(telling))[-most:] + CARRIER


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)


class Distance:
    """Row of 0/1 by threshold for each window, remembered by window."""

    def __init__(self, model: Model) -> None:
        self.toxic, self.ordinary = _compressor(model.toxic), _compressor(model.ordinary)
        self.memo: dict[bytes, int] = {}

    def of(self, window: bytes) -> int:
        framed = CARRIER + _framed(window) + CARRIER[:16]
        return len(self.ordinary.compress(framed)) - len(self.toxic.compress(framed))

    def levels(self, window: bytes) -> int:
        """How many distance thresholds the window reaches, and how many shares, as one number."""
        if (level := self.memo.get(window)) is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            d = self.of(window)
            share = d / (len(window) + 2) if d >= THRESHOLDS[0] else 0.0
            level = self.memo[window] = int((d >= THRESHOLDS).sum()) * (len(SHARES) + 1) + int((share >= SHARES).sum())
        return level

    def counts(self, text: bytes) -> list[int]:
        """Windows at or above each threshold and each share, and the number of windows."""
        found = windows(text)
        at = np.bincount(np.fromiter(map(self.levels, found), np.int64, len(found)), minlength=(len(THRESHOLDS) + 1) * (len(SHARES) + 1)).reshape(len(THRESHOLDS) + 1, -1)
        above = lambda x: np.cumsum(x[::-1])[::-1][1:].tolist()
        return [*above(at.sum(1)), *above(at.sum(0)), len(found)]


def _inputs(counts: np.ndarray) -> np.ndarray:
    hits, n = counts[:, :-1], np.maximum(counts[:, -1:], 1)
    return np.concatenate([np.log1p(hits), np.minimum(100 * hits / n, 5), np.log(n)], 1)


def _present(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each distinct window of each document, with the document's label and fold as one number."""
    found: Counter = Counter()
    for text, label, fold in zip(texts(batch), batch.column("label").to_pylist(), batch.column("fold").to_pylist(), strict=True):
        found.update((w, label * FOLDS + fold) for w in set(windows(text)))
    keys = list(found)
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in keys], pa.binary()), pa.array([x for _, x in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], ["w", "part", "n"])


def _telling(counted: DataFrame, of: Counter, without: int | None) -> tuple[list[tuple[bytes, int, float]], list[tuple[bytes, int]]]:
    """(window, documents, standard errors ahead) of toxic text, most telling first, and (window, documents) that do not mark it, most frequent first.

    ``without`` is a fold whose documents are not counted. A window that is not three times as
    frequent in toxic text counts as not ahead.
    """
    folds = [f for f in range(FOLDS) if f != without]
    known = counted.select("w", *(sum((F.col(f"c{x * FOLDS + f}") for f in folds), F.lit(0)).alias(f"n{x}") for x in (0, 1)))
    n = [sum(of[x * FOLDS + f] for f in folds) for x in (0, 1)]
    share = lambda x: (F.col(f"n{x}") + 0.5) / (n[x] + 1.0)
    both = (F.col("n0") + F.col("n1")) / float(max(1, sum(n)))
    ahead = (share(1) - share(0)) / F.sqrt(both * (1 - both) * (1.0 / max(1, n[0]) + 1.0 / max(1, n[1])) + 1e-12)
    marked = F.when(share(1) >= 3 * share(0), ahead).otherwise(F.least(ahead, F.lit(0.0)))
    marks = known.where("n1 > 0").select("w", F.col("n1").alias("n"), marked.alias("ahead")).orderBy(F.desc("ahead"), "w")
    plain = known.where((F.col("n0") > 0) & (ahead < 1)).select("w", F.col("n0").alias("n")).orderBy(F.desc("n"), "w")
    return tuple([(bytes(r["w"]), *r[1:]) for r in x.limit(VOCABULARY).collect()] for x in (marks, plain))


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
    return w


def _loss(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """Log loss of all rows, each fold with the weights of the others."""
    total = 0.0
    for f in np.unique(fold):
        w = _regression(x[fold != f], y[fold != f])
        z = np.clip(x[fold == f] @ w[:-1] + w[-1], -30, 30)
        total += float((np.log1p(np.exp(z)) - y[fold == f] * z).sum())
    return total


def _counts(sample: DataFrame, models: list[list[Model]]) -> pd.DataFrame:
    """label, fold, level and counts of each document of the sample, with each of the models of its fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = [[Distance(m) for m in of] for of in models]
        for batch in batches:
            for piece in pieces(batch) if batch.num_rows else ():
                label, folds = piece.column("label"), piece.column("fold")
                for level in range(len(models[0])):
                    found = np.array([distances[f][level].counts(t) for t, f in zip(texts(piece), folds.to_pylist(), strict=True)], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), level, np.int32)), label, folds, *(pa.array(c) for c in found.T)], ["level", "label", "fold", *COUNTS, "n"])

    return sample.mapInArrow(run, f"level int, label int, fold int, {', '.join(f'{c} long' for c in COUNTS)}, n long").toPandas().sort_values([*COUNTS, "n", "label", "fold"])


def _standardised(found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Inputs, labels, folds, and the mean and scale of the inputs."""
    x = _inputs(found[[*COUNTS, "n"]].to_numpy(np.float64))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return (x - mean) / scale, found["label"].to_numpy(np.float64), found["fold"].to_numpy(), (mean, scale)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``rows`` labelled documents; what reaches the driver is bounded by that and VOCABULARY."""
    sample = labelled_sample(docs, labels, "toxic", rows).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    of = Counter({r["part"]: r["n"] for r in sample.groupBy((F.col("label") * FOLDS + F.col("fold")).alias("part")).agg(F.count("*").alias("n")).collect()})
    ordinary_rows, toxic_rows = (sum(of[x * FOLDS + f] for f in range(FOLDS)) for x in (0, 1))
    model = Model(toxic_rows / max(1, toxic_rows + ordinary_rows))
    if not toxic_rows or not ordinary_rows:
        return model
    parts = map_pieces(sample, _present, "w binary, part int, n long").groupBy("w")
    counted = written(parts.agg(*(F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(2 * FOLDS))), "windows")
    marks, plain = _telling(counted, of, None)
    if not marks:
        return model
    chosen = lambda found, level, part=1.0: [(w, n) for w, n, ahead in found if n >= part * level[0] and ahead >= part**0.5 * level[1]]
    trial: list[list[Model]] = []
    for fold in range(FOLDS):
        found, others = _telling(counted, of, fold)
        ordinary = _dictionary(others, ORDINARY_BYTES)
        trial.append([Model(model.prior, _dictionary(chosen(found, level, 1 - 1 / FOLDS), TOXIC_BYTES), ordinary) for level in LEVELS])

    found = _counts(sample, trial)
    best, level, weighed = np.inf, None, None
    for k, tried in enumerate(LEVELS):
        x, y, fold, scales = _standardised(found[found["level"] == k])
        if chosen(marks, tried) and (loss := _loss(x, y, fold)) < best:
            best, level, weighed = loss, tried, (x, y, scales)
    model.toxic, model.ordinary = _dictionary(chosen(marks, level), TOXIC_BYTES), _dictionary(plain, ORDINARY_BYTES)
    if level == LEVELS[0]:  # so many documents hold each marked window that no document's own words tell: the dictionaries in use are the better ones to calibrate
        x, y, _, scales = _standardised(_counts(sample, [[model]] * FOLDS))
        weighed = x, y, scales
    x, y, (model.mean, model.scale) = weighed
    model.weights = _regression(x, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), one row per row of ``docs``."""
    chosen = docs.select("doc_id", (crc_fold() == 0).alias("held_out"), whole_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model) if model.toxic else None
        for batch in batches:
            for piece in pieces(batch) if batch.num_rows else ():
                if distance is None:
                    s = np.full(piece.num_rows, model.prior)
                else:
                    x = (_inputs(np.array([distance.counts(t) for t in texts(piece)], np.float64)) - model.mean) / model.scale
                    s = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return chosen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
