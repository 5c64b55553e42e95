"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one feature at a time are boosted in turn (cyclically) and summed into one
lookup table per feature; then the pairs of features with the largest gain on the residuals
get two-dimensional tables the same way. A score is the logistic of an intercept and one
looked-up value per table, added for a whole batch at once.

Features look at form alone, never at lang, source or doc_id. Defined cases: a null text is
empty and is scored like any other; with no labelled rows every score is 0.5, and with one
class only it is near that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import crc_fold, pieces, texts, whole_text
from skeinlake.llm.labelled import SAMPLE_ROWS, labelled_sample

FEATURES = ["log_words", "mean_word", "upper", "symbols", "bangs", "digits", "distinct", "distinct_pairs", "repeats", "same_lines", "line_words", "ends", "pipes", "short_words", "longest_run"]
BINS, PAIR_BINS, PAIRS = 32, 8, 5
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1
ACCEPT = 0.3
_UPPER = bytes(range(65, 91))
_ALPHA = bytes(range(65, 91)) + bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>{}=~^\\_@"
_DIGITS = b"0123456789"


def features(text: bytes) -> list[float]:
    """The features of a UTF-8 text, in the order of FEATURES."""
    words = text.lower().split()
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, size - len(text.translate(None, _ALPHA)))
    same = list(map(eq, words, words[1:]))
    run = longest = 0
    if any(same):
        for x in same:
            run = run + 1 if x else 0
            longest = max(longest, run)
    ends = sum(x.rstrip().endswith((b".", b"!", b"?", b'"', b"\xe2\x80\xa6")) for x in lines)
    return [
        np.log1p(n),
        size / max(1, n),
        (size - len(text.translate(None, _UPPER))) / letters,
        (size - len(text.translate(None, _SYMBOLS))) / size,
        text.count(b"!") / max(1, n),
        (size - len(text.translate(None, _DIGITS))) / size,
        len(set(words)) / max(1, n),
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        sum(same) / max(1, n - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        ends / max(1, len(lines)),
        text.count(b"|") / max(1, n),
        sum(len(w) <= 3 for w in words) / max(1, n),
        np.log1p(longest),
    ]


@dataclass
class Gam:
    """Cut points and lookup tables; ``pairs`` holds (i, j, coarse cuts of i, of j, table)."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += t[np.searchsorted(c, x[:, k], "right")]
        for i, j, ci, cj, t in self.pairs:
            out += t[np.searchsorted(ci, x[:, i], "right"), np.searchsorted(cj, x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree with three leaves at most, grown greedily on sums of gradients and Hessians."""
    value, spans = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, 0)
        for lo, hi in spans:
            if hi - lo > 1:
                gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
                gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (lo, hi), lo + k + 1)
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    for lo, hi in spans:
        value[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return value


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four parts."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    parts = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    quarters = list(zip(parts(cg), parts(ch), strict=True))
    gain = sum(a**2 / (b + 1) for a, b in quarters)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = np.zeros_like(g)
    for (a, b), (rows, columns) in zip(quarters, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        value[rows, columns] = _leaf(a[i, j], b[i, j])
    return float(gain[i, j]), value


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fits the tables to features and 0/1 labels; deterministic in the rows and their order."""
    model = Gam()
    if not len(y):
        return model
    p = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(p / (1 - p)))
    model.cuts = [_quantiles(x[:, k], BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.cuts)]
    f = np.full(len(y), model.intercept)
    rest = lambda: (y - (q := 1 / (1 + np.exp(-f))), q * (1 - q))
    for _ in range(ROUNDS):
        for k, b in enumerate(binned):
            g, h = rest()
            step = RATE * _shallow(np.bincount(b, g, len(model.tables[k])), np.bincount(b, h, len(model.tables[k])))
            model.tables[k] += step
            f += step[b]
    coarse = [_quantiles(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    small = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)
    grid = lambda i, j, v: np.bincount(small[i] * shape(i, j)[1] + small[j], v, shape(i, j)[0] * shape(i, j)[1]).reshape(shape(i, j))
    g, h = rest()
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])), key=lambda t: (-t[0], t[1], t[2]))[:PAIRS]
    tables = {(i, j): np.zeros(shape(i, j)) for _, i, j in gains}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in tables.items():
            g, h = rest()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            f += step[small[i], small[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in tables.items()]
    return model


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in texts(batch)], np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Gam:
    """Learns from at most ``rows`` labelled documents; only their features reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch) if batch.num_rows else ():
                x = _matrix(piece)
                yield pa.RecordBatch.from_arrays([piece.column("label"), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["label", *FEATURES])

    sample = labelled_sample(docs, labels, "quality", rows)
    found = sample.mapInArrow(run, f"label int, {', '.join(f'{k} double' for k in FEATURES)}").toPandas().sort_values([*FEATURES, "label"])
    return train(found[FEATURES].to_numpy(np.float64), found["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Gam, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``; ``keep``: the accepted rows themselves instead."""
    if keep:
        chosen, schema = docs, docs.schema
    else:
        chosen = docs.select("doc_id", (crc_fold() == 0).alias("held_out"), whole_text().alias("text"))
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch) if batch.num_rows else ():
                s = model.score(np.array([features(t or b"") for t in texts(piece)], np.float64).reshape(-1, len(FEATURES)))
                if keep:
                    yield piece.filter(pa.array(s >= ACCEPT))
                else:
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return chosen.mapInArrow(run, schema)


def rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of what the classifier turns down."""
    return score(docs, fit(docs, labels)).where(F.col("predicted") == 0).select("doc_id", "score")
