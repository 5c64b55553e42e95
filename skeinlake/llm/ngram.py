"""Language-model scores by a weighted backoff automaton.

States are the contexts: two words, one word, or none; a text starts in the state of the end
token. A state has an arc for each word that followed it in training, which carries the
smoothed probability p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K), and a failure arc of weight
K / (c(h) + K) to the state of the shorter context h'. The state without context has
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) for every word; unknown ones share the last half count.
A text is one left-to-right traversal that ends with the end token: from each state the next
word's arc is taken, after as many failure arcs as it needs, and the logarithms add up.

The automaton of a whole corpus fits nowhere, but a block of documents only ever visits the
arcs of its own n-grams. So documents are dealt into blocks of bounded text; each block asks
for the counts of its distinct n-grams (sorted hashes, packed by hash range), each hash range
adds up what the blocks counted in training texts and answers each block in the order of its
question, and each block builds the states and arcs it got and walks its texts over them. All
words and n-grams of all texts count; nothing is pruned or capped. A block asks only ranges in
which it has n-grams, so the rows exchanged are never more than the distinct n-grams of the
blocks, which is in proportion to the text however many blocks there are; a range holds as
much as a block.

Defined cases: a null text is empty and scores the end token alone; without training texts
all counts are zero; repeated rows are scored alike, count as often as they occur, and are
dealt by the partition they come from, so that no block has to hold them all. Hashes of 64
bits stand for words, of 48 bits for pairs and triples: among 10^10 distinct ones, one of the
latter shares its count with another with a chance of one in 28,000 (it changes the score of
texts that hold it a little, and no count of words or base score).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from skeinlake.llm.common import crc_fold, whole_text

#: Weight of the shorter context, in counts, for states of one word and of two: the best of 14 pairs on texts of the training fold whose remainder is 2, learnt from the others (sf0.1: -3.53 a token, -4.20 without contexts).
WEIGHTS = (1600.0, 10.0)
#: Text of a block, in bytes; what a Python worker holds is a small multiple.
BLOCK_BYTES = 8 << 20
#: Tasks that blocks and ranges are dealt to at most.
MOST_TASKS = 20_000
HELD_OUT = 1
ORDERS = ("one", "two", "three")
BITS = {"one": 64, "two": 48, "three": 48}
END = np.uint64(xxh64_intdigest(b""))


def _hashes(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token of all texts, end tokens included, and the number of tokens of each text."""
    parts, sizes = [], np.zeros(len(rows), np.int64)
    for k, t in enumerate(rows):
        words = t.lower().split()
        sizes[k] = len(words) + 1
        parts.append(np.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)), END))
    return np.concatenate([np.zeros(0, np.uint64), *parts]), sizes


def _mixed(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = before * np.uint64(0x9E3779B97F4A7C15) + (tokens << np.uint64(31) | tokens >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _grams(tokens: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Hashes of each token, of it with the one before it, and with the two before it; before a text stand end tokens."""
    before = np.concatenate([[END], tokens[:-1]])[: len(tokens)]  # the text before ends in one
    pairs = _mixed(before, tokens)
    earlier = np.concatenate([[END], before[:-1]])[: len(tokens)]
    earlier[np.cumsum(sizes) - sizes] = END
    short = np.uint64(64 - BITS["two"])
    return {"one": tokens, "two": pairs >> short, "three": _mixed(earlier ^ np.uint64(0x94D049BB133111EB), pairs) >> short}


def _cuts(keys: np.ndarray, ranges: int, bits: int) -> dict[int, tuple[int, int]]:
    """From and to, in sorted keys of so many bits, of each range of hashes that has any."""
    if not len(keys):
        return {}
    found, starts = np.unique((keys >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32), return_index=True)
    return dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True), strict=True))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in as few whole bytes each as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps[1:].max()).bit_length() + 7) // 8) if len(keys) > 1 else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width, first = data[0], np.frombuffer(data[1:9], "<u8")
    steps = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate([first, steps.reshape(-1).view("<u8")]), dtype=np.uint64)


def _squeezed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64) if len(raw) else np.zeros(0, np.int64)


def _block_rows(table: pa.Table) -> list[bytes]:
    return table.column("text").cast(pa.binary()).combine_chunks().to_pylist() if table.num_rows else []


def _asked(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        tokens, sizes = _hashes(_block_rows(table))
        trained = np.repeat(~table.column("held_out").to_numpy().astype(bool), sizes)
        block = table.column("block")[0].as_py()
        held = {}
        for name, keys in _grams(tokens, sizes).items():
            known, place = np.unique(keys, return_inverse=True)
            held[name] = (known, np.bincount(place[trained], minlength=len(known)), _cuts(known, ranges, BITS[name]))
        met = sorted(set().union(*(cuts for _, _, cuts in held.values())))
        columns: dict[str, list] = {"block": [block] * len(met), "range": met}
        for name, (known, n, cuts) in held.items():
            spans = [cuts.get(r, (0, 0)) for r in met]
            columns[f"{name}_keys"] = [_packed(known[a:b]) for a, b in spans]
            columns[f"{name}_n"] = [_squeezed(n[a:b]) for a, b in spans]
        return pa.table(columns, schema=pa.schema([("block", pa.int64()), ("range", pa.int64()), *((f"{k}_{x}", pa.binary()) for k in ORDERS for x in ("keys", "n"))]))

    return run


def _answered(table: pa.Table) -> pa.Table:
    """The counts over all blocks, to each block in the order of its question."""
    columns: dict[str, list] = {"block": table.column("block").to_pylist(), "range": table.column("range").to_pylist()}
    for name in ORDERS:
        keys = [_unpacked(x) for x in table.column(f"{name}_keys").to_pylist()]
        n = [_counts(x) for x in table.column(f"{name}_n").to_pylist()]
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(n), len(known)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        columns[f"{name}_total"] = [_squeezed(total[place[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)]
    return pa.table(columns)


def _totals(table: pa.Table) -> pa.Table:
    """How often the words of a range occur in training texts, and how many of them do."""
    keys = [_unpacked(x) for x in table.column("one_keys").to_pylist()]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate([_counts(x) for x in table.column("one_n").to_pylist()]), len(known)).astype(np.int64)
    return pa.table({"tokens": [int(total.sum())], "types": [int((total > 0).sum())]})


@dataclass
class Level:
    """The states of one length of context, and their arcs.

    By state: the log10 weight of its failure arc. By arc (a distinct n-gram of the block): its
    log10 probability, and whether the arc exists (the n-gram occurred in training).
    """

    failure: np.ndarray
    arc: np.ndarray
    exists: np.ndarray


class Automaton:
    """States and arcs for the n-grams of a block, from their counts in training texts."""

    def __init__(self, grams: dict[str, np.ndarray], totals: dict[str, np.ndarray], starts: np.ndarray, tokens: int, types: int, weights: tuple[float, float]) -> None:
        #: For each token of the texts: its arc at each level, and the state it is read in.
        self.arcs: list[np.ndarray] = []
        self.states: list[np.ndarray] = []
        self.levels: list[Level] = []
        alone = np.zeros(0)
        for k, name in enumerate(ORDERS):
            known, first, arcs = np.unique(grams[name], return_index=True, return_inverse=True)
            count = totals[name].astype(np.float64)
            self.arcs.append(arcs)
            if k == 0:
                alone = (count + 0.5) / (tokens + 0.5 * (types + 1))
                self.levels.append(Level(np.zeros(1), np.log10(alone), np.ones(len(known), bool)))
                self.states.append(np.zeros(len(arcs), np.int64))
                ends = self._before(arcs, starts, int(np.searchsorted(known, END)) if len(known) else 0)
                self.contexts = [(ends, count)]
                continue
            state, held = self.contexts[-1]
            weight = weights[k - 1]
            failing = weight / (held + weight)
            lower = np.zeros(len(known)) if not len(known) else 10.0 ** self.levels[-1].arc[self.arcs[k - 1][first]]
            of = state[first]
            arc = count / (held[of] + weight) + failing[of] * lower
            with np.errstate(divide="ignore"):
                self.levels.append(Level(np.log10(failing), np.log10(arc), count > 0))
            self.states.append(state)
            if k == 1:
                # the state of two words: the pair before; a text starts in that of end tokens, as often as texts end
                start = np.array([self.contexts[0][1][int(np.searchsorted(np.unique(grams["one"]), END))]]) if len(known) else np.zeros(1)
                self.contexts.append((self._before(arcs, starts, len(known)), np.concatenate([count, start])))

    @staticmethod
    def _before(arcs: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
        state = np.concatenate([[start], arcs[:-1]])[: len(arcs)]
        state[starts] = start
        return state

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each step's probability, and of the step from the state without context; all texts at once."""
        gained = np.zeros(len(self.arcs[0]))
        waiting = np.arange(len(gained))
        for level, arcs, states in zip(reversed(self.levels), reversed(self.arcs), reversed(self.states), strict=True):
            met = level.exists[arcs[waiting]]
            gained[waiting[met]] += level.arc[arcs[waiting[met]]]
            waiting = waiting[~met]
            gained[waiting] += level.failure[states[waiting]]
        return gained, self.levels[0].arc[self.arcs[0]]


def _walked(docs: pa.Table, answers: pa.Table, weights: tuple[float, float]) -> pa.Table:
    """The traversal of each text of a block."""
    answers = answers.sort_by("range")
    tokens, types = (answers.column(c)[0].as_py() for c in ("tokens", "types"))
    hashes, sizes = _hashes(_block_rows(docs))
    grams = _grams(hashes, sizes)
    totals = {name: np.concatenate([np.zeros(0, np.int64), *map(_counts, answers.column(f"{name}_total").to_pylist())]) for name in ORDERS}
    starts = np.cumsum(sizes) - sizes
    automaton = Automaton(grams, totals, starts, tokens, types, weights)
    step, alone = automaton.walk()
    per = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
    return pa.table({
        "doc_id": docs.column("doc_id"),
        "held_out": docs.column("held_out"),
        "n_tokens": pa.array(sizes),
        "n_known": pa.array(per((totals["one"][automaton.arcs[0]] > 0).astype(np.int64))),
        "train_tokens": pa.array(np.full(len(sizes), tokens, np.int64)),
        "base_score": pa.array(per(alone)),
        "score": pa.array(per(step)),
    })


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of ``docs``."""
    chosen = docs.select("doc_id", whole_text().alias("text"), (crc_fold() == HELD_OUT).alias("held_out"))
    size = chosen.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = 1 + ((size[0] or 0) + 16 * size[1]) // block_bytes
    tasks = min(blocks, MOST_TASKS)  # a task may hold several blocks or ranges, one after the other
    dealt = chosen.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))).repartition(tasks, "block")
    packed = lambda x: ", ".join(f"{k}_{n} binary" for k in ORDERS for n in x)
    asked = dealt.groupBy("block").applyInArrow(_asked(blocks), f"block long, range long, {packed(('keys', 'n'))}")
    # both read one exchange; the totals are a single row
    ranged = asked.repartition(tasks, "range").groupBy("range")
    totals = ranged.applyInArrow(_totals, "tokens long, types long").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    answered = ranged.applyInArrow(_answered, f"block long, range long, {packed(('total',))}").crossJoin(F.broadcast(totals))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(answered.repartition(tasks, "block").groupBy("block")).applyInArrow(lambda block, answers: _walked(block, answers, weights), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
