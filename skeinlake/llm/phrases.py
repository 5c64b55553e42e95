"""Phrases whose words stand together more often than chance, over all texts of a language.

Texts are split at ``[.,;:!?\\n-\\r]`` into pieces and pieces at spaces and tabs into words. Words
found LEAST times or more in their language get a number; a phrase cannot be that frequent
with a word that isn't, so pieces are broken at all others. Runs of two and three numbers
are packed into binary keys of one width, radix-sorted and counted by run lengths within blocks
of texts, dealt by ranges of keys, and sorted and counted again there.

1. Blocks: a task turns each run of texts (BLOCK_WORDS words, BLOCK_TYPES different ones) into one
   row: the words' numbers within the block, 0 for a break, and the words with their counts. Texts
   are read once; the blocks are written to the shared folder.
2. Dictionary: counts of all blocks are added by (language, word); the frequent ones get
   consecutive numbers. Each block gets back the numbers of its own words by a join on (language,
   word), so no task needs the whole dictionary.
3. Keys: each block cuts its different keys, sorted and counted, at the bounds of ranges, and hands on a
   row for each range that it has keys in. A range gets a key once from each block at most, however
   frequent the key is. Bounds come from a bounded sample of blocks and only decide how keys are dealt;
   beyond RANGES ranges, each is dealt to shares by a hash of the key.
4. Scores: joins of the frequent phrases with their parts, which are frequent too. The best of each
   language are found by a rank that Spark applies before the shuffle, then by the phrase itself.

Defined cases: a null text is empty, a null language is "und"; repeated rows count each; a text
longer than SLICE_BYTES is taken piece by piece (a piece is held whole); ties are ordered by the
phrase's bytes; an empty table has no phrases; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.llm.common import whole_text, written

LEAST, TOP, DROP_PERCENT = 10, 2_000, 50
BLOCK_WORDS, BLOCK_TYPES, SLICE_BYTES = 1 << 20, 1 << 17, 1 << 20
#: Different keys (of all blocks) that one range, or share of one, holds on average; ranges; and the blocks that bounds are taken from, every so many keys.
RANGE_KEYS, RANGES, SAMPLE_BLOCKS, SAMPLE_STEP = 500_000, 4_096, 16, 64
#: Pairs of a block that are packed and sorted at a time, about, and of how many one is looked at to tell the parts.
PART_KEYS, PART_STEP = 1 << 17, 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_BREAK, _BLANK = 0, 1


def _slices(text: bytes) -> Iterator[bytes]:
    """The lower-cased text in slices that end where a piece ends."""
    text, at = text.translate(_LOWER), 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE_BYTES:
            end = text.rfind(b"\n", at, at + SLICE_BYTES)
            end = end if end > at else text.find(b"\n", at + SLICE_BYTES)
            end = end + 1 if end >= 0 else len(text)
        yield text[at:end]
        at = end


class _Block:
    """Numbers of the words of a run of texts; words are numbered from 2 as they come."""

    def __init__(self) -> None:
        number = count(2)
        self.ids: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__, {b"": _BLANK, b"\n": _BREAK}))
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, lang: str, text: bytes) -> None:
        found = np.fromiter(map(self.ids[lang].__getitem__, text.replace(b"\n", b" \n ").split(b" ")), np.uint32)
        found = found[found != _BLANK]
        self.parts += [found, np.array([_BREAK], np.uint32)]
        self.words += len(found)

    def full(self) -> bool:
        return self.words >= BLOCK_WORDS or sum(map(len, self.ids.values())) >= BLOCK_TYPES

    def row(self, block: int) -> pa.RecordBatch:
        numbers = np.concatenate(self.parts)
        words = sorted((k, lang, w.decode()) for lang, own in self.ids.items() for w, k in own.items() if k > _BLANK)
        counts = np.bincount(numbers, minlength=len(words) + 2)[2:]
        told = pa.StructArray.from_arrays([pa.array([x for _, x, _ in words], pa.string()), pa.array([x for _, _, x in words], pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"])
        kind = np.uint16 if len(words) + 2 <= 1 << 16 else np.uint32
        return pa.record_batch({"block": pa.array([block], pa.int64()), "wide": pa.array([kind is np.uint32]), "numbers": pa.array([numbers.astype(kind).tobytes()], pa.binary()), "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), told)})


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, block = count(TaskContext.get().partitionId() << 40), _Block()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for piece in _slices(text.as_buffer().to_pybytes()):
                block.add(lang, piece)
                if block.full():
                    yield block.row(next(name))
                    block = _Block()
    if block.parts:
        yield block.row(next(name))


def blocks(docs: DataFrame) -> DataFrame:
    """block, wide, numbers, words (lang, word, n): each row is a run of texts."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(_in_blocks, "block long, wide boolean, numbers binary, words array<struct<lang: string, word: string, n: long>>")


def numbered(words: DataFrame) -> DataFrame:
    """The rows with consecutive numbers ``id`` from 1, by counts of the partitions as written."""
    placed = written(words.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "words")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*words.columns, (F.col("_before") + F.col("_at") + 1).alias("id"))


def radix_order(digits: np.ndarray) -> np.ndarray:
    """The order of rows of 16-bit digits: one stable counting pass a digit, the last one first."""
    order = np.argsort(digits[:, -1], kind="stable")
    for d in reversed(range(digits.shape[1] - 1)):
        order = order[np.argsort(digits[order, d], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of an even number of bytes, in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    digits = keys.view(">u2").astype(np.uint16)
    order = radix_order(digits)
    digits = digits[order]
    starts = np.flatnonzero(np.r_[True, (digits[1:] != digits[:-1]).any(axis=1)])
    return keys[order[starts]], np.add.reduceat(counts[order], starts)


def _packed(runs: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of three numbers (0 for none) as bytes, most significant first, padded in front to an even length."""
    out = np.zeros((len(runs[0]), 3 * width + width % 2), np.uint8)
    for k, ids in enumerate(runs):
        end = out.shape[1] - (2 - k) * width
        out[:, end - width : end] = np.ascontiguousarray(ids, ">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return out


def _coded(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys and counts byte plane by byte plane: sorted keys change little in the first ones."""
    planes = np.concatenate([keys.T, counts.astype("<u4").view(np.uint8).reshape(-1, 4).T])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _decoded(payload: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(size + 4, -1)
    return planes[:size].T, np.ascontiguousarray(planes[size:].T).view("<u4").reshape(-1).astype(np.int64)


def _block_keys(wide, numbers, own, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of a block, in order, with their counts."""
    local = np.frombuffer(numbers.as_buffer(), np.uint32 if wide.as_py() else np.uint16)
    table = np.zeros(int(local.max(initial=0)) + 1, np.int64)
    if own.is_valid:
        table[own.values.field("k").to_numpy()] = own.values.field("id").to_numpy()
    x = table[local]
    two = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
    three = two[:-1][np.diff(two) == 1] if len(two) else two
    # parts by ranges of the first number, so that a part of the keys is packed and sorted at a time
    few = np.sort(x[two[::PART_STEP]])
    edges = np.unique(few[np.arange(1, 1 + len(two) // PART_KEYS) * len(few) // (1 + len(two) // PART_KEYS)]) if len(two) else few
    done = []
    for low, high in zip(np.r_[0, edges], np.r_[edges, np.iinfo(np.int64).max], strict=True):
        pick = lambda at: at[(x[at] >= low) & (x[at] < high)]  # noqa: B023, E731
        p, t = pick(two), pick(three)
        keys = np.concatenate([_packed([x[p], x[p + 1], np.zeros(len(p), np.int64)], width), _packed([x[t], x[t + 1], x[t + 2]], width)])
        done.append(run_lengths(keys, np.ones(len(keys), np.int64)))
    return np.concatenate([k for k, _ in done]), np.concatenate([n for _, n in done])


def _sampled(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                keys, _ = _block_keys(*row, width)
                few = keys[SAMPLE_STEP // 2 :: SAMPLE_STEP]
                yield pa.record_batch({"n": pa.array([len(keys)], pa.int64()), "keys": pa.array([few.tobytes()], pa.binary())})

    return run


def _as_text(keys: np.ndarray) -> np.ndarray:
    """Rows of bytes as one comparable value each; all have one width, so that NULs at the end change no order."""
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").reshape(-1)


def _cut(width: int, bounds: np.ndarray, shares: int) -> Callable:
    """Each block's keys as one row for each range (and share of a range) that they fall into."""
    text = _as_text(bounds) if len(bounds) else np.zeros(0, "S1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                keys, counts = _block_keys(*row, width)
                edges = np.r_[0, np.searchsorted(_as_text(keys), text, "left") if len(keys) else np.zeros(len(text), int), len(keys)]
                names, rows = [], []
                for k in np.flatnonzero(np.diff(edges)):
                    own, n = keys[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]]
                    mixed = np.zeros(len(own), np.uint64)
                    for c in range(own.shape[1] if shares > 1 else 0):
                        mixed += own[:, c] * np.uint64((c + 1) * 2654435761)
                    share = (mixed >> np.uint64(7)) % np.uint64(shares)
                    for part in np.unique(share):
                        names.append(int(k) * shares + int(part))
                        rows.append(_coded(own[share == part], n[share == part]))
                yield pa.record_batch({"range": pa.array(names, pa.int64()), "payload": pa.array(rows, pa.binary())})

    return run


def _counted(width: int, least: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        size = 3 * width + width % 2
        parts = [_decoded(x.as_buffer().to_pybytes(), size) for x in rows.column("payload")]
        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros((0, size), np.uint8)
        found, n = run_lengths(np.ascontiguousarray(keys), np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64))
        found, n = found[n >= least], n[n >= least]
        ids = []
        for k in range(3):
            end = size - (2 - k) * width
            whole = np.zeros((len(found), 8), np.uint8)
            whole[:, 8 - width :] = found[:, end - width : end]
            ids.append(whole.view(">u8").reshape(-1).astype(np.int64))
        return pa.table({"w1": pa.array(ids[0]), "w2": pa.array(ids[1]), "w3": pa.array(ids[2]), "a": pa.array(n, pa.int64())})

    return run


def _ranges(rows: DataFrame, blocks: int, width: int) -> tuple[np.ndarray, int]:
    """Bounds between ranges, and the shares that each is dealt to, from the keys of SAMPLE_BLOCKS blocks; they only decide how keys are dealt."""
    size = 3 * width + width % 2
    found = rows.mapInArrow(_sampled(width), "n long, keys binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint8).reshape(-1, size) for r in found] or [np.zeros((0, size), np.uint8)])
    total = sum(r["n"] for r in found) * blocks / max(1, len(found))
    want = int(min(RANGES, 1 + total // RANGE_KEYS, len(keys)))
    keys, _ = run_lengths(keys, np.ones(len(keys), np.int64))
    at = np.arange(1, want) * len(keys) // max(1, want)
    return keys[np.unique(at)] if want > 1 else keys[:0], max(1, int(total // (RANGE_KEYS * RANGES)))


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, id), phrases (w1, w2, w3 or 0, a) found ``least`` times or more, and the words of each language (lang, n)."""
    read = written(blocks(docs), "blocks")
    own = read.select("block", F.posexplode("words").alias("k", "w")).select("block", (F.col("k") + 2).alias("k"), "w.*")
    totals = own.groupBy("lang").agg(F.sum("n").alias("n"))
    words = numbered(own.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    most = words.agg(F.max("id")).first()[0] or 0
    width = max(1, (int(most).bit_length() + 7) // 8)
    known = own.join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("k", "id")).alias("ids"))
    n = read.count()
    few = read.select("block").orderBy(F.xxhash64("block")).limit(SAMPLE_BLOCKS)  # a bounded number
    packed = lambda asked: asked.join(own.join(few, "block", "left_semi").join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("k", "id")).alias("ids")), "block", "left").select("wide", "numbers", "ids")
    bounds, shares = _ranges(packed(read.join(few, "block", "left_semi")), n, width)
    keys = read.join(known, "block", "left").select("wide", "numbers", "ids").mapInArrow(_cut(width, bounds, shares), "range long, payload binary")
    phrases = written(keys.groupBy("range").applyInArrow(_counted(width, least), "w1 long, w2 long, w3 long, a long"), "phrases")
    return words, phrases, totals


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    up = (whole(a) * whole(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", up, whole(left) * whole(right))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, drop_percent: int = DROP_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases."""
    words, phrases, totals = frequent(docs, least)
    two, three = phrases.where("w3 = 0").select("w1", "w2", "a"), phrases.where("w3 > 0")
    of = lambda *names: words.select(*(F.col(c).alias(n) for c, n in zip(("id", "f", "lang"), names, strict=False)))
    pair = lambda a, b, n: two.select(F.col("w1").alias(a), F.col("w2").alias(b), F.col("a").alias(n))
    longer = three.select("a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p")).groupBy("p.w1", "p.w2").agg(F.max("a").alias("most"))
    kept = two.join(longer, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("most") < drop_percent * F.col("a"), F.lit(True)))
    pairs = kept.join(of("w1", "l", "lang"), "w1").join(of("w2", "r"), "w2").select("lang", "w1", "w2", F.lit(0).cast("long").alias("w3"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    cut = three.join(of("w1", "f1", "lang"), "w1").join(of("w3", "f3"), "w3").join(pair("w1", "w2", "f12"), ["w1", "w2"]).join(pair("w2", "w3", "f23"), ["w2", "w3"])
    cuts = F.array(*(F.struct(_score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate((("f1", "f23"), ("f12", "f3")), 1)))
    triples = cut.select("lang", "w1", "w2", "w3", "a", F.array_min(cuts).alias("c")).select("lang", "w1", "w2", "w3", "a", "c.l", "c.r", "c.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = pairs.unionByName(triples).withColumn("place", F.rank().over(best)).where(F.col("place") <= top)
    name = lambda k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"))
    told = found.join(name(1), "w1").join(name(2), "w2").join(name(3), "w3", "left").withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    ranked = told.withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
