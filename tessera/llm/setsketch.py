"""Near-duplicate documents by SetSketch registers, banded, compared by likelihood, verified on full sets."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, chunks, mix, sequence_hashes, signed, texts_of, word_bounds, word_hashes, written
from tessera.llm.components import connected_components

REGISTERS, ROWS, SHINGLE = 128, 4, 5
#: Register scale: value k stands for minima near BASE**-k; values end at LAST.
BASE, RATE, LAST = 1.001, 20.0, 65_535
PERCENT = 75
#: Pairs whose most likely similarity is below this are not verified; five standard errors of 128 registers below 0.75.
LEAST_LIKELY = 0.55
#: Classes of a bucket that are compared as pairs; in larger buckets, classes and shingles of a block at most, on average.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 512, 1_000_000

_rng = np.random.default_rng(7_2020)
_FACTOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z lower-cased; of the whole sequence if it is shorter; none without words."""
    data = LOWER[np.frombuffer(text, dtype=np.uint8)]
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    if not len(words):
        return words
    return np.unique(sequence_hashes(words, min(k, len(words))))


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch of a set of 64-bit items: for each register the least of exponential variates, on an exponential scale, truncated to 16 bits."""
    least = np.full(REGISTERS, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(items), 1024):
        part = _FACTOR[:, None] * items[None, i : i + 1024]
        part += _SHIFT[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    arrival = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(arrival) / math.log(BASE)), 0, LAST).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union is the larger register everywhere."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches (rows) of sets of known sizes, from how many registers are above, below and equal."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    same = np.clip(1 - up - down, 1e-12, 1)
    score = above * np.log(np.clip(up, 1e-12, 1)) + below * np.log(np.clip(down, 1e-12, 1)) + (a.shape[1] - above - below) * np.log(same)
    return j[np.arange(len(j)), score.argmax(axis=1)]


_SIGNATURE = "doc_id long, n_shingles long, key_a long, key_b long, sketch binary, bands array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band_no = np.arange(REGISTERS // ROWS, dtype=np.uint64)
    for batch in batches:
        for part, texts in chunks(batch):
            sizes, keys, sketches, bands = [], [], [], []
            for t in texts:
                s = shingles(t)
                sizes.append(len(s))
                if not len(s):
                    keys.append((None, None)), sketches.append(None), bands.append(None)
                    continue
                r = registers(s)
                keys.append(struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest()))
                sketches.append(r.tobytes())
                grouped = r.reshape(-1, ROWS).astype(np.uint64)
                bands.append(signed(mix(grouped @ (np.uint64(1) << np.arange(0, 64, 64 // ROWS, dtype=np.uint64)), 3) ^ mix(band_no, 4)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "key_a", "key_b", "sketch", "bands"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
        n = [batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
        keep = np.zeros(len(a), dtype=bool)
        for i in range(0, len(a), 4096):
            at = slice(i, i + 4096)
            keep[at] = likely_similarity(a[at], b[at], n[0][at], n[1][at]) >= LEAST_LIKELY
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])


def _lower_words(text: bytes) -> list[bytes]:
    return text.translate(LOWER.tobytes()).split()


def near(x: list[bytes], y: list[bytes]) -> bool:
    """Whether the sets of 5-word shingles of two sequences of words are similar enough, on the words themselves: words are numbered, shingles are tuples of numbers."""
    number: dict[bytes, int] = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) for words in (x, y))
    if not len(a) or not len(b):
        return False
    if min(len(a), len(b)) < SHINGLE:  # a shorter sequence is a set of itself alone
        return len({tuple(w[i : i + SHINGLE]) for w in (x, y) for i in range(max(1, len(w) - SHINGLE + 1))}) == 1
    code = lambda w, k: w[k : len(w) - SHINGLE + 1 + k]
    both = np.concatenate([code(a, 0), code(b, 0)])
    for k in range(1, SHINGLE):
        if len(number) > 1 << 12:  # five numbers do not fit 63 bits together: pairs are numbered anew
            both = np.unique(both, return_inverse=True)[1]
        both = both * len(number) + np.concatenate([code(a, k), code(b, k)])
    own, other = (np.unique(part) for part in np.split(both, [len(a) - SHINGLE + 1]))
    shared = len(np.intersect1d(own, other, assume_unique=True))
    return 100 * shared >= PERCENT * (len(own) + len(other) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, last, held = [], None, []
        for x, y in zip(texts_of(batch.column("text_a")), texts_of(batch.column("text_b")), strict=True):
            if last is None or y != last:
                last, held = y, _lower_words(y)
            keep.append(near(_lower_words(x), held))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of class ids that hold on full sets. Sketches go first, so that texts travel only for likely pairs."""
    side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    near = written(near.mapInArrow(_likely, "a long, b long"), "likely")
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = written(texts.join(ids.hint("merge"), "doc_id").groupBy("doc_id").agg(F.first("text").alias("text")), "texts")
    text = lambda x: needed.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    return written(near.join(text("a"), "a").join(text("b"), "b").mapInArrow(_verify, "a long, b long"), "links")


def _pairs(df: DataFrame) -> DataFrame:
    """Distinct (a, b), a above b, of (doc_id, leader)."""
    return df.filter("doc_id != leader").select(F.greatest("doc_id", "leader").alias("a"), F.least("doc_id", "leader").alias("b")).distinct()


def _block_links(unit: pa.Table) -> pa.Table:
    """Links between components of one unit, the members of two blocks of a bucket (or of one): every pair is counted on full sets of hashes, and those that join anything are confirmed on words."""
    ids, of = unit.column("doc_id").to_numpy(), unit.column("component").to_numpy()
    low, high = ((unit.column("block").to_numpy() == unit.column(c).to_numpy()).nonzero()[0] for c in ("lo", "hi"))
    texts = texts_of(unit.column("text").combine_chunks())
    sets = [shingles(t) for t in texts]
    n = np.array([len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    row, item = np.repeat(np.arange(len(sets)), n)[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    by = np.argsort(item, kind="stable")
    row, item = row[by], item[by]
    both = np.zeros((len(low), len(high)), dtype=np.float32)
    for first in range(0, int(item[-1]) + 1 if len(item) else 0, 2048):
        a, b = np.searchsorted(item, [first, first + 2048])
        holds = np.zeros((len(sets), 2048), dtype=np.float32)
        holds[row[a:b], item[a:b] - first] = 1
        both += holds[low] @ holds[high].T
    both = both.astype(np.int64)
    linked = (100 * both >= PERCENT * (n[low][:, None] + n[high][None, :] - both)) & (of[low][:, None] != of[high][None, :])
    group, links = list(range(len(ids))), []

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for x, y in zip(*(side[k].tolist() for side, k in zip((low, high), np.nonzero(linked), strict=True)), strict=True):
        i, j = find(x), find(y)
        if i != j and near(_lower_words(texts[x]), _lower_words(texts[y])):
            group[i] = j
            links.append((x, y))
    return pa.table({c: pa.array(ids[[link[k] for link in links]] if links else [], pa.int64()) for k, c in enumerate("ab")})


def _met(large: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components of the same bucket, for buckets of any size.

    A bucket's members are dealt into blocks of bounded size, those of its largest component apart from the rest. Every two blocks meet
    in a unit of their own, but for two of the largest component, so every pair of different components is met, and no unit grows with its bucket.
    """
    ids = large.select("doc_id").distinct()
    needed = written(texts.join(ids.hint("merge"), "doc_id").groupBy("doc_id").agg(F.first("text").alias("text")), "texts")
    in_top, dealt = F.col("component") == F.col("top"), F.xxhash64("doc_id", F.lit("block"))
    block = F.when(in_top, F.col("rests") + F.pmod(dealt, F.col("tops"))).otherwise(F.pmod(dealt, F.col("rests"))).cast("int")
    others = F.sequence(F.lit(0), F.when(in_top, F.col("rests") - 1).otherwise(F.col("rests") + F.col("tops") - 1).cast("int"))
    units = large.select("band", "doc_id", "component", block.alias("block"), F.explode(others).alias("other"))
    units = units.select("band", "doc_id", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = units.join(needed, "doc_id").groupBy("band", "lo", "hi").applyInArrow(_block_links, "a long, b long")
    return written(found.distinct(), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id LONG, text STRING): n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= 75 * |A or B| over their sets of distinct 5-word shingles.
    Equal sets form a class by a 128-bit BLAKE2b digest of the whole set's hashes and stand for themselves by their smallest doc_id. Links between
    classes are confirmed on the words themselves (see `near`). Class members share
    32 bands of four registers; a pair at similarity 0.75 misses every band with probability 5e-6.

    In each band bucket every class is first paired with the most connected one (the class whose buckets hold most others: the
    original among its copies), and verified links give components: a group of thousands of copies costs one pair a copy and bucket.
    Where a bucket still holds several components, every two of its members of different components are compared: as pairs
    in buckets of up to SMALL classes, else block by block on full sets (see `_met`). So no two classes that share a bucket stay uncompared,
    unless links already join them. A large bucket of texts that are not near copies costs work that grows with the square of its size.

    Null or empty texts have no shingles: component_id is their own doc_id. A null doc_id is never linked: its
    component_id is null, kept true. Repeated rows are each returned. Columns other than doc_id and text are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(texts.mapInArrow(_signatures, _SIGNATURE), "sketches")
    keys = ["key_a", "key_b", "n_shingles"]
    sets = written(rows.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("class_id")), "classes")
    classes = written(rows.join(sets, keys).filter("doc_id = class_id").dropDuplicates(["doc_id", "key_a"]).drop("class_id"), "class-sketches")

    bands = classes.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    crowded = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(bands.join(crowded, "band"), "buckets")
    degrees = members.groupBy("doc_id").agg(F.sum(F.col("size") - 1).alias("degree"))
    members = written(members.join(degrees, "doc_id"), "buckets")
    central = F.max(F.struct("degree", (-F.col("doc_id")).alias("rank"), "doc_id"))
    leaders = members.groupBy("band").agg(central.alias("top")).select("band", F.col("top.doc_id").alias("leader"))
    pairs = written(_pairs(members.join(leaders, "band")), "pairs")
    links = _verified(pairs, classes, texts)
    labels = connected_components(links).withColumnRenamed("v", "doc_id")
    of = members.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    parts = of.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    mixed = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "component")).alias("top")).filter("parts > 1")
    cut = lambda n, s: F.ceil(F.greatest(n / F.lit(BLOCK), s / F.lit(BLOCK_SHINGLES))).cast("int")
    mixed = mixed.select("band", F.col("top.component").alias("top"), cut(F.col("top.n"), F.col("top.s")).alias("tops"), cut(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("rests"))
    of = written(of.join(mixed, "band"), "open")
    small = of.filter(F.col("size") <= SMALL)
    cross = small.select("band", "doc_id", "component").join(small.select("band", F.col("doc_id").alias("leader"), F.col("component").alias("other")), "band").filter("component < other")
    fresh = written(_pairs(cross.select("doc_id", "leader")).join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = [] if fresh.isEmpty() else [_verified(fresh, classes, texts)]
    large = of.filter(F.col("size") > SMALL)
    if not large.isEmpty():
        more.append(_met(large, texts))
    for one in more:
        links = links.union(one)
    found = connected_components(links)

    of_class = sets.join(found.withColumnRenamed("v", "class_id"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id")).drop("component", "class_id")
    out = rows.select("doc_id", *keys).join(of_class, keys, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
