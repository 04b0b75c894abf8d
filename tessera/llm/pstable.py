"""Approximate nearest neighbours by p-stable hashing with perturbed probes, then exact distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

NEAREST = 10
#: The share of the k nearest that an index is set up to find, measured on so many queries; rows that stand for all the others there.
RECALL, SAMPLE, OTHERS = 0.95, 64, 128
#: What is tried: projections of a table, bucket widths in distances to the k-th nearest, tables, probes of each.
PROJECTIONS, WIDTHS, TABLES, PROBES = (1, 2, 4, 8, 12, 16, 20, 24), (2.4, 3.2), (1, 2, 4, 8, 16, 32, 64, 96, 128), (1, 4, 16, 64, 128)
#: Settings are chosen for few rows met; a bucket that is looked up counts as so many.
LOOKUP = 1 / 64
#: Distinct vectors of an index shard (and their components together), queries of a block: what one task holds. Queries whose probes stand side by side.
SHARD, SHARD_VALUES, BLOCK, TOGETHER = 40_000, 1 << 23, 8_000, 64


@lru_cache(maxsize=64)
def perturbations(probes: int, projections: int) -> list[list[int]]:
    """Sets of perturbations in order of estimated success, as ranks into a query's 2 * projections boundary distances, ascending.

    The squared distance from a projection to the j-th nearest boundary is expected at j (j + 1) up to the middle and
    symmetric beyond, whatever the query; sets are built from the smallest by shifting or adding a last element. The two
    boundaries of one projection have ranks j and 2m - 1 - j, and no set holds both.
    """
    m = projections
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    cost = np.append(low, 1 - (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) / (m + 1) + low[::-1])
    out: list[list[int]] = [[]]
    heap = [(cost[0], [0])]
    while heap and len(out) < probes:
        c, s = heapq.heappop(heap)
        if all(2 * m - 1 - x not in s for x in s):
            out.append(s)
        if s[-1] + 1 < 2 * m:
            nxt = s[-1] + 1
            heapq.heappush(heap, (c - cost[s[-1]] + cost[nxt], [*s[:-1], nxt]))
            heapq.heappush(heap, (c + cost[nxt], [*s, nxt]))
    return out


class Hashes:
    """p-stable functions: in each table a vector's bucket is floor((a.v + b) / w) of several projections, named by a linear hash of these numbers.

    Two buckets of one name bring vectors together that need not be near; exact distances sort them out. A table is the same whatever number of them is used.
    """

    def __init__(self, center: np.ndarray, width: float, projections: int, tables: int, probes: int, seed: int = 3):
        self.center, self.width, self.projections, self.tables = center, width, projections, tables
        drawn = [np.random.default_rng([seed, projections, t]) for t in range(tables)]
        self.axes = [rng.standard_normal((len(center), projections)) for rng in drawn]
        self.shift = [rng.uniform(0, 1, projections) for rng in drawn]
        self.weight = np.random.default_rng(seed).integers(0, 1 << 63, projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.step = np.concatenate([np.uint64(0) - self.weight, self.weight, np.zeros(1, dtype=np.uint64)])  # to the cell beyond each boundary
        sets = perturbations(probes, projections)
        self.sets = np.full((len(sets), max(map(len, sets)) or 1), 2 * projections)
        for i, ranks in enumerate(sets):
            self.sets[i, : len(ranks)] = ranks

    def _cells(self, vectors: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and where in its cell each vector is."""
        place = np.clip(np.nan_to_num((vectors - self.center) @ self.axes[t] / self.width + self.shift[t]), -(2.0**62), 2.0**62)
        cells = np.floor(place)
        return cells.astype(np.int64).view(np.uint64), place - cells

    def keys(self, vectors: np.ndarray, t: int) -> np.ndarray:
        return (self._cells(vectors, t)[0] * self.weight).sum(axis=1, dtype=np.uint64)

    def probes(self, queries: np.ndarray, t: int) -> np.ndarray:
        """Buckets to visit, a row of them for each query, in the order of estimated success."""
        cells, below = self._cells(queries, t)
        boundaries = np.argsort(np.concatenate([below, 1 - below], axis=1), axis=1, kind="stable")  # nearest first
        boundaries = np.concatenate([boundaries, np.full((len(queries), 1), 2 * self.projections)], axis=1)
        moves = self.step[boundaries][:, self.sets].sum(axis=2, dtype=np.uint64)
        return (cells * self.weight).sum(axis=1, dtype=np.uint64)[:, None] + moves


def _nearest_of(sample: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k nearest of each sampled query, equal vectors left out, and their distances (infinite where there are fewer)."""
    size = (vectors**2).sum(axis=1)
    places, far = [], []
    for q in sample:
        square = size - 2 * (vectors @ q) + q @ q
        square[square <= 1e-10 * (q @ q)] = np.inf
        own = np.argpartition(square, min(k, len(square)) - 1)[:k]
        own = own[np.argsort(square[own], kind="stable")]
        places.append(own), far.append(np.sqrt(square[own]))
    return np.array(places), np.array(far)


def fitted(vectors: np.ndarray, queries: np.ndarray, k: int = NEAREST) -> Hashes | None:
    """The cheapest of the settings tried that finds RECALL of the k nearest, or None where none does.

    Measured on SAMPLE of the queries (filled up with vectors), against their true nearest among all vectors; what else a query
    meets is measured on OTHERS of the vectors. Costs are rows met, a row as often as tables hold it, and LOOKUP for each bucket.
    """
    spread = lambda rows, most: rows[np.unique(np.linspace(0, len(rows) - 1, min(most, len(rows))).astype(int))]
    sample = spread(queries, SAMPLE)
    if len(sample) < SAMPLE:
        sample = np.concatenate([sample, spread(vectors, SAMPLE - len(sample))])
    others = spread(vectors, OTHERS)
    places, far = _nearest_of(sample, vectors, k)
    sound = np.isfinite(far)
    if not sound.any():
        return None
    radius = float(np.median([row[ok][-1] for row, ok in zip(far, sound, strict=True) if ok.any()]))
    close, center = vectors[places.ravel()], vectors.mean(axis=0)
    best, least = None, np.inf
    for m in PROJECTIONS:
        hashes = Hashes(center, radius, m, TABLES[-1], PROBES[-1])
        tried = len(hashes.sets)
        for width in WIDTHS:
            hashes.width = width * radius
            first = np.full(places.shape, tried)  # of each near vector: the first probe of any table so far that meets it
            met = np.zeros(tried)  # of each probe: rows met in all tables so far
            for t in range(TABLES[-1]):
                probes = hashes.probes(sample, t)
                same = probes[:, :, None] == hashes.keys(close, t).reshape(len(sample), 1, -1)
                first = np.minimum(first, np.where(same.any(axis=1), same.argmax(axis=1), tried))
                by = np.sort(hashes.keys(others, t))
                met += (np.searchsorted(by, probes, side="right") - np.searchsorted(by, probes)).mean(axis=0) / len(others)
                if t + 1 not in TABLES:
                    continue
                for some in PROBES:
                    cost = met[:some].sum() * len(vectors) + LOOKUP * (t + 1) * min(some, tried)
                    if cost < least and (first[sound] < some).mean() >= RECALL:
                        best, least = (width * radius, m, t + 1, some), cost
                if LOOKUP * (t + 1) + met[0] * len(vectors) > least:
                    break  # more tables only cost more
    return None if best is None else Hashes(center, *best)


class Tables:
    """An index of some vectors, by hashes set up for them and their queries (see `fitted`)."""

    def __init__(self, vectors: np.ndarray, queries: np.ndarray, k: int = NEAREST):
        self.k, self.n, self.hashes, self.met = k, len(vectors), fitted(vectors, queries, k), 0
        self.keys, self.bounds, self.rows = [], [], []
        for t in range(self.hashes.tables if self.hashes else 0):
            key = self.hashes.keys(vectors, t)
            by = np.argsort(key, kind="stable").astype(np.int32)
            names, first = np.unique(key[by], return_index=True)
            self.keys.append(names), self.bounds.append(np.append(first, len(by))), self.rows.append(by)

    def candidates(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """Of each query: the places of all vectors in the buckets it probes, merged over the tables. A query that meets no more than k is measured against all."""
        everything = np.arange(self.n)
        for at in range(0, len(queries), TOGETHER):
            some = queries[at : at + TOGETHER]
            found: list[list[np.ndarray]] = [[] for _ in some]
            for t, names in enumerate(self.keys):
                probes = self.hashes.probes(some, t)
                place = np.minimum(np.searchsorted(names, probes), len(names) - 1)
                which, probe = np.nonzero(names[place] == probes)
                buckets = place[which, probe]
                first = self.bounds[t][buckets]
                size = self.bounds[t][buckets + 1] - first
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                rows = self.rows[t][np.repeat(first, size) + within]
                self.met += len(rows)
                ends = np.cumsum(np.bincount(which, weights=size, minlength=len(some))).astype(int)
                for q, part in enumerate(np.split(rows, ends[:-1])):
                    found[q].append(part)
            for own in found:
                near = np.unique(np.concatenate(own)) if own else everything
                yield near if len(near) > self.k else everything


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64) if len(flat) else np.zeros((0, 1))


def _search(index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The nearest found of every query in one shard: distances to all candidates, in double precision on the vectors themselves."""
    names = ["query_id", "vec_class", "score"]
    if not index.num_rows or not queries.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    index, queries = index.sort_by("vec_class"), queries.sort_by("query_id")  # so that a task that runs again finds the same
    base, asked = _matrix(index.column("vector")), _matrix(queries.column("vector"))
    ids, out = index.column("vec_class").to_numpy(), []
    for q, vector, near in zip(queries.column("query_id").to_pylist(), asked, Tables(base, asked, k).candidates(asked), strict=True):
        far = np.sqrt(((base[near] - vector) ** 2).sum(axis=1))
        own = np.lexsort((ids[near], far))[: k + 1]
        out += [(q, int(ids[near[i]]), float(far[i])) for i in own]
    return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=names)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = NEAREST, shard: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query (vec_id LONG, embedding ARRAY) among vectors, by Euclidean distance in double precision, ties to the smaller vec_id; a query's own row is left out.

    Null or zero vectors, those with null or non-finite components, and those not of the most frequent length take no part; nor do null ids. Fewer candidates
    give fewer rows. Repeated (id, vector) rows count once. Other columns are ignored.

    Equal vectors are indexed once, for their k + 1 smallest ids; these are found by salted groups, so a vector that a
    third of all rows hold is no hot spot. Distinct vectors are dealt into shards by a hash, queries into blocks, and every block
    meets every shard in a task of its own. There projections, width, tables and probes are chosen from the data for RECALL of the nearest (see `fitted`), at any
    dimension and contrast; the tables are built and probed, and all they find is measured: memory is bounded by `shard` (SHARD vectors, of SHARD_VALUES components at most)
    and `block`, and only the nearest of a shard leave it. Every row is indexed, and no bucket is capped. Where no setting reaches RECALL, or a query meets no more than k, all rows of the shard are measured.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()).distinct()

    rows = usable(vectors)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 1
    rows = rows.filter(F.size("vector") == d).withColumn("key", F.xxhash64("vector"))
    smallest = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    salted = smallest(rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))), "key", "vector", "salt")
    members = written(smallest(salted.drop("salt"), "key", "vector").withColumn("vec_class", F.min("vec_id").over(Window.partitionBy("key", "vector"))), "members")
    classes = members.filter("vec_id = vec_class").select("vec_class", "vector", "key")
    asked = usable(queries).filter(F.size("vector") == d).select(F.col("vec_id").alias("query_id"), "vector")

    shard = shard or max(1, min(SHARD, SHARD_VALUES // max(1, d)))
    shards = max(1, -(-classes.count() // shard))
    blocks = max(1, -(-asked.count() // block))
    left = classes.select("vec_class", "vector", F.pmod("key", F.lit(shards)).cast("long").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("query_id", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(lambda index, asked: _search(index, asked, k), "query_id long, vec_class long, score double")
    # the k + 1 nearest classes hold the k nearest rows, the query's own put aside
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_class"))).filter(F.col("r") <= k + 1)
    each = best.join(members.select("vec_class", "vec_id"), "vec_class").filter("vec_id != query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
