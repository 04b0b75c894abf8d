"""Back-references: earlier equal stretches of a sequence, as candidates, as a greedy parse, and expanded again.

A null pixel equals none and starts no match; the parse leaves it out. Positions are meant to be unique in a sequence: of rows that share one, each counts
in the parse, in no fixed order, and none starts or continues a match elsewhere. A gap between positions ends a match. Of equally good matches the nearest wins. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bytes import argb, color_slot
from tessera.operators.batches import by_image, starts_of
from tessera.operators.pixels import KEYS
from tessera.operators.scan import BLOCK, running_sum
from tessera.sources.shared import Rounds

#: Limits of the format: probes, longest copy, distances below.
PROBES, LONGEST, FARTHEST = 8, 4096, (1 << 20) - 120
#: Fixed values of the hash of one colour and of three.
MULTIPLIER, SECOND, THIRD, BUCKET_BITS = 0x1E35A7BD, 0x9E3779B9, 0x85EBCA6B, 14


def near_offsets() -> list[tuple[int, int]]:
    """(dx, dy) of distance codes 1 to 120: the pixels above and to the left within eight columns and seven rows, nearest first (by squared distance; of equal ones the smaller |dx|-row first, left of the pixel before right)."""
    cells = [(x, y) for y in range(8) for x in range(-7, 9) if (y > 0 or x > 0)]
    cells.sort(key=lambda c: (c[0] * c[0] + c[1] * c[1], abs(c[0]), -c[0]))
    return cells[:120]


def with_distance_code(df: DataFrame, dist: str = "dist", width: str = "width", name: str = "code") -> DataFrame:
    """Rows with the code of a distance in a grid of some width: 1 to 120 for a near pixel, else dist + 120; null for a null distance. A near cell (dx, dy) stands for dist = dy * width + dx, at least 1. The 120 cells are a broadcast table."""
    near = df.sparkSession.createDataFrame([(y * 32 + x, k) for k, (x, y) in enumerate(near_offsets(), 1)], "_cell int, _near long")
    y = F.call_function("div", F.col(dist).cast("long"), F.col(width).cast("long"))
    x = F.col(dist) - y * F.col(width)
    # within eight columns left of the pixel in row y above, or less than eight right of it in row y + 1 above
    cell = F.when((x <= 8) & (y < 8), y * 32 + x).when((x > F.col(width) - 8) & (y < 7), (y + 1) * 32 + x - F.col(width)).cast("int")
    j = df.withColumn("_cell", cell).join(F.broadcast(near), "_cell", "left")
    return j.withColumn(name, F.coalesce("_near", (F.col(dist) + 120).cast("long"))).drop("_cell", "_near")


def distance_from_code(code: Column, width: Column) -> Column:
    offsets = near_offsets()
    dx = F.create_map(*(F.lit(v) for k, c in enumerate(offsets, 1) for v in (k, c[0])))
    dy = F.create_map(*(F.lit(v) for k, c in enumerate(offsets, 1) for v in (k, c[1])))
    near = F.greatest(F.try_element_at(dy, code.cast("int")) * width + F.try_element_at(dx, code.cast("int")), F.lit(1))
    return F.when(code > 120, code - 120).otherwise(near).cast("bigint")


def hash_chain(pixels: DataFrame, k: int = PROBES, keys: list[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """(keys, pos, bucket, earlier): for each position the k nearest earlier ones whose next three pixels have the same hash; all positions, not only those a parse would visit. The last two positions start nothing.

    Sequences are cut into blocks of positions. A block gets the two pixels after it as a halo, so each position sees its three pixels; then each block of a bucket begins with the k
    last positions of the blocks before it. So a giant image, and one of a single colour with a single bucket, is sorted in blocks.
    """
    p = pixels.select(*keys, "pos", argb().alias("p0")).filter("pos IS NOT NULL").withColumn("_home", F.floor(F.col("pos") / block))
    halo = F.when(F.col("pos") % block < 2, F.array("_home", F.col("_home") - 1)).otherwise(F.array("_home"))
    w = Window.partitionBy(*keys, "_block").orderBy("pos")
    p = p.withColumn("_block", F.explode(halo))
    p = p.withColumns({f"{name}{i}": F.lead(of, i).over(w) for i in (1, 2) for name, of in (("p", "p0"), ("_pos", "pos"))})
    p = p.filter("_block = _home AND p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL AND _pos1 = pos + 1 AND _pos2 = pos + 2")
    h = [color_slot(F.col(f"p{i}"), BUCKET_BITS).cast("bigint") for i in range(3)]
    bucket = h[0].bitwiseXOR(h[1] * F.lit(SECOND)).bitwiseXOR(h[2] * F.lit(THIRD)).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    p = p.select(*keys, "pos", "_block", bucket.alias("bucket"))
    tails = p.groupBy(*keys, "bucket", "_block").agg(F.slice(F.sort_array(F.collect_list("pos"), asc=False), 1, k).alias("_tail"))
    # every block that is listed has a position, so k blocks before one are enough
    before = F.flatten(F.collect_list("_tail").over(Window.partitionBy(*keys, "bucket").orderBy("_block").rowsBetween(-k, -1)))
    heads = tails.select(*keys, "bucket", "_block", F.sort_array(F.slice(F.sort_array(before, asc=False), 1, k)).alias("_carried")).filter(F.size("_carried") > 0)
    w = Window.partitionBy(*keys, "bucket", "_block").orderBy(F.asc_nulls_first("pos"))
    both = p.unionByName(heads, allowMissingColumns=True)
    own, carried = F.collect_list("pos").over(w.rowsBetween(-k, -1)), F.first("_carried").over(w)
    joined = both.withColumns({"_own": own, "_carried": F.coalesce(carried, F.array().cast("array<bigint>"))}).filter("pos IS NOT NULL")
    room = F.lit(k) - F.size("_own")
    kept = F.when((room > 0) & (F.size("_carried") > 0), F.slice("_carried", -F.least(room, F.size("_carried")), F.least(room, F.size("_carried")))).otherwise(F.array().cast("array<bigint>"))
    return joined.select(*keys, "pos", "bucket", F.concat(kept, "_own").alias("earlier"))


def match_candidates(pixels: DataFrame, k: int = PROBES, farthest: int = FARTHEST, keys: list[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """(keys, pos, from_pos, dist) for the k nearest earlier positions of the same bucket within the distance."""
    c = hash_chain(pixels, k, keys, block).select(*keys, "pos", F.explode("earlier").alias("from_pos"))
    return c.withColumn("dist", F.col("pos") - F.col("from_pos")).filter(F.col("dist") < farthest)


def stretch_names(pixels: DataFrame, longest: int = LONGEST, keys: list[str] = KEYS) -> list[DataFrame]:
    """Tables (keys, pos, name), the k-th over stretches of 2**k pixels from pos on: two stretches of a sequence have one name if and only if they are equal.

    Prefix doubling: a name is the first position of its stretch; a stretch of twice the length is the pair of its halves' names. Every round is an equi-join with the positions 2**k further
    on, and a count by pair, and leaves out stretches that stand once only, so the tables shrink, and end when none is repeated. Stretches over the end, a gap, a null pixel or a repeated position have no name.
    """
    rounds = Rounds(pixels.sparkSession, "names")
    cells = pixels.select(*keys, "pos", argb().alias("a")).filter("pos IS NOT NULL").groupBy(*keys, "pos").agg(F.min("a").alias("a"), F.count("*").alias("n")).filter("n = 1 AND a IS NOT NULL").select(*keys, "pos", "a", F.lit(0).cast("bigint").alias("b"))
    out: list[DataFrame] = []
    while True:
        cells = rounds.keep(cells, "pairs")
        often = cells.groupBy(*keys, "a", "b").agg(F.min("pos").alias("name"), F.count("*").alias("n")).filter("n > 1").drop("n")
        names = rounds.keep(cells.join(often, [*keys, "a", "b"]).select(*keys, "pos", "name"), f"names-{len(out)}")
        if out and names.isEmpty():
            break
        out.append(names)
        if 2 << (len(out) - 1) > longest:
            break
        second = names.select(*keys, (F.col("pos") - (1 << (len(out) - 1))).alias("pos"), F.col("name").alias("b"))
        cells = names.withColumnRenamed("name", "a").join(second, [*keys, "pos"])
    rounds.drop("pairs")
    return out


def match_lengths(candidates: DataFrame, pixels: DataFrame, longest: int = LONGEST, keys: list[str] = KEYS) -> DataFrame:
    """Candidates with len: how many pixels from pos on equal those from from_pos on, up to `longest`.

    Lengths are found from the names of stretches (`stretch_names`), the longest first: where both have one name the length grows by that stretch. Joins by position only, no sequence is put in order; pixels are
    equal by value, not by a hash.
    """
    out = candidates.withColumn("len", F.lit(0))
    for k, names in reversed(list(enumerate(stretch_names(pixels, longest, keys)))):
        at = lambda of, name: names.select(*keys, F.col("pos").alias(of), F.col("name").alias(name))  # noqa: B023, E731
        out = out.withColumns({"_at": F.col("pos") + F.col("len"), "_from": F.col("from_pos") + F.col("len")})
        out = out.join(at("_at", "_ahead"), [*keys, "_at"], "left").join(at("_from", "_behind"), [*keys, "_from"], "left")
        out = out.withColumn("len", F.col("len") + F.when(F.col("_ahead") == F.col("_behind"), 1 << k).otherwise(0)).drop("_at", "_from", "_ahead", "_behind")
    return out.select(*keys, "pos", "from_pos", "dist", F.least("len", F.lit(longest)).alias("len"))


def longest_match(lengths: DataFrame, least: int = 3, keys: list[str] = KEYS) -> DataFrame:
    """The longest candidate of each position, of equal ones the nearest; those of under three pixels are none."""
    best = lengths.filter(F.col("len") >= least).groupBy(*keys, "pos").agg(F.max_by(F.struct("dist", "len"), F.struct("len", -F.col("dist"))).alias("m"))
    return best.select(*keys, "pos", "m.dist", "m.len")


_TOKENS = "image_id long, tok long, pos long, kind string, g int, r int, b int, a int, len int, dist long, slot int"


def triple_bucket(a: int, b: int, c: int) -> int:
    h = [((x * MULTIPLIER) & 0xFFFFFFFF) >> (32 - BUCKET_BITS) for x in (a, b, c)]
    return (h[0] ^ h[1] * SECOND ^ h[2] * THIRD) & ((1 << BUCKET_BITS) - 1)


def equal_run(colors: list[int], a: int, b: int, most: int) -> int:
    """How many colours from a on equal those from b on, up to `most`; whole slices first, halved where they differ."""
    m, step = 0, 16
    while m < most:
        step = min(step, most - m)
        if colors[a + m : a + m + step] == colors[b + m : b + m + step]:
            m, step = m + step, step * 2
        elif step == 1:
            break
        else:
            step //= 2
    return m


def _hash(colors: np.ndarray, bits: int) -> np.ndarray:
    """`color_slot` of an array."""
    return ((colors.astype(np.uint64) * np.uint64(MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)


def copies_of(colors: np.ndarray, edges: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Where the greedy parse of each sequence (colours from one edge to the next) copies: (place in the array, length, distance). Chains hold visited positions only, nearest first.

    A copy begins only where three pixels stand that stood in the sequence before, so only these places are looked at one by one, with those of their buckets, which fill the chains; arrays tell them, by hashes that may name a few too many.
    """
    n = len(colors)
    which = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    last = np.repeat(edges[1:], np.diff(edges))
    starts = np.flatnonzero(np.arange(n) + 2 < last)
    if not len(starts):
        return [], [], []
    c = np.asarray(colors, dtype=np.int64).view(np.uint64)
    p = [c[starts + k] for k in range(3)]
    mixed = which[starts].astype(np.uint64)
    for v in p:
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ v) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(mixed, kind="stable")
    again = np.zeros(len(starts), dtype=bool)
    again[order[1:]] = mixed[order[1:]] == mixed[order[:-1]]
    if not again.any():
        return [], [], []
    h = [_hash(v, BUCKET_BITS) for v in p]
    bucket = (h[0] ^ h[1] * np.uint64(SECOND) ^ h[2] * np.uint64(THIRD)) & np.uint64((1 << BUCKET_BITS) - 1)
    bucket = bucket.astype(np.int64) + (which[starts] << BUCKET_BITS)
    look = np.flatnonzero(np.isin(bucket, bucket[again]))
    colors, chains, free = np.asarray(colors).tolist(), defaultdict(list), 0
    at, lengths, distances = [], [], []
    for i, b, repeated, end in zip(starts[look].tolist(), bucket[look].tolist(), again[look].tolist(), last[starts[look]].tolist(), strict=True):
        if i < free:
            continue
        chain = chains[b]
        if repeated:
            length = dist = 0
            most, three = min(LONGEST, end - i), colors[i : i + 3]
            for j in chain[: -PROBES - 1 : -1]:
                if i - j >= FARTHEST:
                    break
                # a copy longer than the best so far also has the pixel after that
                if colors[j : j + 3] == three and length < most and colors[j + length] == colors[i + length]:
                    m = equal_run(colors, j, i, most)
                    if m > length:
                        length, dist = m, i - j
            if length >= 3:
                at.append(i)
                lengths.append(length)
                distances.append(dist)
                free = i + length
        chain.append(i)
    return at, lengths, distances


def parse(colors: list[int]) -> list[tuple[int, int, int]]:
    """Greedy back-references over a sequence: (position, length, distance), length 0 for a literal."""
    visited, length, dist = _visited(np.array(colors, dtype=np.int64), np.array([0, len(colors)]))
    return list(zip(visited.tolist(), length.tolist(), dist.tolist(), strict=True))


def _visited(colors: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Visited places of sequences one after another, with the length and distance of the copy there, or zeros."""
    at, lengths, distances = (np.array(v, dtype=np.int64) for v in copies_of(colors, edges))
    inside = np.zeros(len(colors) + 1, dtype=np.int64)
    np.add.at(inside, at + 1, 1)
    np.add.at(inside, at + lengths, -1)
    length, dist = np.zeros(len(colors), dtype=np.int64), np.zeros(len(colors), dtype=np.int64)
    length[at], dist[at] = lengths, distances
    visited = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    return visited, length[visited], dist[visited]


def _token_rows(frame: pd.DataFrame) -> pd.DataFrame:
    """Tokens of whole images from pixels in order with argb, slot and hit."""
    edges = starts_of(frame.image_id.to_numpy())
    at, length, dist = _visited(frame["argb"].to_numpy(), edges)
    first = np.searchsorted(at, edges[:-1])
    tok = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    cells, copy = frame.iloc[at], length > 0
    hit = ~copy & cells["hit"].to_numpy()
    only = lambda values, keep: pd.arrays.IntegerArray(np.asarray(values, dtype=np.int64), ~keep)
    out = pd.DataFrame({"image_id": cells.image_id.to_numpy(), "tok": tok, "pos": cells.pos.to_numpy(), "kind": np.where(copy, "copy", np.where(hit, "cache", "literal"))})
    for ch in "grba":
        out[ch] = only(cells[ch].to_numpy(), ~copy & ~hit)
    out["len"], out["dist"], out["slot"] = only(length, copy), only(dist, copy), only(cells["slot"].to_numpy(), hit)
    return out


def backref_parse(hits: DataFrame) -> DataFrame:
    """Tokens of each image from `cache_hits` rows: copies, cache hits and literals. The parse depends on what it chose before, so an image is in one task, many small ones in one batch; `backref_tokens` finds the hits in that task, too.
    Rows with a null id, position or channel take no part."""
    columns = ["image_id", "pos", "r", "g", "b", "a", "argb", "slot", "hit"]
    return by_image(hits.select(columns).dropna(), _token_rows, _TOKENS, ["pos"])


def backref_tokens(pixels: DataFrame, bits: int | None = 4) -> DataFrame:
    """`backref_parse` of the `cache_hits` of pixels (image_id, pos, r, g, b, a), or without any hits, in one shuffle: the task that parses an image has all its pixels, and what each slot held before."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r, g, b, a = (frame[ch].to_numpy(np.int64) for ch in "rgba")
        argb = (a << 24) | (r << 16) | (g << 8) | b
        if bits is None:
            return _token_rows(frame.assign(argb=argb, slot=0, hit=False))
        slot = _hash(argb, bits).astype(np.int64)
        edges = starts_of(frame.image_id.to_numpy())
        group = (np.repeat(np.arange(len(edges) - 1), np.diff(edges)) << bits) + slot
        order = np.argsort(group, kind="stable")
        before = np.zeros(len(frame), dtype=np.int64)
        before[order[1:]] = np.where(group[order[1:]] == group[order[:-1]], argb[order[:-1]], 0)
        return _token_rows(frame.assign(argb=argb, slot=slot, hit=(before == argb) & (frame.pos.to_numpy() > 0)))

    return by_image(pixels.select("image_id", "pos", *"rgba").dropna(), run, _TOKENS, ["pos"])


def _dealt(table: DataFrame) -> DataFrame:
    """A table for a join that deals out both sides: kept tables are far smaller as files than as rows, so Spark would send them whole through the driver in every round."""
    return table.hint("merge")


def _resolved(links: DataFrame, rounds: Rounds, name: str, most_rounds: int = 60) -> DataFrame:
    """(image_id, pos, to) with every `to` followed to the last: links that point at the pos of another link jump on to where that one points, so each round doubles the steps."""
    links = rounds.keep(links, name)
    for _ in range(most_rounds):
        ahead = links.select("image_id", F.col("pos").alias("to"), F.col("to").alias("_next"))
        step = links.join(_dealt(ahead), ["image_id", "to"], "left").select("image_id", "pos", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved"))
        step = rounds.keep(step, name)
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            return links
    raise RuntimeError(f"copies did not end in {most_rounds} rounds")


def backref_expand(tokens: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(image_id, pos, argb, error) from tokens (image_id, tok, kind, a, r, g, b, len, dist, slot). An error row ends its image: `bad_distance` for a copy from before the start, `bad_token` for a
    token that lacks what its kind needs or has it negative, or a slot of more than `bits` bits. Tokens without image or number are left out; rows that share a number are in no fixed order.

    Nothing here walks an image. Where each token starts is a running sum by blocks. Every pixel of a copy points at its source (for a copy that overlaps what it makes, into the stretch before it), and pointers
    jump until they meet a literal or a cache hit: rounds grow with the logarithm of how deep copies of copies go. With that every pixel's slot is known, so a hit takes the last colour set in its slot before it; where that was a
    copy of another hit, it points there, and pointers jump once more. An image larger than a task is many joined rows.
    """
    spark = tokens.sparkSession
    rounds = Rounds(spark, "expand")
    lacks = lambda *names: F.coalesce(F.greatest(*((F.coalesce(F.col(n), F.lit(-1)) < 0) for n in names)) if len(names) > 1 else F.coalesce(F.col(names[0]), F.lit(-1)) < 0, F.lit(True))
    kind = F.col("kind")
    bad = F.when(kind == "copy", lacks("len", "dist")).when(kind == "cache", lacks("slot") | (F.col("slot") >= (1 << bits))).when(kind == "literal", lacks("a", "r", "g", "b")).otherwise(True)
    t = tokens.dropna(subset=["image_id", "tok"]).select("image_id", "tok", "kind", *"argb", "len", "dist", "slot", bad.alias("bad"))
    t = rounds.keep(t, "given")
    size = F.when(F.col("bad"), 0).when(kind == "copy", F.col("len")).otherwise(1)
    t = rounds.keep(running_sum(t, ["image_id"], "tok", size, "start", block), "tokens")
    far = (kind == "copy") & ((F.col("dist") < 1) | (F.col("dist") > F.col("start")))
    error = F.when(F.col("bad"), "bad_token").when(far, "bad_distance")
    ends = t.withColumn("error", error).filter("error IS NOT NULL").groupBy("image_id").agg(F.min(F.struct("tok", "start", "error")).alias("e"))
    ends = rounds.keep(ends.select("image_id", F.col("e.tok").alias("_end"), F.col("e.start").alias("pos"), "e.error"), "ends")
    sound = t.join(_dealt(ends.select("image_id", "_end")), "image_id", "left").filter("_end IS NULL OR tok < _end")

    roots = sound.filter("kind != 'copy'").select("image_id", F.col("start").alias("pos"), F.when(kind == "literal", argb()).alias("argb"), F.when(kind == "cache", F.col("slot")).alias("slot"))
    roots = rounds.keep(roots.withColumn("slot", F.coalesce("slot", color_slot(F.col("argb"), bits))), "read")
    # slots begin at 0: before the first literal of its slot a hit is a 0, which belongs to slot 0
    first = roots.filter("argb IS NOT NULL").groupBy("image_id", "slot").agg(F.min("pos").alias("_first"))
    unset = F.col("argb").isNull() & (F.col("slot") != 0) & F.coalesce(F.col("pos") < F.col("_first"), F.lit(True))
    roots = roots.join(_dealt(first), ["image_id", "slot"], "left").withColumn("_unset", unset)
    roots = rounds.keep(roots.select("image_id", "pos", F.when(F.col("_unset"), 0).otherwise(F.col("argb")).alias("argb"), F.when(F.col("_unset"), 0).otherwise(F.col("slot")).alias("slot")), "roots")
    each = sound.filter("kind = 'copy' AND len > 0").select("image_id", "start", "dist", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i"))
    links = each.select("image_id", (F.col("start") + F.col("i")).alias("pos"), (F.col("start") - F.col("dist") + F.col("i") % F.col("dist")).alias("to"))
    links = _resolved(links, rounds, "copies")
    copies = rounds.keep(links.join(_dealt(roots.withColumnRenamed("pos", "to")), ["image_id", "to"]), "pixels")

    # of each hit the last pixel of its slot that is none: its colour, or the hit that it is a copy of
    setters = roots.select("image_id", "pos", "slot", "argb", F.lit(None).cast("bigint").alias("to")).unionByName(copies.select("image_id", "pos", "slot", "argb", F.when(F.col("argb").isNull(), F.col("to")).alias("to")))
    set_ = F.when(F.col("argb").isNotNull() | F.col("to").isNotNull(), F.struct("argb", "to"))
    last = F.last(set_, ignorenulls=True).over(Window.partitionBy("image_id", "slot").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    hits = setters.withColumn("_last", last).filter("argb IS NULL AND to IS NULL").select("image_id", "pos", F.when(F.col("_last.to").isNull(), F.coalesce("_last.argb", F.lit(0))).alias("argb"), F.col("_last.to").alias("to"))
    hits = rounds.keep(hits, "hits")
    open_ = hits.filter("to IS NOT NULL").select("image_id", "pos", "to")
    known = hits.filter("to IS NULL").select("image_id", "pos", "argb")
    if not open_.isEmpty():
        open_ = _resolved(open_, rounds, "open")
        known = rounds.keep(known.unionByName(open_.join(_dealt(known.withColumnRenamed("pos", "to")), ["image_id", "to"]).select("image_id", "pos", "argb")), "known")

    of_hits = copies.filter("argb IS NULL").select("image_id", "pos", "to").join(_dealt(known.withColumnRenamed("pos", "to")), ["image_id", "to"]).select("image_id", "pos", "argb")
    pixels = roots.filter("argb IS NOT NULL").select("image_id", "pos", "argb").unionByName(copies.filter("argb IS NOT NULL").select("image_id", "pos", "argb")).unionByName(known).unionByName(of_hits)
    return pixels.withColumn("error", F.lit(None).cast("string")).unionByName(ends.select("image_id", "pos", F.lit(0).cast("bigint").alias("argb"), "error"))
