"""Jobs over pixel tables (keys..., pos, x, y, r, g, b, a): channel decorrelation, windows, tiles, prediction, scores.

Every function takes `keys`, the columns that tell one sequence or grid from another. Rows with null keys form a grid of their own;
null channel values give null results; an empty table gives an empty table; other columns pass through where rows do, also those named
like a column that a job needs on its way (mode, tx, ty, l, t, tl, tr, g2r, ...). Columns that a job returns replace others of that name.
A repeated pixel is one more pixel to counts and to jobs on single rows. Jobs that walk a grid in order (`sequential_modes`,
`inverse_predict`) leave out rows with a null coordinate or channel, take the first of repeated pixels by position and channels, and allow gaps,
such as a last row that ends early: a missing pixel is nobody's, and a neighbour of zeros to others (`with_neighbors` says which pixels are neighbours).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bytes import argb, avg2, clamp8, color_slot, div0, signed8, tile_key, wrap8
from tessera.operators.batches import Grid, by_image, merged_counts, starts_of

KEYS = ["image_id"]
CHANNELS = ["r", "g", "b", "a"]


def _aside(df: DataFrame, names: list[str], back: bool = False) -> DataFrame:
    """The caller's columns of these names under other names, or back under their own."""
    own = {n: f"_own_{n}" for n in names}
    own = {v: k for k, v in own.items()} if back else own
    return df.withColumnsRenamed({k: v for k, v in own.items() if k in df.columns})


def subtract_green(pixels: DataFrame) -> DataFrame:
    """Red and blue less green, modulo 256."""
    return pixels.withColumns({"r": wrap8(F.col("r") - F.col("g")), "b": wrap8(F.col("b") - F.col("g"))})


def add_green(pixels: DataFrame) -> DataFrame:
    """Red and blue plus green, modulo 256: `subtract_green` undone."""
    return pixels.withColumns({"r": wrap8(F.col("r") + F.col("g")), "b": wrap8(F.col("b") + F.col("g"))})


def _delta(coefficient: Column, channel: Column) -> Column:
    """Product of two signed bytes, shifted down by five with sign."""
    return F.shiftright((signed8(coefficient) * signed8(channel)).cast("bigint"), 5)


#: Columns of `cross_color` that live within the job only.
COEFFICIENTS = ["g2r", "g2b", "r2b", "tx", "ty"]


def _with_coeffs(pixels: DataFrame, coeffs: DataFrame | None, bits: int, keys: list[str]) -> DataFrame:
    pixels = _aside(pixels, [c for c in COEFFICIENTS if c not in keys])
    if coeffs is None:
        return pixels.withColumns({"g2r": F.lit(3), "g2b": F.lit(2), "r2b": F.lit(1)})
    return with_tile(pixels, coeffs, bits, keys)


def cross_color(pixels: DataFrame, coeffs: DataFrame | None = None, bits: int = 4, keys: list[str] = KEYS) -> DataFrame:
    """Red less what green foretells, blue less what green and the original red do; coeffs (keys, tx, ty, g2r, g2b, r2b), or 3, 2, 1 throughout. A pixel without coefficients for its tile is left out."""
    p = _with_coeffs(pixels, coeffs, bits, keys)
    red = wrap8(F.col("r") - _delta(F.col("g2r"), F.col("g")))
    blue = wrap8(F.col("b") - _delta(F.col("g2b"), F.col("g")) - _delta(F.col("r2b"), F.col("r")))
    return _aside(p.withColumns({"r": red, "b": blue}).drop(*COEFFICIENTS), COEFFICIENTS, back=True)


def inverse_cross_color(pixels: DataFrame, coeffs: DataFrame | None = None, bits: int = 4, keys: list[str] = KEYS) -> DataFrame:
    """Red first, then blue from the restored red."""
    p = _with_coeffs(pixels, coeffs, bits, keys).withColumn("r", wrap8(F.col("r") + _delta(F.col("g2r"), F.col("g"))))
    p = p.withColumn("b", wrap8(F.col("b") + _delta(F.col("g2b"), F.col("g")) + _delta(F.col("r2b"), F.col("r")))).drop(*COEFFICIENTS)
    return _aside(p, COEFFICIENTS, back=True)


def unpremultiply(pixels: DataFrame) -> DataFrame:
    """Colours as if alpha were full: min(255, 255 c / a), all zero where alpha is."""
    whole = lambda ch: F.when(F.col("a") == 0, 0).otherwise(F.least(F.lit(255), div0(F.col(ch) * 255, F.greatest(F.col("a"), F.lit(1))))).cast("int")
    return pixels.withColumns({ch: whole(ch) for ch in "rgb"})


def alpha_from_green(pixels: DataFrame) -> DataFrame:
    """Green as alpha; the colours go."""
    return pixels.withColumn("a", F.col("g")).drop("r", "g", "b")


def has_alpha(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, has_alpha): whether any pixel is not opaque; null where no alpha is known."""
    return pixels.groupBy(*keys).agg(F.bool_or(F.col("a") != 255).alias("has_alpha"))


def valid_dims(images: DataFrame) -> DataFrame:
    """Images with a column error: sides must be 1 to 16384."""
    ok = lambda side: F.col(side).between(1, 16384)
    return images.withColumn("error", F.when(~F.coalesce(ok("width") & ok("height"), F.lit(False)), "bad_size"))


def with_neighbors(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Left, top, top-left and top-right pixel of each, as structs l, t, tl, tr; null where there is none.

    Past the last pixel of the row above, top-right is the first pixel of the pixel's own row, which is what follows in row-major order. Windows are by
    row and by column, so a giant image is still many groups. Only pixels at a distance of one count: beyond a gap there is no neighbour. Top-left and top-right are reached
    through the pixel above: where that is missing, so are they. Repeated pixels are neighbours of none.
    """
    pixel = F.struct(*CHANNELS)
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    p = pixels.withColumns({
        "_p": pixel, "l": F.when(F.lag("x").over(row) == F.col("x") - 1, F.lag(pixel).over(row)), "_after": F.lead("x").over(row),
        "_next": F.lead(pixel).over(row), "_head": F.when(F.first("x").over(row) == 0, F.first(pixel).over(row)),
    })
    # what the pixel above has to its right: the next pixel, or nothing over a gap, or the end of its row
    p = p.withColumns({"_r": F.when(F.col("_after") == F.col("x") + 1, F.col("_next")), "_ends": F.col("_after").isNull()})
    above = F.lag("y").over(column) == F.col("y") - 1
    p = p.withColumns({"t": F.when(above, F.lag("_p").over(column)), "tl": F.when(above, F.lag("l").over(column)), "_tr": F.when(above, F.lag("_r").over(column)), "_last": F.when(above, F.lag("_ends").over(column))})
    return p.withColumn("tr", F.coalesce("_tr", F.when(F.col("_last"), F.col("_head")))).drop("_p", "_r", "_head", "_tr", "_after", "_next", "_ends", "_last")


def _select(l: Column, t: Column, tl: Column, left_far: Column, top_far: Column) -> Column:
    """Left if it is strictly nearer than top to left + top - top-left."""
    return F.when(left_far < top_far, l).otherwise(t)


def predictors() -> dict[int, Callable[[dict[str, Column], Column], Column]]:
    """The 14 predictors of a channel from its neighbours n['l'], n['t'], n['tl'], n['tr']; the second argument picks left for mode 11. Users may replace or add modes."""
    return {
        0: lambda n, _: n["zero"],
        1: lambda n, _: n["l"],
        2: lambda n, _: n["t"],
        3: lambda n, _: n["tr"],
        4: lambda n, _: n["tl"],
        5: lambda n, _: avg2(avg2(n["l"], n["tr"]), n["t"]),
        6: lambda n, _: avg2(n["l"], n["tl"]),
        7: lambda n, _: avg2(n["l"], n["t"]),
        8: lambda n, _: avg2(n["tl"], n["t"]),
        9: lambda n, _: avg2(n["t"], n["tr"]),
        10: lambda n, _: avg2(avg2(n["l"], n["tl"]), avg2(n["t"], n["tr"])),
        11: lambda n, left: F.when(left, n["l"]).otherwise(n["t"]),
        12: lambda n, _: clamp8(n["l"] + n["t"] - n["tl"]),
        13: lambda n, _: clamp8(avg2(n["l"], n["t"]) + div0(avg2(n["l"], n["t"]) - n["tl"], 2)),
    }


def predicted(mode: Column, neighbors: DataFrame | None = None, table: dict | None = None) -> dict[str, Column]:
    """Predicted channels of rows with x, y and l, t, tl, tr: the borders have their own rule (opaque black, then left in the first row, top in the first column), elsewhere the mode's. A neighbour that is not there counts as zeros."""
    table = table or predictors()
    cell = lambda k, ch: F.when(F.col(k).isNull(), 0).otherwise(F.col(f"{k}.{ch}"))
    far = lambda near: sum((F.abs(cell(near, ch) - cell("tl", ch)) for ch in CHANNELS), F.lit(0))
    left_nearer = far("t") < far("l")  # the distance of left + top - top-left to left is that of top to top-left
    out = {}
    for ch in CHANNELS:
        n = {k: cell(k, ch) for k in ("l", "t", "tl", "tr")} | {"zero": F.lit(255 if ch == "a" else 0)}
        inner = None
        for m, f in table.items():
            inner = F.when(mode == m, f(n, left_nearer)) if inner is None else inner.when(mode == m, f(n, left_nearer))
        out[ch] = F.when((F.col("x") == 0) & (F.col("y") == 0), n["zero"]).when(F.col("x") == 0, n["t"]).when(F.col("y") == 0, n["l"]).otherwise(inner).cast("int")
    return out


def residual(pixels: DataFrame, tiles: DataFrame | None = None, bits: int = 4, mode: int = 11, keys: list[str] = KEYS) -> DataFrame:
    """Pixels less their predictions, modulo 256; the mode comes from tiles (keys, tx, ty, mode), or is one for all."""
    within = ["l", "t", "tl", "tr", "mode", "tx", "ty"]
    p = with_neighbors(_aside(pixels, within), keys)
    p = with_tile(p, tiles, bits, keys) if tiles is not None else p.withColumn("mode", F.lit(mode))
    guess = predicted(F.col("mode"))
    p = p.withColumns({f"_{ch}": wrap8(F.col(ch) - guess[ch]) for ch in CHANNELS}).drop(*CHANNELS, *within).withColumnsRenamed({f"_{ch}": ch for ch in CHANNELS})
    return _aside(p, within, back=True)


def with_tile(pixels: DataFrame, tiles: DataFrame, bits: int = 4, keys: list[str] = KEYS) -> DataFrame:
    """Each pixel with the columns of its tile of 2**bits by 2**bits pixels."""
    return pixels.withColumns({"tx": tile_key("x", bits), "ty": tile_key("y", bits)}).join(tiles, [*keys, "tx", "ty"])


def gini_impurity(hist: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """1 - sum n**2 / (sum n)**2 of each histogram (by..., symbol, n)."""
    n = F.col("n").cast("double")
    return hist.groupBy(*by).agg(F.round(1 - F.sum(n * n) / (F.sum(n) * F.sum(n)), digits).alias("impurity"))


def _mode_counts(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of residuals by tile, mode and channel of pixels with their neighbours, batch by batch: all modes of a batch are one array."""
    own = [*keys, "tx", "ty"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.select(own).to_pandas().groupby(own, dropna=False, sort=False).ngroup().to_numpy()
            cells = [np.stack([batch.column(f"{k}_{ch}").fill_null(-1).to_numpy() for ch in CHANNELS], axis=1).astype(np.int64) for k in ("p", "l", "t", "tl", "tr")]
            known = (cells[0] >= 0).all(axis=1)
            pixel, left, top, corner, right = (np.maximum(c[known], 0) for c in cells)
            x, y, tile = (v[known] for v in (batch.column("x").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False), tile))
            rest = np.stack([(pixel - g) & 255 for g in _with_borders(x, y, left, top, _guesses(left, top, corner, right))])
            n_modes = len(rest)
            code = (((tile[None, :, None] * n_modes + np.arange(n_modes)[:, None, None]) * 4 + np.arange(4)) << 8) + rest
            code, n = np.unique(code, return_counts=True)
            first = np.unique(tile, return_index=True)[1] if len(tile) else np.empty(0, np.int64)
            row_of = np.zeros(int(tile.max()) + 1 if len(tile) else 0, dtype=np.int64)
            row_of[tile[first]] = np.flatnonzero(known)[first]
            at = pa.array(row_of[(code >> 8) // 4 // n_modes])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in own), pa.array(((code >> 8) // 4 % n_modes).astype(np.int32)), pa.array(((code >> 8) % 4).astype(np.int32)), pa.array((code & 255).astype(np.int32)), pa.array(n.astype(np.int64))], names=[*own, "mode", "ch", "symbol", "n"])

    return run


def tile_mode_scores(pixels: DataFrame, bits: int = 4, keys: list[str] = KEYS) -> DataFrame:
    """(keys, tx, ty, mode, score): summed impurity of the four channels' residuals for each tile and mode.

    56 values a pixel, counted in the task that makes them; the counts are packed and shuffled once, by tile, and only their sums leave the task that merges them. A pixel with a null channel or place takes no part.
    """
    p = with_neighbors(pixels, keys).filter("x IS NOT NULL AND y IS NOT NULL")
    flat = {f"{k}_{ch}": F.col(f"{k}.{ch}") for k in ("l", "t", "tl", "tr") for ch in CHANNELS} | {f"p_{ch}": F.col(ch) for ch in CHANNELS}
    p = p.select(*keys, "x", "y", tile_key("x", bits).alias("tx"), tile_key("y", bits).alias("ty"), *(v.cast("int").alias(k) for k, v in flat.items()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema if f.name in (*keys, "tx", "ty"))
    counts = p.mapInArrow(_mode_counts(keys), f"{kinds}, mode int, ch int, symbol int, n long")
    each = merged_counts(counts, [*keys, "tx", "ty", "mode", "ch"], [*keys, "tx", "ty"])
    # the four channels of a tile and mode are rows of one task, which adds them up before the shuffle
    total = F.col("total").cast("double")
    impurity = F.round(1 - F.col("squares") / (total * total), 12)
    return each.groupBy(*keys, "tx", "ty", "mode").agg(F.round(F.sum(impurity), 9).alias("score"))


def best_tile_mode(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The mode of least score of each tile by itself, ties to the lowest mode. `sequential_modes` is the other rule."""
    return scores.groupBy(*keys, "tx", "ty").agg(F.min_by("mode", F.struct("score", "mode")).alias("mode"))


def _whole(pixels: DataFrame) -> DataFrame:
    """Pixels with all that a walk over their grid needs."""
    return pixels.dropna(subset=["image_id", "x", "y", *CHANNELS]).filter("x >= 0 AND y >= 0")


def _places(frame: pd.DataFrame) -> pd.DataFrame:
    """Sorted pixels of whole images, each place once: of repeated ones the first by position and channels."""
    return frame.drop_duplicates(["image_id", "y", "x"], ignore_index=True)


#: The order in which walks over grids take an image's pixels.
_WALK = ["y", "x", "pos", *CHANNELS]


def _guesses(left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """Predictions of all modes from neighbour arrays (..., 4)."""
    mean = lambda a, b: (a + b) >> 1
    clip = lambda v: np.clip(v, 0, 255)
    take_left = (np.abs(top - corner).sum(-1) < np.abs(left - corner).sum(-1))[..., None]
    m = mean(left, top)
    half = np.trunc((m - corner) / 2).astype(np.int64)
    black = np.broadcast_to(np.array([0, 0, 0, 255]), left.shape)
    return [black, left, top, right, corner, mean(mean(left, right), top), mean(left, corner), m, mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right)), np.where(take_left, left, top), clip(left + top - corner), clip(m + half)]


def _with_borders(x: np.ndarray, y: np.ndarray, left: np.ndarray, top: np.ndarray, guesses: list[np.ndarray]) -> list[np.ndarray]:
    """Guesses where there are both neighbours, else those of the border: opaque black, then left in the first row, top in the first column."""
    border = np.where((y == 0)[:, None], left, top)
    border[(x == 0) & (y == 0)] = (0, 0, 0, 255)
    on_border = ((x == 0) | (y == 0))[:, None]
    return [np.where(on_border, border, g) for g in guesses]


def _around(p: np.ndarray, grid: Grid, at: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
    """The guesses of all modes for pixels of a grid (p: channels by pixel, then zeros), the borders by their own rule."""
    left, top, corner, right = (p[of[at]] for of in (grid.left, grid.top, grid.corner, grid.right))
    return _with_borders(grid.x[at], grid.y[at], left, top, _guesses(left, top, corner, right))


def sequential_modes(pixels: DataFrame, bits: int = 4) -> DataFrame:
    """(image_id, tx, ty, mode) as one pass over an image chooses them: a tile's mode is the one with least impurity of its residuals
    together with those of all tiles before it, in row-major order. An image is in one task; above a size that a task holds, use `best_tile_mode`."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _places(frame)
        p = np.zeros((len(frame) + 1, 4), dtype=np.int64)
        p[:-1] = frame[CHANNELS].to_numpy(np.int64)
        grid, out = Grid(frame), []
        rest = np.stack([(p[:-1] - g) & 255 for g in _around(p, grid)])
        tx, ty = grid.x >> bits, grid.y >> bits
        order = np.lexsort((tx, ty, grid.image))
        tile = ((grid.image << 40) + (ty << 20) + tx)[order]
        seen, image = np.zeros((4, 256)), -1
        edges = starts_of(tile)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = order[a:b]
            if grid.image[at[0]] != image:
                seen, image = np.zeros((4, 256)), grid.image[at[0]]
            # all modes and channels are counted at once
            cell = (np.arange(len(rest) * 4).reshape(-1, 4) * 256)[:, None] + rest[:, at]
            n = seen[None] + np.bincount(cell.ravel(), minlength=len(rest) * 1024).reshape(len(rest), 4, 256)
            best = int(np.argmin((1 - (n * n).sum(2) / n.sum(2) ** 2).sum(1)))
            seen = n[best]
            out.append((frame.image_id[int(at[0])], int(tx[at[0]]), int(ty[at[0]]), best))
        return pd.DataFrame(out, columns=["image_id", "tx", "ty", "mode"])

    return by_image(_whole(pixels).select("image_id", "pos", "x", "y", *CHANNELS), choose, "image_id long, tx int, ty int, mode int", _WALK)


def inverse_predict(residuals: DataFrame, tiles: DataFrame, bits: int = 4) -> DataFrame:
    """Pixels from residuals and tile modes (image_id, tx, ty, mode). A pixel whose tile has no mode is left out.

    A pixel needs its left, top, top-left and top-right, so those on one skewed diagonal need nothing of each other: a wave of all images of a batch is restored at once, wave after wave. An image is in one task.
    """

    def restore(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _places(frame)
        grid, modes, rests = Grid(frame), frame["mode"].to_numpy(np.int64), frame[CHANNELS].to_numpy(np.int64)
        done = np.zeros((len(frame) + 1, 4), dtype=np.int64)
        for at in grid.waves():
            guesses = np.stack(_around(done, grid, at))
            done[at] = (rests[at] + guesses[modes[at], np.arange(len(at))]) & 255
        out = frame[["image_id", "pos", "x", "y"]].copy()
        out[CHANNELS] = done[:-1]
        return out

    modes = tiles.select("image_id", "tx", "ty", "mode").filter("mode BETWEEN 0 AND 13")
    pixels = with_tile(_whole(residuals).select("image_id", "pos", "x", "y", *CHANNELS), modes, bits).drop("tx", "ty")
    return by_image(pixels, restore, "image_id long, pos long, x int, y int, r int, g int, b int, a int", _WALK)


def cache_hits(pixels: DataFrame, bits: int = 4, keys: list[str] = KEYS) -> DataFrame:
    """Pixels with slot and hit: whether the pixel before it in its slot of a recent-value cache has its colour. Slots begin at 0, and the first pixel never hits."""
    p = pixels.withColumn("argb", argb()).withColumn("slot", color_slot(F.col("argb"), bits))
    last = F.lag("argb").over(Window.partitionBy(*keys, "slot").orderBy("pos"))
    return p.withColumn("hit", (F.coalesce(last, F.lit(0)) == F.col("argb")) & (F.col("pos") > 0))


def cache_tokens(hits: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, pos, kind, argb, slot): what a stream without copies holds; a hit tells its slot only."""
    return hits.select(*keys, "pos", F.when(F.col("hit"), "cache").otherwise("literal").alias("kind"), F.when(~F.col("hit"), F.col("argb")).alias("argb"), F.when(F.col("hit"), F.col("slot")).alias("slot"))


def expand_cache(tokens: DataFrame, bits: int = 4, keys: list[str] = KEYS) -> DataFrame:
    """(keys, pos, argb) from cache tokens: a hit takes the last colour seen in its slot, or 0."""
    t = tokens.withColumn("slot", F.coalesce("slot", color_slot(F.col("argb"), bits)))
    w = Window.partitionBy(*keys, "slot").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return t.select(*keys, "pos", F.coalesce(F.last("argb", ignorenulls=True).over(w), F.lit(0)).alias("argb"))


#: Histograms of `channel_profile`, by number: subtraction leaves green and alpha as they are, so these count for both stages.
_PROFILES = [[("plain", "r")], [("plain", "g"), ("subtract_green", "g")], [("plain", "b")], [("plain", "a"), ("subtract_green", "a")], [("subtract_green", "r")], [("subtract_green", "b")]]


def _channel_counts(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of values by image and histogram, batch by batch. A null value is one more symbol, above all others."""
    null = 1 << 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            image = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            r, g, b, a = (batch.column(ch).cast(pa.int64()).fill_null(null).to_numpy() for ch in CHANNELS)
            less = [np.where((v == null) | (g == null), null, (v - g) & 255) for v in (r, b)]
            code = ((image * len(_PROFILES) + np.arange(len(_PROFILES))[:, None]) << 34) + np.stack([r, g, b, a, *less]) + (1 << 32)
            code, n = np.unique(code, return_counts=True)
            row_of = np.unique(image, return_index=True)[1]
            at = pa.array(row_of[(code >> 34) // len(_PROFILES)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array(((code >> 34) % len(_PROFILES)).astype(np.int32)), pa.array((code & ((1 << 34) - 1)) - (1 << 32)), pa.array(n.astype(np.int64))], names=[*keys, "profile", "symbol", "n"])

    return run


def channel_profile(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """For each image, stage (plain, subtract_green) and channel: pixels, distinct values, impurity. Values are counted in the task that has them; the counts are packed and shuffled once, by image."""
    p = pixels.select(*keys, *(F.col(ch).cast("int").alias(ch) for ch in CHANNELS))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema if f.name in keys)
    sums = merged_counts(p.mapInArrow(_channel_counts(keys), f"{kinds}, profile int, symbol long, n long"), [*keys, "profile"], keys)
    names = F.array(*(F.array(*(F.struct(F.lit(stage).alias("stage"), F.lit(ch).alias("channel")) for stage, ch in of)) for of in _PROFILES))
    each, total = sums.select(*keys, F.inline(F.get(names, F.col("profile"))), "total", "n_distinct", "squares"), F.col("total").cast("double")
    return each.select(*keys, "stage", "channel", "total", "n_distinct", F.round(1 - F.col("squares") / (total * total), 9).alias("impurity"))
