"""Planar images: subsampled chroma, conversion to colours, alpha filters.

Null values give null results, and an empty table an empty one; a row with a null key meets nothing in a join. Of repeated samples joins by
`upsample_join` take the largest; packing keeps each one. A plane that is missing leaves its pixels out (chroma) or opaque (alpha).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bytes import clamp8
from tessera.operators.batches import Grid, by_image

#: Shifts of chroma coordinates by subsampling ratio.
RATIOS = {"444": (0, 0), "422": (1, 0), "420": (1, 1), "440": (0, 1), "411": (2, 0), "410": (2, 1)}


def plane_sizes(images: DataFrame, ratio: str = "ratio") -> DataFrame:
    """Images with chroma_width and chroma_height by their subsampling ratio."""
    pick = lambda k: F.create_map(*(F.lit(v) for r, s in RATIOS.items() for v in (r, s[k])))
    shrink = lambda side, k: F.ceil(F.col(side) / F.pow(F.lit(2), F.try_element_at(pick(k), F.col(ratio)))).cast("int")
    return images.withColumns({"chroma_width": shrink("width", 0), "chroma_height": shrink("height", 1)})


def crop_planes(planes: DataFrame, images: DataFrame) -> DataFrame:
    """Planes without the padding to whole blocks: luma and alpha to the image's size, chroma to half of it, rounded up."""
    j = planes.join(images.select("image_id", "width", "height"), "image_id")
    half = F.col("plane").isin("Cb", "Cr")
    side = lambda s: F.when(half, F.shiftright(F.col(s) + 1, 1)).otherwise(F.col(s))
    return j.filter((F.col("px") < side("width")) & (F.col("py") < side("height"))).drop("width", "height")


def upsample_join(planes: DataFrame, ratio: str = "420") -> DataFrame:
    """(image_id, x, y, luma, cb, cr, a): every luma pixel with the chroma of its block; both chroma planes come as one row, so that one join does. Alpha is 255 where there is no alpha plane."""
    sx, sy = RATIOS[ratio]
    full = planes.filter(F.col("plane").isin("Y", "A")).groupBy("image_id", F.col("px").alias("x"), F.col("py").alias("y")).agg(F.max(F.when(F.col("plane") == "Y", F.col("v"))).alias("luma"), F.coalesce(F.max(F.when(F.col("plane") == "A", F.col("v"))), F.lit(255)).alias("a"))
    chroma = planes.filter(F.col("plane").isin("Cb", "Cr")).groupBy("image_id", F.col("px").alias("cx"), F.col("py").alias("cy")).agg(F.max(F.when(F.col("plane") == "Cb", F.col("v"))).alias("cb"), F.max(F.when(F.col("plane") == "Cr", F.col("v"))).alias("cr"))
    return full.withColumns({"cx": F.shiftright("x", sx), "cy": F.shiftright("y", sy)}).join(chroma, ["image_id", "cx", "cy"]).select("image_id", "x", "y", "luma", "cb", "cr", "a")


def ycbcr_to_rgba(pixels: DataFrame) -> DataFrame:
    """Colours by the limited-range BT.601 formula in integers (fixed values 298, 409, 100, 208, 516)."""
    c, d, e = 298 * (F.col("luma") - 16), F.col("cb") - 128, F.col("cr") - 128
    down = lambda x: clamp8(F.shiftright((x + 128).cast("bigint"), 8))
    return pixels.select("image_id", "x", "y", down(c + 409 * e).alias("r"), down(c - 100 * d - 208 * e).alias("g"), down(c + 516 * d).alias("b"), "a")


def unfilter_alpha(plane: DataFrame, kind: int) -> DataFrame:
    """Alpha plane (image_id, x, y, v) with filter 0 (none), 1 (horizontal) or 2 (vertical) undone: sums modulo 256 along rows or columns. The first column of 1 and the first row of 2 follow the other direction."""
    if kind == 0:
        return plane
    run = lambda by, order: Window.partitionBy("image_id", by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    along, main, other = ("y", "x", "y") if kind == 1 else ("x", "y", "x")
    p = plane.withColumn("_edge", F.sum(F.when(F.col(main) == 0, F.col("v")).otherwise(0)).over(run(main, other)))
    p = p.withColumn("_v", F.when(F.col(main) == 0, F.col("_edge")).otherwise(F.col("v")))
    return p.withColumn("v", F.pmod(F.sum("_v").over(run(along, main)), F.lit(256)).cast("int")).drop("_edge", "_v")


def unfilter_alpha_gradient(plane: DataFrame) -> DataFrame:
    """Filter 3 undone: each value adds left + top - top-left, clamped, of restored values (in the first row and column the one neighbour there is). An image is in one task, a wave of values of many images at once (see `Grid`).
    Rows with a null take no part, the smallest of repeated values counts, and a missing one is 0 to others, as in a last row that ends early."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["image_id", "y", "x"], ignore_index=True)
        grid, v, done = Grid(frame), frame.v.to_numpy(np.int64), np.zeros(len(frame) + 1, dtype=np.int64)
        for at in grid.waves():
            left, top, corner = (done[of[at]] for of in (grid.left, grid.top, grid.corner))
            guess = np.where(grid.y[at] == 0, left, np.where(grid.x[at] == 0, top, np.clip(left + top - corner, 0, 255)))
            done[at] = (v[at] + guess) & 255
        return frame.assign(v=done[:-1])[["image_id", "x", "y", "v"]]

    return by_image(plane.dropna(subset=["image_id", "x", "y", "v"]).filter("x >= 0 AND y >= 0").select("image_id", "x", "y", "v"), run, "image_id long, x int, y int, v int", ["y", "x", "v"])


def filter_gradient(plane: DataFrame) -> DataFrame:
    """The gradient filter itself, by windows: its guesses use the given values, with the neighbours that `unfilter_alpha_gradient` has: none over a gap, and a top-left only where there is a top."""
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    p = plane.withColumn("_l", F.when(F.lag("x").over(row) == F.col("x") - 1, F.lag("v").over(row)))
    above = F.lag("y").over(col) == F.col("y") - 1
    p = p.withColumns({"_t": F.when(above, F.lag("v").over(col)), "_tl": F.when(above, F.lag("_l").over(col))})
    l, t, tl = (F.coalesce(c, F.lit(0)) for c in ("_l", "_t", "_tl"))
    guess: Column = F.when(F.col("y") == 0, l).when(F.col("x") == 0, t).otherwise(clamp8(l + t - tl))
    return p.withColumn("v", F.pmod(F.col("v") - guess, F.lit(256)).cast("int")).drop("_l", "_t", "_tl")


def pack_planes(planes: DataFrame) -> DataFrame:
    """(image_id, blob): luma, chroma and alpha planes in a row, each by rows."""
    no = F.create_map(*(F.lit(v) for k, p in enumerate(["Y", "Cb", "Cr", "A"]) for v in (p, k)))
    cell = F.struct(F.try_element_at(no, F.col("plane")).alias("no"), "py", "px", F.lpad(F.hex("v"), 2, "0").alias("h"))
    return planes.groupBy("image_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda e: e["h"]), "")).alias("blob"))


def pack_pixels(pixels: DataFrame) -> DataFrame:
    """(image_id, blob): red, green, blue, alpha bytes by position."""
    h = lambda ch: F.lpad(F.hex(ch), 2, "0")
    cell = F.struct("pos", F.concat(h("r"), h("g"), h("b"), h("a")).alias("h"))
    return pixels.groupBy("image_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda e: e["h"]), "")).alias("blob"))
