"""Palettes: building, indexing, packing several indices into a byte, and back.

A caller's column named argb is replaced by the colour of r, g, b, a. Pixels with a null channel have no colour: they take an entry of the palette each kind,
and no index. Repeated pixels are indexed each; where two colours first appear at one position, their order in the palette is not fixed. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bytes import argb, packing_factor, wrap8
from tessera.operators.pixels import CHANNELS, KEYS

MOST_COLORS = 256


def build_palette(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, idx, argb, r, g, b, a, n_colors, error): distinct colours in order of first appearance; images of over 256 have error 'too_many_colors'."""
    first = pixels.withColumn("argb", argb()).groupBy(*keys, "argb", *CHANNELS).agg(F.min("pos").alias("at"))
    w = Window.partitionBy(*keys)
    p = first.withColumn("idx", F.row_number().over(w.orderBy("at")) - 1).withColumn("n_colors", F.count("*").over(w))
    return p.select(*keys, "idx", "argb", *CHANNELS, "n_colors", F.when(F.col("n_colors") > MOST_COLORS, "too_many_colors").alias("error"))


def index_colors(pixels: DataFrame, palette: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, pos, x, y, idx, n_colors) of the pixels whose colour is in a sound palette."""
    p = palette.filter("error IS NULL").select(*keys, "argb", "idx", "n_colors")
    return pixels.withColumn("argb", argb()).join(p, [*keys, "argb"]).select(*keys, "pos", "x", "y", "idx", "n_colors")


def unmatched_pixels(pixels: DataFrame, palette: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Pixels whose colour their palette lacks."""
    return pixels.withColumn("argb", argb()).join(palette.select(*keys, "argb"), [*keys, "argb"], "left_anti").select(*keys, "pos", "argb")


def pack_indices(indexed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, px, y, packed, size): 8, 4, 2 or 1 neighbouring indices in a byte, the first in the low bits."""
    size = packing_factor(F.col("n_colors"))
    p = indexed.withColumn("size", size).withColumn("px", F.expr("x div size"))
    return p.groupBy(*keys, "px", "y", "size").agg(F.sum(F.expr("shiftleft(idx, CAST((x % size) * (8 div size) AS INT))")).cast("int").alias("packed")).select(*keys, F.col("px").cast("int").alias("px"), "y", "packed", "size")


def unpack_indices(packed: DataFrame, images: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, x, y, idx) from packed bytes; images (keys, width) tells where rows end."""
    p = packed.join(images.select(*keys, "width"), keys).withColumn("k", F.explode(F.expr("sequence(0, size - 1)")))
    idx = F.expr("shiftright(packed, CAST(k * (8 div size) AS INT)) & (shiftleft(1, CAST(8 div size AS INT)) - 1)")
    return p.select(*keys, (F.col("px") * F.col("size") + F.col("k")).cast("int").alias("x"), "y", idx.cast("int").alias("idx"), "width").filter("x < width").drop("width")


def lookup_palette(indexed: DataFrame, palette: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Indices as colours; an index without entry is transparent black."""
    j = indexed.join(palette.select(*keys, "idx", *CHANNELS), [*keys, "idx"], "left")
    return j.withColumns({ch: F.coalesce(ch, F.lit(0)) for ch in CHANNELS})


def palette_delta(palette: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Entries less the entry before, modulo 256."""
    w = Window.partitionBy(*keys).orderBy("idx")
    return palette.select(*keys, "idx", *(wrap8(F.col(ch) - F.coalesce(F.lag(ch).over(w), F.lit(0))).alias(ch) for ch in CHANNELS))


def palette_undelta(deltas: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Entries from their differences: `palette_delta` undone."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select(*keys, "idx", *(wrap8(F.sum(ch).over(w)).alias(ch) for ch in CHANNELS))
