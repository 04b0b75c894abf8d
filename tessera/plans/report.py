"""Coded size of images by technique."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import coding as C
from tessera.operators import matching as M
from tessera.operators import palette as L
from tessera.operators import pixels as P


def _plain(pixels: DataFrame) -> DataFrame:
    """Every pixel as four literal symbols."""
    cells = F.array(*(F.struct(F.lit(a).alias("alphabet"), F.col(ch).alias("symbol"), F.lit(0).alias("extra_bits")) for a, ch in enumerate("grba")))
    return pixels.select("image_id", F.inline(cells))


def technique_report(pixels: DataFrame, flat: DataFrame, width: int = 16) -> DataFrame:
    """(technique, image_id, bits): coded bits of each image by each technique, and a total for each technique and for all (null image_id, null technique).

    flat: images of few colours, for the palette. Sizes are those of the coded symbols with one code book an alphabet; headers are not counted. One pass
    over the union of all variants makes histograms, books and sizes.
    """
    hits = P.cache_hits(pixels)
    wide = pixels.select("image_id").distinct().withColumn("width", F.lit(width))
    cache = hits.select("image_id", F.col("pos").alias("tok"), "pos", F.when(F.col("hit"), "cache").otherwise("literal").alias("kind"), *"grba", F.lit(None).cast("int").alias("len"), F.lit(None).cast("long").alias("dist"), "slot")
    copies = M.backref_tokens(pixels, None)
    small = L.build_palette(flat)
    packed = L.pack_indices(L.index_colors(flat, small))
    tile = P.best_tile_mode(P.tile_mode_scores(pixels))
    mix = P.residual(P.subtract_green(pixels), P.best_tile_mode(P.tile_mode_scores(P.subtract_green(pixels))))
    symbols = {
        "plain": _plain(pixels),
        "subtract_green": _plain(P.subtract_green(pixels)),
        "cross_color": _plain(P.cross_color(pixels)),
        "predictor": _plain(P.residual(pixels, tile)),
        "cache": C.tokens_to_symbols(cache, wide).select("image_id", "alphabet", "symbol", "extra_bits"),
        "back_references": C.tokens_to_symbols(copies, wide).select("image_id", "alphabet", "symbol", "extra_bits"),
        "palette": packed.select("image_id", F.lit(0).alias("alphabet"), F.col("packed").alias("symbol"), F.lit(0).alias("extra_bits")),
        "default": C.tokens_to_symbols(M.backref_tokens(mix), wide).select("image_id", "alphabet", "symbol", "extra_bits"),
    }
    all_ = reduce(DataFrame.unionByName, (s.withColumn("stream", F.lit(name)) for name, s in symbols.items()))
    both = all_.groupBy("image_id", "stream", "alphabet", "symbol").agg(F.count("*").alias("n"), F.sum("extra_bits").alias("extra_bits"))
    size = C.coded_bits(both)
    return size.withColumnRenamed("stream", "technique").rollup("technique", "image_id").agg(F.sum("bits").alias("bits"))
