"""Literal cases: header bytes, planes, codes, copies, and empty or odd input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.bytes import le_bytes, le_int
from tessera.operators import coding as C
from tessera.operators import container as K
from tessera.operators import matching as M
from tessera.operators import palette as L
from tessera.operators import pixels as P
from tessera.operators import planes as N

PIXELS = "image_id long, pos long, x int, y int, r int, g int, b int, a int"


def test_lossless_header_literal(spark):
    chunks = spark.createDataFrame([(1, 0, "VP8L", 6, bytes.fromhex("2F0FC0031012"))], "file_id long, chunk_no int, fourcc string, size long, head binary")
    row = K.lossless_header(chunks).first()
    assert (row.width, row.height) == (16, 16)


def test_little_endian(spark):
    row = spark.range(1).select(le_bytes(F.lit(0x8001F0), 3).alias("b")).select(F.hex("b").alias("h"), le_int("b", 0, 3).alias("v"), le_int("b", 1, 3).alias("over")).first()
    assert (row.h, row.v, row.over) == ("F00180", 0x8001F0, None)


def test_one_pixel_plane(spark):
    rows = [(1, "Y", x, y, 0x34) for x in range(16) for y in range(16)] + [(1, p, x, y, v) for p, v in (("Cb", 0x33), ("Cr", 0x32)) for x in range(8) for y in range(8)]
    planes = spark.createDataFrame(rows, "image_id long, plane string, px int, py int, v int")
    cropped = N.crop_planes(planes, spark.createDataFrame([(1, 1, 1)], "image_id long, width int, height int"))
    assert [tuple(r) for r in N.ycbcr_to_rgba(N.upsample_join(cropped)).collect()] == [(1, 0, 0, 0, 135, 0, 255)]
    assert len(N.pack_planes(planes).first().blob) == 384


@pytest.mark.parametrize(("data", "error"), [
    (b"", "invalid_signature"), (b"RIFF\x04\0\0\0WEBM", "not_webp"), (b"RIFF\xff\0\0\0WEBP", "truncated"),
    (b"RIFF\x0c\0\0\0WEBPABCD\x09\0\0\0", "chunk_out_of_range"), (b"RIFF\x0d\0\0\0WEBPABCD\x01\0\0\0x", "missing_pad"), (b"RIFF\x06\0\0\0WEBPab", "short_chunk_header"), (b"RIFF\x04\0\0\0WEBP", None),
])
def test_broken_files(spark, data, error):
    files = spark.createDataFrame([(1, data)], "file_id long, content binary")
    assert [r.error for r in K.chunk_errors(files, strict=True).collect()] == ([error] if error else [])
    if error == "short_chunk_header":
        assert K.chunk_errors(files).count() == 0


def test_depths_are_a_full_code():
    for counts in ({0: 1, 1: 1, 2: 2, 3: 4, 4: 100_000}, {k: 1 << k for k in range(30)}, {k: 1 for k in range(300)}):
        depths = C.code_depths(counts)
        assert sum(2.0**-d for d in depths.values()) == 1 and max(depths.values()) <= 15
    assert C.code_depths({7: 3}) == {7: -1} and C.code_depths({}) == {0: -1}


def test_near_offsets():
    cells = M.near_offsets()
    assert len(set(cells)) == 120 and cells[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and cells[-1] == (8, 7)


def test_parse_and_expand(spark):
    colors = [1, 2, 3, 1, 2, 3, 1, 2, 3, 9, 9, 9, 9, 9, 9, 5]
    tokens = M.parse(colors)
    assert tokens[3] == (3, 6, 3) and sum(max(1, n) for _, n, _ in tokens) == len(colors)
    bad = spark.createDataFrame([(1, 0, 0, "copy", None, None, None, None, 3, 2, None)], M._TOKENS)
    assert [r.error for r in M.backref_expand(bad).collect()] == ["bad_distance"]


def test_match_lengths_in_full(spark):
    """Lengths over 16 up to the format's 4,096, at the end of a sequence and over a mismatch; the longer of two long matches wins."""
    long = [(k * 7919) % 9973 for k in range(900)]
    colors = [*long, -1, *long[:20], -2, *long, -3, *[5] * 5000]
    rows = [(1, p, 0, 0, (c >> 16) & 255, (c >> 8) & 255, c & 255, 255) for p, c in enumerate(colors)]
    pixels = spark.createDataFrame(rows, PIXELS)
    at = len(long) + 22
    pairs = [(at, 0), (at, 901), (901, 0), (at + 1, 1), (at + 643, 643), (len(colors) - 4999, len(colors) - 5000), (len(colors) - 300, len(colors) - 301), (len(colors) - 1, 3)]
    candidates = spark.createDataFrame([(1, p, f, p - f) for p, f in pairs], "image_id long, pos long, from_pos long, dist long")

    def length(p, f):
        n = 0
        while n < M.LONGEST and p + n < len(colors) and colors[p + n] == colors[f + n]:
            n += 1
        return n

    found = M.match_lengths(candidates, pixels)
    assert {(r.pos, r.from_pos): r.len for r in found.collect()} == {(p, f): length(p, f) for p, f in pairs}
    best = {r.pos: (r.dist, r.len) for r in M.longest_match(found).collect()}
    assert best[at] == (at, 900) and max(n for _, n in best.values()) == M.LONGEST


def test_too_many_colors(spark):
    p = spark.range(300).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("pos"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), (F.col("id") % 256).cast("int").alias("r"), F.expr("CAST(id div 256 AS INT)").alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a"))
    palette = L.build_palette(p)
    assert Counter(r.error for r in palette.collect()) == {"too_many_colors": 300}
    assert L.index_colors(p, palette).count() == 0 and L.unmatched_pixels(p, palette).count() == 0


def test_empty_pixels(spark):
    p = spark.createDataFrame([], PIXELS)
    for f in (P.subtract_green, P.cross_color, P.with_neighbors, P.residual, P.cache_hits, P.tile_mode_scores, P.channel_profile, L.build_palette, M.match_candidates, N.pack_pixels):
        assert f(p).count() == 0


def test_null_channel(spark):
    p = spark.createDataFrame([(1, 0, 0, 0, None, 5, 9, 255)], PIXELS)
    row = P.subtract_green(p).first()
    assert (row.r, row.g, row.b) == (None, 5, 4)
