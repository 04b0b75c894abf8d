"""Registered queries of the media jobs, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.functions.bytes import argb, color_slot, packing_factor, prefix_code, prefix_decode, tile_count, tile_key
from tessera.operators import coding as C
from tessera.operators import container as K
from tessera.operators import matching as M
from tessera.operators import palette as L
from tessera.operators import pixels as P
from tessera.operators import planes as N
from tessera.operators import verify as V
from tessera.sources.media import read_bucket, read_files, write_files, write_media
from tessera.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, plain: bool = False) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql if plain else X.sql(sql)
        return f

    return keep


def _wrap(x: str) -> str:
    return f"((({x}) % 256 + 256) % 256)"


_ARGB = "(a::BIGINT * 16777216 + r::BIGINT * 65536 + g::BIGINT * 256 + b::BIGINT)"
_SLOT = "(((({0}) * 506832829::HUGEINT) % 4294967296) // {1})"
_SIGNED = "((({0}) + 128) % 256 + 256) % 256 - 128"


def _down5(c: str, v: str) -> str:
    return f"floor(({_SIGNED.format(c)}) * ({_SIGNED.format(v)}) / 32.0)::INT"


# --- scalar and pixel expressions ---------------------------------------------------------------------------------------


@register("slice0_channel_profile", """
    WITH s AS (SELECT image_id, 'plain' AS stage, r, g, b, a FROM v_doc_px UNION ALL
        SELECT image_id, 'subtract_green', (r - g + 256) % 256, g, (b - g + 256) % 256, a FROM v_doc_px),
    e AS (SELECT image_id, stage, 'r' AS channel, r AS symbol FROM s UNION ALL SELECT image_id, stage, 'g', g FROM s UNION ALL SELECT image_id, stage, 'b', b FROM s UNION ALL SELECT image_id, stage, 'a', a FROM s),
    h AS (SELECT image_id, stage, channel, symbol, count(*) AS n FROM e GROUP BY ALL)
    SELECT image_id, stage, channel, sum(n)::BIGINT AS total, count(*) AS n_distinct, round(1 - sum(n::DOUBLE * n) / (sum(n::DOUBLE) * sum(n::DOUBLE)), 9) AS impurity FROM h GROUP BY ALL""")
def slice0(spark: SparkSession, d: str) -> DataFrame:
    return P.channel_profile(X.doc_px(spark, d))


@register("p1_subtract_green", "SELECT image_id, pos, x, y, (r - g + 256) % 256 AS r, g, (b - g + 256) % 256 AS b, a FROM v_vec_px")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return P.subtract_green(X.vec_px(spark, d))


@register("p1_green_round_trip", "SELECT * FROM v_vec_px")
def p1_back(spark: SparkSession, d: str) -> DataFrame:
    return P.add_green(P.subtract_green(X.vec_px(spark, d)))


@register("p2_cross_color", f"""
    SELECT image_id, pos, x, y, {_wrap(f"r - {_down5('3', 'g')}")} AS r, g, {_wrap(f"b - {_down5('2', 'g')} - {_down5('1', 'r')}")} AS b, a FROM v_vec_px""")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return P.cross_color(X.vec_px(spark, d))


def _coeffs(spark: SparkSession, d: str) -> DataFrame:
    t = X.vec_px(spark, d).select("image_id", tile_key("x", 1).alias("tx"), tile_key("y", 1).alias("ty")).distinct()
    m = lambda k: ((F.col("image_id") * k + F.col("tx") * 37 + F.col("ty") * 91) % 256 - 128).cast("int")
    return t.withColumns({"g2r": m(7), "g2b": m(11), "r2b": m(13)})


@register("p2_cross_color_round_trip", "SELECT * FROM v_vec_px")
def p2_back(spark: SparkSession, d: str) -> DataFrame:
    co = _coeffs(spark, d)
    return P.inverse_cross_color(P.cross_color(X.vec_px(spark, d), co, 1), co, 1)


@register("p3_unpremultiply", """SELECT image_id, pos, x, y, CASE WHEN a = 0 THEN 0 ELSE least(255, r * 255 // a) END AS r,
    CASE WHEN a = 0 THEN 0 ELSE least(255, g * 255 // a) END AS g, CASE WHEN a = 0 THEN 0 ELSE least(255, b * 255 // a) END AS b, a FROM v_vec_px""")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return P.unpremultiply(X.vec_px(spark, d))


@register("p7_alpha_from_green", "SELECT image_id, pos, x, y, g AS a FROM v_vec_px")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return P.alpha_from_green(X.vec_px(spark, d))


@register("p8_valid_dims", """SELECT l_orderkey AS image_id, l_partkey AS width, l_suppkey * 997 AS height,
    CASE WHEN l_partkey BETWEEN 1 AND 16384 AND l_suppkey * 997 BETWEEN 1 AND 16384 THEN NULL ELSE 'bad_size' END AS error FROM lineitem""", plain=True)
def p8(spark: SparkSession, d: str) -> DataFrame:
    return P.valid_dims(X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("width"), (F.col("l_suppkey") * 997).alias("height")))


@register("p9_color_slot", f"SELECT image_id, pos, {_SLOT.format(_ARGB, 1 << 28)}::INT AS slot4, {_SLOT.format(_ARGB, 1 << 21)}::INT AS slot11 FROM v_vec_px")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return X.vec_px(spark, d).select("image_id", "pos", color_slot(argb(), 4).alias("slot4"), color_slot(argb(), 11).alias("slot11"))


_SYM = "CASE WHEN n <= 5 THEN greatest(n - 1, 0) ELSE 2 * (length(bin(n - 1)) - 1) + (((n - 1) >> (length(bin(n - 1)) - 2)) & 1) END"


@register("p10_prefix_code", f"""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey AS n FROM lineitem), s AS (SELECT *, {_SYM} AS symbol FROM t),
    u AS (SELECT *, CASE WHEN symbol < 4 THEN 0 ELSE (symbol - 2) >> 1 END AS extra_bits FROM s)
    SELECT l_orderkey, l_linenumber, n, symbol, CASE WHEN n <= 5 THEN 0 ELSE n - 1 - ((2 + (symbol & 1)) << extra_bits) END AS extra, extra_bits, greatest(n, 1) AS decoded FROM u""", plain=True)
def p10(spark: SparkSession, d: str) -> DataFrame:
    t = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("n"))
    symbol, extra, bits = prefix_code(F.col("n"))
    t = t.select("*", symbol.alias("symbol"), extra.alias("extra"), bits.alias("extra_bits"))
    return t.withColumn("decoded", prefix_decode(F.col("symbol"), F.col("extra")))


_NEAR = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(M.near_offsets(), 1))


@register("p12_distance_code_round_trip", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey + 1 AS dist, 1 + l_suppkey % 40 AS width FROM lineitem), cells(code, dx, dy) AS (VALUES {_NEAR}),
    s AS (SELECT *, dist // width AS y, dist % width AS x FROM t),
    u AS (SELECT *, CASE WHEN x <= 8 AND y < 8 THEN x WHEN x > width - 8 AND y < 7 THEN x - width END AS cx, CASE WHEN x <= 8 AND y < 8 THEN y WHEN x > width - 8 AND y < 7 THEN y + 1 END AS cy FROM s)
    SELECT l_orderkey, l_linenumber, dist, width, coalesce(code, dist + 120)::BIGINT AS code, dist AS back FROM u LEFT JOIN cells ON cx = dx AND cy = dy""", plain=True)
def p12(spark: SparkSession, d: str) -> DataFrame:
    t = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 1).alias("dist"), (1 + F.col("l_suppkey") % 40).alias("width"))
    return M.with_distance_code(t).withColumn("back", M.distance_from_code(F.col("code"), F.col("width")))


@register("p13_tiles", "SELECT image_id, (x >> 1)::INT AS tx, (y >> 1)::INT AS ty, count(*) AS n, (max(x) + 4) >> 2 AS tiles_x FROM v_vec_px GROUP BY 1, 2, 3")
def p13(spark: SparkSession, d: str) -> DataFrame:
    t = X.vec_px(spark, d).groupBy("image_id", tile_key("x", 1).alias("tx"), tile_key("y", 1).alias("ty")).agg(F.count("*").alias("n"), F.max("x").alias("m"))
    return t.select("image_id", "tx", "ty", "n", tile_count(F.col("m") + 1, 2).alias("tiles_x"))


@register("p14_packing_factor", "SELECT o_orderkey, CASE WHEN o_custkey <= 2 THEN 8 WHEN o_custkey <= 4 THEN 4 WHEN o_custkey <= 16 THEN 2 ELSE 1 END AS size FROM orders", plain=True)
def p14(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "orders").select("o_orderkey", packing_factor(F.col("o_custkey")).alias("size"))


@register("p15_plane_sizes", """
    WITH t AS (SELECT p_partkey, p_size AS width, p_partkey % 100 + 1 AS height, list_extract(['444', '422', '420', '440', '411', '410'], (p_partkey % 6 + 1)::INT) AS ratio FROM part)
    SELECT *, CASE WHEN ratio IN ('422', '420') THEN (width + 1) // 2 WHEN ratio IN ('411', '410') THEN (width + 3) // 4 ELSE width END::INT AS chroma_width,
        CASE WHEN ratio IN ('420', '440', '410') THEN (height + 1) // 2 ELSE height END::INT AS chroma_height FROM t""", plain=True)
def p15(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.element_at(F.array(*(F.lit(r) for r in ("444", "422", "420", "440", "411", "410"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return N.plane_sizes(X.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("width"), (F.col("p_partkey") % 100 + 1).alias("height"), ratio.alias("ratio")))


# --- neighbours, prediction, scores --------------------------------------------------------------------------------------

_NB = """nb AS MATERIALIZED (
    SELECT p.*, {0} FROM v_vec_px p
    LEFT JOIN v_vec_px l ON l.image_id = p.image_id AND l.pos = p.pos - 1 AND p.x > 0
    LEFT JOIN v_vec_px t ON t.image_id = p.image_id AND t.pos = p.pos - 4
    LEFT JOIN v_vec_px c ON c.image_id = p.image_id AND c.pos = p.pos - 5 AND p.x > 0
    LEFT JOIN v_vec_px q ON q.image_id = p.image_id AND q.pos = p.pos - 3 AND p.y > 0)""".format(", ".join(f"{s}.{ch} AS {n}_{ch}" for s, n in (("l", "l"), ("t", "t"), ("c", "tl"), ("q", "tr")) for ch in "rgba"))


def _guess(mode: int, ch: str) -> str:
    l, t, tl, tr = (f"{k}_{ch}" for k in ("l", "t", "tl", "tr"))
    mean = lambda a, b: f"((({a}) + ({b})) // 2)"
    clip = lambda v: f"greatest(0, least(255, {v}))"
    nearer = " + ".join(f"abs(t_{k} - tl_{k})" for k in "rgba") + " < " + " + ".join(f"abs(l_{k} - tl_{k})" for k in "rgba")
    zero = "255" if ch == "a" else "0"
    inner = [zero, l, t, tr, tl, mean(mean(l, tr), t), mean(l, tl), mean(l, t), mean(tl, t), mean(t, tr), mean(mean(l, tl), mean(t, tr)), f"CASE WHEN {nearer} THEN {l} ELSE {t} END", clip(f"{l} + {t} - {tl}"), clip(f"{mean(l, t)} + trunc(({mean(l, t)} - {tl}) / 2.0)::INT")][mode]
    return f"CASE WHEN x = 0 AND y = 0 THEN {zero} WHEN x = 0 THEN {t} WHEN y = 0 THEN {l} ELSE {inner} END"


@register("w1_neighbors", f"WITH {_NB} SELECT image_id, pos, l_r, l_a, t_g, tl_b, tr_r, tr_a FROM nb")
def w1(spark: SparkSession, d: str) -> DataFrame:
    n = P.with_neighbors(X.vec_px(spark, d))
    return n.select("image_id", "pos", *(F.col(f"{k}.{ch}").alias(f"{k}_{ch}") for k, ch in (("l", "r"), ("l", "a"), ("t", "g"), ("tl", "b"), ("tr", "r"), ("tr", "a"))))


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    t = X.vec_px(spark, d).select("image_id", tile_key("x", 1).alias("tx"), tile_key("y", 1).alias("ty")).distinct()
    return t.withColumn("mode", ((F.col("image_id") + F.col("tx") * 3 + F.col("ty") * 5) % 14).cast("int"))


_MODE = "((image_id + (x // 2) * 3 + (y // 2) * 5) % 14)"


@register("p5_residual", f"""WITH {_NB} SELECT image_id, pos, x, y, {", ".join(_wrap(f"{ch} - CASE {_MODE} " + " ".join(f"WHEN {m} THEN {_guess(m, ch)}" for m in range(14)) + " END") + f" AS {ch}" for ch in "rgba")} FROM nb""")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return P.residual(X.vec_px(spark, d), _tiles(spark, d), 1)


@register("h4_inverse_predict_round_trip", "SELECT * FROM v_vec_px")
def h4(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d)
    return P.inverse_predict(P.residual(X.vec_px(spark, d), t, 1), t, 1)


_RESIDUALS = f"""{_NB}, e AS ({" UNION ALL ".join(f"SELECT image_id, x // 2 AS tx, y // 2 AS ty, {m} AS mode, '{ch}' AS ch, {_wrap(f'{ch} - {_guess(m, ch)}')} AS symbol FROM nb" for m in range(14) for ch in "rgba")})"""
_SCORES = f"""{_RESIDUALS},
    h AS (SELECT image_id, tx, ty, mode, ch, symbol, count(*)::DOUBLE AS n FROM e GROUP BY ALL),
    i AS (SELECT image_id, tx, ty, mode, ch, round(1 - sum(n * n) / (sum(n) * sum(n)), 12) AS impurity FROM h GROUP BY ALL),
    s AS (SELECT image_id, tx, ty, mode, round(sum(impurity), 9) AS score FROM i GROUP BY ALL)"""


@register("a3_tile_mode_scores", f"WITH {_SCORES} SELECT image_id, tx, ty, mode, score FROM s")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return P.tile_mode_scores(X.vec_px(spark, d), 1)


@register("a4_best_tile_mode", f"WITH {_SCORES} SELECT image_id, tx, ty, mode FROM (SELECT *, row_number() OVER (PARTITION BY image_id, tx, ty ORDER BY score, mode) AS k FROM s) WHERE k = 1")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return P.best_tile_mode(P.tile_mode_scores(X.vec_px(spark, d), 1))


def _spread(x: str) -> str:
    """Impurity of a list of symbols in SQL."""
    return f"(1 - list_sum(list_transform({x}, lambda u: len(list_filter({x}, lambda v: v = u))))::DOUBLE / (len({x}) * len({x}))::DOUBLE)"


# the residuals of all tiles so far, as lists, go from tile to tile; the least score of 14 is taken, of equal ones the lowest mode
_SEQUENTIAL = f"""{_RESIDUALS},
    tm AS (SELECT image_id, ty * 2 + tx AS k, tx, ty, mode, {", ".join(f"list(symbol) FILTER (ch = '{ch}') AS {ch}" for ch in "rgba")} FROM e GROUP BY ALL),
    tl AS MATERIALIZED (SELECT image_id, k, tx, ty, list(struct_pack(mode := mode, r := r, g := g, b := b, a := a) ORDER BY mode) AS modes FROM tm GROUP BY ALL),
    walk(image_id, k, tx, ty, best) AS (
        SELECT image_id, -1::BIGINT, NULL::BIGINT, NULL::BIGINT, struct_pack(score := 0.0::DOUBLE, mode := 0, {", ".join(f"{ch} := []::BIGINT[]" for ch in "rgba")}) FROM tl WHERE k = 0
        UNION ALL SELECT image_id, k, tx, ty, list_sort(list_transform(c, lambda z: struct_pack(score := {" + ".join(_spread(f"z.{ch}") for ch in "rgba")}, mode := z.mode, {", ".join(f"{ch} := z.{ch}" for ch in "rgba")})))[1]
        FROM (SELECT tl.image_id, tl.k, tl.tx, tl.ty, list_transform(tl.modes, lambda z: struct_pack(mode := z.mode::INT, {", ".join(f"{ch} := list_concat(walk.best.{ch}, z.{ch}::BIGINT[])" for ch in "rgba")})) AS c FROM walk JOIN tl ON tl.image_id = walk.image_id AND tl.k = walk.k + 1))"""


@register("h3_sequential_modes", f"WITH {_SEQUENTIAL} SELECT image_id, tx::INT AS tx, ty::INT AS ty, best.mode AS mode FROM walk WHERE k >= 0")
def h3(spark: SparkSession, d: str) -> DataFrame:
    return P.sequential_modes(X.vec_px(spark, d), 1)


@register("h3_first_tile", f"WITH {_SCORES} SELECT image_id, mode FROM (SELECT *, row_number() OVER (PARTITION BY image_id, tx, ty ORDER BY score, mode) AS k FROM s) WHERE k = 1 AND tx = 0 AND ty = 0")
def h3_first(spark: SparkSession, d: str) -> DataFrame:
    return P.sequential_modes(X.vec_px(spark, d), 1).filter("tx = 0 AND ty = 0").select("image_id", "mode")


# --- planes ------------------------------------------------------------------------------------------------------------


@register("j3_p6_upsample_to_rgba", """
    WITH j AS (SELECT y.image_id, y.px AS x, y.py AS y, 298 * (y.v - 16) AS c, cb.v - 128 AS d, cr.v - 128 AS e FROM v_planes y
        JOIN v_planes cb ON cb.plane = 'Cb' AND cb.image_id = y.image_id AND cb.px = y.px // 2 AND cb.py = y.py // 2
        JOIN v_planes cr ON cr.plane = 'Cr' AND cr.image_id = y.image_id AND cr.px = y.px // 2 AND cr.py = y.py // 2 WHERE y.plane = 'Y')
    SELECT image_id, x, y, greatest(0, least(255, floor((c + 409 * e + 128) / 256.0)))::INT AS r, greatest(0, least(255, floor((c - 100 * d - 208 * e + 128) / 256.0)))::INT AS g,
        greatest(0, least(255, floor((c + 516 * d + 128) / 256.0)))::INT AS b, 255 AS a FROM j""")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return N.ycbcr_to_rgba(N.upsample_join(X.planes(spark, d)))


@register("j3_upsample_with_alpha", """SELECT y.image_id, y.px AS x, y.py AS y, y.v AS luma, cb.v AS cb, cr.v AS cr, CASE WHEN y.image_id % 3 = 0 THEN 255 ELSE p.a END AS a FROM v_planes y
        JOIN v_planes cb ON cb.plane = 'Cb' AND cb.image_id = y.image_id AND cb.px = y.px // 2 AND cb.py = y.py // 2
        JOIN v_planes cr ON cr.plane = 'Cr' AND cr.image_id = y.image_id AND cr.px = y.px // 2 AND cr.py = y.py // 2
        JOIN v_vec_px p ON p.image_id = y.image_id AND p.x = y.px AND p.y = y.py WHERE y.plane = 'Y'""")
def j3_alpha(spark: SparkSession, d: str) -> DataFrame:
    """Two of three images have an alpha plane; it is opaque in the others."""
    alpha = X.vec_px(spark, d).filter("image_id % 3 != 0").select("image_id", F.lit("A").alias("plane"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("a").alias("v"))
    return N.upsample_join(X.planes(spark, d).unionByName(alpha))


@register("p17_crop_planes", "SELECT image_id, plane, px, py, v FROM v_planes WHERE px < CASE plane WHEN 'Y' THEN 3 ELSE 2 END AND py < CASE plane WHEN 'Y' THEN 1 + image_id % 4 ELSE (2 + image_id % 4) // 2 END")
def p17(spark: SparkSession, d: str) -> DataFrame:
    p = X.planes(spark, d)
    return N.crop_planes(p, p.select("image_id").distinct().select("image_id", F.lit(3).alias("width"), (1 + F.col("image_id") % 4).alias("height")))


_PLANE = "SELECT image_id, x, y, r AS v FROM v_vec_px"


@register("w4_unfilter_horizontal", f"WITH p AS ({_PLANE}), c AS (SELECT image_id, y, sum(v) OVER (PARTITION BY image_id ORDER BY y) AS e FROM p WHERE x = 0) SELECT p.image_id, x, p.y, ((e + sum(CASE WHEN x = 0 THEN 0 ELSE v END) OVER (PARTITION BY p.image_id, p.y ORDER BY x)) % 256)::INT AS v FROM p JOIN c ON c.image_id = p.image_id AND c.y = p.y")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return N.unfilter_alpha(X.vec_px(spark, d).select("image_id", "x", "y", F.col("r").alias("v")), 1)


@register("w4_unfilter_vertical", f"WITH p AS ({_PLANE}), c AS (SELECT image_id, x, sum(v) OVER (PARTITION BY image_id ORDER BY x) AS e FROM p WHERE y = 0) SELECT p.image_id, p.x, y, ((e + sum(CASE WHEN y = 0 THEN 0 ELSE v END) OVER (PARTITION BY p.image_id, p.x ORDER BY y)) % 256)::INT AS v FROM p JOIN c ON c.image_id = p.image_id AND c.x = p.x")
def w4_vertical(spark: SparkSession, d: str) -> DataFrame:
    return N.unfilter_alpha(X.vec_px(spark, d).select("image_id", "x", "y", F.col("r").alias("v")), 2)


@register("h5_gradient_round_trip", _PLANE)
def h5(spark: SparkSession, d: str) -> DataFrame:
    return N.unfilter_alpha_gradient(N.filter_gradient(X.vec_px(spark, d).select("image_id", "x", "y", F.col("r").alias("v"))))


@register("s7_pack_planes", "SELECT image_id, md5(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY CASE plane WHEN 'Y' THEN 0 WHEN 'Cb' THEN 1 ELSE 2 END, py, px)) AS digest, count(*) AS n FROM v_planes GROUP BY 1")
def s7(spark: SparkSession, d: str) -> DataFrame:
    return N.pack_planes(X.planes(spark, d)).select("image_id", F.md5(F.hex("blob").cast("binary")).alias("digest"), F.octet_length("blob").cast("long").alias("n"))


@register("s6_pack_pixels", "SELECT image_id, md5(string_agg(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0') || lpad(to_hex(a), 2, '0'), '' ORDER BY pos)) AS digest, 4 * count(*) AS n FROM v_vec_px GROUP BY 1")
def s6(spark: SparkSession, d: str) -> DataFrame:
    return N.pack_pixels(X.vec_px(spark, d)).select("image_id", F.md5(F.hex("blob").cast("binary")).alias("digest"), F.octet_length("blob").cast("long").alias("n"))


@register("s5_explode_round_trip", "SELECT * FROM v_vec_px")
def s5(spark: SparkSession, d: str) -> DataFrame:
    from tessera.sources.media import explode_pixels

    return explode_pixels(N.pack_pixels(X.vec_px(spark, d)).select("image_id", F.lit(4).alias("width"), F.col("blob").alias("rgba")))


# --- palettes and caches ------------------------------------------------------------------------------------------------

_PAL = f"f AS (SELECT image_id, r, g, b, a, {_ARGB} AS argb, min(pos) AS seen FROM v_idx_px GROUP BY ALL), pal AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY seen) - 1 AS idx, argb, r, g, b, a, count(*) OVER (PARTITION BY image_id) AS n_colors FROM f)"


@register("a5_build_palette", f"WITH {_PAL} SELECT *, NULL::VARCHAR AS error FROM pal")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return L.build_palette(X.idx_px(spark, d))


_INDEXED = f"{_PAL}, ix AS (SELECT p.image_id, pos, x, y, idx, n_colors FROM v_idx_px p JOIN pal ON pal.image_id = p.image_id AND pal.r = p.r AND pal.g = p.g AND pal.b = p.b AND pal.a = p.a)"


@register("j1_index_colors", f"WITH {_INDEXED} SELECT * FROM ix")
def j1(spark: SparkSession, d: str) -> DataFrame:
    p = X.idx_px(spark, d)
    return L.index_colors(p, L.build_palette(p))


@register("a6_pack_indices", f"WITH {_INDEXED}, z AS (SELECT *, CASE WHEN n_colors <= 2 THEN 8 WHEN n_colors <= 4 THEN 4 WHEN n_colors <= 16 THEN 2 ELSE 1 END AS size FROM ix) SELECT image_id, (x // size)::INT AS px, y, sum(idx << ((x % size) * (8 // size)))::INT AS packed, size FROM z GROUP BY image_id, 2, y, size")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return L.pack_indices(j1(spark, d))


@register("p18_unpack_round_trip", f"WITH {_INDEXED} SELECT image_id, x, y, idx FROM ix")
def p18(spark: SparkSession, d: str) -> DataFrame:
    ix = j1(spark, d)
    return L.unpack_indices(L.pack_indices(ix), ix.select("image_id").distinct().withColumn("width", F.lit(16)))


@register("j4_lookup_palette", f"WITH {_INDEXED}, b AS (SELECT image_id, pos, idx + pos % 2 * 3 AS idx FROM ix) SELECT b.image_id, pos, b.idx, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(pal.b, 0) AS b, coalesce(a, 0) AS a FROM b LEFT JOIN pal ON pal.image_id = b.image_id AND pal.idx = b.idx")
def j4(spark: SparkSession, d: str) -> DataFrame:
    p = X.idx_px(spark, d)
    pal = L.build_palette(p)
    moved = L.index_colors(p, pal).select("image_id", "pos", (F.col("idx") + F.col("pos") % 2 * 3).alias("idx"))
    return L.lookup_palette(moved, pal).select("image_id", "pos", "idx", "r", "g", "b", "a")


@register("j8_unmatched_pixels", f"SELECT image_id, pos, {_ARGB} AS argb FROM v_vec_px p WHERE NOT EXISTS (SELECT 1 FROM v_vec_px q WHERE q.image_id = p.image_id AND q.pos % 2 = 0 AND q.r = p.r AND q.g = p.g AND q.b = p.b AND q.a = p.a)")
def j8(spark: SparkSession, d: str) -> DataFrame:
    p = X.vec_px(spark, d)
    return L.unmatched_pixels(p, L.build_palette(p.filter("pos % 2 = 0")))


@register("w3_palette_delta", f"WITH {_PAL} SELECT image_id, idx, " + ", ".join(_wrap(f"{ch} - coalesce(lag({ch}) OVER (PARTITION BY image_id ORDER BY idx), 0)") + f" AS {ch}" for ch in "rgba") + " FROM pal")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return L.palette_delta(L.build_palette(X.idx_px(spark, d)))


@register("w3_palette_round_trip", f"WITH {_PAL} SELECT image_id, idx, r, g, b, a FROM pal")
def w3_back(spark: SparkSession, d: str) -> DataFrame:
    return L.palette_undelta(w3(spark, d))


@register("a7_has_alpha", "SELECT image_id, bool_or(a <> 255) AS has_alpha FROM v_vec_px GROUP BY 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return P.has_alpha(X.vec_px(spark, d))


_HITS = f"c AS (SELECT *, {_ARGB} AS argb, {_SLOT.format(_ARGB, 1 << 28)}::INT AS slot FROM v_idx_px), hits AS (SELECT *, coalesce(lag(argb) OVER (PARTITION BY image_id, slot ORDER BY pos), 0) = argb AND pos > 0 AS hit FROM c)"


@register("w2_cache_hits", f"WITH {_HITS} SELECT image_id, pos, slot, hit FROM hits")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return P.cache_hits(X.idx_px(spark, d)).select("image_id", "pos", "slot", "hit")


@register("w10_expand_cache_round_trip", f"SELECT image_id, pos, {_ARGB} AS argb FROM v_idx_px")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return P.expand_cache(P.cache_tokens(P.cache_hits(X.idx_px(spark, d))))


# --- matches ------------------------------------------------------------------------------------------------------------

_H14 = lambda c: _SLOT.format(c, 1 << 18) + "::BIGINT"
_CAND = f"""c AS (SELECT image_id, pos, {_ARGB} AS p0 FROM v_idx_px), d AS (SELECT *, lead(p0) OVER w AS p1, lead(p0, 2) OVER w AS p2 FROM c WINDOW w AS (PARTITION BY image_id ORDER BY pos)),
    k AS (SELECT image_id, pos, xor(xor({_H14("p0")}, {_H14("p1")} * 2654435769), {_H14("p2")} * 2246822507) & 16383 AS bucket FROM d WHERE p2 IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY image_id, bucket ORDER BY pos) AS rn FROM k),
    cand AS (SELECT b.image_id, b.pos, a.pos AS from_pos, b.pos - a.pos AS dist FROM n b JOIN n a ON a.image_id = b.image_id AND a.bucket = b.bucket AND a.rn BETWEEN b.rn - 8 AND b.rn - 1)"""


@register("w5_j6_match_candidates", f"WITH {_CAND} SELECT * FROM cand")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return M.match_candidates(X.idx_px(spark, d))


@register("t3_longest_match", f"""WITH {_CAND}, ext(image_id, pos, dist, len) AS (SELECT image_id, pos, dist, 0 FROM cand
        UNION ALL SELECT e.image_id, e.pos, e.dist, e.len + 1 FROM ext e JOIN c x ON x.image_id = e.image_id AND x.pos = e.pos + e.len JOIN c y ON y.image_id = e.image_id AND y.pos = e.pos - e.dist + e.len WHERE x.p0 = y.p0 AND e.len < 4096),
    l AS (SELECT image_id, pos, dist, max(len) AS len FROM ext GROUP BY 1, 2, 3)
    SELECT image_id, pos, dist, len::INT AS len FROM (SELECT *, row_number() OVER (PARTITION BY image_id, pos ORDER BY len DESC, dist) AS k FROM l WHERE len >= 3) WHERE k = 1""")
def t3(spark: SparkSession, d: str) -> DataFrame:
    p = X.idx_px(spark, d)
    return M.longest_match(M.match_lengths(M.match_candidates(p), p))


@register("h1_backref_parse")
def h1(spark: SparkSession, d: str) -> DataFrame:
    return M.backref_tokens(X.doc_px(spark, d))


# The greedy parse step by step: what was visited, the nearest eight of those with the same three-pixel hash, the longest match of them (of equal ones the nearest).
_PARSE = f"""{_CAND}, {_HITS.replace("c AS (", "hc AS (", 1).replace("FROM c)", "FROM hc)")},
    seq AS MATERIALIZED (SELECT c.image_id, list(p0 ORDER BY c.pos) AS p, list(bucket ORDER BY c.pos) AS b, count(*) AS n FROM c LEFT JOIN k ON k.image_id = c.image_id AND k.pos = c.pos GROUP BY 1),
    parse(image_id, tok, pos, len, dist, here, seen) AS (SELECT image_id, -1::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM seq
        UNION ALL SELECT image_id, tok + 1, here, CASE WHEN m.len >= 3 THEN m.len ELSE 0 END, CASE WHEN m.len >= 3 THEN m.dist ELSE 0 END, here + CASE WHEN m.len >= 3 THEN m.len ELSE 1 END, CASE WHEN here + 2 < n THEN list_append(seen, here) ELSE seen END
        FROM (SELECT q.image_id, tok, here, seen, n, list_sort(list_transform(list_reverse(list_filter(seen, lambda v: here + 2 < n AND b[v + 1] = b[here + 1] AND here - v < {M.FARTHEST}))[1 : {M.PROBES}],
                lambda v: struct_pack(less := -least({M.LONGEST}, coalesce(list_min(list_filter(range(0, n - here), lambda i: p[v + i + 1] <> p[here + i + 1])), n - here)), dist := here - v)))[1] AS best
            FROM parse q JOIN seq ON seq.image_id = q.image_id WHERE here < n) u, LATERAL (SELECT coalesce(-best.less, 0) AS len, coalesce(best.dist, 0) AS dist) m),
    toks AS (SELECT q.image_id, tok, q.pos, CASE WHEN len > 0 THEN 'copy' WHEN hit THEN 'cache' ELSE 'literal' END AS kind, g, r, b, a, len, dist, slot FROM parse q JOIN hits h ON h.image_id = q.image_id AND h.pos = q.pos)"""


@register("h1_backref_tokens", f"""WITH {_PARSE} SELECT image_id, tok, pos, kind, {", ".join(f"CASE WHEN kind = 'literal' THEN {ch} END AS {ch}" for ch in "grba")},
    CASE WHEN kind = 'copy' THEN len END::INT AS len, CASE WHEN kind = 'copy' THEN dist END AS dist, CASE WHEN kind = 'cache' THEN slot END AS slot FROM toks""")
def h1_tokens(spark: SparkSession, d: str) -> DataFrame:
    return M.backref_tokens(X.idx_px(spark, d))


@register("h2_backref_round_trip", f"SELECT image_id, pos, {_ARGB} AS argb, NULL::VARCHAR AS error FROM v_idx_px")
def h2(spark: SparkSession, d: str) -> DataFrame:
    return M.backref_expand(M.backref_tokens(X.idx_px(spark, d)))


# --- symbols and codes --------------------------------------------------------------------------------------------------


def _cache_tokens(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    h = P.cache_hits(X.idx_px(spark, d))
    literal = lambda ch: F.when(~F.col("hit"), F.col(ch)).alias(ch)
    return h.select("image_id", F.col("pos").alias("tok"), "pos", F.when(F.col("hit"), "cache").otherwise("literal").alias("kind"), *(literal(c) for c in "grba"), none.cast("int").alias("len"), none.cast("long").alias("dist"), F.when(F.col("hit"), F.col("slot")).alias("slot"))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    t = _cache_tokens(spark, d)
    return C.tokens_to_symbols(t, t.select("image_id").distinct().withColumn("width", F.lit(16)))


_SYMS = f"""{_HITS}, syms AS (SELECT image_id, 'main' AS stream, pos * 4 AS seq, 0 AS alphabet, CASE WHEN hit THEN slot + 280 ELSE g END AS symbol FROM hits
    UNION ALL SELECT image_id, 'main', pos * 4 + 1, 1, r FROM hits WHERE NOT hit UNION ALL SELECT image_id, 'main', pos * 4 + 2, 2, b FROM hits WHERE NOT hit UNION ALL SELECT image_id, 'main', pos * 4 + 3, 3, a FROM hits WHERE NOT hit),
    hist AS (SELECT image_id, stream, alphabet, symbol, count(*) AS n FROM syms GROUP BY ALL)"""


@register("p19_tokens_to_symbols", f"WITH {_SYMS} SELECT *, 0::BIGINT AS extra, 0 AS extra_bits FROM syms")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d)


@register("p19_copy_symbols", f"""WITH {_PARSE}, cells(code, dx, dy) AS (VALUES {_NEAR}),
    w AS (SELECT *, CASE WHEN dist % 16 <= 8 AND dist // 16 < 8 THEN dist % 16 WHEN dist % 16 > 8 AND dist // 16 < 7 THEN dist % 16 - 16 END AS cx, CASE WHEN dist % 16 <= 8 AND dist // 16 < 8 THEN dist // 16 WHEN dist % 16 > 8 AND dist // 16 < 7 THEN dist // 16 + 1 END AS cy FROM toks WHERE kind = 'copy'),
    v AS (SELECT image_id, 0 AS alphabet, 256 AS base, len AS n FROM w UNION ALL SELECT image_id, 4, 0, coalesce(code, dist + 120) FROM w LEFT JOIN cells ON cx = dx AND cy = dy),
    s AS (SELECT image_id, alphabet, base + {_SYM} AS symbol FROM v UNION ALL SELECT image_id, 0, slot + 280 FROM toks WHERE kind = 'cache'
        UNION ALL SELECT image_id, alphabet, symbol FROM (SELECT image_id, unnest([0, 1, 2, 3]) AS alphabet, unnest([g, r, b, a]) AS symbol FROM toks WHERE kind = 'literal'))
    SELECT image_id, 'main' AS stream, alphabet, symbol::INT AS symbol, count(*) AS n FROM s GROUP BY ALL""")
def p19_copies(spark: SparkSession, d: str) -> DataFrame:
    t = M.backref_tokens(X.idx_px(spark, d))
    return C.symbol_histogram(C.tokens_to_symbols(t, t.select("image_id").distinct().withColumn("width", F.lit(16))))


def _hist(spark: SparkSession, d: str) -> DataFrame:
    return C.symbol_histogram(_symbols(spark, d))


@register("a1_symbol_histogram", f"WITH {_SYMS} SELECT * FROM hist")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return _hist(spark, d)


@register("a2_gini_impurity", f"WITH {_SYMS} SELECT image_id, alphabet, round(1 - sum(n::DOUBLE * n) / (sum(n::DOUBLE) * sum(n::DOUBLE)), 9) AS impurity FROM hist GROUP BY 1, 2")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return P.gini_impurity(_hist(spark, d), ["image_id", "alphabet"])


@register("a9_codebook_kraft", f"WITH {_SYMS} SELECT image_id, alphabet, count(*) AS n_symbols, CASE WHEN count(*) = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS kraft, true AS within FROM hist GROUP BY 1, 2")
def a9(spark: SparkSession, d: str) -> DataFrame:
    b = C.codebook_lengths(_hist(spark, d))
    return b.groupBy("image_id", "alphabet").agg(F.count("*").alias("n_symbols"), F.sum(F.pow(F.lit(2.0), -F.col("depth"))).alias("kraft"), (F.max("depth") <= 15).alias("within"))


def _swap(h: str, i: str, j: str) -> str:
    return f"list_transform(range(1, len({h}) + 1), lambda q: CASE WHEN q = {i} THEN {h}[{j}] WHEN q = {j} THEN {h}[{i}] ELSE {h}[q] END)"


def _pushed(h: str, new: str) -> str:
    """A heap with one more node in SQL: it goes up past every ancestor that is strictly heavier."""
    up = "CASE WHEN s.i > 1 AND s.h[s.i].w < s.h[s.i // 2].w THEN struct_pack(h := {}, i := s.i // 2) ELSE s END".format(_swap("s.h", "s.i", "(s.i // 2)"))
    return f"list_reduce(list_transform(range(12), lambda z: struct_pack(h := list_append({h}, {new}), i := len({h}) + 1)), lambda s, z: {up}).h"


def _popped(h: str) -> str:
    """A heap without its top in SQL: the last node goes down, to the right only if that child is strictly lighter, and stays above one that is as heavy."""
    child = "CASE WHEN 2 * s.i + 1 <= len(s.h) AND s.h[2 * s.i + 1].w < s.h[2 * s.i].w THEN 2 * s.i + 1 ELSE 2 * s.i END"
    down = f"CASE WHEN 2 * s.i > len(s.h) OR s.h[s.i].w <= s.h[{child}].w THEN s ELSE struct_pack(h := {_swap('s.h', 's.i', f'({child})')}, i := {child}) END"
    rest = f"CASE WHEN len({h}) = 1 THEN []::STRUCT(w BIGINT, id BIGINT)[] ELSE list_concat([{h}[len({h})]], {h}[2 : len({h}) - 1]) END"
    return f"list_reduce(list_transform(range(12), lambda z: struct_pack(h := {rest}, i := 1::BIGINT)), lambda s, z: {down}).h"


# Code lengths with the heap's own order of equal weights: nodes are pushed in the order of symbols, then the two at the top are joined again and again; a leaf's depth is how often it is joined.
_HEAP = f"""
    grp AS MATERIALIZED (SELECT image_id, alphabet, list(symbol ORDER BY symbol) AS symbols, list(greatest(n, total >> 13)::BIGINT ORDER BY symbol) AS ws FROM (SELECT *, sum(n) OVER (PARTITION BY image_id, alphabet)::BIGINT AS total FROM hist) GROUP BY 1, 2),
    fill(image_id, alphabet, k, h) AS (SELECT image_id, alphabet, 0::BIGINT, []::STRUCT(w BIGINT, id BIGINT)[] FROM grp
        UNION ALL SELECT f.image_id, f.alphabet, k + 1, {_pushed("f.h", "struct_pack(w := g.ws[k + 1], id := k + 1)")} FROM fill f JOIN grp g ON g.image_id = f.image_id AND g.alphabet = f.alphabet WHERE k < len(g.ws)),
    full_ AS (SELECT f.image_id, f.alphabet, f.h, k + 1 AS next FROM fill f JOIN grp g ON g.image_id = f.image_id AND g.alphabet = f.alphabet WHERE k = len(g.ws)),
    joins(image_id, alphabet, h, next, a, b) AS (SELECT image_id, alphabet, h, next, 0::BIGINT, 0::BIGINT FROM full_
        UNION ALL SELECT image_id, alphabet, {_pushed("h2", "struct_pack(w := h[1].w + h1[1].w, id := next)")}, next + 1, h[1].id, h1[1].id FROM (
            SELECT *, {_popped("h1")} AS h2 FROM (SELECT *, {_popped("h")} AS h1 FROM joins WHERE len(h) > 1))),
    up AS MATERIALIZED (SELECT image_id, alphabet, unnest([a, b]) AS child, unnest([next - 1, next - 1]) AS parent FROM joins WHERE a > 0),
    climb(image_id, alphabet, leaf, here, depth) AS (SELECT image_id, alphabet, unnest(range(1, len(ws) + 1)), unnest(range(1, len(ws) + 1)), 0 FROM grp
        UNION ALL SELECT c.image_id, c.alphabet, leaf, parent, depth + 1 FROM climb c JOIN up u ON u.image_id = c.image_id AND u.alphabet = c.alphabet AND u.child = c.here),
    book AS MATERIALIZED (SELECT c.image_id, 'main' AS stream, c.alphabet, symbols[leaf] AS symbol, CASE WHEN len(ws) = 1 THEN -1 ELSE max(depth) END AS depth FROM climb c JOIN grp g ON g.image_id = c.image_id AND g.alphabet = c.alphabet GROUP BY c.image_id, c.alphabet, leaf, symbols, ws)"""
_BOOK = f"""{_SYMS}, {_HEAP}, codes AS (SELECT *, ((coalesce(sum(1::BIGINT << (15 - depth)) OVER (PARTITION BY image_id, alphabet ORDER BY depth, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT >> (15 - depth))::BIGINT AS code FROM book WHERE depth > 0)"""


@register("a9_codebook_lengths", f"WITH {_SYMS}, {_HEAP} SELECT * FROM book")
def a9_all(spark: SparkSession, d: str) -> DataFrame:
    return C.codebook_lengths(_hist(spark, d))


def _book(spark: SparkSession, d: str) -> DataFrame:
    return C.codebook_lengths(_hist(spark, d))


@register("w6_canonical_codes", f"WITH {_BOOK} SELECT * FROM codes")
def w6(spark: SparkSession, d: str) -> DataFrame:
    return C.canonical_codes(_book(spark, d))


_CODED = f"{_BOOK}, coded AS (SELECT s.image_id, s.stream, seq, s.alphabet, s.symbol, coalesce(depth, 0) AS depth, coalesce(code, 0) AS code FROM syms s LEFT JOIN codes c ON c.image_id = s.image_id AND c.alphabet = s.alphabet AND c.symbol = s.symbol)"


@register("j5_apply_codebook", f"WITH {_CODED} SELECT * FROM coded")
def j5(spark: SparkSession, d: str) -> DataFrame:
    return C.apply_codebook(_symbols(spark, d), C.canonical_codes(_book(spark, d))).drop("extra", "extra_bits")


@register("w7_bit_offsets", f"WITH {_CODED} SELECT image_id, seq, depth, coalesce(sum(depth) OVER (PARTITION BY image_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM coded")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return C.bit_offsets(C.apply_codebook(_symbols(spark, d), C.canonical_codes(_book(spark, d)))).select("image_id", "seq", "depth", "start")


@register("h6_pack_bits", f"""WITH {_CODED}, o AS (SELECT *, coalesce(sum(depth) OVER (PARTITION BY image_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM coded),
    bits AS (SELECT image_id, start + i AS place, (code >> (depth - 1 - i)) & 1 AS bit FROM o, range(15) t(i) WHERE i < depth),
    bytes AS (SELECT image_id, place // 8 AS k, sum(bit << (place % 8)::INT)::INT AS v FROM bits GROUP BY 1, 2)
    SELECT image_id, md5(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY k)) AS digest, count(*) AS n FROM bytes GROUP BY 1""")
def h6(spark: SparkSession, d: str) -> DataFrame:
    packed = C.pack_bits(C.apply_codebook(_symbols(spark, d), C.canonical_codes(_book(spark, d))))
    return packed.select("image_id", F.md5(F.hex("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("long").alias("n"))


@register("a10_coded_size", f"WITH {_BOOK} SELECT h.image_id, h.stream, h.alphabet, sum(n * greatest(depth, 0))::BIGINT AS bits FROM hist h JOIN book b ON b.image_id = h.image_id AND b.alphabet = h.alphabet AND b.symbol = h.symbol GROUP BY 1, 2, 3")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return C.coded_size(_hist(spark, d), _book(spark, d))


@register("a11_depth_histogram", f"WITH {_BOOK} SELECT image_id, stream, alphabet, depth, count(*) AS n FROM book GROUP BY ALL")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return C.depth_histogram(_book(spark, d))


@register("a12_alphabet_summary", f"WITH {_SYMS} SELECT image_id, stream, alphabet, count(*) AS used, sum(n)::BIGINT AS total, CASE alphabet WHEN 0 THEN 296 WHEN 4 THEN 40 ELSE 256 END AS size FROM hist GROUP BY 1, 2, 3")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return C.alphabet_summary(_hist(spark, d), 4)


@register("t1_top_symbols", f"WITH {_SYMS} SELECT image_id, stream, alphabet, symbol, n, rank, CASE alphabet WHEN 0 THEN CASE WHEN symbol < 256 THEN 'G' || symbol WHEN symbol < 280 THEN 'LEN' || (symbol - 256) ELSE 'CC' || (symbol - 280) END WHEN 1 THEN 'R' || symbol WHEN 2 THEN 'B' || symbol WHEN 3 THEN 'A' || symbol END AS label FROM (SELECT *, row_number() OVER (PARTITION BY image_id, alphabet ORDER BY n DESC, symbol) AS rank FROM hist) WHERE rank <= 3")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return C.top_symbols(_hist(spark, d), 3)


@register("t2_codebook_listing", f"WITH {_BOOK} SELECT image_id, stream, alphabet, row, symbol, depth, lpad(bin(code), depth::INT, '0') AS bits FROM (SELECT *, row_number() OVER (PARTITION BY image_id, alphabet ORDER BY depth, symbol) AS row FROM codes) WHERE row <= 4")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return C.codebook_listing(C.canonical_codes(_book(spark, d)), 4)


def _chosen(source: str) -> str:
    """Residuals of each image of a table under its best mode in SQL; 4 x 4 pixels are one tile of 16."""
    every = " UNION ALL ".join(f"SELECT image_id, pos, x, y, {m} AS mode, '{ch}' AS ch, {_wrap(f'{ch} - {_guess(m, ch)}')} AS symbol FROM nb" for m in range(14) for ch in "rgba")
    scores = _SCORES[len(_RESIDUALS) :].replace("tx, ty, ", "")
    return f"""WITH {_NB.replace("v_vec_px", source)}, e AS MATERIALIZED ({every}){scores}, best AS (SELECT image_id, arg_min(mode, (score, mode)) AS mode FROM s GROUP BY 1)
        SELECT image_id, pos, x, y, {", ".join(f"max(symbol) FILTER (ch = '{ch}') AS {ch}" for ch in "rgba")} FROM e JOIN best USING (image_id, mode) GROUP BY 1, 2, 3, 4"""


_BITS = f"CASE WHEN n <= 5 THEN 0 ELSE (({_SYM}) - 2) >> 1 END"


def _plain_symbols(technique: str, source: str) -> str:
    return f"SELECT '{technique}' AS technique, image_id, unnest([0, 1, 2, 3]) AS alphabet, unnest([g, r, b, a]) AS symbol, 0 AS extra_bits FROM {source}"


def _token_symbols(technique: str, tokens: str) -> str:
    """Symbols of tokens of images four pixels wide in SQL."""
    return f"""{_plain_symbols(technique, tokens)} WHERE kind = 'literal' UNION ALL SELECT '{technique}', image_id, 0, slot + 280, 0 FROM {tokens} WHERE kind = 'cache'
        UNION ALL SELECT '{technique}', image_id, alphabet, base + {_SYM}, {_BITS} FROM (SELECT image_id, 0 AS alphabet, 256 AS base, len AS n FROM {tokens} WHERE kind = 'copy'
            UNION ALL SELECT image_id, 4, 0, coalesce(code, dist + 120) FROM {tokens} LEFT JOIN cells ON dist % 4 = dx AND dist // 4 = dy WHERE kind = 'copy')"""


_TOKEN_COLUMNS = "image_id, g, r, b, a, len, dist, slot"
# Totals stay under 2**13, so weights are counts, and the bits of a book are the sums of all its joins, whatever the order of equal ones.
_REPORT = f"""WITH cells(code, dx, dy) AS (VALUES {_NEAR}),
    green AS MATERIALIZED (SELECT image_id, pos, x, y, (r - g + 256) % 256 AS r, g, (b - g + 256) % 256 AS b, a FROM v_vec_px),
    crossed AS (SELECT image_id, {_wrap(f"r - {_down5('3', 'g')}")} AS r, g, {_wrap(f"b - {_down5('2', 'g')} - {_down5('1', 'r')}")} AS b, a FROM v_vec_px),
    predicted AS MATERIALIZED ({_chosen("v_vec_px")}), mixed AS MATERIALIZED ({_chosen("green")}),
    cached AS MATERIALIZED (WITH {_HITS.replace("v_idx_px", "v_vec_px")} SELECT image_id, g, r, b, a, NULL::BIGINT AS len, NULL::BIGINT AS dist, slot, CASE WHEN hit THEN 'cache' ELSE 'literal' END AS kind FROM hits),
    copied AS MATERIALIZED (WITH RECURSIVE {_PARSE.replace("v_idx_px", "v_vec_px")} SELECT {_TOKEN_COLUMNS}, CASE WHEN kind = 'copy' THEN kind ELSE 'literal' END AS kind FROM toks),
    both_ AS MATERIALIZED (WITH RECURSIVE {_PARSE.replace("v_idx_px", "mixed")} SELECT {_TOKEN_COLUMNS}, kind FROM toks),
    packed AS MATERIALIZED (WITH {_INDEXED}, z AS (SELECT *, CASE WHEN n_colors <= 2 THEN 8 WHEN n_colors <= 4 THEN 4 WHEN n_colors <= 16 THEN 2 ELSE 1 END AS size FROM ix)
        SELECT image_id, sum(idx << ((x % size) * (8 // size)))::INT AS packed FROM z GROUP BY image_id, x // size, y, size),
    every AS ({_plain_symbols("plain", "v_vec_px")} UNION ALL {_plain_symbols("subtract_green", "green")} UNION ALL {_plain_symbols("cross_color", "crossed")} UNION ALL {_plain_symbols("predictor", "predicted")}
        UNION ALL {_token_symbols("cache", "cached")} UNION ALL {_token_symbols("back_references", "copied")} UNION ALL {_token_symbols("default", "both_")} UNION ALL SELECT 'palette', image_id, 0, packed, 0 FROM packed),
    counts AS (SELECT technique, image_id, alphabet, symbol, count(*) AS n, sum(extra_bits) AS extra_bits FROM every GROUP BY ALL),
    joined(technique, image_id, ws, bits) AS (SELECT technique, image_id, list_sort(list(n)), sum(extra_bits)::BIGINT FROM counts GROUP BY technique, image_id, alphabet
        UNION ALL SELECT technique, image_id, list_sort(list_append(ws[3:], ws[1] + ws[2])), bits + ws[1] + ws[2] FROM joined WHERE len(ws) > 1)
    SELECT technique, image_id, sum(bits)::BIGINT AS bits FROM joined WHERE len(ws) = 1 GROUP BY ROLLUP (technique, image_id)"""


@register("a15_technique_report", _REPORT)
def a15(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.report import technique_report

    return technique_report(X.vec_px(spark, d), X.idx_px(spark, d), 4)


_BOTH = """x AS (SELECT * FROM v_doc_px UNION ALL SELECT * FROM v_doc_px WHERE pos % 89 = 3),
    y AS (SELECT image_id, pos, x, y, r, CASE WHEN pos % 97 = 5 THEN g + 1 ELSE g END AS g, b, a FROM x WHERE pos % 101 <> 7 UNION ALL SELECT * FROM v_doc_px WHERE pos % 83 = 2)"""


@register("j7_golden_diff", f"""WITH {_BOTH}, d AS (SELECT image_id, pos, r, g, b, a, 1 AS extra, 0 AS missing FROM (SELECT image_id, pos, r, g, b, a FROM x EXCEPT ALL SELECT image_id, pos, r, g, b, a FROM y)
        UNION ALL SELECT image_id, pos, r, g, b, a, 0, 1 FROM (SELECT image_id, pos, r, g, b, a FROM y EXCEPT ALL SELECT image_id, pos, r, g, b, a FROM x)),
    k AS (SELECT image_id, pos, sum(extra) AS extra, sum(missing) AS missing FROM d GROUP BY 1, 2),
    e AS (SELECT image_id, pos, unnest(['changed', 'extra', 'missing']) AS side, unnest([least(extra, missing), extra - least(extra, missing), missing - least(extra, missing)])::BIGINT AS n FROM k)
    SELECT image_id, side, count(*) AS n_keys, sum(n)::BIGINT AS n_different FROM e WHERE n > 0 GROUP BY 1, 2""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    """Texts as images, some pixels twice, against a copy with pixels changed, taken out and repeated."""
    p = X.doc_px(spark, d)
    twice = F.explode(F.when(F.col("pos") % 89 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    actual = p.withColumn("_copy", twice).drop("_copy")
    other = actual.filter("pos % 101 != 7").withColumn("g", F.when(F.col("pos") % 97 == 5, F.col("g") + 1).otherwise(F.col("g"))).unionByName(p.filter("pos % 83 = 2"))
    return V.mismatches(V.golden_diff(actual, other, ["image_id", "pos"], ["r", "g", "b", "a"]))


@register("a13_transform_check", "SELECT l_orderkey AS image_id, l_linestatus || l_returnflag AS type, 'repeated_transform' AS error FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", plain=True)
def a13(spark: SparkSession, d: str) -> DataFrame:
    t = X.table(spark, d, "lineitem")
    return V.transform_check(t.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("step"), F.concat("l_linestatus", "l_returnflag").alias("type")))


# --- containers ----------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    return K.assemble_container(X.payloads(spark, d))


_OFFSET = "(20 + coalesce(sum(8 + size + size % 2) OVER (PARTITION BY file_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT"


@register("s2_s8_chunk_inventory", f"SELECT file_id, chunk_no::INT AS chunk_no, fourcc, size, {_OFFSET} AS data_offset FROM v_chunks")
def s2(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_inventory(_files(spark, d), strict=True).drop("head")


@register("w8_chunk_offsets", f"SELECT file_id, chunk_no, size, {_OFFSET} AS data_offset FROM v_chunks")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_offsets(X.payloads(spark, d).select("file_id", "chunk_no", F.octet_length("payload").cast("long").alias("size")))


@register("a14_container_sizes", "SELECT file_id, (4 + sum(8 + size + size % 2))::BIGINT AS riff_size FROM v_chunks GROUP BY 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return K.container_sizes(X.payloads(spark, d).select("file_id", F.octet_length("payload").alias("size")))


def _le(n: str, k: int) -> str:
    """A number's k bytes, lowest first, as hexadecimal digits in SQL."""
    return "(" + " || ".join(f"lpad(upper(to_hex((({n})::BIGINT >> {8 * i}) & 255)), 2, '0')" for i in range(k)) + ")"


@register("s8_container_bytes", f"""SELECT file_id, (12 + sum(8 + size + size % 2))::BIGINT AS n,
    md5('52494646' || {_le("4 + sum(8 + size + size % 2)", 4)} || '57454250' || string_agg(hex(encode(fourcc)) || {_le("size", 4)} || hex(payload) || CASE WHEN size % 2 = 1 THEN '00' ELSE '' END, '' ORDER BY chunk_no)) AS digest FROM v_chunks GROUP BY 1""")
def s8(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", F.octet_length("content").cast("long").alias("n"), F.md5(F.hex("content").cast("binary")).alias("digest"))


@register("s4_describe_files", """WITH s AS (SELECT file_id, 'RIFF, ' || (4 + sum(8 + size + size % 2))::BIGINT || ' bytes, WEBP, ' || string_agg(fourcc || ', ' || size || ' bytes', ', ' ORDER BY chunk_no) AS summary FROM v_chunks GROUP BY 1),
    n AS (SELECT file_id, copy, k, count(fourcc) AS n, string_agg(', ' || fourcc || ', ' || size || ' bytes', '' ORDER BY chunk_no) AS parts, sum(8 + size + size % 2) AS bytes
        FROM (SELECT m.file_id, m.copy, m.k, c.chunk_no, c.fourcc, CASE c.fourcc WHEN 'VP8L' THEN 6 WHEN 'ALPH' THEN 3 WHEN 'ANIM' THEN 6 WHEN 'ANMF' THEN 16 ELSE 10 END AS size
            FROM v_media m LEFT JOIN v_media_chunks c ON c.file_id = m.file_id AND c.copy = m.copy) GROUP BY ALL)
    SELECT file_id, summary, NULL::VARCHAR AS error FROM s
    UNION ALL SELECT file_id, CASE WHEN k <> 9 THEN 'RIFF, ' || (4 + CASE WHEN n > 0 THEN bytes ELSE 0 END)::BIGINT || ' bytes, WEBP' || CASE WHEN n > 0 THEN parts ELSE '' END END, CASE WHEN k = 9 THEN 'truncated' END FROM n""")
def s4(spark: SparkSession, d: str) -> DataFrame:
    return K.describe_files(K.walk_files(_files(spark, d).union(X.media(spark, d).select("file_id", "content"))))


@register("s3_chunk_errors", """SELECT file_id, CASE file_id % 5 WHEN 1 THEN 'invalid_signature' WHEN 2 THEN 'not_webp' WHEN 3 THEN 'truncated' ELSE 'chunk_out_of_range' END AS error,
    CASE file_id % 5 WHEN 1 THEN 0 WHEN 2 THEN 8 WHEN 3 THEN 4 ELSE 12 END::BIGINT AS at_offset, CASE file_id % 5 WHEN 1 THEN 'RIFX' WHEN 2 THEN 'WEBM' WHEN 4 THEN fourcc END AS fourcc FROM v_chunks WHERE file_id % 5 <> 0 AND chunk_no = 0""")
def s3(spark: SparkSession, d: str) -> DataFrame:
    f, k, c = _files(spark, d), F.col("file_id") % 5, F.col("content")
    n = F.octet_length(c)
    part = lambda a, size: F.substr(c, F.lit(a), size)
    broken = F.when(k == 1, F.concat(F.encode(F.lit("RIFX"), "US-ASCII"), part(5, n))).when(k == 2, F.concat(part(1, F.lit(8)), F.encode(F.lit("WEBM"), "US-ASCII"), part(13, n))).when(k == 3, part(1, n - 3)).when(k == 4, F.concat(part(1, F.lit(16)), F.unhex(F.lit("FFFFFF7F")), part(21, n))).otherwise(c)
    return K.chunk_errors(f.withColumn("content", broken), strict=True)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


@register("s1_read_media", f"SELECT file_id, (12 + sum(8 + size + size % 2))::BIGINT AS length, md5('52494646' || {_le("4 + sum(8 + size + size % 2)", 4)} || '57454250' || string_agg(hex(encode(fourcc)) || {_le("size", 4)} || hex(payload) || CASE WHEN size % 2 = 1 THEN '00' ELSE '' END, '' ORDER BY chunk_no)) AS digest, count(*) AS n_chunks FROM v_chunks GROUP BY 1")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as files in folders by id, written and read again by the source of binary files, then walked."""
    at = _folder(spark, "files")
    write_files(_files(spark, d).select("file_id", "content"), at)
    files = read_files(spark, at).select("file_id", "content", F.octet_length("content").cast("long").alias("length"), F.md5(F.hex("content").cast("binary")).alias("digest"))
    return K.walk_files(files, strict=True, keep=("length", "digest")).select("file_id", "length", "digest", F.size("chunks").cast("long").alias("n_chunks"))


@register("s11_write_media", "SELECT image_id, pos, r, g, b, a FROM v_vec_px WHERE image_id = 7")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """Pixels written in folders by a hash of their image; one image's are read from its folder alone."""
    at = _folder(spark, "blobs")
    write_media(X.vec_px(spark, d), at, "image_id", 16)
    return read_bucket(spark.read.parquet(at), "image_id", 7, 16).select("image_id", "pos", *"rgba")


def _walked(spark: SparkSession, d: str) -> DataFrame:
    return K.walk_files(X.media(spark, d))


@register("f1_lossless_header", "SELECT file_id, 47 AS magic, p_size AS width, file_id % 1000 + 1 AS height, file_id % 2 AS alpha_hint, 0 AS version FROM v_media_chunks WHERE fourcc = 'VP8L'")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return K.lossless_header(K.chunk_rows(_walked(spark, d))).drop("chunk_no")


@register("f2_lossy_header", """SELECT file_id, true AS key_frame, 0 AS version, true AS show, file_id % 4096 AS first_partition, true AS start_ok, p_size AS width, file_id % 1000 + 1 AS height,
    file_id % 4 AS x_scale, 0 AS y_scale, (p_size + 15) // 16 AS mb_width, (file_id % 1000 + 16) // 16 AS mb_height FROM v_media_chunks WHERE fourcc = 'VP8 '""")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return K.lossy_header(K.chunk_rows(_walked(spark, d))).drop("chunk_no")


@register("f3_canvas_header", "SELECT file_id, chunk_no, k IN (2, 5, 10) AS has_alpha, k = 7 AS animated, p_size AS width, file_id % 1000 + 1 AS height, NULL::VARCHAR AS error FROM v_media_chunks WHERE fourcc = 'VP8X'")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return K.canvas_header(K.chunk_rows(_walked(spark, d)))


@register("f4_alpha_header", "SELECT file_id, file_id % 4 AS compression, file_id % 16 // 4 AS filter FROM v_media_chunks WHERE fourcc = 'ALPH'")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return K.alpha_header(K.chunk_rows(_walked(spark, d))).drop("chunk_no")


_CATALOG = """SELECT file_id, CASE WHEN k IN (0, 3) THEN 'lossless' WHEN k = 1 THEN 'lossy' WHEN k = 2 THEN 'lossy+alpha' END AS format, CASE WHEN k < 4 THEN p_size END AS width, CASE WHEN k < 4 THEN file_id % 1000 + 1 END AS height,
    CASE WHEN k IN (0, 3) THEN file_id % 2 = 1 WHEN k = 1 THEN false WHEN k = 2 THEN true END AS has_alpha,
    CASE k WHEN 4 THEN 'unexpected_alpha' WHEN 5 THEN 'lossless_with_alpha' WHEN 6 THEN 'repeated_extended_header' WHEN 7 THEN 'invalid_format' WHEN 8 THEN 'invalid_format' WHEN 9 THEN 'truncated' WHEN 10 THEN 'unexpected_alpha' END AS error FROM v_media"""


@register("f5_image_catalog", _CATALOG)
def f5(spark: SparkSession, d: str) -> DataFrame:
    return K.image_catalog(_walked(spark, d))


@register("w9_dispatch_state", """WITH s AS (SELECT file_id, chunk_no, fourcc, count(*) FILTER (fourcc = 'VP8X') OVER w AS n_extended, coalesce(bool_or(fourcc = 'VP8X' AND k IN (2, 5, 10)) OVER w, false) AS promised, coalesce(bool_or(fourcc = 'ALPH') OVER w, false) AS alpha_seen
    FROM v_media_chunks WINDOW w AS (PARTITION BY file_id, copy ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT * FROM s""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return K.dispatch_state(_walked(spark, d)).drop("size", "data_offset", "head")


@register("p16_clamp_frames", "SELECT anim_id, frame_no, least(duration, 16777215) AS duration, least(disposal, 1) AS disposal FROM v_frames")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return K.clamp_frames(X.frames(spark, d)).select("anim_id", "frame_no", "duration", "disposal")


@register("a8_animation_summary", "SELECT anim_id, count(*) AS n_frames, max(width) AS width, max(height) AS height, bool_or(has_alpha) AS has_alpha, sum(n)::BIGINT AS payload_bytes, sum(least(duration, 16777215))::BIGINT AS total_duration, NULL::VARCHAR AS error FROM v_frames GROUP BY 1")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return K.animation_summary(X.frames(spark, d))


@register("s9_assemble_animation", f"""WITH a AS (SELECT anim_id, (12 + 18 + 14 + sum(8 + 16 + 8 + n + n % 2))::BIGINT AS length, max(width) AS w, max(height) AS h, bool_or(has_alpha) AS alpha FROM v_frames GROUP BY 1)
    SELECT anim_id, length, 0 AS chunk_no, 'VP8X' AS fourcc, 10::BIGINT AS size, CASE WHEN alpha THEN '12000000' ELSE '02000000' END || {_le("w - 1", 3)} || {_le("h - 1", 3)} AS fields FROM a
    UNION ALL SELECT anim_id, length, 1, 'ANIM', 6, 'FFFFFFFF0000' FROM a
    UNION ALL SELECT f.anim_id, length, 2 + frame_no, 'ANMF', 24 + n + n % 2, '000000000000' || {_le("width - 1", 3)} || {_le("height - 1", 3)} || {_le("least(duration, 16777215)", 3)} || {_le("least(disposal, 1)", 1)} || '5650384C' || {_le("n", 4)} FROM v_frames f JOIN a ON a.anim_id = f.anim_id""")
def s9(spark: SparkSession, d: str) -> DataFrame:
    """Length of each file, and every chunk with its fixed fields: of a frame those before its payload."""
    f = X.frames(spark, d)
    a = K.assemble_animation(f, f.select("anim_id").distinct().select("anim_id", F.lit(0).alias("loop_count"), F.lit(0xFFFFFFFF).alias("background")))
    length = F.octet_length("content").cast("long")
    # the length goes through the walk as a part of the id, so that files are made once
    walked = K.walk_files(a.select((F.col("anim_id") * (1 << 31) + length).alias("file_id"), "content"), strict=True)
    fields = F.substring(F.hex("head"), 1, 48)
    return K.chunk_rows(walked).select(F.shiftright("file_id", 31).alias("anim_id"), F.col("file_id").bitwiseAND(F.lit((1 << 31) - 1)).alias("length"), "chunk_no", "fourcc", "size", fields.alias("fields"))


@register("s10_vp8x_bytes", """SELECT anim_id, frame_no, CASE WHEN has_alpha THEN '12' ELSE '02' END || '000000' || lpad(upper(to_hex((width - 1) % 256)), 2, '0') || lpad(upper(to_hex((width - 1) // 256)), 2, '0') || '00'
    || lpad(upper(to_hex((height - 1) % 256)), 2, '0') || lpad(upper(to_hex((height - 1) // 256)), 2, '0') || '00' AS header FROM v_frames""")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return X.frames(spark, d).select("anim_id", "frame_no", F.hex(K.vp8x_bytes(F.col("width"), F.col("height"), F.col("has_alpha"), F.lit(True))).alias("header"))
