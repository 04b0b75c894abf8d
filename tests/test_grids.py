"""Walks over grids, coding chains and files on literal and odd input, against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import coding as C
from tessera.operators import matching as M
from tessera.operators import palette as L
from tessera.operators import pixels as P
from tessera.operators import planes as N
from tessera.plans.report import technique_report
from tessera.sources.media import explode_pixels, read_media, stream_media, write_media

PIXELS = "image_id long, pos long, x int, y int, r int, g int, b int, a int"
PLANE = "image_id long, x int, y int, v int"


def grid(image, width, n, value=lambda k: ((k * 37) % 251, (k * k) % 256, (k * 11) % 200, 255 - k % 3)):
    return [(image, k, k % width, k // width, *value(k)) for k in range(n)]


def of(pixels):
    return sorted((r.image_id, r.x, r.y, r.r, r.g, r.b, r.a) for r in pixels.collect())


def sequence(colors, image=1):
    return [(image, k, k % 16, k // 16, (c >> 16) & 255, (c >> 8) & 255, c & 255, 255) for k, c in enumerate(colors)]


def test_ragged_grid_round_trip(spark):
    """A last row that ends early, rows with nulls, a repeated pixel: modes are chosen, and prediction is undone."""
    whole = grid(1, 7, 38) + grid(2, 1, 5) + grid(3, 9, 9)
    modes = P.sequential_modes(spark.createDataFrame(whole, PIXELS), bits=2)
    assert {(r.image_id, r.tx, r.ty) for r in modes.collect()} == {(i, x >> 2, y >> 2) for i, _, x, y, *_ in whole}
    rest = P.residual(spark.createDataFrame(whole, PIXELS), modes, bits=2)
    odd = spark.createDataFrame([(1, 90, None, 0, 1, 1, 1, 1), (1, 91, 0, 0, None, 1, 1, 1), (None, 0, 0, 0, 1, 1, 1, 1), (9, 0, 0, 0, 1, 1, 1, 1)], PIXELS)
    again = rest.unionByName(rest.filter("pos = 3")).unionByName(odd.select(rest.columns))
    assert of(P.inverse_predict(again, modes, bits=2)) == of(spark.createDataFrame(whole, PIXELS))


def test_sequential_modes_against_plain_python(spark):
    """Each tile's mode by the histograms of all tiles before it, from residuals that another job made."""
    whole = grid(1, 10, 57)
    df = spark.createDataFrame(whole, PIXELS)
    chosen = {(r.tx, r.ty): r["mode"] for r in P.sequential_modes(df, bits=2).collect()}
    rests = {m: {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in P.residual(df, mode=m).collect()} for m in range(14)}
    seen = [Counter() for _ in range(4)]
    for tile in sorted({(x >> 2, y >> 2) for _, _, x, y, *_ in whole}, key=lambda t: (t[1], t[0])):
        inside = [(x, y) for _, _, x, y, *_ in whole if (x >> 2, y >> 2) == tile]
        scores = []
        for m in range(14):
            sums = [seen[k] + Counter(rests[m][at][k] for at in inside) for k in range(4)]
            scores.append((sum(1 - sum(n * n for n in s.values()) / s.total() ** 2 for s in sums), m, sums))
        least = min(s for s, _, _ in scores)
        score, mode, seen = next(s for s in scores if s[1] == chosen[tile])
        assert score == pytest.approx(least, abs=1e-12)


def test_gradient_known_answers(spark):
    """One row and one column add up; inside, left + top - top-left is clamped; gaps, nulls and repeats do no harm."""
    row, column = [(1, x, 0, 1) for x in range(13)], [(2, 0, y, 100) for y in range(13)]
    inside = [(3, 0, 0, 10), (3, 1, 0, 240), (3, 0, 1, 190), (3, 1, 1, 7), (3, 0, 2, 0)]
    odd = [(1, None, 0, 5), (1, 3, 0, None), (1, 4, 0, 200), (None, 0, 0, 1)]
    found = {(r.image_id, r.x, r.y): r.v for r in N.unfilter_alpha_gradient(spark.createDataFrame(row + column + inside + odd, PLANE)).collect()}
    assert [found[1, x, 0] for x in range(13)] == list(range(1, 14)) and [found[2, 0, y] for y in range(13)] == [(y + 1) * 100 % 256 for y in range(13)]
    # 250 and 200 beside and above, 10 in the corner: clamped to 255, plus 7
    assert {k[1:]: v for k, v in found.items() if k[0] == 3} == {(0, 0): 10, (1, 0): 250, (0, 1): 200, (1, 1): 6, (0, 2): 200}


def test_own_columns_pass_through(spark):
    df = spark.createDataFrame(grid(1, 4, 8), PIXELS).withColumns({c: F.lit(f"mine {c}") for c in ("l", "t", "tl", "tr", "mode", "tx", "ty", "g2r")})
    for job in (P.residual, P.cross_color, P.inverse_cross_color, P.subtract_green):
        rows = job(df).collect()
        assert len(rows) == 8 and all(r[c] == f"mine {c}" for r in rows for c in ("l", "t", "tl", "tr", "mode", "tx", "ty", "g2r"))


def test_cross_color_by_tile(spark):
    """Coefficients of each tile, by literals and both ways; tiles without any lose their pixels."""
    df = spark.createDataFrame([(1, 0, 0, 0, 100, 64, 50, 255), (1, 1, 2, 0, 100, 192, 50, 255), (1, 2, 4, 0, 1, 2, 3, 255)], PIXELS)
    coeffs = spark.createDataFrame([(1, 0, 0, 32, 0, 0), (1, 1, 0, 224, 16, 32)], "image_id long, tx int, ty int, g2r int, g2b int, r2b int")
    coded = P.cross_color(df, coeffs, bits=1)
    # 64 * 32 / 32 = 64 off red; -64 * -32 / 32 = 64 off red, -64 * 16 / 32 = -32 and 100 off blue
    assert of(coded) == [(1, 0, 0, 36, 64, 50, 255), (1, 2, 0, 36, 192, (50 + 32 - 100) % 256, 255)]
    assert of(P.inverse_cross_color(coded, coeffs, bits=1)) == of(df.filter("x < 4"))


def test_parse_against_plain_python(spark):
    """Tokens of a parse expand to the sequence; matches are those of a plain search; nulls take no part."""
    colors = [(k * k * 31) % 7 for k in range(400)] + [5] * 300 + [1, 2, 3]
    df = spark.createDataFrame(sequence(colors) + [(1, None, 0, 0, 1, 1, 1, 1), (1, 5000, 0, 0, None, 1, 1, 1)], PIXELS)
    tokens = M.backref_parse(P.cache_hits(df))
    rows = sorted(tokens.collect(), key=lambda r: r.tok)
    assert [(r.pos, r.len or 0, r.dist or 0) for r in rows] == M.parse([(255 << 24) | c for c in colors])
    for r in rows:
        if r.kind == "copy":
            assert all(colors[r.pos + i] == colors[r.pos - r.dist + i] for i in range(r.len)) and r.len >= 3
    assert sum(r.len or 1 for r in rows) == len(colors)
    back = sorted((r.pos, r.argb, r.error) for r in M.backref_expand(tokens).collect())
    assert back == [(k, (255 << 24) | c, None) for k, c in enumerate(colors)]


def test_bad_tokens(spark):
    kinds = [(1, "literal", None), (2, "cache", 99), (3, "what", None), (4, "copy", None)]
    bad = spark.createDataFrame([(i, 0, 0, kind, None, None, None, None, None, None, slot) for i, kind, slot in kinds], M._TOKENS)
    assert sorted((r.image_id, r.pos, r.error) for r in M.backref_expand(bad).collect()) == [(i, 0, "bad_token") for i, *_ in kinds]


def test_equal_run():
    colors = [1, 2, 3] * 40 + [9] + [1, 2, 3] * 40
    for a, b, most in ((0, 3, 238), (0, 121, 120), (0, 121, 7), (1, 121, 9), (118, 239, 2)):
        n = next((k for k in range(most) if colors[a + k] != colors[b + k]), most)
        assert M.equal_run(colors, a, b, most) == n


def test_payload_from_real_depths(spark):
    """Books from histograms, codes, bit positions and payload: a plain reader finds every symbol and its extra bits again."""
    colors = [(k * k * 31) % 11 + 256 * (k % 5) for k in range(300)] + [7] * 200 + [(k * 13) % 64 for k in range(60)] * 2
    df = spark.createDataFrame(sequence(colors), PIXELS)
    tokens = M.backref_parse(P.cache_hits(df))
    symbols = C.tokens_to_symbols(tokens, spark.createDataFrame([(1, 16)], "image_id long, width int")).persist()
    book = C.codebook_lengths(C.symbol_histogram(symbols))
    codes = C.canonical_codes(book)
    payload = C.pack_bits(C.apply_codebook(symbols, codes)).first().payload
    bits = "".join(f"{byte:08b}"[::-1] for byte in payload)
    table = {(r.alphabet, f"{r.code:0{r.depth}b}"): r.symbol for r in codes.collect()}
    single = {r.alphabet: r.symbol for r in book.filter("depth < 1").collect()}
    at, with_extra = 0, 0
    for s in sorted(symbols.collect(), key=lambda s: s.seq):
        code = ""
        while s.alphabet not in single and (s.alphabet, code) not in table:
            code += bits[at]
            at += 1
        assert s.symbol == (single[s.alphabet] if s.alphabet in single else table[s.alphabet, code])
        assert int(bits[at : at + s.extra_bits][::-1] or "0", 2) == s.extra
        at, with_extra = at + s.extra_bits, with_extra + (s.extra_bits > 0)
    assert with_extra and len(bits) - at < 8 and "1" not in bits[at:]
    size = C.coded_size(C.symbol_histogram(symbols), book, symbols).agg(F.sum("bits")).first()[0]
    assert size == at
    symbols.unpersist()


def test_depths_against_least_total():
    """Depths cost what merging the two least weights again and again costs."""
    import heapq

    for counts in ({0: 5, 1: 1, 2: 1, 3: 2}, {k: (k * 7919) % 50 + 1 for k in range(40)}, {k: 2**k for k in range(12)}):
        heap, cost = sorted(counts.values()), 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert sum(counts[s] * d for s, d in C.code_depths(counts).items()) == cost


def test_report_literals(spark):
    """Four pixels, greens 1 1 2 3: 2 x 1 + 2 x 2 bits; less green, red and blue cost the same each; with a hit for the second, four symbols of 2 bits."""
    df = spark.createDataFrame([(1, k, k, 0, 9, g, 9, 255) for k, g in enumerate((1, 1, 2, 3))], PIXELS)
    rows = technique_report(df, df).collect()
    bits = {(r.technique, r.image_id): r.bits for r in rows}
    assert len(bits) == len(rows) == 8 * 2 + 1
    assert {t: bits[t, 1] for t in ("plain", "back_references", "subtract_green", "cache", "palette")} == {"plain": 6, "back_references": 6, "subtract_green": 18, "cache": 8, "palette": 0}
    assert all(bits[t, None] == v for (t, i), v in bits.items() if i == 1) and bits[None, None] == sum(v for (_, i), v in bits.items() if i == 1)


def test_files_in_and_out(spark, tmp_path):
    """Files below a folder, as a table and as a stream; blobs written in folders by key and read again."""
    (tmp_path / "in/deep").mkdir(parents=True)
    for name, data in (("a.webp", b"RIFF"), ("deep/b.webp", b"x"), ("c.txt", b"no"), ("empty.webp", b"")):
        (tmp_path / "in" / name).write_bytes(data)
    files = read_media(spark, str(tmp_path / "in"))
    assert sorted((r.path.rsplit("/", 1)[1], bytes(r.content), r.length) for r in files.collect()) == [("a.webp", b"RIFF", 4), ("b.webp", b"x", 1)]
    assert files.select("file_id").distinct().count() == 2
    done = stream_media(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("files_seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    streamed = spark.table("files_seen")
    assert {(r.file_id, bytes(r.content)) for r in streamed.collect()} == {(r.file_id, bytes(r.content)) for r in files.filter("path LIKE '%/a.webp'").collect()}
    write_media(files, str(tmp_path / "out"), "file_id", buckets=4)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.file_id, bytes(r.content)) for r in again.collect()) == sorted((r.file_id, bytes(r.content)) for r in files.collect())


def test_explode_odd_images(spark):
    rows = [(1, 2, 1, bytes(range(8))), (None, 2, 1, bytes(8)), (2, None, 1, bytes(8)), (3, 0, 1, bytes(8)), (4, 1, 2, bytes(7)), (5, 1, 1, None)]
    images = spark.createDataFrame(rows, "image_id long, width int, height int, rgba binary")
    assert of(explode_pixels(images)) == [(1, 0, 0, 0, 1, 2, 3), (1, 1, 0, 4, 5, 6, 7), (4, 0, 0, 0, 0, 0, 0)]


def test_empty_walks(spark):
    p = spark.createDataFrame([], PIXELS)
    for found in (P.sequential_modes(p), M.backref_parse(P.cache_hits(p)), M.backref_expand(spark.createDataFrame([], M._TOKENS)), N.unfilter_alpha_gradient(spark.createDataFrame([], PLANE)), L.index_colors(p, L.build_palette(p))):
        assert found.count() == 0
