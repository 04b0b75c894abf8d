"""Stand-in media tables derived from the given tables; each has the same definition in SQL (see `VIEWS_SQL`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.bytes import le_bytes
from tessera.sources.media import explode_pixels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pixels(rows: DataFrame, value, width: int) -> DataFrame:
    """Pixels of (image_id, n, ...) rows, n pixels each; value(i) is the i-th byte."""
    out = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    cells = {ch: value(F.col("pos") * 4 + k).cast("int") for k, ch in enumerate("rgba")}
    return out.select("image_id", F.col("pos").cast("long").alias("pos"), (F.col("pos") % width).cast("int").alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), *(v.alias(k) for k, v in cells.items()))


def vec_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 pixels, 4 x 4, of each vector of 64 components: a byte is floor((component + 1) * 127.5)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.lit(16).alias("n"))
    return _pixels(e, lambda i: F.floor((F.get("embedding", i).cast("double") + 1.0) * 127.5), 4)


def doc_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole UTF-8 text of each document as pixels of four bytes, 16 to a row; the last pixel is filled with zeros."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.lit(16).alias("width"), F.encode("text", "UTF-8").alias("bin"))
    fill = F.unhex(F.repeat(F.lit("00"), F.pmod(-F.octet_length("bin"), F.lit(4)).cast("int")))
    return explode_pixels(d.select("image_id", "width", F.concat("bin", fill).alias("rgba")))


#: Pixels of an event image at most: 256 rows of 16.
IDX_PIXELS = 4096


def idx_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in order of time, 16 to a row and 4,096 to an image, the last row filled with empty pixels; the colour comes from the length of the event's type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    size = F.length("event_type")
    cells = {"r": size * 20 % 256, "g": F.ascii("event_type") % 256, "b": size * size % 256, "a": F.lit(255)}
    own = F.struct(F.col("k").alias("k"), *(v.cast("int").alias(ch) for ch, v in cells.items()))
    filled = F.transform(F.sequence(F.lit(1), F.pmod(-F.col("n"), F.lit(16)).cast("int")), lambda i: F.struct((F.col("k") + i).cast("int").alias("k"), *(F.lit(0).alias(ch) for ch in "rgba")))
    last = (F.col("k") == F.col("n") - 1) & (F.col("n") % 16 != 0)
    out = e.select("user_id", F.inline(F.when(last, F.concat(F.array(own), filled)).otherwise(F.array(own))))
    pos = F.col("k") % IDX_PIXELS
    return out.select((F.col("user_id") * (1 << 20) + F.floor(F.col("k") / IDX_PIXELS)).alias("image_id"), pos.cast("long").alias("pos"), (pos % 16).cast("int").alias("x"), F.floor(pos / 16).cast("int").alias("y"), *"rgba")


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y at every pixel, Cb and Cr at even ones, of the vector images."""
    v = vec_px(spark, sf_dir)
    even = v.filter("x % 2 = 0 AND y % 2 = 0")
    half = lambda name, ch: even.select("image_id", F.lit(name).alias("plane"), F.shiftright("x", 1).alias("px"), F.shiftright("y", 1).alias("py"), F.col(ch).alias("v"))
    return v.select("image_id", F.lit("Y").alias("plane"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("r").alias("v")).union(half("Cb", "g")).union(half("Cr", "b"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a file, a turn a chunk; the role gives the code of four letters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), (F.row_number().over(w) - 1).alias("chunk_no"), F.rpad(F.upper(F.substring("role", 1, 4)), 4, " ").alias("fourcc"), F.encode("text", "UTF-8").alias("payload"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is an animation, a turn a frame; sizes and durations come from the text's length."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.octet_length("text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("anim_id"), (F.row_number().over(w) - 1).alias("frame_no"), (n % 300 + 1).alias("width"), (n % 200 + 1).alias("height"), (n.cast("long") * 100000).alias("duration"), (F.col("turn") % 3).cast("int").alias("disposal"), (n % 7 == 0).alias("has_alpha"), F.encode("text", "UTF-8").alias("stream"))


#: The chunks of each kind of media file.
MEDIA_KINDS = {
    0: ["VP8L"], 1: ["VP8 "], 2: ["VP8X", "ALPH", "VP8 "], 3: ["VP8X", "VP8L"], 4: ["ALPH", "VP8 "], 5: ["VP8X", "VP8L"], 6: ["VP8X", "VP8X", "VP8L"], 7: ["VP8X", "ANIM", "ANMF"],
    8: [], 9: ["VP8L"], 10: ["VP8X", "ALPH", "ALPH", "VP8 "],
}
_MEDIA_SIZES = {"VP8L": 6, "VP8 ": 10, "VP8X": 10, "ALPH": 3, "ANIM": 6, "ANMF": 16}


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small media files from parts. The kind is p_partkey % 8, but for a hundredth each without chunks (8), cut short (9) and with a second alpha chunk (10); a tenth of the files stand twice."""
    k, w, h = F.col("p_partkey"), F.col("p_size").cast("long"), F.col("p_partkey") % 1000 + 1
    kind = F.when(k % 100 == 15, 8).when(k % 100 == 31, 9).when(k % 100 == 47, 10).otherwise(k % 8)
    flags = F.when(kind.isin(2, 5, 10), 16).otherwise(0) + F.when(kind == 7, 2).otherwise(0)
    lossless = F.concat(F.unhex(F.lit("2F")), le_bytes((w - 1).bitwiseOR(F.shiftleft(h - 1, 14)).bitwiseOR(F.shiftleft(k % 2, 28)), 4), F.unhex(F.lit("00")))
    lossy = F.concat(le_bytes(F.lit(16) + F.shiftleft(k % 4096, 5), 3), F.unhex(F.lit("9D012A")), le_bytes(w.bitwiseOR(F.shiftleft(k % 4, 14)), 2), le_bytes(h, 2))
    canvas = F.concat(le_bytes(flags, 4), le_bytes(w - 1, 3), le_bytes(h - 1, 3))
    payload = {"VP8L": lossless, "VP8 ": lossy, "VP8X": canvas, "ALPH": F.concat(le_bytes(k % 16, 1), F.unhex(F.lit("0102"))), "ANIM": F.unhex(F.lit("FFFFFFFF0000")), "ANMF": F.unhex(F.lit("00" * 16))}
    p = table(spark, sf_dir, "part").select(k.alias("file_id"), kind.alias("kind"), *(v.alias(c) for c, v in payload.items()))
    # written once for all cases: the payloads above are columns, what stands around them is fixed
    raw = lambda text: F.unhex(F.lit(text.hex()))
    content = None
    for case, codes in MEDIA_KINDS.items():
        size = 4 + sum(8 + _MEDIA_SIZES[c] + _MEDIA_SIZES[c] % 2 for c in codes) + (case == 9)
        parts = [raw(b"RIFF" + size.to_bytes(4, "little") + b"WEBP")]
        for c in codes:
            parts += [raw(c.encode() + _MEDIA_SIZES[c].to_bytes(4, "little")), F.col(c)] + [raw(b"\0")] * (_MEDIA_SIZES[c] % 2)
        content = F.when(F.col("kind") == case, F.concat(*parts)) if content is None else content.when(F.col("kind") == case, F.concat(*parts))
    out = p.select("file_id", F.concat(F.lit("part-"), F.col("file_id").cast("string")).alias("path"), content.alias("content"), F.explode(F.when(F.col("file_id") % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.withColumn("length", F.octet_length("content").cast("long")).drop("copy")


_HEX_BYTE = "('0x' || substr(h, {0}, 2))::INT"
_B = lambda i: _HEX_BYTE.format(f"2 * ({i}) + 1")

#: The same views for DuckDB.
VIEWS_SQL: dict[str, str] = {
    "v_vec_px": """
        SELECT vec_id AS image_id, p AS pos, (p % 4)::INT AS x, (p // 4)::INT AS y,
            floor((embedding[4 * p + 1]::DOUBLE + 1.0) * 127.5)::INT AS r, floor((embedding[4 * p + 2]::DOUBLE + 1.0) * 127.5)::INT AS g,
            floor((embedding[4 * p + 3]::DOUBLE + 1.0) * 127.5)::INT AS b, floor((embedding[4 * p + 4]::DOUBLE + 1.0) * 127.5)::INT AS a
        FROM embeddings, range(16) t(p)""",
    "v_doc_px": f"""
        SELECT image_id, p AS pos, (p % 16)::INT AS x, (p // 16)::INT AS y, {_B("0")} AS r, {_B("1")} AS g, {_B("2")} AS b, {_B("3")} AS a
        FROM (SELECT image_id, unnest(range(n)) AS p, unnest(list_transform(range(n), lambda i: rpad(substr(hx, (8 * i + 1)::BIGINT, 8), 8, '0'))) AS h
            FROM (SELECT doc_id AS image_id, hex(encode(text)) AS hx, (octet_length(encode(text)) + 3) // 4 AS n FROM documents WHERE text IS NOT NULL))""",
    "v_idx_px": f"""
        SELECT user_id * 1048576 + k // {IDX_PIXELS} AS image_id, k % {IDX_PIXELS} AS pos, (k % 16)::INT AS x, (k % {IDX_PIXELS} // 16)::INT AS y, r, g, b, a FROM (
            SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, (length(event_type) * 20 % 256)::INT AS r, (ascii(event_type) % 256)::INT AS g, (length(event_type) * length(event_type) % 256)::INT AS b, 255 AS a FROM events
            UNION ALL SELECT user_id, n + i, 0, 0, 0, 0 FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), range(15) t(i) WHERE i < (16 - n % 16) % 16)""",
    "v_planes": """
        SELECT image_id, 'Y' AS plane, x AS px, y AS py, r AS v FROM v_vec_px
        UNION ALL SELECT image_id, 'Cb', x // 2, y // 2, g FROM v_vec_px WHERE x % 2 = 0 AND y % 2 = 0
        UNION ALL SELECT image_id, 'Cr', x // 2, y // 2, b FROM v_vec_px WHERE x % 2 = 0 AND y % 2 = 0""",
    "v_chunks": """
        SELECT conv_id AS file_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_no, rpad(upper(substr(role, 1, 4)), 4, ' ') AS fourcc,
            encode(text) AS payload, octet_length(encode(text)) AS size FROM conversations""",
    "v_frames": """
        SELECT conv_id AS anim_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_no, octet_length(encode(text)) AS n,
            octet_length(encode(text)) % 300 + 1 AS width, octet_length(encode(text)) % 200 + 1 AS height, octet_length(encode(text)) * 100000 AS duration, (turn % 3)::INT AS disposal, octet_length(encode(text)) % 7 = 0 AS has_alpha FROM conversations""",
    "v_media": f"""
        SELECT p_partkey AS file_id, p_size, copy, CASE p_partkey % 100 WHEN 15 THEN 8 WHEN 31 THEN 9 WHEN 47 THEN 10 ELSE p_partkey % 8 END AS k FROM part, range(2) t(copy) WHERE copy = 0 OR p_partkey % 10 = 3""",
    "v_media_chunks": f"""
        SELECT m.*, i - 1 AS chunk_no, codes[i] AS fourcc FROM v_media m JOIN (VALUES {", ".join(f"({k}, {codes}::VARCHAR[])" for k, codes in MEDIA_KINDS.items() if k != 9)}) v(kind, codes) ON m.k = v.kind, range(1, 5) t(i) WHERE i <= len(codes)""",
}


def sql(query: str, *views: str) -> str:
    """A query for DuckDB over the named views and those that they read."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS_SQL:
            if other != name and other in VIEWS_SQL[name]:
                add(other)
        if name not in needed:
            needed.append(name)

    for v in views or [v for v in VIEWS_SQL if v in query]:
        add(v)
    return "WITH RECURSIVE " + ", ".join(f"{v} AS MATERIALIZED ({VIEWS_SQL[v]})" for v in needed) + (", " + query.strip()[5:] if query.strip().upper().startswith("WITH ") else " " + query)
