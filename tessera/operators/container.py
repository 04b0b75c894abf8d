"""RIFF containers: walking, describing, checking and assembling them; header features and the catalog of images.

Every file is its own row: repeated files give repeated rows, an empty or null content is an error row, and a header too short for a field gives null there.
An empty table gives an empty one. What is told of a file is read from its row, which holds its chunks as an array (`walk_files`): no job here but assembling and
the sums over chunk tables groups or joins by file_id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bytes import ascii_bytes, byte_at, le_bytes, le_int

#: Payload bytes of each chunk that stay on its row, for the header features.
HEAD = 32
#: A chunk of a walked file; its number is its place in the array.
CHUNK = "struct<fourcc: string, size: bigint, data_offset: bigint, head: binary>"


def _code(raw: bytes) -> str:
    return raw.decode("latin-1")


def _walk(data: bytes, strict: bool) -> Iterator[tuple]:
    """(fourcc, size, offset, head, error, at) of each chunk, then of an error if there is one."""
    bad = lambda error, at, code=None: (code, None, None, None, error, at)
    if len(data) < 12 or data[:4] != b"RIFF":
        yield bad("invalid_signature", 0, _code(data[:4]))
        return
    if data[8:12] != b"WEBP":
        yield bad("not_webp", 8, _code(data[8:12]))
        return
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        yield bad("truncated", 4)
        return
    at = 12
    while at + 8 <= end:
        code, size = _code(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        start = at + 8
        if start + size > end:
            yield bad("chunk_out_of_range", at, code)
            return
        yield code, size, start, data[start : start + min(size, HEAD)], None, None
        at = start + size
        if size & 1:
            if at + 1 > end:
                yield bad("missing_pad", at, code)
                return
            at += 1
    if strict and at < end:
        yield bad("short_chunk_header", at)


def walk_files(files: DataFrame, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, riff_size, chunks, error, at_offset, fourcc), one row a row of files (file_id LONG, content BINARY): the chunks in order, then what ended the walk of a file that is not sound.

    strict: a tail of under eight bytes is an error too; the lister's rule ignores it. Null content is an invalid signature. The content is read in one
    pass and left behind: only the first 32 bytes of each payload stay. riff_size is the size that a signed header tells, else null. keep: columns of files that stay beside.
    """
    cell = pa.struct([("fourcc", pa.string()), ("size", pa.int64()), ("data_offset", pa.int64()), ("head", pa.binary())])
    kinds = {"file_id": pa.int64(), "riff_size": pa.int64(), "chunks": pa.list_(cell), "error": pa.string(), "at_offset": pa.int64(), "fourcc": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, data in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                chunks, fault = [], (None, None, None)
                for code, size, start, head, error, at in _walk(data or b"", strict):
                    if error:
                        fault = (error, at, code)
                    else:
                        chunks.append({"fourcc": code, "size": size, "data_offset": start, "head": head})
                size = struct.unpack_from("<I", data, 4)[0] if data and len(data) >= 8 and data[:4] == b"RIFF" else None
                rows.append((file_id, size, chunks, *fault))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())), *(batch.column(c) for c in keep)], names=[*kinds, *keep])

    kept = "".join(f", `{c}` {dict(files.dtypes)[c]}" for c in keep)
    return files.select(F.col("file_id").cast("long").alias("file_id"), "content", *keep).mapInArrow(run, f"file_id long, riff_size long, chunks array<{CHUNK}>, error string, at_offset long, fourcc string{kept}")


def chunk_rows(walked: DataFrame) -> DataFrame:
    """(file_id, chunk_no, fourcc, size, data_offset, head) of walked files, one row a chunk."""
    return walked.select("file_id", F.posexplode("chunks").alias("chunk_no", "c")).select("file_id", "chunk_no", "c.*")


def error_rows(walked: DataFrame) -> DataFrame:
    """(file_id, error, at_offset, fourcc) of walked files that are not sound."""
    return walked.filter("error IS NOT NULL").select("file_id", "error", "at_offset", "fourcc")


def chunk_inventory(files: DataFrame, strict: bool = False) -> DataFrame:
    """(file_id, chunk_no, fourcc, size, data_offset, head)."""
    return chunk_rows(walk_files(files, strict))


def chunk_errors(files: DataFrame, strict: bool = False) -> DataFrame:
    """(file_id, error, at_offset, fourcc) of files that are not sound."""
    return error_rows(walk_files(files, strict))


def describe_files(walked: DataFrame) -> DataFrame:
    """(file_id, summary, error), one row a walked file: 'RIFF, n bytes, WEBP, code, m bytes, ...'; a sound file without chunks ends after WEBP, one that is not sound has an error instead."""
    each = F.transform("chunks", lambda c: F.concat(F.lit(", "), c["fourcc"], F.lit(", "), c["size"].cast("string"), F.lit(" bytes")))
    summary = F.concat(F.lit("RIFF, "), F.col("riff_size").cast("string"), F.lit(" bytes, WEBP"), F.array_join(each, ""))
    return walked.select("file_id", F.when(F.col("error").isNull(), summary).alias("summary"), "error")


def container_sizes(chunks: DataFrame) -> DataFrame:
    """(file_id, riff_size): four bytes of form, and header, payload and pad of each chunk."""
    return chunks.groupBy("file_id").agg((F.lit(4) + F.sum(8 + F.col("size") + F.col("size") % 2)).alias("riff_size"))


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """Chunks (file_id, chunk_no, size) with the offset of each payload in the assembled file."""
    w = Window.partitionBy("file_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("data_offset", F.coalesce(F.sum(8 + F.col("size") + F.col("size") % 2).over(w), F.lit(0)) + 20)


def assemble_container(payloads: DataFrame, form: str = "WEBP") -> DataFrame:
    """(file_id, content) from payloads (file_id, chunk_no, fourcc, payload): header and chunks in order, odd ones padded outside their size."""
    size = F.octet_length("payload")
    pad = F.when(size % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    chunk = F.concat(F.encode("fourcc", "US-ASCII"), le_bytes(size, 4), F.col("payload"), pad)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.hex(chunk).alias("h")))), lambda e: e["h"])
    body = payloads.groupBy("file_id").agg(F.unhex(F.array_join(in_order, "")).alias("body"))
    return body.select("file_id", F.concat(ascii_bytes("RIFF"), le_bytes(F.octet_length("body") + 4, 4), ascii_bytes(form), F.col("body")).alias("content"))


def _when_long(n: int, cell: Column) -> Column:
    return F.when(F.octet_length("head") >= n, cell)


def _part(value: Column, shift: int, bits: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << bits) - 1))


_IS_LOSSLESS, _IS_LOSSY = "fourcc = 'VP8L' AND octet_length(head) >= 5", "fourcc = 'VP8 ' AND octet_length(head) >= 10"


def _promises_alpha(chunk: Column) -> Column:
    """Whether a chunk is an extended header with the alpha flag."""
    return F.coalesce((chunk["fourcc"] == "VP8X") & (F.shiftright(byte_at(chunk["head"], 0), 4).bitwiseAND(F.lit(1)) == 1), F.lit(False))


def lossless_header(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_no, magic, width, height, alpha_hint, version) of lossless chunks."""
    bits = le_int("head", 1, 4)
    return chunks.filter(_IS_LOSSLESS).select("file_id", "chunk_no", byte_at("head", 0).alias("magic"), (_part(bits, 0, 14) + 1).alias("width"), (_part(bits, 14, 14) + 1).alias("height"), _part(bits, 28, 1).alias("alpha_hint"), _part(bits, 29, 3).alias("version"))


def lossy_header(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_no, key_frame, version, show, first_partition, start_ok, width, height, x_scale, y_scale, mb_width, mb_height) of lossy chunks."""
    tag, w, h = le_int("head", 0, 3), le_int("head", 6, 2), le_int("head", 8, 2)
    start = F.hex(F.substr("head", F.lit(4), F.lit(3))) == "9D012A"
    out = chunks.filter(_IS_LOSSY).select("file_id", "chunk_no", (_part(tag, 0, 1) == 0).alias("key_frame"), _part(tag, 1, 3).alias("version"), (_part(tag, 4, 1) == 1).alias("show"), _part(tag, 5, 19).alias("first_partition"), start.alias("start_ok"), _part(w, 0, 14).alias("width"), _part(h, 0, 14).alias("height"), _part(w, 14, 2).alias("x_scale"), _part(h, 14, 2).alias("y_scale"))
    return out.withColumns({"mb_width": F.shiftright(F.col("width") + 15, 4), "mb_height": F.shiftright(F.col("height") + 15, 4)})


def canvas_header(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_no, has_alpha, animated, width, height, error) of extended headers, which are ten bytes long."""
    flags = byte_at("head", 0)
    side = lambda at: F.when(F.col("size") == 10, le_int("head", at, 3) + 1)
    bit = lambda n: F.shiftright(flags, n).bitwiseAND(F.lit(1)) == 1
    return chunks.filter("fourcc = 'VP8X'").select("file_id", "chunk_no", bit(4).alias("has_alpha"), bit(1).alias("animated"), side(4).alias("width"), side(7).alias("height"), F.when(F.col("size") != 10, "bad_size").alias("error"))


def alpha_header(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_no, compression, filter) of alpha chunks."""
    b = byte_at("head", 0)
    return chunks.filter("fourcc = 'ALPH' AND size > 0").select("file_id", "chunk_no", b.bitwiseAND(F.lit(3)).alias("compression"), F.shiftright(b, 2).bitwiseAND(F.lit(3)).alias("filter"))


def dispatch_state(walked: DataFrame) -> DataFrame:
    """Chunks of walked files with what came before each: extended headers (n_extended), whether alpha was promised, whether an alpha chunk was seen (promised, alpha_seen).

    The places of these chunks, few in a sound file, are found once a file and compared with each chunk's own: nothing leaves the row.
    """
    chunks = F.transform("chunks", lambda c, k: F.struct(k.alias("k"), c["fourcc"].alias("fourcc"), _promises_alpha(c).alias("alpha")))
    of = lambda test: F.transform(F.filter(chunks, test), lambda c: c["k"])
    marks = walked.select("file_id", "chunks", of(lambda c: c["fourcc"] == "VP8X").alias("_x"), of(lambda c: c["alpha"]).alias("_p"), of(lambda c: c["fourcc"] == "ALPH").alias("_a"))
    each = marks.select("file_id", F.posexplode("chunks").alias("chunk_no", "c"), "_x", "_p", "_a")
    before = lambda name: F.coalesce(F.array_min(name) < F.col("chunk_no"), F.lit(False))
    n_extended = F.size(F.filter("_x", lambda k: k < F.col("chunk_no")))
    return each.select("file_id", "chunk_no", "c.*", n_extended.alias("n_extended"), before("_p").alias("promised"), before("_a").alias("alpha_seen"))


def image_catalog(walked: DataFrame) -> DataFrame:
    """(file_id, format, width, height, has_alpha, error), one row a walked file.

    The first image chunk decides, unless a rule broke before it: an alpha chunk needs a promise of alpha that no alpha chunk has met yet, and a first byte; an extended header must be
    the only one and ten bytes long; a lossy image must bring the alpha promised, a lossless one must have neither. Other
    chunks are passed over. A file that ends without image has the error that ended its walk, or is an invalid format. The rules are a fold over the row's chunks.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    start = F.struct(F.lit(0).alias("n_extended"), F.lit(False).alias("wants"), F.lit(False).alias("alpha_seen"), none("string", "fault"), none("string", "fourcc"), none("binary", "head"))

    def step(s: Column, chunk: Column) -> Column:
        code = chunk["fourcc"]
        fault = (
            F.when((code == "ALPH") & ~s["wants"], "unexpected_alpha").when((code == "ALPH") & (chunk["size"] == 0), "empty_alpha")
            .when((code == "VP8X") & (s["n_extended"] > 0), "repeated_extended_header").when((code == "VP8X") & (chunk["size"] != 10), "bad_extended_header")
            .when((code == "VP8 ") & s["wants"], "missing_alpha").when((code == "VP8L") & (s["wants"] | s["alpha_seen"]), "lossless_with_alpha")
        )
        image = code.isin("VP8 ", "VP8L")
        wants = F.when(code == "VP8X", _promises_alpha(chunk)).when(code == "ALPH", F.lit(False)).otherwise(s["wants"])
        after = F.struct((s["n_extended"] + (code == "VP8X").cast("int")).alias("n_extended"), wants.alias("wants"), (s["alpha_seen"] | (code == "ALPH")).alias("alpha_seen"), fault.alias("fault"), F.when(image, code).alias("fourcc"), F.when(image, chunk["head"]).alias("head"))
        return F.when(s["fault"].isNotNull() | s["fourcc"].isNotNull(), s).otherwise(after)

    ends = walked.select("file_id", F.col("error").alias("walk_error"), F.aggregate("chunks", start, step).alias("s")).select("file_id", "walk_error", "s.fault", "s.fourcc", "s.alpha_seen", "s.head")
    lossless, lossy = F.expr(_IS_LOSSLESS), F.expr(_IS_LOSSY)
    ends = ends.withColumns({"bits": F.when(lossless, le_int("head", 1, 4)), "w": F.when(lossy, le_int("head", 6, 2)), "h": F.when(lossy, le_int("head", 8, 2))})
    ok = F.col("fault").isNull() & F.col("fourcc").isNotNull()
    of_lossless = F.col("fourcc") == "VP8L"
    kind = F.when(of_lossless, "lossless").when(F.col("alpha_seen"), "lossy+alpha").otherwise("lossy")
    width, height = F.coalesce(_part(F.col("bits"), 0, 14) + 1, _part(F.col("w"), 0, 14)), F.coalesce(_part(F.col("bits"), 14, 14) + 1, _part(F.col("h"), 0, 14))
    error = F.when(~ok, F.coalesce("fault", "walk_error", F.lit("invalid_format")))
    return ends.select("file_id", F.when(ok, kind).alias("format"), F.when(ok, width).alias("width"), F.when(ok, height).alias("height"), F.when(ok, F.when(of_lossless, _part(F.col("bits"), 28, 1) == 1).otherwise(F.col("alpha_seen"))).alias("has_alpha"), error.alias("error"))


# --- animations -------------------------------------------------------------------------------------------------------


def clamp_frames(frames: DataFrame) -> DataFrame:
    """Durations to 24 bits, disposal to one."""
    return frames.withColumns({"duration": F.least("duration", F.lit((1 << 24) - 1)), "disposal": F.least("disposal", F.lit(1))})


def animation_summary(frames: DataFrame) -> DataFrame:
    """(anim_id, n_frames, width, height, has_alpha, payload_bytes, total_duration, error): the canvas is the widest and the highest frame; lists that lack a duration or a disposal for a frame are an error."""
    c = clamp_frames(frames)
    lacking = F.count("*") != F.least(F.count("duration"), F.count("disposal"))
    return c.groupBy("anim_id").agg(F.count("*").alias("n_frames"), F.max("width").alias("width"), F.max("height").alias("height"), F.bool_or("has_alpha").alias("has_alpha"), F.sum(F.octet_length("stream")).alias("payload_bytes"), F.sum("duration").alias("total_duration"), F.when(lacking, "lists_differ").alias("error"))


def vp8x_bytes(width: Column, height: Column, alpha: Column, animated: Column) -> Column:
    """The payload of an extended header: flags, three reserved bytes, sides less one in 24 bits."""
    flags = F.when(alpha, 16).otherwise(0) + F.when(animated, 2).otherwise(0)
    return F.concat(le_bytes(flags, 4), le_bytes(width - 1, 3), le_bytes(height - 1, 3))


def assemble_animation(frames: DataFrame, animations: DataFrame) -> DataFrame:
    """(anim_id, content): extended header, animation header and one frame chunk for each frame, of animations (anim_id, loop_count, background) whose lists agree."""
    s = animation_summary(frames).filter("error IS NULL").join(animations, "anim_id")
    top = s.select(F.col("anim_id").alias("file_id"), F.lit(-2).alias("chunk_no"), F.lit("VP8X").alias("fourcc"), vp8x_bytes(F.col("width"), F.col("height"), F.col("has_alpha"), F.lit(True)).alias("payload"))
    anim = s.select("anim_id", F.lit(-1), F.lit("ANIM"), F.concat(le_bytes("background", 4), le_bytes("loop_count", 2)))
    size = F.octet_length("stream")
    inner = F.concat(ascii_bytes("VP8L"), le_bytes(size, 4), F.col("stream"), F.when(size % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    body = F.concat(le_bytes(0, 6), le_bytes(F.col("width") - 1, 3), le_bytes(F.col("height") - 1, 3), le_bytes("duration", 3), le_bytes("disposal", 1), inner)
    each = clamp_frames(frames).join(s.select("anim_id"), "anim_id", "left_semi").select("anim_id", "frame_no", F.lit("ANMF"), body)
    return assemble_container(top.union(anim).union(each)).withColumnRenamed("file_id", "anim_id")
