"""Files as rows, comparison as multisets, and streamed batches that run twice."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import container as K
from tessera.operators import verify as V
from tessera.streaming import media as S

PIXELS = "image_id long, pos long, v int"


def riff(*chunks, form=b"WEBP", extra=0):
    body = b"".join(code + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2) for code, data in chunks)
    return b"RIFF" + (4 + len(body) + extra).to_bytes(4, "little") + form + body


LOSSLESS = (b"VP8L", bytes.fromhex("2F0FC0031000"))
LOSSY = (b"VP8 ", bytes.fromhex("1000009D012A0A001400"))
CANVAS, ALPHA_CANVAS, ALPHA = (b"VP8X", bytes(10)), (b"VP8X", b"\x10" + bytes(9)), (b"ALPH", b"\x05ab")

#: File, then format, width, height, alpha and error as the rules have them.
CATALOG = [
    (riff(LOSSLESS), ("lossless", 16, 16, True, None)),
    (riff(LOSSY), ("lossy", 10, 20, False, None)),
    (riff(ALPHA_CANVAS, ALPHA, LOSSY), ("lossy+alpha", 10, 20, True, None)),
    (riff(CANVAS, (b"ICCP", b"x"), LOSSY, ALPHA), ("lossy", 10, 20, False, None)),
    (riff(ALPHA, LOSSY), (None, None, None, None, "unexpected_alpha")),
    (riff(ALPHA_CANVAS, ALPHA, ALPHA, LOSSY), (None, None, None, None, "unexpected_alpha")),
    (riff(ALPHA_CANVAS, (b"ALPH", b""), LOSSY), (None, None, None, None, "empty_alpha")),
    (riff(ALPHA_CANVAS, LOSSY), (None, None, None, None, "missing_alpha")),
    (riff(ALPHA_CANVAS, ALPHA, LOSSLESS), (None, None, None, None, "lossless_with_alpha")),
    (riff(CANVAS, CANVAS, LOSSLESS), (None, None, None, None, "repeated_extended_header")),
    (riff((b"VP8X", bytes(9)), LOSSLESS), (None, None, None, None, "bad_extended_header")),
    (riff((b"ANIM", b"")), (None, None, None, None, "invalid_format")),
    (riff(), (None, None, None, None, "invalid_format")),
    (riff(LOSSLESS, form=b"WEBM"), (None, None, None, None, "not_webp")),
    (riff(LOSSLESS, extra=1), (None, None, None, None, "truncated")),
    (None, (None, None, None, None, "invalid_signature")),
    (riff(LOSSLESS)[:-14] + b"VP8L\xff\0\0\0abcdef", (None, None, None, None, "chunk_out_of_range")),
    (riff((b"VP8L", b"\x2f")), ("lossless", None, None, None, None)),
]


@pytest.fixture(scope="module")
def files(spark):
    """Each case three times under one id, among the rest."""
    return spark.createDataFrame([(k % 7, data, "mine") for k, (data, _) in enumerate(CATALOG) for _ in range(3)], "file_id long, content binary, format string")


def test_catalog_of_repeated_files(spark, files):
    """Files that share an id, or are the same, are rows of their own; nothing is exchanged."""
    catalog = K.image_catalog(K.walk_files(files))
    found = Counter((r.file_id, r.format, r.width, r.height, r.has_alpha, r.error) for r in catalog.collect())
    expected = Counter()
    for k, (_, row) in enumerate(CATALOG):
        expected[(k % 7, *row)] += 3
    assert found == expected
    plan = catalog._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_descriptions(files):
    rows = Counter((r.summary, r.error) for r in K.describe_files(K.walk_files(files)).collect())
    assert sum(rows.values()) == 3 * len(CATALOG)
    assert rows["RIFF, 4 bytes, WEBP", None] == 3 and rows["RIFF, 18 bytes, WEBP, VP8L, 6 bytes", None] == 3
    assert rows["RIFF, 60 bytes, WEBP, VP8X, 10 bytes, ALPH, 3 bytes, ALPH, 3 bytes, VP8 , 10 bytes".replace("60", str(len(riff(ALPHA_CANVAS, ALPHA, ALPHA, LOSSY)) - 8)), None] == 3
    assert rows[None, "truncated"] == rows[None, "not_webp"] == rows[None, "chunk_out_of_range"] == rows[None, "invalid_signature"] == 3


def test_dispatch_of_repeated_files(spark):
    data = riff(ALPHA_CANVAS, ALPHA, CANVAS, LOSSY, ALPHA)
    twice = spark.createDataFrame([(1, data), (1, data), (2, riff())], "file_id long, content binary")
    rows = sorted((r.chunk_no, r.fourcc, r.n_extended, r.promised, r.alpha_seen) for r in K.dispatch_state(K.walk_files(twice)).collect())
    one = [(0, "VP8X", 0, False, False), (1, "ALPH", 1, True, False), (2, "VP8X", 1, True, True), (3, "VP8 ", 2, True, True), (4, "ALPH", 2, True, True)]
    assert rows == sorted(one * 2)


def test_walk_of_no_files(spark):
    walked = K.walk_files(spark.createDataFrame([], "file_id long, content binary"))
    for job in (K.chunk_rows, K.error_rows, K.describe_files, K.dispatch_state, K.image_catalog):
        assert job(walked).count() == 0


def test_many_chunks(spark):
    """A long animation: every frame is a chunk of one row."""
    data = riff(CANVAS, *[(b"ANMF", bytes(k % 40)) for k in range(5000)], LOSSLESS)
    walked = K.walk_files(spark.createDataFrame([(1, data)], "file_id long, content binary"))
    assert K.image_catalog(walked).first().format == "lossless"
    last = K.dispatch_state(walked).orderBy(F.desc("chunk_no")).first()
    assert (last.chunk_no, last.fourcc, last.n_extended) == (5001, "VP8L", 1)


# --- comparison --------------------------------------------------------------------------------------------------------------


def _diff(spark, a, b):
    df = lambda rows: spark.createDataFrame(rows, PIXELS)
    return sorted((tuple(r) for r in V.golden_diff(df(a), df(b), ["image_id", "pos"], ["v"]).collect()), key=str)


@pytest.mark.parametrize(("actual", "expected", "rows"), [
    ([(1, 0, 5), (1, 0, 5)], [(1, 0, 9), (1, 0, 9)], [(1, 0, "changed", 2)]),
    ([(1, 0, 5)] * 3, [(1, 0, 5)], [(1, 0, "extra", 2)]),
    ([(1, 0, 5)], [(1, 0, 5)] * 3, [(1, 0, "missing", 2)]),
    ([(1, 0, 5), (1, 1, 6)], [(1, 1, 6), (1, 0, 5)], []),
    ([(1, 0, 5), (1, 0, 6)], [(1, 0, 6), (1, 0, 7), (1, 0, 7)], [(1, 0, "changed", 1), (1, 0, "missing", 1)]),
    ([(1, 0, None), (None, 0, 1)], [(1, 0, None), (None, 0, 1)], []),
    ([(1, 0, None), (None, 0, 1), (1, None, 2)], [(1, 0, 0), (None, 0, 2)], [(1, 0, "changed", 1), (1, None, "extra", 1), (None, 0, "changed", 1)]),
    ([], [(1, 0, 5)], [(1, 0, "missing", 1)]),
    ([], [], []),
])
def test_multisets(spark, actual, expected, rows):
    assert _diff(spark, actual, expected) == sorted(rows, key=str)


def test_mismatches(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 1, 5), (2, 0, 1)], PIXELS)
    b = spark.createDataFrame([(1, 0, 6), (2, 0, 1)], PIXELS)
    found = V.mismatches(V.golden_diff(a, b, ["image_id", "pos"], ["v"])).collect()
    assert sorted(tuple(r) for r in found) == [(1, "changed", 1, 1), (1, "extra", 1, 2)]


# --- streams -----------------------------------------------------------------------------------------------------------------


def test_batch_that_runs_twice(spark, files, tmp_path):
    """A batch whose end was not noted is run again: its rows are there once. The later batch adds to them."""
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    some = files.select("file_id", F.lit("p").alias("path"), "content")

    def run():
        stream = spark.readStream.schema(some.schema).parquet(str(source))
        S.stream_catalog(stream, sink, str(state)).awaitTermination()
        return {name: S.catalog_table(spark, sink, name).count() for name in S.TABLES}

    some.coalesce(1).write.parquet(str(source))
    first = run()
    walked = K.walk_files(some)
    assert first == {"chunks": K.chunk_rows(walked).count(), "catalog": some.count(), "quarantine": K.error_rows(walked).count()}
    for f in (state / "commits").iterdir():  # as after a failure between the last table and the note of the batch
        f.unlink()
    assert run() == first
    some.limit(5).coalesce(1).write.mode("append").parquet(str(source))
    assert run()["catalog"] == some.count() + 5


def test_files_byte_for_byte(spark, tmp_path):
    """Bytes of any kind, with line feeds and none, are read as they were written."""
    from tessera.sources.media import read_bucket, read_files, write_files, write_media

    data = {1: bytes(range(256)), 2: b"\n\n", 3: b"", 4: None, 5: b"\xff\xfe\x80\n", 6: riff(LOSSLESS)}
    write_files(spark.createDataFrame(list(data.items()), "file_id long, content binary"), str(tmp_path / "files"))
    assert {r.file_id: (bytes(r.content), r.length) for r in read_files(spark, str(tmp_path / "files")).collect()} == {k: (v or b"", len(v or b"")) for k, v in data.items()}
    write_media(spark.range(300).select("id", F.lit(b"x").alias("blob")), str(tmp_path / "blobs"), "id", 8)
    one = read_bucket(spark.read.parquet(str(tmp_path / "blobs")), "id", 17, 8)
    assert [r.id for r in one.collect()] == [17] and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_heap_order_against_sql(duck):
    """Depths of many equal weights, and of weights raised to the floor, by the heap of the registered SQL."""
    import random

    from tessera.operators.coding import code_depths
    from tessera.plans.media_queries import _HEAP

    rng = random.Random(12)
    hists = {k: {s: rng.choice([1, 1, 2, 3, 5, 8, 13, 10**rng.randrange(7)]) for s in rng.sample(range(300), rng.randrange(1, 40))} for k in range(25)}
    rows = ", ".join(f"({k}, 0, {s}, {n}::BIGINT)" for k, h in hists.items() for s, n in h.items())
    found = {}
    for image, symbol, depth in duck.execute(f"WITH RECURSIVE hist(image_id, alphabet, symbol, n) AS (VALUES {rows}), {_HEAP} SELECT image_id, symbol, depth FROM book").fetchall():
        found.setdefault(image, {})[symbol] = depth
    assert found == {k: code_depths(h) for k, h in hists.items()}


def test_comparison_shuffles_chunks(spark):
    """Both sides are dealt as packed chunks, once, not as rows: a few bytes a row. The last key may be any type, and extremes of integers and nulls come back as they were."""
    from tessera.operators.batches import arrow_schema, pack, unpack

    rng = spark.range(0, 60_000, 1, 2).select(F.floor(F.col("id") / 900).alias("image_id"), (F.col("id") % 900).alias("pos"), *(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(64)).cast("int").alias(f"v{k}") for k in range(4)))
    chunks = pack(rng, F.xxhash64("image_id"))
    assert chunks.agg(F.sum("n"), F.sum(F.octet_length("data") + 8 * F.size("form"))).first()[0] == 60_000
    assert chunks.agg(F.sum(F.octet_length("data") + 8 * F.size("form"))).first()[0] < 5 * 60_000
    other = rng.withColumn("v1", F.when(F.col("pos") == 7, 99).otherwise(F.col("v1")))
    plan = V.golden_diff(rng, other, ["image_id", "pos"], ["v0", "v1", "v2", "v3"])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]
    assert below.count("MapInArrow") >= 1 and "hashpartitioning(bucket" in below
    rows = [(1, "a", -(1 << 63), 1.5, None), (1, "b", (1 << 63) - 1, None, "x"), (None, None, 0, 0.0, "é"), (1, "a", -(1 << 63), 1.5, None)]
    df = spark.createDataFrame(rows, "k int, name string, v long, w double, s string")
    table = next(unpack(iter(pack(df, F.xxhash64("k")).toArrow().to_batches()), arrow_schema(df)))[0]
    assert Counter(map(tuple, (r.values() for r in table.to_pylist()))) == Counter(rows)
    found = V.golden_diff(df, df.limit(0).unionByName(df.dropDuplicates()), ["k", "name"], ["v", "w", "s"]).collect()
    assert [tuple(r) for r in found] == [(1, "a", "extra", 1)]


def test_many_files_in_few_folders(spark, sf_dir, tmp_path):
    """One file a row whatever the folder, in a bounded number of folders, ids of any sign; the query reads and walks each file once."""
    from tessera.plans.media_queries import QUERIES
    from tessera.sources.media import FOLDERS, read_files, write_files

    ids = [-1, -(1 << 63), (1 << 63) - 1, *range(700)]
    write_files(spark.createDataFrame([(i, str(i).encode()) for i in ids], "file_id long, content binary"), str(tmp_path / "files"))
    assert len(list((tmp_path / "files").glob("*/part-*"))) == len(ids) and len(list((tmp_path / "files").glob("folder=*"))) <= FOLDERS
    assert sorted((r.file_id, bytes(r.content)) for r in read_files(spark, str(tmp_path / "files")).collect()) == sorted((i, str(i).encode()) for i in ids)
    plan = QUERIES["s1_read_media"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
