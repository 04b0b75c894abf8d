"""Jobs cut into blocks, waves and rounds, with blocks of a few rows, against plain Python that walks a sequence."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.bytes import argb
from tessera.operators import coding as C
from tessera.operators import matching as M
from tessera.operators import pixels as P
from tessera.operators import planes as N
from tessera.operators.batches import whole_images
from tessera.operators.scan import running_sum
from tessera.sources.shared import Rounds

PIXELS = "image_id long, pos long, x int, y int, r int, g int, b int, a int"


def sequence(colors, image=1, skip=()):
    return [(image, k, k % 16, k // 16, (c >> 16) & 255, (c >> 8) & 255, c & 255, 255) for k, c in enumerate(colors) if k not in skip]


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_running_sum(spark, block):
    rng = random.Random(block)
    rows = [(k, i, rng.choice([None, 0, 1, 5, 70])) for k in (1, 2, None) for i in sorted(rng.sample(range(60), 25))] + [(1, None, 4)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    found = {(r.k, r.i): r.s for r in running_sum(df, ["k"], "i", F.col("v"), "s", block).collect()}
    for k in (1, 2, None):
        total = 0
        for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: -1 if r[1] is None else r[1]):
            assert found[k, i] == total
            total += v or 0
    assert len(found) == len(rows) and running_sum(df.limit(0), ["k"], "i", F.col("v"), "s").count() == 0


def test_rounds_leave_one_table(spark, tmp_path):
    rounds = Rounds(spark, "test")
    for k in range(3):
        kept = rounds.keep(spark.range(k + 1), "a")
    from os import listdir

    assert kept.count() == 3 and len(listdir(rounds.at.removeprefix("file:"))) == 1
    rounds.drop("a")
    assert not listdir(rounds.at.removeprefix("file:"))


def _chain(colors, k, present):
    """Nearest k earlier positions of equal bucket, nearest last."""
    chains, out = {}, {}
    for i in range(len(colors)):
        if all(j in present and colors[j] is not None for j in (i, i + 1, i + 2)):
            b = M.triple_bucket(*((255 << 24) | c for c in colors[i : i + 3]))
            out[i] = chains.setdefault(b, [])[-k:]
            chains[b] = [*chains[b], i]
    return out


@pytest.mark.parametrize("block", [2, 5])
@pytest.mark.parametrize("kind", ["flat", "few", "gaps"])
def test_chains_in_blocks(spark, block, kind):
    """One colour throughout (a single bucket), three colours, and gaps: the same chains however the sequence is cut."""
    rng = random.Random(4)
    colors = [7] * 150 if kind == "flat" else [rng.randrange(3) for _ in range(150)]
    skip = set(rng.sample(range(150), 12)) if kind == "gaps" else set()
    df = spark.createDataFrame(sequence(colors, skip=skip) + sequence(colors[:40], image=2), PIXELS)
    found = {(r.image_id, r.pos): list(r.earlier) for r in M.hash_chain(df, 4, block=block).collect()}
    expected = {(1, i): v for i, v in _chain(colors, 4, set(range(150)) - skip).items()} | {(2, i): v for i, v in _chain(colors[:40], 4, set(range(40))).items()}
    assert found == expected


def test_names_are_exact(spark):
    """Two stretches have one name exactly if they are equal; gaps, nulls and the end have none."""
    rng = random.Random(8)
    colors = [rng.randrange(2) for _ in range(80)] + [1] * 40 + [rng.randrange(2) for _ in range(30)]
    skip = {20, 90}
    df = spark.createDataFrame(sequence(colors, skip=skip) + [(1, 151, 0, 0, None, 0, 0, 0)], PIXELS)
    for k, names in enumerate(M.stretch_names(df, 16)):
        got = {r.pos: r.name for r in names.collect()}
        whole = {i: tuple(colors[i : i + (1 << k)]) for i in range(len(colors)) if i + (1 << k) <= len(colors) and not skip & set(range(i, i + (1 << k)))}
        often = [v for v in whole.values()]
        expected = {i: min(j for j, w in whole.items() if w == v) for i, v in whole.items() if often.count(v) > 1}
        assert got == expected


def _expand(tokens, bits):
    """Tokens one after another, with a cache that every pixel writes."""
    cache, done = [0] * (1 << bits), []
    put = lambda c: (done.append(c), cache.__setitem__(((c * M.MULTIPLIER) & 0xFFFFFFFF) >> (32 - bits), c))
    for kind, *v in tokens:
        if any(x is None or x < 0 for x in v) or (kind == "cache" and v[0] >= 1 << bits) or kind == "what":
            return done, "bad_token"
        if kind == "copy":
            if not 1 <= v[1] <= len(done):
                return done, "bad_distance"
            for _ in range(v[0]):
                put(done[-v[1]])
        else:
            put(cache[v[0]] if kind == "cache" else v[0])
    return done, None


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_expansion_against_a_walk(spark, block):
    """Random tokens: hits of any slot, also of ones never set, copies that overlap themselves and hold hits and copies of hits, deep chains, and tokens that end an image."""
    rng, bits, rows, expected = random.Random(6), 2, [], {}
    for image in range(40):
        tokens, size = [], 0
        for _ in range(rng.randrange(1, 60)):
            kind = rng.choice(["literal", "cache", "cache", "copy", "copy"])
            if kind == "copy":
                tokens.append(("copy", rng.randrange(0, 9), rng.randrange(1, max(2, size + 1))))
                size += tokens[-1][1]
            else:
                tokens.append((kind, rng.randrange(4) if kind == "cache" else (255 << 24) | rng.randrange(6)))
                size += 1
        if image % 4 == 1:
            tokens.insert(rng.randrange(len(tokens) + 1), rng.choice([("what", 0), ("cache", 4), ("copy", None, 2), ("copy", 2, 10_000), ("copy", 3, 0), ("literal", None)]))
        expected[image] = _expand(tokens, bits)
        for k, (kind, *v) in enumerate(tokens):
            c = v[0] if kind == "literal" else None
            channels = (None,) * 4 if c is None else ((c >> 8) & 255, (c >> 16) & 255, c & 255, c >> 24)
            rows.append((image, k * 3, 0, kind, *channels, *(v if kind == "copy" else (None, None)), v[0] if kind == "cache" else None))
    rng.shuffle(rows)
    found = {}
    for r in M.backref_expand(spark.createDataFrame([*rows, (None, 1, 0, "literal", 1, 1, 1, 1, None, None, None)], M._TOKENS), bits, block).collect():
        found.setdefault(r.image_id, []).append((r.pos, r.argb, r.error))
    for image, (done, error) in expected.items():
        want = [(k, c, None) for k, c in enumerate(done)] + ([(len(done), 0, error)] if error else [])
        assert sorted(found.get(image, [])) == want, image


def test_expansion_of_deep_copies(spark):
    """A copy of a copy, again and again: 3,000 pixels behind one literal, in a few rounds."""
    rows = [(1, 0, 0, "literal", 1, 2, 3, 4, None, None, None)] + [(1, k, 0, "copy", None, None, None, None, 3, 1 if k == 1 else 3, None) for k in range(1, 1000)]
    found = M.backref_expand(spark.createDataFrame(rows, M._TOKENS), block=100)
    assert found.agg(F.count("*"), F.count_distinct("argb"), F.max("pos")).first()[:] == (2998, 1, 2997)


def test_payload_in_blocks(spark):
    """Offsets and bytes are those of one walk, with blocks of five symbols."""
    rng = random.Random(2)
    rows, bits, start = [], "", []
    for k in range(400):
        depth, extra_bits = rng.randrange(0, 16), rng.choice([0, 0, 3, 18])
        code, extra = rng.randrange(1 << depth), rng.randrange(1 << extra_bits)
        start.append(len(bits))
        bits += (f"{code:0{depth}b}" if depth else "") + (f"{extra:0{extra_bits}b}"[::-1] if extra_bits else "")
        rows.append((1, "main", k, code, depth, extra, extra_bits))
    coded = spark.createDataFrame(rows, "image_id long, stream string, seq long, code long, depth int, extra long, extra_bits int")
    assert [r.start for r in C.bit_offsets(coded, block=5).orderBy("seq").collect()] == start
    bits += "0" * (-len(bits) % 8)
    assert bytes(C.pack_bits(coded, block=5).first().payload) == bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


# --- waves -------------------------------------------------------------------------------------------------------------------


def _holes(image, width, height, lost, seed):
    rng = random.Random(seed)
    return [(image, y * width + x, x, y, *(rng.randrange(256) for _ in range(4))) for y in range(height) for x in range(width) if rng.random() >= lost]


@pytest.mark.parametrize("lost", [0.1, 0.5])
def test_prediction_over_gaps(spark, lost):
    """Residuals by windows and restored pixels by waves see the same neighbours, whatever is missing."""
    rows = _holes(1, 9, 7, lost, 1) + _holes(2, 1, 6, lost, 2) + _holes(3, 14, 2, lost, 3) + _holes(4, 5, 5, lost, 4)
    df = spark.createDataFrame(rows, PIXELS)
    tiles = df.select("image_id", F.shiftright("x", 1).alias("tx"), F.shiftright("y", 1).alias("ty")).distinct().withColumn("mode", F.pmod(F.col("image_id") + F.col("tx") * 3 + F.col("ty") * 5, F.lit(14)).cast("int"))
    back = P.inverse_predict(P.residual(df, tiles, 1), tiles, 1)
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(rows)


def test_neighbors_over_gaps(spark):
    """Left, top, top-left and top-right of a grid with holes, by looking them up."""
    rows = _holes(1, 6, 6, 0.3, 5)
    at = {(x, y): c for _, _, x, y, *c in rows}
    for r in P.with_neighbors(spark.createDataFrame(rows, PIXELS)).collect():
        top = at.get((r.x, r.y - 1))
        ends = not any((x, r.y - 1) in at for x in range(r.x + 1, 9))
        expected = {"l": at.get((r.x - 1, r.y)), "t": top, "tl": at.get((r.x - 1, r.y - 1)) if top else None, "tr": (at.get((0, r.y)) if ends else at.get((r.x + 1, r.y - 1))) if top else None}
        assert {k: list(r[k]) if r[k] else None for k in expected} == expected


def test_gradient_over_gaps(spark):
    plane = spark.createDataFrame([(i, x, y, r) for i, _, x, y, r, *_ in _holes(1, 8, 9, 0.3, 6) + _holes(2, 3, 3, 0, 7)], "image_id long, x int, y int, v int")
    back = N.unfilter_alpha_gradient(N.filter_gradient(plane))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, plane.collect()))


def test_whole_images():
    import pandas as pd

    for size in (1, 2, 3, 7, 100):
        ids = pd.DataFrame({"image_id": [1] * 5 + [2] + [4] * 9 + [5, 6], "v": range(17)})
        parts = [ids.iloc[k : k + size] for k in range(0, 17, size)] + [ids.iloc[:0]]
        cut = list(whole_images(iter(parts)))
        assert pd.concat(cut).v.tolist() == list(range(17))
        assert sum(f.image_id.nunique() for f in cut) == 5
    assert list(whole_images(iter([]))) == []


def test_parse_of_many_images(spark):
    """Small images in one batch are parsed apart."""
    rng = random.Random(3)
    images = {k: [rng.randrange(2) for _ in range(rng.randrange(1, 40))] for k in range(30)}
    df = spark.createDataFrame([row for k, c in images.items() for row in sequence(c, k)], PIXELS)
    tokens = M.backref_parse(P.cache_hits(df))
    for k, c in images.items():
        rows = sorted((r.tok, r.pos, r.len or 0, r.dist or 0) for r in tokens.filter(F.col("image_id") == k).collect()) if k < 3 else None
        assert rows is None or [r[1:] for r in rows] == M.parse([(255 << 24) | v for v in c])
    assert M.backref_expand(tokens).drop("error").exceptAll(df.select("image_id", "pos", argb().alias("argb"))).isEmpty()


def _plain_parse(colors):
    """The greedy parse, one place after another."""
    chains, out, i, n = {}, [], 0, len(colors)
    while i < n:
        length = dist = 0
        if i + 2 < n:
            chain = chains.setdefault(M.triple_bucket(*colors[i : i + 3]), [])
            for j in chain[: -M.PROBES - 1 : -1]:
                if i - j >= M.FARTHEST:
                    break
                m = 0
                while m < min(M.LONGEST, n - i) and colors[j + m] == colors[i + m]:
                    m += 1
                if m > length:
                    length, dist = m, i - j
            chain.append(i)
        out.append((i, length, dist) if length >= 3 else (i, 0, 0))
        i += max(out[-1][1], 1)
    return out


def test_parse_looks_at_few_places(monkeypatch):
    """The parse is that of a walk over all places, and only those that may copy, or share a bucket with these, are looked at."""
    rng = random.Random(9)
    for size, colors in ((1, 1), (2, 1), (3, 1), (400, 1), (9000, 1), (300, 2), (300, 4), (2000, 9), (4000, 40), (3000, 1 << 24)):
        c = [(255 << 24) | rng.randrange(colors) for _ in range(size)]
        c = c + c[size // 3 : size // 2] + c[: size // 4]
        assert M.parse(c) == _plain_parse(c)
    looked = []
    monkeypatch.setattr(M, "equal_run", lambda *v, of=M.equal_run: looked.append(v) or of(*v))
    c = [rng.randrange(1 << 32) for _ in range(20_000)]
    assert len(M.parse(c + c[50:90])) == 20_001 and len(looked) <= 2


@pytest.mark.parametrize("bits", [4, None])
def test_tokens_in_one_shuffle(spark, bits):
    """`backref_tokens` gives what `backref_parse` gives for `cache_hits`, with one exchange of packed pixels."""
    rng = random.Random(13)
    rows = [r for k in range(40) for r in sequence([rng.choice([0, 1, 2, 77, 1 << 20]) for _ in range(rng.randrange(1, 90))], k, {5})]
    df = spark.createDataFrame([*rows, (None, 0, 0, 0, 1, 1, 1, 1), (3, 500, 0, 0, None, 1, 1, 1)], PIXELS)
    hits = P.cache_hits(df)
    tokens = M.backref_tokens(df, bits)
    assert tokens._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    other = M.backref_parse(hits if bits else hits.withColumn("hit", F.lit(False)))
    assert sorted(map(str, tokens.collect())) == sorted(map(str, other.collect()))


def test_sizes_without_books(spark):
    """`coded_bits` is `coded_size` with the histogram's own book, from one exchange."""
    rng = random.Random(21)
    rows = [(k, s, a, v, rng.randrange(1, 400), rng.choice([0, 0, 7])) for k in (1, 2, None) for s in ("p", "q") for a in (0, 4) for v in rng.sample(range(300), rng.choice([1, 2, 30]))]
    hist = spark.createDataFrame(rows, "image_id long, stream string, alphabet int, symbol int, n long, extra_bits long").filter("image_id IS NOT NULL")
    sizes = C.coded_bits(hist)
    assert sizes._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(sizes.collect()) == sorted(C.coded_size(hist, C.codebook_lengths(hist.drop("extra_bits")), hist).collect())


def test_mode_counts_are_packed(spark):
    """Counts of residuals are shuffled as chunks, dealt by tile; a tile that lies in many batches has one score a mode."""
    df = spark.range(0, 400, 1, 5).select(F.lit(1).cast("long").alias("image_id"), "id", (F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"), *(F.pmod(F.xxhash64("id", F.lit(ch)), F.lit(9)).cast("int").alias(ch) for ch in "rgba"))
    scores = P.tile_mode_scores(df.withColumnRenamed("id", "pos"), 3)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(image_id, tx, ty, mode, ch" not in plan
    assert sorted({(r.tx, r.ty) for r in scores.collect()}) == [(x, y) for x in range(3) for y in range(3)] and scores.count() == 9 * 14


def test_profiles_in_one_shuffle(spark):
    """Values are counted where they are, nulls as one more; one exchange of packed counts."""
    rng = random.Random(22)
    rows = [(k, i, 0, 0, *(rng.choice([None, 0, 3, 255, rng.randrange(256)]) for _ in range(4))) for k in (1, 2, None) for i in range(rng.randrange(5, 80))]
    profile = P.channel_profile(spark.createDataFrame(rows, PIXELS).repartition(5))
    assert profile._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    expected = set()
    for k in (1, 2, None):
        own = [r[4:] for r in rows if r[0] == k]
        less = [tuple(None if v is None or (j in (0, 2) and r[1] is None) else (v - r[1]) % 256 if j in (0, 2) else v for j, v in enumerate(r)) for r in own]
        for stage, cells in (("plain", own), ("subtract_green", less)):
            for j, ch in enumerate("rgba"):
                n = Counter(c[j] for c in cells)
                expected.add((k, stage, ch, len(own), len(n), round(1 - sum(v * v for v in n.values()) / len(own) ** 2, 9)))
    assert {tuple(r) for r in profile.collect()} == expected


def test_expansion_sends_no_tables(spark, monkeypatch):
    """Tables of pixels are dealt out in all rounds, and not sent through the driver, however small their files are."""
    plans, keep = [], Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df, name))
    rng = random.Random(23)
    df = spark.createDataFrame([r for k in range(9) for r in sequence([rng.randrange(3) for _ in range(60)], k)], PIXELS)
    found = M.backref_expand(M.backref_tokens(df))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.drop("error").exceptAll(df.select("image_id", "pos", argb().alias("argb"))).isEmpty()
    assert sum("Join" in p for p in plans) > 3 and not any("Broadcast" in p for p in plans)
