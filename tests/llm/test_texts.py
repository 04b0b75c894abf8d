"""Operators on documents: against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import bpe, decontaminate, langid, ppm, recompression, setsketch, toxicity
from tessera.llm.common import LOWER
from tessera.llm.queries import QUERIES, ORACLE_SQL, table

#: Clashing and needless columns, a null id, null, empty and blank texts, a repeated row, and a very long word.
ODD = [(1, None, "n1"), (2, "", "n2"), (3, " \t\n ", "n3"), (4, "a b c", "n4"), (4, "a b c", "n4"), (None, "x " * 50, "n5"), (6, "y" * 50_000, "n6"), (7, "ünï cödé 日本 <|endoftext|> 👍 " * 20, None)]
SCHEMA = "doc_id long, text string, key string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _words(text, lower=True):
    raw = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.translate(LOWER.tobytes()) if lower else raw)


def _near(texts):
    """Components by comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = _words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    of = {i: i for i in sets}

    def find(a):
        while of[a] != a:
            a = of[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_brute_force(spark):
    rnd = random.Random(4)
    rows, word = [], lambda: rnd.choice("abcdefghij") * rnd.randint(1, 6)
    for g in range(12):
        base = [word() + str(rnd.randint(0, 40)) for _ in range(rnd.choice([4, 40, 120]))]
        for _ in range(rnd.choice([1, 3, 25])):
            copy = [w if rnd.random() > 0.02 else word() for w in base]
            rows.append((len(rows), " ".join(copy)))
    expected = _near(rows)
    found = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_crowded_buckets(spark):
    """1,500 texts on one template at 0.70 to each other, and among them 40 pairs at 0.754, some of which meet only in crowded buckets."""
    template = [f"t{k}" for k in range(104)]
    tails = [[f"u{i}x{k}" for k in range(21)] for i in range(1500)]
    for i in range(40):
        tails[1000 + i] = tails[i][:4] + tails[1000 + i][4:]
    rows = [(i, " ".join(template + t)) for i, t in enumerate(tails)]
    found = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id != r.component_id} == {1000 + i: i for i in range(40)}


def _thue_morse(n, other=0):
    return "".join("ab"[(bin(i).count("1") + other) % 2] for i in range(n))


def test_words_of_regular_structure_stay_apart(spark):
    """Words that polynomials modulo a power of two take for the same are neither near copies nor repeats."""
    x, y = _thue_morse(2048), _thue_morse(2048, 1)
    short = spark.createDataFrame([(1, f"one two three four {x}"), (2, f"one two three four {y}")], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in setsketch.near_duplicates(short).orderBy("doc_id").collect()] == [(1, 1), (2, 2)]
    words = " ".join(f"w{i}" for i in range(34))
    long_ = [(1, f"{words} {x}"), (2, f"{words} {y}")]
    # and sequences of two words of such structure
    long_ += [(3, " ".join(_thue_morse(2048))), (4, " ".join(_thue_morse(2048, 1)))]
    found = recompression.digests(recompression.remove_repeats(spark.createDataFrame(long_, "doc_id long, text string"))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == {i + 1: r for i, r in enumerate(recompression.reference([t for _, t in long_]))}


def test_near_duplicates_odd(odd, none):
    rows = setsketch.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {(r.doc_id, r.n_shingles) for r in rows} >= {(1, 0), (2, 0), (3, 0), (4, 1), (None, 1), (6, 1)}
    assert all(r.kept for r in rows)
    assert setsketch.near_duplicates(none).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[1000:])
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merge_registers(ra, rb) == setsketch.registers(np.unique(pool))).all()
    guess = setsketch.likely_similarity(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
    assert abs(guess - len(np.intersect1d(a, b)) / len(np.unique(pool))) < 0.15


def test_repeats_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["the", "of", "a", *(f"w{i}" for i in range(300))])
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 80)] + [["x"] * 90]
    texts = [None, "", "one two"]
    for _ in range(60):
        body = [word() for _ in range(rnd.randint(0, 120))]
        for p in rnd.sample(passages, rnd.randint(0, 2)):
            at = rnd.randint(0, len(body))
            body[at:at] = p
        texts.append("\n".join([" ".join(body[:50]), "  ".join(body[50:])]))
    texts.append(texts[-1])
    rows = list(enumerate(texts))
    found = recompression.digests(recompression.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == dict(enumerate(recompression.reference(texts)))


def test_repeats_odd(odd, none):
    rows = recompression.remove_repeats(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in rows)[4, 3, 0] == 2
    assert {(r.doc_id, r.n_words, r.n_removed) for r in rows} >= {(None, 50, 50), (6, 1, 0), (1, 0, 0)}
    assert recompression.remove_repeats(none).count() == 0


def test_parse_is_local():
    """A symbol whose context lies in a shared passage stands in both texts."""
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 50, 60, dtype=np.uint64)
    two = [np.concatenate([rng.integers(0, 50, n, dtype=np.uint64), shared, rng.integers(0, 50, 30, dtype=np.uint64)]) for n in (17, 40)]
    found = [[{(int(a) - n, int(b) - n) for a, b in zip(lo, hi, strict=True) if a >= n and b < n + 60} for lo, hi in recompression.parse(w)] for w, n in zip(two, (17, 40), strict=True)]
    assert found[0] == found[1] and any(found[0][2])


def test_bpe_equals_library(odd, none, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def expected(text):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        return len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))

    both = odd.select("doc_id", "text").union(docs.select("doc_id", "text"))
    texts = [r.text for r in both.collect()]
    assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(both).collect()) == Counter(map(expected, texts))
    row = bpe.encode_texts(odd.filter("doc_id = 7")).first()
    assert row.decoded == ODD[-1][1] and len(row.ids) > 20
    assert bpe.encode_digests(none).count() == 0


def test_bpe_cache_is_bounded():
    """What a worker keeps stays under its bound in bytes, measured, and what it forgot it encodes alike."""
    import tracemalloc

    tracemalloc.start()
    kept, before = bpe.Kept(4 << 20), tracemalloc.get_traced_memory()[0]
    for i in range(60_000):
        kept.add(f"piece{i}", f"{i},{i + 1}")
    assert tracemalloc.get_traced_memory()[0] - before <= 5 << 20
    tracemalloc.stop()
    kept.add("x" * 65, "1")
    assert kept.older("piece0") is None and "x" * 65 not in kept.young and len(kept.old) > 1000
    assert kept.older(next(iter(kept.old))) is not None
    own = bpe.Bpe(bpe.default_path())
    own.known, own.rows = bpe.Kept(20_000), bpe.Kept(20_000)
    texts = [" ".join(f"w{i % 97}{i % 13}" for i in range(k, k + 400)) for k in range(5)] * 2
    assert [own.encode(t) for t in texts] == [bpe.loaded(bpe.default_path()).encode(t) for t in texts]


def test_bpe_random_pieces():
    from tokenizers import Tokenizer

    lib, own, rnd = Tokenizer.from_file(bpe.default_path()), bpe.loaded(bpe.default_path()), random.Random(3)
    for letters in ("abcdefghijklmnoprstuy  '.\n-=0123éß😀日", "thean ", "a", "  \n"):
        for _ in range(200):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60)))
            assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_language_held_out(docs, odd, none):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = langid.identify_languages(docs).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    from pyspark.sql import functions as F

    rows = langid.identify_languages(odd.withColumn("lang", F.lit("en"))).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"} and len(rows) == len(ODD)
    assert langid.identify_languages(none.withColumn("lang", F.lit("en"))).count() == 0


def test_language_brute_force(docs):
    """Every prediction and score again, from counts of the sample (here all rows that may be learned from) and full rows of frequencies."""
    texts = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    known = [(t, l) for i, t, l in texts if l is not None and zlib.crc32(str(i).encode()) % 5]
    languages = sorted({l for _, l in known})
    assert max(Counter(l for _, l in known).values()) < langid.SAMPLE_DOCS
    parts = lambda w, n: langid.grams(w, n) if n else [w]
    counts = [{l: Counter() for l in languages} for _ in range(langid.LONGEST + 1)]
    for t, l in known:
        for w in langid.words_of(t):
            for n, table_ in enumerate(counts):
                table_[l].update(parts(w, n))
    every = [set().union(*c.values()) for c in counts]
    total = [{l: sum(c[l].values()) + 0.5 * (len(e) + 1) for l in languages} for c, e in zip(counts, every, strict=True)]
    found = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    for i, t, _ in texts:
        score, n_words, words = dict.fromkeys(languages, 0.0), 0, langid.words_of(t)
        for w in words:
            for n in (0, *range(langid.LONGEST, 0, -1)):
                held = [p for p in parts(w, n) if p in every[n]]
                if held:
                    n_words += 1
                    for l in languages:
                        score[l] += sum(math.log10((counts[n][l][p] + 0.5) / total[n][l]) for p in held) / len(held)
                    break
        if not words:
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        top = max(score.values())
        share = {l: 10 ** ((v - top) / max(1.0, n_words**0.5)) for l, v in score.items()}
        assert math.isclose(score[found[i].lang_pred], top, rel_tol=1e-9) and math.isclose(found[i].score, share[found[i].lang_pred] / sum(share.values()), rel_tol=1e-6)


def test_base_score_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokens = {i: [*_words(t), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in ppm.score_texts(docs).collect():
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert -math.inf < r.score < 0


def test_score_brute_force(docs):
    """Scores from many blocks and shards are those of one trie over all training text, whatever the blocks."""
    texts = [(r.doc_id, r.text.encode()) for r in docs.collect()]
    trained = np.concatenate([ppm.packed(t) for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2])
    trie = ppm.Trie(*np.unique(trained, return_counts=True))
    expected = {i: trie.log10(ppm.packed(t)).sum() for i, t in texts}
    found = {r.doc_id: r.score for r in ppm.score_texts(docs.repartition(3), block_bytes=20_000, shard_bytes=5_000).collect()}
    assert found.keys() == expected.keys() and all(math.isclose(found[i], expected[i], rel_tol=1e-9) for i in expected)


def test_scores_odd(odd, none):
    rows = ppm.score_texts(odd).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert len({(r.base_score, r.score) for r in rows if r.doc_id == 4}) == 1
    assert ppm.score_texts(none).count() == 0


def test_ppm_brute_force():
    """The trie against counting by hand, and probabilities that sum to one."""
    order, texts = 2, [b"abracadabra", b"abacus", b"", b"bra"]
    keys, n = np.unique(np.concatenate([ppm.packed(t, order) for t in texts]), return_counts=True)
    trie = ppm.Trie(keys, n, order)
    symbols = [[ppm.EDGE] * order + list(t) + [ppm.EDGE] for t in texts]
    seen = [Counter() for _ in range(order + 1)]
    for s in symbols:
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[k][tuple(s[i - k : i + 1])] += 1

    def probability(context, symbol):
        p, out = 1.0, set()
        for k in range(order, -1, -1):
            c = context[len(context) - k :]
            own = {g[-1]: x for g, x in seen[k].items() if g[:-1] == c and g[-1] not in out}
            total = sum(own.values())
            if not own:
                continue
            if symbol in own:
                return p * (own[symbol] - 0.5) / total
            p *= 0.5 * len(own) / total
            out |= set(own)
        return p / (ppm.ALPHABET - len(out))

    for context in ((97, 98), (98, 114), (120, 97), (ppm.EDGE, ppm.EDGE), (1, 2)):
        keys = np.array([(context[0] << 18) | (context[1] << 9) | s for s in range(ppm.ALPHABET)])
        own = 10 ** trie.log10(keys)
        assert np.allclose(own, [probability(context, s) for s in range(ppm.ALPHABET)])
        assert math.isclose(own.sum(), 1, rel_tol=1e-9)


def test_toxicity(spark, odd, none):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7)))
    common = [word() for _ in range(300)]
    rows = []
    for i in range(600):
        body = [rnd.choice(common) for _ in range(rnd.randint(20, 120))]
        if i % 3 == 0:
            for _ in range(3):
                body.insert(rnd.randint(0, len(body)), rnd.choice(["zurkle", "vextwort", "quongled"]))
        rows.append((i, " ".join(body), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.score_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.9 * len(held)
    labels = spark.createDataFrame([(4, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.score == 0 and r.predicted == 0 for r in rows)  # one label alone tells nothing apart
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_toxicity_by_hand(spark):
    """Scores from the compressed lengths of windows, taken one by one with zstandard, and the calibrated weights."""
    import zstandard

    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["Alpha", "beta", "gamma", "delta", "eps"]) + rnd.choice("xyz") + (" zurkle" if i % 2 and rnd.random() < 0.2 else "") for _ in range(rnd.randint(1, 60)))) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    size = lambda part, raw: len(zstandard.ZstdCompressor(level=16, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(part))
    found = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(docs, labels).collect()}
    for i, text in rows[::10]:
        words = text.lower().split()
        parts = [" " + " ".join(words[k : k + 12]) for k in range(0, max(1, len(words) - 1), 11)]
        gain = np.array([size(p.encode(), model["plain"]) - size(p.encode(), model["toxic"]) for p in parts], dtype=float)
        score = 1 / (1 + math.exp(-(toxicity.features(gain) @ model["weights"][:-1] + model["weights"][-1])))
        assert math.isclose(found[i][0], score, rel_tol=1e-9) and found[i][1] == int(score >= 0.3)


def test_leaks(spark, docs, sf_dir, odd, none):
    items = table(spark, sf_dir, "benchmark")
    normal = lambda t: f" {' '.join(decontaminate.normal_words(t))} "
    own = [(r.doc_id, normal(r.text)) for r in docs.collect()]
    exact = {(i, b.item_id) for b in items.collect() for i, t in own if normal(b.text) in t}
    found = {(r.doc_id, r.item_id): r.n_edits for r in decontaminate.find_leaks(docs, items).collect()}
    assert exact and {k for k, e in found.items() if e == 0} == exact
    assert decontaminate.find_leaks(odd, items).count() == 0 and decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_leaks_stay_in_their_text():
    """A clean text before one that begins with an item holds nothing, however texts are searched together."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    for n in (5, 10, 20, 40):
        items = [(i, " ".join(word() for _ in range(n))) for i in range(20)]
        search = decontaminate.Benchmark(items).search
        for i, text in items:
            clean, leaking = " ".join(word() for _ in range(50)), f"{text} {' '.join(word() for _ in range(30))}"
            together = search([clean, leaking, clean, leaking])
            assert together == [(1, i, 0, 0), (3, i, 0, 0)] and search([clean]) == [] and search([leaking]) == [(0, i, 0, 0)]


def test_leaks_recall_at_the_limit():
    """All items are found with one edit for each five words, of every kind, and with the fewest edits that brute force finds."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    for n in (5, 8, 10, 15, 20, 30, 40, 60):
        items = [(i, " ".join(word() for _ in range(n))) for i in range(40)]
        held = decontaminate.Benchmark(items)
        for k, (i, text) in enumerate(items):
            words = text.split()
            for _ in range(n // 5):
                at = rnd.randrange(len(words))
                words[at : at + rnd.randint(0, 1)] = ["zz"] * rnd.randint(0, 1)
            filler = [word() for _ in range(rnd.choice([0, 3, 30]))]
            full = " ".join(filler + words + filler)
            ids = np.array([held.ids.get(w, 0) for w in full.split()])
            cost, first = min((decontaminate.edits(held.items[k][1], ids[p : p + n + n // 5]), p) for p in range(len(ids)))
            assert held.search(["", full, " ".join(text.split()[n // 2 :])]) == [(1, i, first, cost)]


def test_leaks_recall_and_edits():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 60)))) for i in range(100)]
    search, hit = decontaminate.Benchmark(items).search, 0
    for i, text in items:
        words = text.split()
        for _ in range(max(1, len(words) // 10)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.randint(0, 1)] = ["zz"] * rnd.randint(0, 1)
        filler = " ".join(word() for _ in range(40))
        hit += any(f[1] == i for f in search([filler, f"{filler} {' '.join(words)} {filler}"]))
    assert hit >= 97
    a, b = np.array([1, 2, 3, 4]), np.array([1, 3, 4, 9, 9])
    assert decontaminate.edits(a, b) == 1 and decontaminate.edits(a, a) == 0 and decontaminate.edits(a, b[:0]) == 4


@pytest.mark.parametrize("name", ["op7_minhash_near_dedup", "op8_substring_dedup", "op1_warc_revisits"])
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_near_on_words():
    """Exact similarity of word sequences against sets of tuples, short and long ones, with few and many different words."""
    rnd = random.Random(2)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    seen = set()
    for n, kinds in ((0, 3), (3, 1), (4, 2), (5, 2), (30, 3), (200, 1000), (6000, 9000)):
        for _ in range(30 if n < 1000 else 4):
            x = [b"%d" % rnd.randrange(kinds) for _ in range(n)]
            y = [w if rnd.random() > 0.02 else b"z" for w in x][: rnd.choice([n, n, n - 1])]
            a, b = sets(x), sets(y)
            expected = bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
            seen.add(expected)
            assert setsketch.near(x, y) == expected
    assert seen == {True, False}


def test_leaks_short_items_and_scripts_without_blanks():
    """Items of under five words stand as they are; letters of scripts without blanks are words."""
    items = [(1, "alpha Beta gamma"), (2, "你好世界再见朋友"), (3, "ทดสอบ"), (4, "solo"), (5, "one two three four five")]
    search = decontaminate.Benchmark(items).search
    texts = ["x ALPHA, beta: gamma y", "alpha beta delta gamma", "他说你好世界再见朋友吧", "他说你好世界见朋友吧", "คำ ทดสอบ", "a solo b", "one two three four six", "one two three", ""]
    assert search(texts) == [(0, 1, 1, 0), (2, 2, 2, 0), (3, 2, 2, 1), (4, 3, 2, 0), (5, 4, 1, 0), (6, 5, 0, 1)]
    assert decontaminate.normal_words("Ab_1 c世界d") == ["ab_1", "c", "世", "界", "d"]
    assert decontaminate.Benchmark([]).search(texts) == [] and decontaminate.Benchmark([(1, ""), (2, "?!")]).search(texts) == []
