"""License notices, ranked search and spelling variants: against SQL, brute force, and on odd rows."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical, licenses, variants
from tessera.llm.queries import ORACLE_SQL, QUERIES, table
from tessera.llm.terms import groups, words, words_by_part

#: Clashing and needless columns, a null id, null, empty and blank texts, a repeated row, and a very long word.
ODD = [(1, None, "n1"), (2, "", "n2"), (3, " \t\n ", "n3"), (4, "a b c", "n4"), (4, "a b c", "n4"), (None, "All rights reserved " * 3, "n5"), (6, "y" * 50_000, "n6"), (7, "ünï cödé 日本 <|endoftext|> 👍 " * 20, None)]
SCHEMA = "doc_id long, text string, n long, label string, word string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 5, "x", "w") for i, t, _ in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_lexical_search", "op13_spelling_variants"])
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_words_and_parts():
    text = "Über A_b-c3 日本 " * 1000
    assert words("Über A_b-c3 日本\n".encode()) == ["Über".encode(), b"a", b"b", b"c3", "日本".encode()]
    for most in (1, 7, 100, 1 << 20):
        assert list(itertools.chain(*words_by_part(text.encode(), most))) == words(text.encode())
    assert list(words_by_part(b"", 3)) == [[]]
    assert list(groups([("a", 3), ("b", 3), ("c", 9), ("d", 1)], 6)) == [["a", "b"], ["c"], ["d"]] and list(groups([], 6)) == []


# --- notices -------------------------------------------------------------------------------------------------------------


def _windows(text, template, percent):
    """Best overlap of any window of the block's length, by looking at every window."""
    w, t = words(text.encode()), words(template.encode())
    own, span = set(t), licenses.block_words(len(t))
    best = max((len(own & set(w[i : i + span])) for i in range(len(w))), default=0)
    return best / len(own) if 100 * best >= percent * len(own) else None


def test_notices_against_all_windows(spark):
    """Every template, in any order, with words lost, spread or put between, among words of other templates: found exactly where the threshold is met."""
    rng = random.Random(3)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in words(t.encode())})
    texts = []
    for k in range(300):
        label, t = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        w = [x.decode() for x in words(t.encode())]
        for _ in range(rng.randrange(4)):
            w.pop(rng.randrange(len(w))) if len(w) > 1 else None
        for _ in range(rng.randrange(5)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["zq", *(v.decode() for v in vocabulary[:40])]))
        if k % 3 == 0:
            rng.shuffle(w)
        texts.append(" ".join(["x"] * rng.randrange(3) + w + ["the", "license"] * rng.randrange(3) + w[: rng.randrange(len(w))]))
    rows = licenses.find_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    hits = 0
    for r in rows:
        found = {}
        for b in r.blocks:
            found[b.template] = max(found.get(b.template, 0), b.containment)
            assert 0 <= b.first_word <= b.last_word < len(words(texts[r.doc_id].encode()))
        expected = {t: _windows(texts[r.doc_id], t, licenses.PERCENT) for _, t in licenses.TEMPLATES}
        assert found == pytest.approx({t: c for t, c in expected.items() if c})
        hits += len(found)
    assert hits > 100


def test_notices_by_groups_and_hot_text(spark, monkeypatch):
    """Groups of one template give what one group gives, and a text of one notice over and over is one stretch."""
    docs = spark.createDataFrame([(1, "All rights reserved. Released under the MIT License!"), (2, "all rights reserved " * 5000), (3, "nothing")], "doc_id long, text string")
    some = licenses.TEMPLATES[-4:]
    plain = sorted(map(str, licenses.find_notices(docs, some).collect()))
    monkeypatch.setattr(licenses, "GROUP_BYTES", 1)
    assert sorted(map(str, licenses.find_notices(docs, some).collect())) == plain
    blocks = {r.doc_id: r.blocks for r in licenses.find_notices(docs, [*some, ("none", "...")]).collect()}
    assert [b.label for b in blocks[1]] == ["mit", "reserved"] and [(b.first_word, b.last_word) for b in blocks[2]] == [(0, 14_999)] and blocks[3] == []


def test_license_scan_odd_rows(odd, none):
    found = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.license_scan(odd).collect()]
    assert Counter(found) == Counter([(1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0)] + [(4, 3, 0, None, None, "", "", 0.0)] * 2 + [(None, 9, 3, 0, 6, "reserved", "reserved", 1.0), (6, 1, 0, None, None, "", "", 0.0), (7, 100, 0, None, None, "", "", 0.0)])
    assert licenses.license_scan(none).count() == 0


# --- search --------------------------------------------------------------------------------------------------------------


def _ranked(docs, items, top=10):
    """Scores by the formula, over all documents."""
    split = [(i, Counter(words((t or "").encode()))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in split), sum(c.total() for _, c in split)
    df = Counter(w for _, c in split for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in split:
            m = 25 + (75 * c.total() * n_docs) // max(n_terms, 1)
            s = sum(times * lexical.weight(n_docs, df[w]) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, times in Counter(words((text or "").encode())).items() if c[w])
            if s:
                scores.append((-s, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def _found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_search_against_formula(spark, monkeypatch):
    """Frequent and rare terms, ties, repeated rows and terms, null ids; the same with tiny shards and blocks, and with items in groups."""
    rng = random.Random(5)
    term = lambda: f"t{min(int(rng.paretovariate(0.7)), 300)}"
    docs = [(k, " ".join(term() for _ in range(rng.randrange(60)))) for k in range(700)]
    docs += [(1000, "T1, t1; t2 zebra"), (1001, "t1 t1 t2 zebra"), (1001, "t1 t1 t2 zebra"), (None, "t1 t1 t2 zebra"), (1002, None), (1003, "")]
    items = [(k, " ".join(term() for _ in range(rng.randrange(1, 25)))) for k in range(25)] + [(90, "zebra zebra T1"), (91, "unheard of"), (92, None), (93, ""), (90, "zebra zebra T1")]
    one = [x for k, x in enumerate(items) if x not in items[:k]]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = _ranked(docs, one)
    assert _found(lexical.search(df, asked)) == expected
    monkeypatch.setattr(lexical, "GROUP_BYTES", 150)
    assert _found(lexical.search(df.withColumn("score", F.lit(1)), asked.withColumn("rank", F.lit(1)))) == expected


@pytest.mark.parametrize(("short", "block", "shard"), [(0.25, 4096, 10_000), (0.25, 3, 97), (0.0, 1, 50), (5.0, 16, 10_000), (0.02, 8, 10_000)])
def test_hybrid_walk(short, block, shard):
    """Any split of short and long lists, blocks and shards gives the best by full scores; few documents of the long lists are looked at when the short ones decide."""
    rng = np.random.default_rng(2)
    n, terms = 900, 40
    share = np.geomspace(0.002, 0.95, terms)
    has = rng.random((n, terms)) < share
    tf = np.where(has, rng.integers(1, 6, (n, terms)), 0)
    tf[n // 2] = tf[n // 3]  # a tie
    lengths = tf.sum(1) + 3
    weights = np.array([lexical.weight(n, int(x)) for x in has.sum(0)])
    for q in range(30):
        query = [(int(t), int(rng.integers(1, 3))) for t in rng.choice(terms, rng.integers(1, 12), replace=False)]
        best = lexical.Best(10)
        for at in range(0, n, shard):
            rows = slice(at, at + shard)
            r, c = np.nonzero(tf[rows])
            s = lexical.build(np.arange(n)[rows], lengths[rows], c.astype(np.int32), tf[rows][r, c], (tf[rows] > 0).sum(1), weights, n, int(lengths.sum()))
            lexical.search_shard(s, query, best, short, block)
        m = lexical.lengths_of(lengths, n, int(lengths.sum()))
        total = sum(times * np.where(tf[:, t] > 0, lexical.gains(tf[:, t], m, weights[t]), 0) for t, times in query)
        order = [i for i in np.lexsort((np.arange(n), -total))[:10] if total[i] > 0]
        assert best.ids.tolist() == order and best.scores.tolist() == total[order].tolist()


def test_search_bounds():
    assert lexical.weight(10, 10) == math.floor(1000 * math.log(22 / 21)) and lexical.weight(10, 0) == math.floor(1000 * math.log(22))
    assert lexical.lengths_of(np.array([1 << 31, 5]), 1 << 31, 1 << 33).tolist() == [25 + (75 << 62) // (1 << 33), 25 + (375 << 31) // (1 << 33)]


def test_search_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "a rights c"), (2, None)], "item_id long, text string")
    assert _found(lexical.search(odd, items)) == _ranked([(i, t) for i, t, _ in ODD], [(1, "a rights c")])
    assert lexical.search(none, items).count() == 0 and lexical.search(odd, items.filter("item_id > 5")).count() == 0
    text_ids = spark.createDataFrame([("q", "b")], "item_id string, text string")
    assert [(r.item_id, r.doc_id) for r in lexical.search(odd, text_ids).collect()] == [("q", 4), ("q", 4)]


# --- variants ------------------------------------------------------------------------------------------------------------


def _one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _grouped(counts):
    near = {w: [v for v in counts if _one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    root = {}
    for w in counts:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return sorted((w, form[w] or "", root[w], n, len(near[w]), counts[form[w]] if form[w] else 0) for w, n in counts.items())


def _variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_variants_against_all_pairs(spark, monkeypatch):
    """Random words over few letters, so that many are near, have the same letters, or repeat a letter; chains of forms; ties by code point; and the same with chunks of two words."""
    rng = random.Random(9)
    counts = {}
    for _ in range(900):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9)))
        counts[w] = rng.choice([3, 3, 4, 7, 9, 20, 50, 120])
    counts |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "y" * 3000: 5, "y" * 3001: 11, "straße": 4, "strasse": 9, "strase": 8}
    rows = list(counts.items()) + [("abcd", 50), ("rare5", 2), (None, 9)]
    df = spark.createDataFrame([(w, n - 1 if w == "aaaaa" else n, 0) for w, n in rows] + [("aaaaa", 1, 0)], "word string, n long, form int")
    expected = _grouped(counts)
    assert _variants(variants.group_variants(df)) == expected
    assert {r[0]: r[2] for r in expected}["aaaaa"] == {r[0]: r[2] for r in expected}["aaaaaa"]
    monkeypatch.setattr(variants, "CHUNK", 2)
    assert _variants(variants.group_variants(df)) == expected


def test_signatures_meet():
    """Multisets at distance two at most share a signature; one pair is told by exactly one of them."""
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(5, 12))]
        b = list(a)
        k = rng.randrange(len(b))
        if rng.random() < 0.5:
            b[k] = rng.choice("abcdefghij")
        else:
            del b[k]
        x, y = ("".join(sorted(w)) for w in (a, b))
        shared = variants.signatures(x) == variants.signatures(y)
        assert shared.all() if x == y else shared.any() and variants.differ(x, y)
    assert variants.differ("abc", "abc") is None and variants.differ("abc", "abde") is None and variants.differ("abc", "abd") == ("c", "d") and variants.differ("ab", "abc") == ("", "c")


def test_marked_words(spark, odd, none, monkeypatch):
    import zlib

    docs = [(k, "Straße straße Ünder × ÷ naïve-co_op " + "qqqqqqq" * (k % 5)) for k in range(400)] + [(None, "Null id"), (5, None)]
    expected = Counter()
    for i, t in docs:
        for run, n in Counter(variants.RUN.findall((t or "").encode().translate(variants._LOWER).decode())).items():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            expected[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += n
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.word: r.n for r in variants.marked_words(df).collect()}
    assert found == expected and "straße" in found and "Ünder" in found and "×" in found and "sraße" in found
    monkeypatch.setattr(variants, "HELD", 3)
    assert {r.word: r.n for r in variants.marked_words(df).collect()} == expected
    assert variants.group_variants(variants.marked_words(none)).count() == 0
    assert {r.word for r in variants.group_variants(variants.marked_words(odd), 1, 1).collect()} >= {"y" * 50_000, "rights", "a"}


def test_whole_tables_are_read(spark, sf_dir):
    assert licenses.license_scan(table(spark, sf_dir, "documents")).count() == table(spark, sf_dir, "documents").count()
