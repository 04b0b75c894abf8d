"""Operators on vectors, captures and labels, and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import ordinal, pstable, revisits
from tessera.llm.components import connected_components
from tessera.llm.queries import table


def test_recall_and_order(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.collect()
    ids, all_ = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = pstable.nearest(vectors.filter("vec_id % 100 = 0"), vectors).collect()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((all_ - all_[ids == q][0]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(np.isclose(s, far[ids == v][0], rtol=1e-12) for _, v, s in own)
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        hit, total = hit + len({v for _, v, _ in own} & set(ids[best].tolist())), total + 10
    assert hit >= 0.9 * total


def _recall(vectors, asked, k=10):
    """Recall of the candidates; rows met in buckets, and rows measured, as shares of all rows."""
    index, hit, share = pstable.Tables(vectors, vectors[asked], k), 0, 0
    for q, near in zip(asked, index.candidates(vectors[asked]), strict=True):
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        hit += len(set([i for i in np.argsort(far, kind="stable") if i != q][:k]) & set(near.tolist())) / k
        share += len(near) / len(vectors)
    return hit / len(asked), index.met / len(asked) / len(vectors), share / len(asked)


def test_hashing_selects():
    """At sf0.1, whose vectors are close to noise: fewer rows are met in buckets, repeats over tables included, than there are."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    ids, all_ = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    recall, met, share = _recall(all_, np.flatnonzero(ids % 100 == 0))
    assert recall >= 0.9 and met < 0.9 and share < 0.6, (recall, met, share)


@pytest.mark.parametrize("d", [64, 128, 256, 768])
def test_recall_at_any_dimension(d):
    """Unit vectors of noise, where hashes can select little, and clusters, where few rows are met."""
    rng = np.random.default_rng(d)
    noise = rng.standard_normal((2500, d))
    recall, met, _ = _recall(noise / np.linalg.norm(noise, axis=1)[:, None], np.arange(0, 2500, 25))
    assert recall >= 0.9 and met <= 1, (recall, met)
    clusters = rng.standard_normal((100, d))[rng.integers(0, 100, 5000)] + 0.5 * rng.standard_normal((5000, d))
    recall, met, share = _recall(clusters, np.arange(0, 5000, 50))
    assert recall >= 0.9 and met < 0.15 and share < 0.15, (recall, met, share)


@pytest.mark.filterwarnings("ignore")
def test_recall_at_any_scale():
    """Components whose squares overflow, clusters a thousand million times as wide as others, one dimension, vectors equal but for rounding: what cannot be fitted is measured whole."""
    rng = np.random.default_rng(1)
    scales = np.concatenate([rng.standard_normal((1000, 16)) * 1e-6 + 1, rng.standard_normal((1000, 16)) * 1e3])
    for v in (rng.standard_normal((300, 8)) * 1e200, scales, rng.standard_normal((1000, 1)), np.ones((500, 4)) + rng.standard_normal((500, 4)) * 1e-14):
        recall, met, _ = _recall(v, np.arange(0, len(v), 20))
        assert recall >= 0.9 and met <= 1, (recall, met)


def test_recall_over_large_shards(spark):
    """Three shards of over 1,000 vectors and several blocks, against brute force."""
    rng = np.random.default_rng(8)
    all_ = rng.standard_normal((3600, 96))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(all_)], "vec_id long, embedding array<double>")
    found = pstable.nearest(df.filter("vec_id % 100 = 0"), df, shard=1200, block=12).collect()
    hit = 0
    for q in range(0, 3600, 100):
        far = np.sqrt(((all_ - all_[q]) ** 2).sum(axis=1))
        hit += len({r.vec_id for r in found if r.query_id == q} & {int(i) for i in [i for i in np.argsort(far, kind="stable") if i != q][:10]})
    assert len(found) == 360 and hit >= 0.9 * 360, hit


def test_recall_over_shards(spark):
    """Several shards and blocks, against brute force."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.collect()
    ids, all_ = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    asked = [int(i) for i in ids if i % 25 == 0]
    found = pstable.nearest(vectors.filter("vec_id % 25 = 0"), vectors, k=5, shard=len(ids) // 4, block=6).collect()
    hit = 0
    for q in asked:
        far = np.sqrt(((all_ - all_[ids == q][0]) ** 2).sum(axis=1))
        hit += len({r.vec_id for r in found if r.query_id == q} & {int(ids[i]) for i in [i for i in np.lexsort((ids, far)) if ids[i] != q][:5]})
    assert len(found) == 5 * len(asked) and hit >= 0.9 * 5 * len(asked)


def test_odd_vectors(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(0, v), (0, v), *((i, v) for i in range(1, 30)), (30, None), (31, [0.0] * 3), (32, [1.0, None, 2.0]), (33, [float("nan"), 1.0, 1.0]), (34, [float("inf"), 1.0, 1.0]), (35, [1.0]), (None, v), (36, [1.0, 0.0, 2.5])]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, key string")
    found = sorted((r["rank"], r.vec_id, r.score) for r in pstable.nearest(df.filter("vec_id = 0"), df).collect())
    assert found == [(k, k, 0.0) for k in range(1, 11)]
    few = df.filter("vec_id IN (5, 36)")
    assert [(r.query_id, r["rank"], r.vec_id) for r in pstable.nearest(few, few).orderBy("query_id").collect()] == [(5, 1, 36), (36, 1, 5)]
    assert pstable.nearest(df.limit(0), df).count() == 0 and pstable.nearest(df, df.limit(0)).count() == 0


def test_perturbations_are_valid():
    sets = pstable.perturbations(50, 4)
    assert sets[0] == [] and len({tuple(s) for s in sets}) == len(sets)
    assert all(7 - r not in s for s in sets for r in s)


RECORD = "record_id string, url string, ts long, kind string, status int, etag string, last_modified long, digest string, headers map<string,string>, span string"


def _record(i, url, ts, kind, status=200, etag=None, modified=None, digest=None, headers=None):
    return (i, url, ts, kind, status, etag, modified, digest, headers, "clash")


def test_revisits(spark):
    rows = [
        _record("a", "http://www.X.org/p/?utm_source=q", 10, "response", 200, '"1"', 5, "d1", {"etag": '"1"', "content-type": "t", "date": "10"}),
        _record("e", "https://x.org:443/p", 9_000, "response", 500, '"9"', 5, "d9", {}),
        _record("b", "https://x.org/p#top", 9_999, "revisit", 304, 'W/"1"', None, None, {"date": "9999", "content-type": "no", "content-length": "0"}),
        _record("b", "https://x.org/p#top", 9_999, "revisit", 304, 'W/"1"', None, None, {"date": "9999", "content-type": "no", "content-length": "0"}),
        _record("c", "x.org/p", 20, "revisit", 304, '"2"', 5),
        _record("d", "x.org/p", 10, "revisit", 304, None, 5),
        _record("0", "x.org/p", 10, "revisit", 304, '"1"'),
        _record("f", "x.org/p", 30, "revisit", 304),
        _record("g", None, 30, "revisit", 304, '"1"'),
        _record("h", "x.org/p", None, "revisit", 304, '"1"'),
        _record("i", "x.org/other", 30, "revisit", 304, '"1"'),
    ]
    found = revisits.header_lines(revisits.resolve_revisits(spark.createDataFrame(rows, RECORD))).collect()
    of = {r.record_id: r for r in found}
    assert len(found) == 9
    assert {k: (r.outcome, r.refers_to) for k, r in of.items()} == {
        "b": ("resolved", "a"), "c": ("validator_mismatch", "a"), "d": ("resolved", "a"), "0": ("no_earlier_response", None), "f": ("no_validator", "a"),
        "g": ("no_url", None), "h": ("no_time", None), "i": ("no_earlier_response", None),
    }
    assert of["b"].headers == 'content-type: t\ndate: 9999\netag: "1"' and of["b"].digest == "d1" and of["c"].digest is None
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_captures_of_odd_pages(spark):
    pages = spark.createDataFrame([(None, None, None), (0, "", ""), (10, "http://a.b/", "h")], "page_id long, url string, html string")
    assert revisits.resolve_revisits(revisits.captures(pages)).count() > 0


def test_grades_held_out(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    grades = ordinal.graded(labels)
    docs = table(spark, sf_dir, "documents")
    found = {r.doc_id: r for r in ordinal.grade_texts(docs, ordinal.graded(labels.filter("crc32(CAST(doc_id AS STRING)) % 4 != 2"))).collect()}
    held = [r for r in grades.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(found[r.doc_id].selected == (r.grade >= 1) for r in held) >= 0.85 * len(held)
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in found.values())


def test_grades_odd(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "z" * 40_000, 0), (3, "z" * 40_000, 0)], "doc_id long, text string, grade int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = ordinal.grade_texts(docs, ordinal.graded(none)).collect()
    assert len(rows) == 5 and all(r.selected and r.expected_grade is None for r in rows)
    one = spark.createDataFrame([(3, 1, 0), (2, 0, 1), (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert ordinal.grade_texts(docs, ordinal.graded(one)).count() == 5 and ordinal.grade_texts(docs.limit(0), ordinal.graded(one)).count() == 0


def test_thresholds_stay_ordered():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 4, 400)
    rows = [(np.array([1, 2]), np.array([g + rng.normal(0, 0.3), 1.0])) for g in grades]
    w, cut = ordinal.fit_cumulative(rows, grades, 4, steps=400, ridge=0.0)
    assert (np.diff(cut) > 0).all() and w[1] > 1
    score = np.array([w[i] @ v for i, v in rows])
    assert ((ordinal.tails(score, cut) > 0.5).sum(axis=1) == grades).mean() > 0.8


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(150)] + [(7, 7), (None, 3)]
    of = {}

    def find(a):
        while of.setdefault(a, a) != a:
            a = of[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            of[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.component for r in found} == {v: find(v) for v in list(of)}


def test_pipeline(spark, sf_dir):
    """Near copies by all pairs, passages by all windows and ids by the tokenizers library; toxicity and leaks, which have their own tests, by their operators."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tessera.llm import bpe, decontaminate, toxicity
    from tests.llm.test_texts import _near

    docs = table(spark, sf_dir, "documents")
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    kept = {i for i, (_, component) in _near(rows).items() if i == component}
    rows = sorted((i, t) for i, t in rows if i in kept)
    seen, texts = {}, []
    for _, t in rows:
        w = t.split()
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    for _, t in rows:
        w = t.split()
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        texts.append(" ".join(x for j, x in enumerate(w) if j not in gone) if gone else t)
    search = decontaminate.Benchmark([(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]).search
    leaked = {f[0] for f in search(texts)}
    lib, sha = Tokenizer.from_file(bpe.default_path()), lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = set()
    for k, ((i, _), t) in enumerate(zip(rows, texts, strict=True)):
        if k not in leaked:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            expected.add((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert found == expected


def test_pipeline_keeps_one_of_repeated_rows(spark):
    """Repeated rows and copies with a null id: one stays, with the sound id, and keeps its text through the next stage."""
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(1)), (2, text(2)), (None, text(2)), (None, text(3)), (None, text(3)), (4, text(4)), (4, text(5)), (6, text(6)), (7, text(6)), (8, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    left = corpus_pipeline.cut_repeats(spark, near, "")
    expected = [(1, text(1)), (2, text(2)), (4, text(4)), (4, text(5)), (6, text(6)), (8, None), (9, None), (None, text(3))]
    for found in (near, left):
        assert found.columns == corpus_pipeline.COLUMNS
        assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_pipeline_filters_go_by_rows(spark, sf_dir, monkeypatch):
    """Toxic and leaking rows without id go, a clean row that shares the id of a toxic or leaking one stays; repeated rows share what becomes of them. The classifier is stood in for."""
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "score_toxicity", lambda docs, labels, learn_from: docs.selectExpr("doc_id", "CAST(text LIKE '%vile%' AS INT) AS predicted"))
    toxic, plain, leak = "vile words", "plain words", f"xx {table(spark, sf_dir, 'benchmark').first().text} yy"
    rows = [(None, toxic), (7, toxic), (7, plain), (None, leak), (8, leak), (8, plain), (8, leak), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert left(corpus_pipeline.drop_toxic(spark, docs, sf_dir)) == sorted([r for r in rows if r[1] != toxic], key=str)
    assert left(corpus_pipeline.drop_leaks(spark, docs, sf_dir)) == sorted([r for r in rows if r[1] != leak], key=str)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_header_names_have_no_case(spark):
    """A 304 with `Date` and `Cache-Control` puts its own in the place of the stored `date` and adds the other; names stay as written."""
    rows = [
        _record("a", "http://x.org/p", 10, "response", 200, '"1"', 5, "d1", {"ETag": '"1"', "Content-Type": "t", "date": "10", "Vary": "x"}),
        _record("b", "http://x.org/p", 20, "revisit", 304, '"1"', None, None, {"Date": "20", "Cache-Control": "max-age=9", "content-TYPE": "no"}),
    ]
    found = revisits.header_lines(revisits.resolve_revisits(spark.createDataFrame(rows, RECORD))).collect()
    assert [r.headers for r in found] == ['Cache-Control: max-age=9\nContent-Type: t\nDate: 20\nETag: "1"\nVary: x']


def test_sample_of_many_strata(spark, monkeypatch):
    """Every stratum is sampled, however many there are."""
    from tessera.llm import common

    df = spark.range(3000).selectExpr("id", "id % 300 AS s")
    whole = {r.id for r in common.bounded_sample(df, "id", 5, "s").collect()}
    monkeypatch.setattr(common, "MOST_STRATA", 7)
    assert {r.id for r in common.bounded_sample(df, "id", 5, "s").collect()} == whole and len({i % 300 for i in whole}) > 280
