"""Quality grades by ordinal regression: one set of hashed-text weights, ordered thresholds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, chunks, mix, word_bounds, word_hashes

DIMENSIONS = 1 << 16
#: Bounds of the training sample: documents of each grade, and bytes of text.
SAMPLE_DOCS, SAMPLE_BYTES = 3_000, 24 << 20
#: A grade from which on a document is selected, and the probability at which it is.
SELECT_FROM, SELECT_AT = 1, 0.5
_RUNS = re.compile(rb"(.)\1+", re.S)
#: Shape of a byte: letters a, capitals A, digits 0, bytes of longer characters u, others themselves.
_SHAPE = bytes(97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 117 if b > 127 else b for b in range(256))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text and their values: words, word shapes and pairs of shapes, weighted by the root of their share, and how long the text is."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    shapes = [_RUNS.sub(rb"\1", w) for w in text.translate(_SHAPE).split()]
    kinds = list(Counter(shapes))
    at = dict(zip(kinds, range(len(kinds)), strict=True))
    own = mix(np.array([int.from_bytes((k * 8)[:8], "little") ^ len(k) for k in kinds], dtype=np.uint64), 21)
    shape = own[[at[s] for s in shapes]] if shapes else np.zeros(0, dtype=np.uint64)
    pairs = mix(shape[:-1] * np.uint64(3) + shape[1:], 22)
    parts = []
    for salt, keys in ((31, words), (32, shape), (33, pairs)):
        found, n = np.unique(mix(keys, salt) % np.uint64(DIMENSIONS), return_counts=True)
        parts.append((found.astype(np.int64), np.sqrt(n / max(1, len(keys)))))
    size = np.array([min(int(np.log2(len(words) + 1)), 20)])
    parts.append((size, np.ones(1)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade above threshold k) for each text and threshold."""
    return _sigmoid(score[:, None] - thresholds[None, :])


def fit_cumulative(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, steps: int = 200, rate: float = 0.05, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of P(grade <= k) = sigmoid(threshold_k - w.x), by Adam on the likelihood.

    Thresholds are a first one and positive gaps, so they stay in order whatever the steps.
    """
    index = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    starts = np.append(0, np.cumsum([len(r[0]) for r in rows])[:-1])
    shares = np.clip(np.array([(grades <= k).mean() for k in range(n_grades - 1)]), 1e-3, 1 - 1e-3)
    cut = np.log(shares / (1 - shares))
    raw = np.append(cut[:1], np.log(np.maximum(np.diff(cut), 1e-3)))
    w = np.zeros(DIMENSIONS)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, raw)]
    for t in range(1, steps + 1):
        thresholds = np.cumsum(np.append(raw[:1], np.exp(raw[1:])))
        score = np.add.reduceat(w[index] * value, starts)
        upper = np.append(thresholds, np.inf)[grades]
        lower = np.append(-np.inf, thresholds)[grades]
        high = np.where(np.isinf(upper), 1.0, _sigmoid(np.where(np.isinf(upper), 0, upper) - score))
        low = np.where(np.isinf(lower), 0.0, _sigmoid(np.where(np.isinf(lower), 0, lower) - score))
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_score = (d_high - d_low) / len(rows)
        g_w = np.bincount(index, weights=g_score[of] * value, minlength=DIMENSIONS) + ridge * w
        g_cut = np.array([(-d_high * (grades == k) + d_low * (grades == k + 1)).sum() for k in range(n_grades - 1)]) / len(rows)
        after = np.cumsum(g_cut[::-1])[::-1]  # a gap moves all thresholds after it
        g_raw = np.append(after[:1], after[1:] * np.exp(raw[1:]))
        for param, g, s in ((w, g_w, state[0]), (raw, g_raw, state[1])):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            param -= rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8)
    return w, np.cumsum(np.append(raw[:1], np.exp(raw[1:])))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of labels (doc_id, quality 0/1, toxic 0/1): 0 for low quality, 1 for good but toxic text, 2 for good and clean text. Rows with a null are left out; of repeated ids the lowest grade counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, grades: DataFrame) -> dict | None:
    """The model, fitted on at most about SAMPLE_DOCS documents of each grade, drawn by a hash of the id, and SAMPLE_BYTES of text. None without graded text."""
    sample = bounded_sample(grades, "doc_id", SAMPLE_DOCS, "grade")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").filter("length(text) > 0")
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, SAMPLE_BYTES / max(1, size))
    rows = chosen.filter(F.pmod(F.xxhash64(F.lit("bytes"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "text", "grade").toArrow().to_pylist()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    levels = sorted({r["grade"] for r in rows})
    place = {g: i for i, g in enumerate(levels)}
    weights, cut = fit_cumulative([features(r["text"].encode()) for r in rows], np.array([place[r["grade"]] for r in rows]), max(2, len(levels)))
    return {"weights": weights.astype(np.float32), "cut": cut, "levels": levels}


def grade_texts(docs: DataFrame, grades: DataFrame, select_from: int = SELECT_FROM, select_at: float = SELECT_AT) -> DataFrame:
    """One row per row of docs (doc_id LONG, text STRING): doc_id, expected_grade, tail_probability (of a grade of at least select_from), selected.

    grades: (doc_id LONG, grade INT), integers in ascending quality. Whole texts are read; documents are independent, so no shuffle but
    for the sample. Null and empty texts and those without words are graded by their length alone. Repeated rows are each returned, a null doc_id stays
    null, other columns are ignored. Without any graded text the columns are null, and everything is selected.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, grades))  # DIMENSIONS weights: 256 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part, texts in chunks(batch):
                if model is None:
                    none = pa.nulls(len(texts), pa.float64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), none, none, pa.array([True] * len(texts))], names=["doc_id", "expected_grade", "tail_probability", "selected"])
                    continue
                found = [features(t) for t in texts]
                score = np.array([float(model["weights"][i] @ v) for i, v in found])
                above = tails(score, model["cut"])
                levels = np.array((model["levels"] * 2)[: above.shape[1] + 1], dtype=np.float64)
                expected = levels[0] + above @ np.diff(levels)
                k = int(np.searchsorted(levels, select_from))
                tail = np.ones(len(texts)) if k == 0 else above[:, min(k, above.shape[1]) - 1] if k < len(levels) else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(expected), pa.array(tail), pa.array(tail >= select_at)], names=["doc_id", "expected_grade", "tail_probability", "selected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, selected boolean")
