"""Toxicity by compression distance: two zstandard dictionaries, window by window."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, bounded_sample, chunks, mix, remainder

LOWER_TABLE = LOWER.tobytes()
LOWER_LETTERS = {i: i + 32 for i in range(65, 91)}
#: A window is so many words; the next begins with its last word, so that no pair of words is torn.
WINDOW_WORDS = 12
#: Bytes of text common to both dictionaries, and most segments that either has alone.
COMMON_BYTES, OWN_SEGMENTS = 4 << 10, 200
#: A segment is a dictionary's own if at least so many training documents hold it, and it deviates so far from even use.
LEAST_DOCS, LEAST_DEVIATION, LEAST_RATIO = 4, 5.0, 3.0
#: Bounds of what training gathers: labelled documents of each label, and bytes of text.
SAMPLE_DOCS, SAMPLE_BYTES = 4_000, 24 << 20
THRESHOLD = 0.3


def windows(text: bytes) -> list[bytes]:
    """Windows of twelve words, A-Z lower-cased; those of over 1024 bytes (long words) are cut on into overlapping parts."""
    words = text.translate(LOWER_TABLE).split()
    step = WINDOW_WORDS - 1
    out = []
    for i in range(0, max(min(1, len(words)), len(words) - 1), step):
        w = b" " + b" ".join(words[i : i + WINDOW_WORDS])
        out += [w] if len(w) <= 1024 else [w[k : k + 512] for k in range(0, len(w), 448)]
    return out


class Distance:
    """Bytes that a window takes with the ordinary dictionary, less those with the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes, level: int = 16):
        self.codecs = [self._codec(d, level) for d in (ordinary, toxic)]

    @staticmethod
    def _codec(raw: bytes, level: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def gains(self, parts: list[bytes]) -> np.ndarray:
        plain, toxic = (c.compress for c in self.codecs)
        return np.array([len(plain(p)) - len(toxic(p)) for p in parts], dtype=np.float64)


CUTS = (1.0, 2.0, 3.0, 4.0, 6.0)


def features(gains: np.ndarray) -> np.ndarray:
    """What calibration sees of a document: its largest gains, its mean gain, and how many windows, and what share, gain at least so much."""
    if not len(gains):
        return np.zeros(5 + 2 * len(CUTS))
    top = np.sort(gains)[::-1]
    top3 = np.append(top[:3], [0.0] * (3 - len(top[:3])))
    over = np.array([(gains >= c).sum() for c in CUTS], dtype=np.float64)
    return np.concatenate([top3 / 4, [gains.mean(), np.log(len(gains)) / 8], np.log1p(over), 10 * over / len(gains)])


def _segments(text: bytes) -> set[bytes]:
    """The words of a text and their beginnings of four to seven letters."""
    out = set()
    for w in set(text.decode().translate(LOWER_LETTERS).split()):
        out.add(b" " + w.encode()[:40])
        out.update(b" " + w[:n].encode() for n in (4, 5, 6, 7) if len(w) > n)
    return out


def _own(mine: Counter, other: Counter, n_mine: int, n_other: int) -> list[bytes]:
    """Segments that documents of one label hold far more often than the others, the clearest last."""
    found = []
    for g, c in mine.items():
        if c >= LEAST_DOCS and c * n_other > LEAST_RATIO * (other[g] + 0.5) * n_mine:
            p = (c + other[g]) / (n_mine + n_other)
            deviation = (c - p * n_mine) / np.sqrt(p * n_mine * (1 - p * n_mine / (n_mine + n_other)) + 0.5)
            if deviation >= LEAST_DEVIATION:
                found.append((deviation, g))
    return [g for _, g in sorted(found)[-OWN_SEGMENTS:]]


def train(toxic: list[bytes], plain: list[bytes]) -> tuple[bytes, bytes]:
    """The two dictionaries: what texts of one label hold far more often than the other's, then content trained on both.

    Trained on all toxic text as it is, a dictionary spends its bytes on ordinary words, which both texts share, and its
    gains on them are noise. So the common content is trained once and stands in both dictionaries at the same distance.
    """
    counts = [Counter(), Counter()]
    for c, texts in zip(counts, (toxic, plain), strict=True):
        for t in texts:
            c.update(_segments(t))
    parts = [w for t in toxic + plain for w in windows(t) if len(w) >= 8]
    try:
        common = zstandard.train_dictionary(COMMON_BYTES, parts, k=64, d=6).as_bytes()
    except zstandard.ZstdError:  # too few windows for training: the windows themselves serve as content
        common = b" ".join(parts)[-COMMON_BYTES:]
    own = [b"".join(_own(counts[k], counts[1 - k], len(x), len(y))) for k, (x, y) in enumerate([(toxic, plain), (plain, toxic)])]
    size = max(map(len, own))  # nearest to the text: near matches cost least
    return common + own[0].rjust(size) + b" " * 8, common + own[1].rjust(size) + b" " * 8


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> np.ndarray:
    """Weights, the bias last, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if len(y):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(y) / 100 * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(y) / 100 * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Dictionaries and calibration from a bounded sample: at most about SAMPLE_DOCS labelled documents of either label (a hash of the id draws them) and SAMPLE_BYTES of text, from rows whose crc32(doc_id) mod 4 is not 2.

    Half of the sample trains the dictionaries, the other half calibrates, so that calibration sees texts the
    dictionaries have not. None if the sample lacks either label: nothing tells them apart then.
    """
    known = labels.filter("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(remainder("doc_id", 4) != 2)
    sample = bounded_sample(known, "doc_id", SAMPLE_DOCS, "toxic")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").filter("length(text) > 0")
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, SAMPLE_BYTES / max(1, size))
    rows = chosen.filter(F.pmod(F.xxhash64(F.lit("bytes"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "text", "toxic").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    half = (mix(np.array([r["doc_id"] for r in rows], dtype=np.int64).view(np.uint64), 5) & np.uint64(1)).tolist()
    if {bool(r["toxic"]) for r in rows} != {True, False}:
        return None
    texts = [[r["text"].encode() for r, h in zip(rows, half, strict=True) if h and bool(r["toxic"]) == t] for t in (True, False)]
    toxic, plain = train(*texts)
    now = Distance(toxic, plain)
    rest = [(features(now.gains(windows(r["text"].encode()))), bool(r["toxic"])) for r, h in zip(rows, half, strict=True) if not h]
    x = np.array([f for f, _ in rest]).reshape(len(rest), 5 + 2 * len(CUTS))
    # calibrated to the share of toxic labels among all labelled rows, not to that of the drawn sample
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    y = np.array([t for _, t in rest], dtype=np.float64)
    weights = _fit_logistic(x, y)
    if 0 < y.sum() < len(y) and counts.get(0) and counts.get(1):
        weights[-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return {"toxic": toxic, "plain": plain, "weights": weights}


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, learn_from: DataFrame | None = None) -> DataFrame:
    """One row per row of docs (doc_id LONG, text STRING): doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    The whole text is compared, in overlapping windows; documents are independent, so no shuffle. Null and empty texts,
    and texts without words, get the score of a document without windows. A null doc_id is scored like any other and is not held
    out. Repeated rows are each returned. Labels rows with null ids or labels are not used; where ids repeat the largest
    label counts. Where labelled documents of either label are missing, every score is 0. learn_from: the labelled documents, if docs goes by other ids than labels.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if learn_from is None else learn_from, labels))  # two dictionaries and some weights: under 50 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        distance, w = (Distance(held["toxic"], held["plain"]), held["weights"]) if held else (None, None)
        for batch in batches:
            for part, texts in chunks(batch):
                score = np.zeros(len(texts))
                if held:
                    x = np.array([features(distance.gains(windows(t))) for t in texts])
                    score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(remainder(doc_id, 4) == 2, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
