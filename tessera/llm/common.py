"""Helpers that several operators share: words, hashes, tables in the shared folder, bounded samples."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that end a word: blank, and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
#: Words of more bytes are hashed one by one; powers of more words are not kept.
_LONG_WORD, _KEPT_POWERS = 64, 1 << 17
#: Of eight bytes read at once, the first so many.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit."""
    x = (x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)).astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _kept_powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base modulo 2**64; long tables are made anew, so that a worker holds 1 MB of each at most."""
    return _kept_powers(base, _KEPT_POWERS)[:n] if n <= _KEPT_POWERS else _kept_powers.__wrapped__(base, n)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of a byte array."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~IS_SPACE[data]
    edge = np.flatnonzero(np.diff(solid))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: its length, then its bytes, eight at a time, each step mixed; of words over 64 bytes, xxh3.

    No sum or polynomial of the bytes stands between a word and its hash, so words of regular structure do not meet.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64), 40 + seed)
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at = np.flatnonzero(size <= _LONG_WORD)
    for k in range(0, _LONG_WORD, 8):
        if k:
            at = at[size[at] > k]
        if not len(at):
            break
        out[at] = mix(out[at] ^ (eight[starts[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]), seed)
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words, from the words' hashes, each step mixed."""
    n = len(words) - k + 1
    out = mix(words[:n])
    for i in range(1, k):
        out = mix(out ^ words[i : i + n], i)
    return out


class SpanHasher:
    """Hashes of spans of consecutive words, from the words' hashes, in constant time a span: polynomials modulo 2**64.

    Long sequences of regular structure can share a hash: spans meet by these, and are then compared by something else.
    """

    def __init__(self, words: np.ndarray):
        self.down = _powers(pow(_WORD_BASE, -1, 1 << 64), len(words) + 1)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * _powers(_WORD_BASE, len(words) + 1)[: len(words)], out=self.sums[1:])

    def spans(self, first: np.ndarray, past: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[past] - self.sums[first]) * self.down[first] + (past - first).astype(np.uint64), salt)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in parts of about `most` bytes of text (one row at least), so that work arrays stay small."""
    texts = texts_of(batch.column(column))
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield batch.slice(first, i - first), texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield batch.slice(first), texts[first:]


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % F.lit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`. Where it is unset there is none to write to, and this says so."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return found


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: lineage ends here, and a lost executor costs nothing that came before."""
    path = os.path.join(shared_dir(df.sparkSession), f"tessera-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()  # so that Spark's cleaner drops the shuffle files of the steps that have ended
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Strata whose counts are sent to all tasks; more are joined by an exchange.
MOST_STRATA = 10_000


def bounded_sample(df: DataFrame, id_column: str, bound: int, strata: str | None = None, salt: str = "sample") -> DataFrame:
    """About `bound` rows (of each stratum, if any), drawn by a hash of the id, so that a rerun draws the same ones. The counts come from a scan of the id and stratum alone."""
    share = F.pmod(F.xxhash64(F.lit(salt), F.col(id_column)), F.lit(1 << 30)) / float(1 << 30)
    if strata is None:
        n = df.count()
        return df.filter(share * n < bound)
    counts = df.groupBy(strata).agg(F.count("*").alias("n"))
    few = counts.limit(MOST_STRATA + 1).count() <= MOST_STRATA
    return df.join(F.broadcast(counts) if few else counts, strata).filter(share * F.col("n") < bound).drop("n")
