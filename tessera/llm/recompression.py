"""Removal of repeated passages: locally consistent parsing by recompression, then exact window comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SpanHasher, chunks, mix, signed, texts_of, word_bounds, word_hashes, written

WINDOW = 35
#: Rounds of naming. After three, a symbol's context is about 13 words: too long to repeat by chance, short enough that
#: nine windows on average share one; after six, few contexts fit a window.
ROUNDS = 3
_FAR = 1 << 40


def _grouped(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each group of neighbours; group: True where a new one starts."""
    first = np.flatnonzero(group)
    return first, np.append(first[1:], n) - 1


def parse(names: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Recompression of a sequence of names: [(lo, hi)] for each level, the least and greatest positions whose names decided that a symbol stands where it does.

    Each round first names runs of one symbol, then parts the alphabet in two by a bit of each symbol's hash and names
    each pair left-right. Names are hashes of what they stand for, so all documents agree on them without exchange. A
    symbol's decision looks only at its neighbours; (lo, hi) adds up how far. Every occurrence of a text that covers
    lo..hi therefore holds this symbol at this place.
    """
    lo = np.arange(len(names), dtype=np.int64)
    hi = lo.copy()
    levels = [(lo, hi)]
    for r in range(rounds):
        if len(names) < 2:
            break
        # runs: symbol and length; the neighbours must differ, so they count as looked at
        first, last = _grouped(np.append(True, names[1:] != names[:-1]), len(names))
        length = (last - first + 1).astype(np.uint64)
        runs = np.where(length > 1, mix(names[first] ^ mix(length, 8)), names[first])
        lo, hi = np.append(-_FAR, lo[last[:-1]]), np.append(hi[first[1:]], _FAR)
        # pairs: left symbols join right symbols that follow; a lone left looks ahead, a lone right looks back
        left = (mix(runs, 16 + r) & np.uint64(1)).astype(bool)
        joins = np.append(left[:-1] & ~left[1:], False)
        starts = np.append(True, ~joins[:-1])
        first, last = _grouped(starts, len(runs))
        names = np.where(last > first, mix(runs[first] * np.uint64(0x9E3779B97F4A7C15) ^ mix(runs[last], 64)), runs[first])
        lone_left, lone_right = (last == first) & left[first], (last == first) & ~left[first]
        before, after = np.append(-_FAR, lo[:-1]), np.append(hi[1:], _FAR)
        lo, hi = np.where(lone_right, before[first], lo[first]), np.where(lone_left, after[last], hi[last])
        levels.append((lo, hi))
    return levels


def anchors(words: np.ndarray, valid: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """The anchor of every window, as runs of windows: (name, first window, number of windows).

    words: hashes; valid: the first positions of windows that lie in one document. A window's anchor is the symbol of
    the highest level whose context lies inside it, ties to the least hash of that context, then to the leftmost. That is
    a function of the window's words alone, so equal windows have equal anchors at equal places. The name is the hash of
    the anchor's context.
    """
    n = len(words)
    best = np.full(n, -1, dtype=np.int64)
    spans, at = SpanHasher(words), np.flatnonzero(valid)
    all_lo, all_hi, all_name, base = [], [], [], 0
    for level, (lo, hi) in list(enumerate(parse(words)))[::-1]:
        if not len(at):
            break
        fits = (hi - lo < window) & (lo >= 0) & (hi < n)
        lo, hi = lo[fits], hi[fits]
        name = spans.spans(lo, hi + 1, 100 + level)
        first, past = np.searchsorted(lo, at), np.searchsorted(hi, at + window - 1, side="right")
        some = past > first
        chosen, least = first[some].copy(), np.zeros(0, dtype=np.uint64)
        end = past[some]
        if len(chosen):
            least = name[chosen]
            for k in range(1, int((past - first).max())):
                here = first[some] + k
                inside = here < end
                other = np.where(inside, name[np.minimum(here, len(name) - 1)], np.uint64((1 << 64) - 1))
                better = inside & (other < least)
                chosen, least = np.where(better, here, chosen), np.where(better, other, least)
        best[at[some]] = base + chosen
        at = at[~some]
        all_lo.append(lo), all_hi.append(hi), all_name.append(name)
        base += len(lo)
    name = np.concatenate(all_name) if all_name else np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(valid)
    if not len(at):
        return name[:0], at, at
    own = best[at]
    first, last = _grouped(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)), len(at))
    return name[own[first]], at[first], last - first + 1


class Words:
    """The words of some texts, one text after another with a stop between: their hashes, where each text's words start, how many it has, and the words' bytes."""

    def __init__(self, texts: list[bytes]):
        parts, first, past, starts, at, size = [], [], [], [], 0, 0
        plain = [b" ".join(t.split()) for t in texts]
        for k, t in enumerate(plain):
            data = np.frombuffer(t, dtype=np.uint8)
            a, b = word_bounds(data)
            parts += [word_hashes(data, a, b), mix(np.array([k], dtype=np.uint64), 999)]
            first += [a + size, [size + len(t)]]
            past += [b + size, [size + len(t)]]
            starts.append(at)
            at += len(a) + 1
            size += len(t)
        join = lambda x, kind: np.concatenate(x).astype(kind, copy=False) if x else np.zeros(0, dtype=kind)
        self.hashes, self.first, self.past = join(parts, np.uint64), join(first, np.int64), join(past, np.int64)
        self.starts, self.counts = np.array(starts, dtype=np.int64), np.array([len(p) for p in parts[::2]], dtype=np.int64)
        self.bytes = b"".join(plain)

    def prints(self, w0: np.ndarray, n: np.ndarray) -> np.ndarray:
        """BLAKE2b, 128 bits, of each n words from w0 on, with a blank between: two columns of 64 bits. Passages that share it are equal word by word."""
        whole, digest = memoryview(self.bytes), hashlib.blake2b
        raw = [digest(whole[a:b], digest_size=16).digest() for a, b in zip(self.first[w0].tolist(), self.past[w0 + n - 1].tolist(), strict=True)]
        return np.frombuffer(b"".join(raw), dtype=np.int64).reshape(-1, 2)


def _valid(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int64)
    has = counts >= window
    np.add.at(change, starts[has], 1)
    np.add.at(change, starts[has] + counts[has] - window + 1, -1)
    return np.cumsum(change[:-1]) > 0


_PRINT = ["print_a", "print_b"]
_ANCHORS = "name long, print_a long, print_b long, key long, w0 int, n int"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch):
            words = Words(texts)
            name, w0, n = anchors(words.hashes, _valid(len(words.hashes), words.starts, words.counts, WINDOW))
            of = np.searchsorted(words.starts, w0, side="right") - 1
            mark, key = words.prints(w0, n + WINDOW - 1), part.column("key").to_numpy()[of]
            cells = (signed(name), mark[:, 0], mark[:, 1], key, (w0 - words.starts[of]).astype(np.int32), n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["name", *_PRINT, "key", "w0", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames: they cross a shuffle at less than half their size."""
    codec = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array([codec.compress(t) for t in texts_of(batch.column("text"))], pa.binary()), batch.column("no_text")], names=["key", "doc_id", "packed", "no_text"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the regions that are to be compared window by window."""
    for batch in batches:
        for key, text, rows in zip(batch.column("key").to_pylist(), texts_of(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
            words, rows = Words([text]), sorted(rows, key=lambda r: r["w0"])
            n = np.array([r["n"] for r in rows])
            at = np.concatenate([np.arange(r["w0"], r["w0"] + r["n"]) for r in rows])
            mark = words.prints(at, np.full(len(at), WINDOW))
            cells = (np.repeat(np.array([r["name"] for r in rows], dtype=np.int64), n), mark[:, 0], mark[:, 1], np.full(len(at), key), at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["name", *_PRINT, "key", "w0"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = zstandard.ZstdDecompressor()
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for packed, runs in zip(batch.column("packed").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            text = codec.decompress(packed)
            starts, ends = word_bounds(np.frombuffer(text, dtype=np.uint8))
            change = np.zeros(len(starts) + 1, dtype=np.int64)
            for r in runs or ():
                change[r["w0"]] += 1
                change[r["w0"] + r["n"] + WINDOW - 1] -= 1
            keep = np.cumsum(change[:-1]) == 0
            kept.append(b" ".join(text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)).decode())
            n_words.append(len(starts))
            n_removed.append(int((~keep).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), batch.column("no_text")], names=["key", "doc_id", "n_words", "n_removed", "kept_text", "no_text"])


def row_key() -> Column:
    """The hash of doc_id and text, which equal rows share."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit("row"))


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), text.isNull().alias("no_text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id LONG, text STRING): key (`row_key`), doc_id, n_words, n_removed, kept_text, no_text.

    Words are `[^\\x20\\x09-\\x0D]+`. Each word covered by a window of 35 consecutive words that also starts anywhere
    else, in any document, is removed; windows are judged on the input. kept_text joins the kept words by one blank;
    no_text tells null texts, which have no words. Repeated rows are copies of each other: all their windows go. A null
    doc_id is an id like any other. Columns other than doc_id and text are ignored.

    Windows meet by their anchors (see `anchors`): one row a run of windows that share one. Anchor names that occur once
    end there. Runs that equal another in every word repeat whole; of the other names, one copy of each different run is
    opened and its windows compared one by one. Words are compared by the 128-bit BLAKE2b digest of their bytes, so nothing is taken for repeated by a
    hash of hashes. Counts are combined before each shuffle, and both sides of each join are tables, so adaptive execution
    splits a name or passage that a third of all rows share.
    """
    rows = _with_key(docs)
    runs = written(rows.select("key", "text").mapInArrow(_anchor_rows, _ANCHORS), "anchors")
    names = written(runs.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").select("name"), "names")
    shared = written(runs.join(names.hint("merge"), "name"), "shared")
    passage = ["name", *_PRINT]
    regions = written(shared.groupBy(*passage).agg(F.count("*").alias("c"), F.min(F.struct("key", "w0", "n")).alias("one")).select(*passage, "c", "one.*"), "regions")
    often = written(regions.filter("c > 1").select(*passage), "often")
    equal = written(shared.join(often.hint("merge"), passage).select("key", "w0", "n"), "equal")

    # a region that occurs once may still hold windows of other regions of its name: one copy of each of these is opened
    unlike = written(regions.filter("c = 1").select("name").distinct(), "unlike")
    opened = written(regions.join(unlike.hint("merge"), "name").select("key", "w0", "n", "name"), "opened")
    opened = opened.groupBy("key").agg(F.collect_list(F.struct("w0", "n", "name")).alias("runs"))
    texts = rows.select("key", "text").join(opened, "key").dropDuplicates(["key"])
    windows = written(texts.mapInArrow(_window_rows, "name long, print_a long, print_b long, key long, w0 int"), "windows")
    alike = written(windows.groupBy(*passage).agg(F.count("*").alias("c")).filter("c > 1").select(*passage), "alike")
    repeated = windows.join(alike.hint("merge"), passage).select("key", "w0", F.lit(1).alias("n"))

    cover = written(equal.union(repeated).groupBy("key").agg(F.collect_set(F.struct("w0", "n")).alias("runs")), "cover")
    packed = rows.mapInArrow(_pack, "key long, doc_id long, packed binary, no_text boolean")
    return packed.join(cover, "key", "left").mapInArrow(_removed, "key long, doc_id long, n_words long, n_removed long, kept_text string, no_text boolean")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def reference(texts: list[str | None]) -> list[tuple[int, int, str]]:
    """The same on a few texts by comparing all windows; for tests."""
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - WINDOW + 1):
            seen[tuple(w[i : i + WINDOW])] = seen.get(tuple(w[i : i + WINDOW]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i : i + WINDOW])] > 1:
                gone.update(range(i, i + WINDOW))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
