"""Benchmark decontamination: random-walk embedding of word windows, bit-sampled hashes, then exact edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, mix

#: An item is found where a window of words is within so many edits a word of it.
EDITS_PER_WORD = 0.2
#: Items of fewer words are found where they stand word by word.
LEAST_WORDS = 5
#: Words of a hashed window (of items that have so many), words from one window of an item to the next, and steps of a walk for each word.
WINDOW, STRIDE, STEPS_PER_WORD = 7, 1, 1.6
#: Walks, the steps sampled of each, and the different places that these have to show: a walk that hardly moves on tells windows apart by few words.
WALKS, SAMPLED, PLACES = 40, 6, 4
#: Item text that one pass broadcasts at most; a larger benchmark takes several passes.
BLOCK_BYTES = 2 << 20
#: Bits of the map of hashes that a window passes before it is looked up.
MAP_BITS = 22

#: Letters of scripts that set no blanks between words: Thai to Lao, Myanmar, Khmer, kana, Han.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORDS, _ANY_ALONE, _ALONE_OR_WORDS = re.compile(r"\w+").findall, re.compile(f"[{_ALONE}]").search, re.compile(rf"[{_ALONE}]|(?:(?![{_ALONE}])\w)+").findall


def normal_words(text: str) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased; letters of scripts without blanks each by itself."""
    text = text.lower()
    return _ALONE_OR_WORDS(text) if not text.isascii() and _ANY_ALONE(text) else _WORDS(text)


def edits(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance, in words, of an item to any beginning of a text."""
    n = np.arange(len(text) + 1)
    row = n.copy()
    for i, word in enumerate(item, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(np.append(i, step) - n) + n
    return int(row.min())


def edits_from(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position of a text, its end included: least edit distance, in words, of an item to any passage that begins there."""
    text = text[::-1]
    n = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, word in enumerate(item[::-1], 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(np.append(i, step) - n) + n
    return row[::-1]


class Walks:
    """Hashes of windows of some number of words, in several walks.

    A walk reads a word and steps on or stays by a random bit of the step's number and the word (the embedding of Chakraborty, Goldenberg and
    Koucký): edits become differing places of two walks, which meet again after an edit with fair probability. A hash is that of a few sampled
    places. Every second walk goes backward from the window's end, so that an edit at either end leaves half of the walks a clean beginning.
    """

    def __init__(self, window: int, vocabulary: int, exact: bool, seed: int = 11):
        rng = np.random.default_rng([seed, window])
        self.window, self.steps = window, window if exact else int(STEPS_PER_WORD * window)
        self.walks = [(1, np.ones((self.steps, vocabulary + 1), dtype=np.int8), np.arange(window))] if exact else []
        for k in range(0 if exact else WALKS):
            self.walks.append((1 if k % 2 == 0 else -1, rng.integers(0, 2, (self.steps, vocabulary + 1), dtype=np.int8), np.sort(rng.choice(self.steps, min(SAMPLED, window - 1), replace=False))))

    def hashes(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each walk: the hashes of the windows that begin at some places, and which of them show enough places. ids: with `steps` other symbols before and after each text."""
        for k, (way, bits, sampled) in enumerate(self.walks):
            at = first.copy() if way > 0 else first + (self.window - 1)
            out, places, last = np.full(len(first), k + 1, dtype=np.uint64), np.zeros(len(first), dtype=np.int8), np.full(len(first), -1)
            for j in range(int(sampled[-1]) + 1):
                word = ids[at]
                if j in sampled:
                    out = (out ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    out ^= out >> np.uint64(32)
                    places += at != last
                    last = at.copy()
                at += way * bits[j][word]
            yield mix(out), places >= min(PLACES, self.window - 2, len(sampled))


class Benchmark:
    """The searchable form of some items: their vocabulary, and the hashes of the windows of each."""

    def __init__(self, items: list[tuple[int, str]]):
        words = [(i, w) for i, t in items if (w := normal_words(t))]
        vocabulary = sorted({x for _, w in words for x in w})
        self.ids = {x: k for k, x in enumerate(vocabulary, 1)}
        self.items = [(i, np.array([self.ids[x] for x in w], dtype=np.int32)) for i, w in words]
        self.words_of = [set(w.tolist()) for _, w in self.items]
        self.classes = []
        for window in range(1, WINDOW + 1):
            own = [k for k, (_, w) in enumerate(self.items) if min(len(w), WINDOW) == window]
            if own:
                self.classes.append(self._hashed(Walks(window, len(vocabulary), window < LEAST_WORDS), own))
        self.gap = 2 * max((walks.steps for walks, *_ in self.classes), default=1)

    def _hashed(self, walks: Walks, own: list[int]) -> tuple:
        """(walks, map of the hashes, and of each walk: hashes ascending, items, offsets) of the windows of some items."""
        parts, item, offset, at = [np.zeros(walks.steps, dtype=np.int32)], [], [], walks.steps
        for k in own:
            w = self.items[k][1]
            for j in sorted({*range(0, len(w) - walks.window + 1, STRIDE), len(w) - walks.window}):
                item.append(k), offset.append((at + j, j))
            parts += [w, np.zeros(walks.steps, dtype=np.int32)]
            at += len(w) + walks.steps
        first, offset, item = np.array([a for a, _ in offset]), np.array([j for _, j in offset]), np.array(item)
        seen, tables = np.zeros(1 << MAP_BITS, dtype=bool), []
        for h, sound in walks.hashes(np.concatenate(parts), first):
            by = np.flatnonzero(sound)
            by = by[np.argsort(h[by])]
            h = np.where(sound, h, h[by[0]] if len(by) else 0)
            seen[h & np.uint64((1 << MAP_BITS) - 1)] = True
            tables.append((h[by], item[by], offset[by]))
        return walks, seen, tables

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, edits) of every item found in some texts; the passage with fewest edits, the first of these."""
        get, gap = self.ids.get, np.zeros(self.gap, dtype=np.int32)
        parts, starts, at = [gap], [], self.gap
        for t in texts:
            own = np.array([get(w, 0) for w in normal_words(t)], dtype=np.int32)
            parts += [own, gap]
            starts.append((at, len(own)))
            at += len(own) + self.gap
        ids, text = np.concatenate(parts), np.repeat(np.arange(len(texts)), [n for _, n in starts])
        place = np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(a, a + n) for a, n in starts)])
        known = np.cumsum(np.append(0, ids > 0))
        found = []
        for walks, seen, tables in self.classes:
            # windows that lack more than two of their words among all items' words are near none
            c = walks.window
            there = known[np.minimum(place + c, len(ids))] - known[place] >= (c if c < LEAST_WORDS else c - 2)
            first, of = place[there], text[there]
            for (keys, item, offset), (h, sound) in zip(tables, walks.hashes(ids, first), strict=True):
                near = np.flatnonzero(seen[h & np.uint64((1 << MAP_BITS) - 1)] & sound)
                low, high = np.searchsorted(keys, h[near]), np.searchsorted(keys, h[near], side="right")
                size = high - low
                each = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                near = np.repeat(near, size)
                found.append(np.stack([of[near], item[each], first[near] - offset[each]], axis=1))
        found = np.unique(np.concatenate(found), axis=0) if any(map(len, found)) else np.zeros((0, 3), dtype=np.int64)
        if not len(found):
            return []
        pair = np.flatnonzero(np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1)))
        out = []
        for a, b in zip(pair.tolist(), [*pair[1:].tolist(), len(found)], strict=True):
            t, k = found[a, :2].tolist()
            start, n = starts[t]
            if best := self._best(k, (found[a:b, 2] - start).tolist(), ids[start : start + n]):
                out.append((t, self.items[k][0], best[1], best[0]))
        return out

    def _best(self, k: int, begins: list[int], ids: np.ndarray) -> tuple[int, int] | None:
        """(edits, first word) of an item in a text, from where its windows put it (ascending)."""
        item, held = self.items[k][1], self.words_of[k]
        n, most, ranges, best = len(item), int(EDITS_PER_WORD * len(item)), [], None
        for a in begins:
            if ranges and a - most <= ranges[-1][1]:
                ranges[-1][1] = a + most
            else:
                ranges.append([a - most, a + most])
        for low, high in ranges:
            low = max(low, 0)
            part = ids[low : high + n + most]
            if high < low or len(part) < n - most:
                continue
            # a passage within the edits has n + most words at most, and n - most of them are the item's
            there = np.cumsum([0, *(w in held for w in part.tolist())])
            reach = min(n + most, len(part))
            if (there[reach:] - there[:-reach]).max() < n - most:
                continue
            e = edits_from(item, part)[: high - low + 1]
            at = int(e.argmin())
            if e[at] <= most and (best is None or e[at] < best[0]):
                best = (int(e[at]), low + at)
        return best


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_edits: the items of benchmark (item_id LONG, text STRING) found in docs (doc_id LONG, text STRING).

    Words are runs of letters, digits and underscores, lower-cased, so case and punctuation count for nothing; in scripts without blanks between
    words each letter is one. An item is found where its words are within one edit (insertion, deletion, substitution of a word) for each five of
    its words of a passage of the document; items of fewer than five words where they stand as they are.

    Every window of seven words of every text (of fewer, where items have fewer) that holds enough words of the items is embedded by random walks,
    and each walk's hash of sampled places looks up the items' windows. A match puts the item in the text; there every beginning within the edits allowed is measured
    exactly. Passages without edits are always found; with a fifth of their words edited, 98 to 100 of 100 were
    at each length from 5 to 60 words. Null and empty texts hold
    no item; a null item_id or doc_id stays null; repeated rows are each searched, repeated items each found. Other columns are ignored.

    Documents are independent: no shuffle. The items go to all tasks in blocks of at most BLOCK_BYTES of text, one pass each.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Benchmark(held.value).search
            for batch in batches:
                for part, texts in chunks(batch, most=1 << 20):
                    own = part.column("doc_id").to_pylist()
                    found = [(own[f[0]], *f[1:]) for f in search([t.decode() for t in texts])]
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["doc_id", "item_id", "first_word", "n_edits"])

        one = rows.mapInArrow(run, "doc_id long, item_id long, first_word long, n_edits long")
        out = one if out is None else out.union(one)
    return out
