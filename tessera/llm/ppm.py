"""Language-model scores by prediction by partial matching over bytes, and a word-frequency base score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, mix, remainder, signed, texts_of, word_bounds, word_hashes, written

ORDER = 5
#: Symbols are bytes, and one that stands before a text and ends it.
EDGE, ALPHABET, BITS = 256, 257, 9
END_WORD = -1
#: Bytes of text, and texts, of a block, what one task scores at a time; bytes of text for each shard of what is counted.
BLOCK_BYTES, BLOCK_TEXTS, SHARD_BYTES = 16 << 20, 100_000, 8 << 20
#: What is counted: words, and byte contexts with their symbol.
WORDS, CONTEXTS = 0, 1


def packed(text: bytes, order: int = ORDER) -> np.ndarray:
    """Of every symbol of a text, its end included: the `order` symbols before it and itself, nine bits each, the nearest lowest."""
    s = np.full(len(text) + order + 1, EDGE, dtype=np.int64)
    s[order:-1] = np.frombuffer(text, dtype=np.uint8)
    out = np.zeros(len(text) + 1, dtype=np.int64)
    for k in range(order + 1):
        out |= s[k : k + len(out)] << (BITS * (order - k))
    return out


def _low(key: np.ndarray, symbols: int) -> np.ndarray:
    return key & ((1 << (BITS * symbols)) - 1)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed counts."""
    if not len(keys):
        return keys, n
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in an ascending table, -1 if absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Trie:
    """A byte-context trie of one order with counts, laid out by order: log10 probabilities of symbols after contexts.

    Every occurrence counts at all orders. A context with total t over q distinct symbols gives a symbol seen n times
    (n - 1/2) / t, and q / 2t to an escape to the next shorter context, where the symbols already ruled out no longer
    count. After the shortest context, the symbols left share alike.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        """keys: as `packed` gives them; they may be only those of some pairs of nearest symbols, if `pairs` holds the keys and counts of order 1 of all."""
        self.order = order
        self.keys, self.counts = [np.zeros(0, dtype=np.int64)] * (order + 1), [np.zeros(0, dtype=np.int64)] * (order + 1)
        self.keys[order], self.counts[order] = _summed(keys, counts)
        for k in range(order - 1, -1, -1):
            whole = k == 1 and pairs is not None
            self.keys[k], self.counts[k] = pairs if whole else _summed(_low(self.keys[k + 1], k + 1), self.counts[k + 1])
        self.contexts, self.total, self.kinds, self.ruled = [], [], [], []
        for k in range(order + 1):
            context = self.keys[k] >> BITS
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, dtype=np.int64)
            self.contexts.append(context[first])
            add = lambda x: np.add.reduceat(x, first) if len(first) else x  # noqa: B023, E731
            self.total.append(add(self.counts[k]))
            self.kinds.append(np.diff(np.append(first, len(context))))
            # how often this context's symbols occur in the next shorter context: what an escape rules out there
            self.ruled.append(add(self.counts[k - 1][_lookup(self.keys[k - 1], _low(self.keys[k], k))]) if k else np.zeros(len(first)))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each key after the symbols before it."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        ruled, gone = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(self.order, -1, -1):
            own = _low(keys[open_], k + 1)
            c = _lookup(self.contexts[k], own >> BITS)
            there = c >= 0
            at = np.maximum(c, 0)
            if not len(self.contexts[k]):
                continue
            total = np.where(there, self.total[k][at] - ruled[open_], 0)
            kinds = np.where(there, self.kinds[k][at] - gone[open_], 0)
            leaf = _lookup(self.keys[k], own)
            hit = leaf >= 0
            mass = np.maximum(total, 1)
            out[open_[hit]] += np.log10((self.counts[k][leaf[hit]] - 0.5) / mass[hit])
            escape = ~hit & there & (kinds > 0)
            out[open_[escape]] += np.log10(0.5 * kinds[escape] / mass[escape])
            ruled[open_] = np.where(there, self.ruled[k][at], 0)
            gone[open_] = np.where(there, self.kinds[k][at], 0)
            open_ = open_[~hit]
        out[open_] -= np.log10(np.maximum(ALPHABET - gone[open_], 1))
        return out


def _words(text: bytes) -> np.ndarray:
    data = LOWER[np.frombuffer(text, dtype=np.uint8)]
    h = signed(word_hashes(data, *word_bounds(data)))
    return np.append(np.where(h == END_WORD, END_WORD - 1, h), END_WORD)


_BLOCK = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, packed binary"


def _blocks(block_bytes: int):
    """Neighbouring rows as one: ids, which are held out, sizes in bytes, and the texts as one zstandard frame. The table is written, so a block's number holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3)
        base = TaskContext.get().partitionId() << 32
        ids, held, texts, size, n = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            cells = [[base + n], [ids], [held], [[len(t) for t in texts]], [codec.compress(b"".join(texts))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["block", "doc_ids", "held", "sizes", "packed"])

        for batch in batches:
            for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts_of(batch.column("text")), strict=True):
                if texts and (size + len(t) > block_bytes or len(texts) >= BLOCK_TEXTS):
                    yield block()
                    ids, held, texts, size, n = [], [], [], 0, n + 1
                ids.append(i), held.append(h), texts.append(t)
                size += len(t)
        if texts:
            yield block()

    return run


def _texts(packed_: bytes, sizes: list[int]) -> list[bytes]:
    whole, ends = zstandard.ZstdDecompressor().decompress(packed_, max_output_size=max(1, sum(sizes))), np.cumsum([0, *sizes]).tolist()
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _runs(texts: list[bytes], most: int = 2 << 20) -> Iterator[slice]:
    """Neighbouring texts of about `most` bytes together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def _distinct(texts: list[bytes], held: list[bool], of) -> tuple[np.ndarray, np.ndarray]:
    """The distinct items of some texts, ascending, with how often training texts hold them."""
    parts = []
    for out in (False, True):
        own = [t for t, h in zip(texts, held, strict=True) if h == out]
        for run in _runs(own):
            keys, n = np.unique(np.concatenate([of(t) for t in own[run]]), return_counts=True)
            parts.append((keys, np.zeros_like(n) if out else n))
    return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


def _dealt(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys.view(np.uint64), 21) % np.uint64(n)).astype(np.int64)


def _cut(shard: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, slice]]]:
    """Order by shard, and each shard's slice of it."""
    by = np.argsort(shard, kind="stable")
    shard = shard[by]
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return by, zip(shard[first].tolist(), map(slice, first.tolist(), np.append(first[1:], len(shard)).tolist()), strict=True)


_COUNTED = "kind int, shard long, block long, keys binary, n binary, trained long"


def _counted(shards: int):
    """One row for each kind, block and shard: the block's distinct items of the shard, ascending, and how often its training texts hold each. Of kind 2: its contexts of one symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, sizes, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "held", "sizes", "packed")), strict=True):
                texts = _texts(raw, sizes)
                for kind, of in ((WORDS, _words), (CONTEXTS, packed)):
                    keys, n = _distinct(texts, held, of)
                    by, cuts = _cut(_dealt(keys, shards))
                    own, times = keys[by], n[by]
                    rows = [(kind, s, block, _small(own[c]), _small(times[c]), int(times[c].sum())) for s, c in cuts]
                    if kind == CONTEXTS:
                        low, times = _summed(_low(keys[n > 0], 2), n[n > 0])
                        rows.append((2, 0, block, _small(low), _small(times), 0))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["kind", "shard", "block", "keys", "n", "trained"])

    return run


def _small(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _large(cells: pa.ChunkedArray | pa.Array, dtype: type = np.int64) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(x), dtype=dtype) for x in cells.to_pylist()]


def _counts(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a shard's rows: each row's keys; and all distinct keys, ascending, with their counts."""
    keys, n = _large(table.column("keys")), _large(table.column("n"))
    return keys, *_summed(np.concatenate(keys), np.concatenate(n))


_ANSWER = "block long, kind int, shard long, values binary, distinct_words long"


def _answers(table: pa.Table, kind: int, values: list[np.ndarray], distinct: int = 0) -> pa.Table:
    """What a shard gives back to each block: the value of each of its items, in their order."""
    n = table.num_rows
    return pa.table({"block": table.column("block"), "kind": pa.array([kind] * n, pa.int32()), "shard": table.column("shard"), "values": pa.array(map(_small, values), pa.binary()), "distinct_words": pa.array([distinct] + [0] * (n - 1), pa.int64())})


def _word_answers(table: pa.Table) -> pa.Table:
    """Each word's count in all training texts."""
    rows, keys, n = _counts(table)
    return _answers(table, WORDS, [n[np.searchsorted(keys, k)] for k in rows], int((n > 0).sum()))


def _pair_shard(keys: np.ndarray, n: int) -> np.ndarray:
    return _dealt((keys >> BITS) & ((1 << (2 * BITS)) - 1), n)


def _totals(pair_shards: int):
    """The distinct contexts with symbols of a shard and their counts, dealt by the two symbols before the last: all that one context's probabilities rest on, but for the contexts of one symbol, comes together."""

    def run(table: pa.Table) -> pa.Table:
        _, keys, n = _counts(table)
        by, cuts = _cut(_pair_shard(keys, pair_shards))
        keys, n, shard = keys[by], n[by], table.column("shard")[0].as_py()
        rows = [(p, shard, _small(keys[c]), _small(n[c])) for p, c in cuts]
        return pa.table({"pair_shard": pa.array([r[0] for r in rows], pa.int64()), "shard": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.binary()), "n": pa.array([r[3] for r in rows], pa.binary())})

    return run


def _asked(pairs: tuple[np.ndarray, np.ndarray]):
    """log10 probabilities of the contexts' symbols of one pair shard."""

    def run(table: pa.Table) -> pa.Table:
        keys, n = (_large(table.column(c)) for c in ("keys", "n"))
        all_, counts = np.concatenate(keys), np.concatenate(n)
        value = Trie(all_[counts > 0], counts[counts > 0], pairs=pairs).log10(all_)
        ends = np.cumsum([0, *map(len, keys)])
        return pa.table({"shard": table.column("shard"), "keys": table.column("keys"), "values": pa.array([_small(value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    return run


def _context_answers(asked: pa.Table, found: pa.Table) -> pa.Table:
    keys, values = (np.concatenate(_large(found.column(c), kind)) for c, kind in (("keys", np.int64), ("values", np.float64)))
    by = np.argsort(keys)
    keys, values = keys[by], values[by]
    return _answers(asked, CONTEXTS, [values[np.searchsorted(keys, k)] for k in _large(asked.column("keys"))])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _scored(shards: int):
    """The sums of each text of a block, whose items are found again, in the order in which their values came."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, held, sizes, raw = (block.column(c)[0].as_py() for c in ("doc_ids", "held", "sizes", "packed"))
        texts, sums, n_tokens = _texts(raw, sizes), {}, None
        for kind, of, dtype in ((WORDS, _words, np.int64), (CONTEXTS, packed, np.float64)):
            own = sorted((s, v) for k, s, v in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "values")), strict=True) if k == kind)
            keys, _ = _distinct(texts, held, of)
            keys = keys[_cut(_dealt(keys, shards))[0]]
            value = np.concatenate([np.frombuffer(zstandard.decompress(v), dtype) for _, v in own])
            index, parts = pd.Index(keys), []
            for run in _runs(texts):
                items = [of(t) for t in texts[run]]
                found, first = value[index.get_indexer(np.concatenate(items))], np.cumsum([0, *map(len, items)])[:-1]
                parts.append([np.add.reduceat(x, first) for x in ([np.log10(found + 1.0), found > 0, np.ones(len(found))] if kind == WORDS else [found])])
            sums[kind] = [np.concatenate(x) for x in zip(*parts, strict=True)]
        base, known, n_tokens = sums[WORDS]
        whole = lambda x: pa.array(np.asarray(x, dtype=np.int64))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": whole(n_tokens), "n_known": whole(known), "base": pa.array(base), "score": pa.array(sums[CONTEXTS][0])})

    return run


def _pairs(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All symbols after one symbol, with counts: at most 257 * 257 rows, which go to the driver and out again."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(_large(batch.column("keys")), _large(batch.column("n")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "times"])

    rows = counted.filter("kind = 2").select("keys", "n").mapInArrow(each, "key long, times long")
    table = rows.groupBy("key").agg(F.sum("times").alias("times")).orderBy("key").toArrow()
    return table.column("key").to_numpy(), table.column("times").to_numpy()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 7) == 2, F.lit(False))


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs (doc_id LONG, text STRING): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32(doc_id) mod 7 is not 2. score is the sum of log10 probabilities of a text's bytes
    (A-Z as they are) and of its end by the trie of all training texts, which keeps every context; base_score that of its words, A-Z lower-cased, and
    their end, by add-one word frequencies. Null text is empty: one token, the end. A null doc_id is not held out and trains. Repeated rows
    train as often as they occur and are each returned. Without training text, frequencies are those of no count, and bytes share alike. Other columns are ignored.

    Neither words nor trie are gathered anywhere. Texts stand in blocks of 16 MB. A block sends its distinct words and six-byte
    sequences, with counts, to shards, of which there are as many as the input has 8 MB; a row is what one block has for one shard, so it never takes more
    rows than items. A shard adds up and answers: counts for words at once; for bytes, the shards' distinct sequences meet by their two nearest
    context bytes, where the trie of those contexts gives all their probabilities (the 257 * 257 contexts of one byte are sent along), which go back to the shards.
    The answers meet each block's texts by its number. Words are told apart by 64-bit hashes.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), text.alias("text"))
    blocks = written(rows.mapInArrow(_blocks(block_bytes), _BLOCK), "blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(32, -(-size // shard_bytes))
    pair_shards = max(32, 4 * math.isqrt(shards))  # distinct contexts grow with less than the input

    counted = written(blocks.mapInArrow(_counted(shards), _COUNTED), "counted")
    by_kind = lambda k: counted.filter(F.col("kind") == k).select("shard", "block", "keys", "n").groupBy("shard")
    word_answers = written(by_kind(WORDS).applyInArrow(_word_answers, _ANSWER), "answers")
    totals = by_kind(CONTEXTS).applyInArrow(_totals(pair_shards), "pair_shard long, shard long, keys binary, n binary")
    values = totals.groupBy("pair_shard").applyInArrow(_asked(_pairs(counted)), "shard long, keys binary, values binary")
    answers = by_kind(CONTEXTS).cogroup(values.groupBy("shard")).applyInArrow(_context_answers, _ANSWER).union(word_answers)

    trained = counted.filter(F.col("kind") == WORDS).agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]
    distinct = word_answers.agg(F.coalesce(F.sum("distinct_words"), F.lit(0))).first()[0]
    scored = blocks.groupBy("block").cogroup(answers.select("block", "kind", "shard", "values").groupBy("block")).applyInArrow(_scored(shards), _SCORED)
    each = float(np.log10(trained + distinct + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(trained)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score")
