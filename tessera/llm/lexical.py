"""Ranked search for terms: accumulators summed over short lists walk beside the long lists, which are skipped through document by document."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, written
from tessera.llm.terms import groups, words, words_by_part

TOP = 10
#: Bytes of items that are searched in one pass over the texts; more are searched group after group.
GROUP_BYTES = 2 << 20
#: Postings of one shard of documents in a task, and documents that are looked at together.
SHARD, BLOCK = 2_000_000, 4096
#: Lists are summed up, the shortest first, until they hold this share of a shard's documents.
SHORT = 0.25


def weight(n_docs: int, df: int) -> int:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1)))"""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths_of(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 75 + ((75 * n * N) div L), in Python's numbers where 64 bits could not hold a product."""
    if not len(n):
        return n.astype(np.int64)
    if 75 * int(n.max()) * n_docs < 1 << 62:
        return 25 + (75 * n * n_docs) // n_terms
    return np.array([25 + (75 * x * n_docs) // n_terms for x in n.tolist()], dtype=np.int64)


def gains(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w * ((1000000000 * tf) div (1000 * tf + 8 * m))"""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


@dataclass
class Shard:
    """Inverted lists of some documents: per term the documents, ascending, with their gains, and the largest gain."""

    ids: np.ndarray
    first: np.ndarray
    docs: np.ndarray
    gain: np.ndarray
    most: np.ndarray

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.first[term], self.first[term + 1])
        return self.docs[at], self.gain[at]


def build(ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tf: np.ndarray, per_doc: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> Shard:
    """A shard of documents (ids, lengths in terms) with their terms and frequencies, `per_doc` of them each, one document after another."""
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), per_doc)
    order = np.argsort(terms, kind="stable")
    terms, doc, tf = terms[order], doc[order], tf[order].astype(np.int64)
    gain = gains(tf, lengths_of(lengths, n_docs, n_terms)[doc], weights[terms])
    first = np.searchsorted(terms, np.arange(len(weights) + 1))
    most = np.zeros(len(weights), dtype=np.int64)
    held = np.flatnonzero(first[1:] > first[:-1])
    if len(held):
        most[held] = np.maximum.reduceat(gain, first[held])
    return Shard(ids, first, doc, gain, most)


class Best:
    """The highest-scoring documents so far: equal scores by ascending id, a null id (the largest number, marked) last."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids = top, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """What a document has to reach: the last one's score, or 1."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least
        if keep.any():
            scores, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
            order = np.lexsort((ids, -scores))[: self.top]
            self.scores, self.ids = scores[order], ids[order]


def search_shard(shard: Shard, query: list[tuple[int, int]], best: Best, short: float = SHORT, block: int = BLOCK) -> None:
    """Adds a shard's documents to the best of a query (term, times in the query).

    Term at a time: the shortest lists are summed into accumulators, which from then on are one list with the largest accumulator as its bound. Document at a time: lists whose bounds
    together stay below the least score kept are not walked, only probed; the documents of the others are taken in blocks, in their order, and dropped as soon as what they have and
    what the lists not yet probed can add stays below that score. A document that can equal it is kept, so ties are told by id.
    """
    size = {t: int(shard.first[t + 1] - shard.first[t]) for t, _ in query}
    lists = sorted(((size[t], t, times) for t, times in query if size[t] and shard.most[t]), key=lambda x: (x[0], x[1]))
    if not lists:
        return
    summed, held, n = [], 0, len(shard.ids)
    while lists and held + lists[0][0] <= short * n:
        held += lists[0][0]
        summed.append(lists.pop(0))
    walked: list[tuple[int, np.ndarray, np.ndarray]] = []  # (bound, documents, gains)
    if summed:
        docs, gain = (np.concatenate(x) for x in zip(*((d, g * times) for _, t, times in summed for d, g in [shard.list_of(t)]), strict=True))
        docs, at = np.unique(docs, return_inverse=True)
        total = np.zeros(len(docs), dtype=np.int64)
        np.add.at(total, at, gain)
        walked.append((int(total.max()), docs, total))
    for _, t, times in lists:
        docs, gain = shard.list_of(t)
        walked.append((int(shard.most[t]) * times, docs, gain * times if times > 1 else gain))
    walked.sort(key=lambda x: x[0])
    bounds = np.cumsum([0, *(b for b, _, _ in walked)])
    least = best.least
    if summed and len(total) >= best.top:  # the accumulators alone show that so many documents reach this
        least = max(least, int(np.partition(total, len(total) - best.top)[len(total) - best.top]))
    cursors, begin = [0] * len(walked), 0
    while begin < n:
        first = int(np.searchsorted(bounds[1:], least))  # lists before it cannot reach the least score together
        if first >= len(walked):
            return
        # the next block of documents of the lists that are walked: up to the `block`-th of the list that has them densest
        end = n
        for k in range(first, len(walked)):
            docs = walked[k][1]
            cursors[k] += int(np.searchsorted(docs[cursors[k] :], begin))
            if cursors[k] + block < len(docs):
                end = min(end, int(docs[cursors[k] + block]))
        parts = []
        for k in range(first, len(walked)):
            docs, gain = walked[k][1:]
            past = cursors[k] + int(np.searchsorted(docs[cursors[k] :], end))
            parts.append((docs[cursors[k] : past], gain[cursors[k] : past]))
            cursors[k] = past
        docs, at = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
        score = np.zeros(len(docs), dtype=np.int64)
        np.add.at(score, at, np.concatenate([g for _, g in parts]))
        for k in range(first - 1, -1, -1):
            alive = score + bounds[k + 1] >= least
            docs, score = docs[alive], score[alive]
            if not len(docs):
                break
            others, gain = walked[k][1:]
            at = np.searchsorted(others, docs)
            at[at == len(others)] = 0
            score = score + np.where(others[at] == docs, gain[at], 0)
        best.add(score, shard.ids[docs])
        least, begin = max(least, best.least), end


_NULL_ID = (1 << 63) - 1


def _postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of every row: its length in terms, and the numbered terms in it with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                n, terms, tfs = [], [], []
                for t in texts:
                    count, found = 0, []
                    for ws in words_by_part(t):
                        count += len(ws)
                        found.append(np.fromiter((number.get(w, -1) for w in ws), np.int32, len(ws)))
                    ids, tf = np.unique(np.concatenate(found) if found else np.empty(0, np.int32), return_counts=True)
                    n.append(count), terms.append(ids[ids >= 0]), tfs.append(tf[ids >= 0].astype(np.int32))
                ends = pa.array(np.cumsum([0, *map(len, terms)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _search(postings: DataFrame, queries: list[tuple[object, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, top: int, item_type: str) -> DataFrame:
    """(query, item_id, doc_id, score): what each task's shards hold of the best of each query. Memory is that of one shard and the best documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]

        def look(held: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(held)
            ids = whole.column("doc_id").fill_null(_NULL_ID).to_numpy()
            terms, tf = (whole.column(c).combine_chunks() for c in ("terms", "tf"))
            shard = build(ids, whole.column("n").to_numpy(), terms.flatten().to_numpy(), tf.flatten().to_numpy(), terms.value_lengths().to_numpy(), weights, n_docs, n_terms)
            for (_, query), found in zip(queries, best, strict=True):
                search_shard(shard, query, found)

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                held.append(part)
                size += len(part.column("terms").flatten())
                if size >= SHARD:
                    look(held)
                    held, size = [], 0
        if held:
            look(held)
        which = np.repeat(np.arange(len(queries)), [len(b.scores) for b in best])
        ids = np.concatenate([b.ids for b in best]) if best else np.empty(0, np.int64)
        scores = np.concatenate([b.scores for b in best]) if best else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([queries[k][0] for k in which.tolist()], kind), pa.array(ids, mask=ids == _NULL_ID), pa.array(scores)], names=["query", "item_id", "doc_id", "score"])

    kind = pa.int64() if item_type == "bigint" else pa.string()
    return postings.mapInArrow(run, f"query long, item_id {item_type}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` highest-scoring rows of docs (doc_id LONG, text) for each item (item_id, text), with a score above 0; equal scores by ascending doc_id.

    Terms, lengths and scores as in `weight`, `lengths_of` and `gains`; an item's term counts as often as the item has it. Items go to the tasks in groups of at most GROUP_BYTES. For a
    group, one pass over the texts gives the postings of its terms, written as a table; document counts and lengths are sums over that table, document frequencies a count by term. Each
    task then reads its part of the postings in shards of bounded size and keeps the best of each query; only those are shuffled, to be ranked.

    Null and empty texts have no terms: they count for nothing and are never found. Rows that repeat a document are documents of their own; among equal scores, a null doc_id comes last.
    Rows that repeat an item's id and text are one item; texts that share an id are ranked apart, each from 1. Items without known terms have no rows. Other columns are dropped.
    """
    is_long = dict(items.dtypes)["item_id"] in ("bigint", "int", "smallint", "tinyint")
    item_type = "bigint" if is_long else "string"
    own = items.select(F.col("item_id").cast(item_type).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    out = docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for group in groups(((r, len(r.text)) for r in own.toLocalIterator()), GROUP_BYTES):
        asked = [(r.item_id, Counter(words(r.text.encode()))) for r in group]
        number = {w: k for k, w in enumerate(sorted({w for _, c in asked for w in c}))}
        postings = written(_postings(docs, number), "postings")
        whole = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(number), dtype=np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
            df[r.t] = r.df
        weights = np.array([weight(whole.docs, int(x)) for x in df], dtype=np.int64)
        queries = [(item_id, sorted((number[w], times) for w, times in c.items())) for item_id, c in asked]
        found = _search(postings, queries, weights, whole.docs, whole.terms or 1, top, item_type)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        out = out.union(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
