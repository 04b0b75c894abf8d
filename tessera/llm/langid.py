"""Language identification: known words first, shorter and shorter character n-grams for the others."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, chunks, remainder

#: Bound of the training sample: about so many documents of each language, drawn by a hash of the id.
SAMPLE_DOCS = 1_000
LONGEST = 5
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+").findall
_KEPT = 300_000


def words_of(text: str) -> list[str]:
    return _LETTERS(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """log10 frequencies, add-half smoothed, of all words and n-grams of the sample: a row an item, which holds only the languages that have it.

    What a language lacks is worth the same for all items of one table, so a table holds that once a language, and a row how far above it an item is.
    """

    def __init__(self, languages: list[str], words: dict[str, Counter], tables: dict[int, dict[str, Counter]]):
        self.languages = languages
        self.lacking, self.places, size, of, above = [], [], [], [], []
        at = 0
        for counts in (words, *tables.values()):
            by_item: dict[str, list[tuple[int, int]]] = defaultdict(list)
            for k, l in enumerate(languages):
                for item, n in counts[l].items():
                    by_item[item].append((k, n))
            self.lacking.append([math.log10(0.5 / (sum(counts[l].values()) + 0.5 * (len(by_item) + 1))) for l in languages])
            self.places.append({item: at + i for i, item in enumerate(by_item)})
            at += len(by_item)
            for held in by_item.values():
                size.append(len(held))
                of += [k for k, _ in held]
                above += [math.log10((n + 0.5) / 0.5) for _, n in held]
        self.lacking = np.array(self.lacking)
        self.ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int64)
        self.of, self.above = np.array(of, dtype=np.int32), np.array(above)
        self.words, self.tables = self.places[0], dict(zip(tables, self.places[1:], strict=True))
        self.seen: dict[str, tuple[int, list[int]]] = {}

    def evidence(self, word: str) -> tuple[int, list[int]]:
        """The length, and the rows, whose mean speaks for an unseen word: of its known n-grams of the longest length that has any; no rows if even its letters are unknown."""
        found = self.seen.get(word)
        if found is None:
            for n in range(LONGEST, -1, -1):
                found = n, [row for g in grams(word, n) if (row := self.tables[n].get(g)) is not None] if n else []
                if found[1]:
                    break
            if len(self.seen) > _KEPT:
                self.seen.clear()
            self.seen[word] = found
        return found

    def predict(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        rows, weights, n, read = [], [], 0, [0.0] * (LONGEST + 1)
        for w, c in Counter(words).items():
            if (row := self.words.get(w)) is not None:
                length, found = 0, [row]
            else:
                length, found = self.evidence(w)
            if found:
                rows += found
                weights += [c / len(found)] * len(found)
                read[length] += c
                n += c
        at = np.array(rows, dtype=np.int64)
        first, past = self.ends[at], self.ends[at + 1]
        size = past - first
        cells = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        total = np.array(read) @ self.lacking + np.bincount(self.of[cells], self.above[cells] * np.repeat(np.array(weights), size), minlength=len(self.languages))
        best = int(total.argmax())
        weight = np.exp(np.log(10) * (total - total[best]) / max(1.0, n**0.5))  # words are not independent: their evidence grows with the root of their number
        return self.languages[best], float(weight[best] / weight.sum())


def fit(docs: DataFrame) -> Model:
    """A model from a bounded sample of documents with text and language, of ids whose crc32 mod 5 is not 0. Counting is done by Spark's tasks, and one row a language and word of the sample comes to the driver. No word or n-gram of the sample is left out. Rows without id are drawn by their texts."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter("lang IS NOT NULL AND text IS NOT NULL").filter(F.coalesce(remainder("doc_id", 5) != 0, F.lit(True)))
    sample = bounded_sample(known.withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("text"))), "doc_id", SAMPLE_DOCS, "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found[lang].update(words_of(text))
        for lang, c in found.items():
            for i in range(0, len(c), 10_000):
                part = list(c.items())[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([w for w, _ in part]), pa.array([n for _, n in part], pa.int64())], names=["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, Counter] = defaultdict(Counter)
    pieces: dict[int, dict[str, Counter]] = {n: defaultdict(Counter) for n in range(1, LONGEST + 1)}
    table = counted.toArrow()  # words of a bounded sample
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        words[lang][word] += n
        for k in pieces:
            for g in grams(word, k):
                pieces[k][lang][g] += n
    languages = sorted(words)
    return Model(languages, words, pieces)


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id LONG, text STRING, lang STRING): doc_id, held_out, lang_pred, score (0 to 1).

    Every whole text is read; words are runs of letters, lower-cased. `und` with score 0 where the text is null, empty or
    without letters, or where nothing could be learned. Ties go to the language first in order. A null doc_id is not held out. Repeated
    rows are each returned; other columns are ignored. No shuffle but that of the sample's word counts.
    """
    model = fit(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: a cell for each language that has an item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part, texts in chunks(batch, most=4 << 20):
                found = [own.predict(t.decode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(remainder(doc_id, 5) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
