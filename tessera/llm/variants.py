"""Words that differ by one letter: PartEnum signatures over letter multisets, an equi-join, exact checks, and the common form of each group."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, chunks, mix, signed, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A run is marked when its checksum is a multiple of this.
MARKED = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Multisets of words that differ by one letter are at a Hamming distance of at most two, so of PARTS parts of the letters all but two are equal.
PARTS, DISTANCE = 9, 2
SKIPPED = list(combinations(range(PARTS), DISTANCE))
#: Words of a multiset that meet at once; distinct words a task counts before it sends them on.
CHUNK, HELD = 256, 400_000

_PAIRS = np.array(SKIPPED)
_LOWER = LOWER.tobytes()


def marked(run: str, seed: int) -> str:
    """The run, or the run without one letter if its checksum, from `seed` on, is a multiple of 97."""
    h = zlib.crc32(run.encode(), seed)
    if h % MARKED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def marked_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the runs of letters `[A-Za-z\\u00C0-\\u00FF]+` of whole texts (doc_id, text), A-Z lower-cased and marked by document; all lengths and counts.

    Null texts have no runs; a null doc_id stands as an empty one. Counted in each task in dictionaries of bounded size, summed by word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        ready = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for part, texts in chunks(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    lowered = text.translate(_LOWER).decode()
                    # a long text's runs are counted one by one, never listed
                    runs = Counter(RUN.findall(lowered) if len(text) < 1 << 20 else (m.group() for m in RUN.finditer(lowered)))
                    for run, n in runs.items():
                        total[marked(run, seed)] += n
                if len(total) > HELD:
                    yield ready()
                    total.clear()
        yield ready()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def signatures(bag: str) -> np.ndarray:
    """One number for each choice of DISTANCE parts to leave out: a hash of the vector's elements in the other parts. An element is a letter and which of its occurrences it is."""
    sums = [0] * PARTS
    for letter, times in Counter(bag).items():
        for k in range(times):
            h = zlib.crc32(b"%d.%d" % (ord(letter), k))
            sums[h % PARTS] += h * 0x9E3779B97F4A7C15 + h
    each = np.array([s & 0xFFFFFFFFFFFFFFFF for s in sums], dtype=np.uint64)
    return mix(mix(each.sum() - each[_PAIRS].sum(axis=1)) ^ mix(np.arange(len(SKIPPED), dtype=np.uint64), 1))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signatures(b) for b in batch.column("bag").to_pylist()]
        flat = signed(np.concatenate(found)) if found else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(SKIPPED)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("bag"), lists], names=["bag", "signatures"])


def differ(a: str, b: str) -> tuple[str, str] | None:
    """What multiset a (sorted letters) has beyond b and b beyond a, when words of them can differ by one letter: one letter at most each way, and any at all."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        if i == n:
            return None
        # the smaller letter stands only on its side; without it the rest is equal but for one letter of the other side
        if a[i] > b[i]:
            found = differ(b, a)
            return found and (found[1], found[0])
        k = i
        while k + 1 < n and a[k + 1] == b[k]:
            k += 1
        return (a[i], b[k]) if a[k + 1 :] == b[k + 1 :] else None
    if len(a) > len(b):
        return (a[i], "") if a[i + 1 :] == b[i:] else None
    return ("", b[i]) if b[i + 1 :] == a[i:] and len(b) == len(a) + 1 else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of multisets that share a signature those that differ by one letter; each from the first signature that both share."""
    part = lambda bag, c: zlib.crc32(b"%d.%d" % (ord(c), bag.count(c) - 1)) % PARTS
    first: dict[frozenset, int] = {}
    for k, pair in enumerate(SKIPPED):
        for own in ({pair[0]}, {pair[1]}, set(pair)):
            first.setdefault(frozenset(own), k)
    for batch in batches:
        rows = []
        for a, b, k in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "k")), strict=True):
            if abs(len(a) - len(b)) < 2 and (d := differ(a, b)) and first[frozenset({part(a, c) for c in d[0]} | {part(b, c) for c in d[1]})] == k:
                rows.append((a, b, *d))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["a", "b", "only_a", "only_b"])


def _without(words: list[str], letter: str, mark: str) -> dict[str, list[int]]:
    """Words by what is left of them with one occurrence of a letter replaced by a mark; by themselves if there is no letter."""
    out = defaultdict(list)
    for i, w in enumerate(words):
        if not letter:
            out[w].append(i)
            continue
        k = w.find(letter)
        while k >= 0:
            out[w[:k] + mark + w[k + 1 :]].append(i)
            k = w.find(letter, k + 1)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, form_n, form) of the words of two multisets that differ by one letter: their near words, counted, and the best of them."""
    for batch in batches:
        rows = []
        for wa, wb, na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("words_a", "words_b", "ns_a", "ns_b", "only_a", "only_b")), strict=True):
            mark = "?" if x and y else ""
            own, other = _without(wa, x, mark), _without(wb, y, mark)
            near = {(i, j) for key, ids in own.items() if key in other for i in ids for j in other[key]}
            for i, j in near:
                rows.append((wa[i], 1, -nb[j], wb[j]))
                rows.append((wb[j], 1, -na[i], wa[i]))
        best: dict[str, list] = {}
        for w, one, n, other_word in rows:
            kept = best.setdefault(w, [0, n, other_word])
            kept[0] += one
            if (n, other_word) < (kept[1], kept[2]):
                kept[1:] = n, other_word
        columns = [pa.array(list(best), pa.string()), *(pa.array([v[k] for v in best.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "less", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n), distinct, that have any word at exactly one inserted, deleted or replaced code point: how many, and the one of largest n (ties: smallest).

    Words are grouped by their letter multiset. Two words that differ by one letter have multisets at Hamming distance one or two as binary vectors of (letter, occurrence). The elements are
    dealt into nine parts by a hash; at distance two at most, seven parts are equal for one of the 36 choices, so their signatures meet in an equi-join, once for each pair. Multisets that
    differ by one letter then bring their words, in chunks of bounded size, which are looked up with that letter taken out or replaced. Nothing is dropped: the join holds every near pair.
    """
    by_bag = words.withColumn("bag", F.array_join(F.array_sort(F.split("word", "")), ""))
    chunk = F.pmod(F.xxhash64("word"), F.greatest(F.ceil(F.col("size") / CHUNK), F.lit(1)))
    sizes = by_bag.groupBy("bag").agg(F.count("*").alias("size"))
    large = sizes.filter(F.col("size") > CHUNK)
    dealt = by_bag.join(large, "bag", "left").withColumn("chunk", F.when(F.col("size").isNull(), F.lit(0)).otherwise(chunk))
    each = F.sort_array(F.collect_list(F.struct("word", "n")))
    held = written(dealt.groupBy("bag", "chunk").agg(each.alias("w")).select("bag", F.col("w.word").alias("words"), F.col("w.n").alias("ns")), "bags")

    marks = held.select("bag").distinct().mapInArrow(_signed, "bag string, signatures array<long>").select("bag", F.posexplode("signatures").alias("k", "signature"))
    marks = written(marks, "signatures")
    side = lambda x: marks.select(F.col("bag").alias(x), "k", "signature")
    met = side("a").join(side("b"), ["k", "signature"]).filter("a < b AND abs(length(a) - length(b)) <= 1")
    pairs = written(met.select("a", "b", "k").mapInArrow(_candidates, "a string, b string, only_a string, only_b string"), "pairs")
    of = lambda x: held.select(F.col("bag").alias(x), F.col("words").alias(f"words_{x}"), F.col("ns").alias(f"ns_{x}"))
    checked = pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_verify, "word string, n_near long, less long, form string")
    best = checked.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("f"))
    return best.select("word", "n_near", (-F.col("f.less")).alias("form_n"), F.col("f.form").alias("form"))


def roots(forms: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, which has none. Each round doubles the steps; a form is at least twice as frequent, so chains are short."""
    links = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    for _ in range(most_rounds):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return links
    raise RuntimeError(f"forms did not end in {most_rounds} rounds")


def group_variants(counts: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of at least `least_letters` code points and `least_count` occurrences in counts (word, n), one row a word.

    n_near counts the near words (see `near_words`). A word's form is its most frequent near word (ties: the smallest in code-point order), if that is at least twice as frequent, else null, with
    form_n its n. Root is what following forms ends at, the word itself if it has none. Null words and counts take no part; rows of the same word are added up; other columns are dropped.
    """
    words = counts.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") >= least_letters) & (F.col("n") >= least_count))
    words = written(words, "words")
    near = words.join(near_words(words), "word", "left")
    formed = F.col("form_n") >= 2 * F.col("n")
    near = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "near")
    return near.join(roots(near), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
