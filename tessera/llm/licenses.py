"""License notices in texts: an exact set-similarity join of text blocks with notice templates by containment."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks
from tessera.llm.terms import groups, words, words_by_part

#: The share of a template's distinct words that a block must hold, in percent.
PERCENT = 90
#: Bytes of template text whose index goes to the tasks at once; more templates are joined group after group.
GROUP_BYTES = 4 << 20

#: Phrases whose words stand consecutively, with their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Notices as their licenses tell users to write them, with labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
]


def needed(size: int, percent: int = PERCENT) -> int:
    """The least overlap that is `percent` of a set of some size."""
    return -(-size * percent // 100)


def block_words(n_words: int) -> int:
    """The words of a block for a template of n_words: a quarter more, and one."""
    return n_words + n_words // 4 + 1


@dataclass
class Index:
    """Templates as sorted lists of word numbers, numbered from the rarest word of the corpus on, and the postings of their prefixes."""

    number: dict[bytes, int]
    labels: list[str]
    tokens: list[list[int]]
    need: list[int]
    span: list[int]
    prefix: dict[int, list[int]] = field(default_factory=dict)


def index(templates: Sequence[tuple[str, str]], counts: dict[bytes, int], percent: int = PERCENT) -> Index:
    """The index of templates (label, text); counts tell how often a word stands in the corpus. A template without words is left out."""
    split = [(label, words(text.encode())) for label, text in templates]
    split = [(label, w) for label, w in split if w]
    order = sorted({w for _, ws in split for w in ws}, key=lambda w: (counts.get(w, 0), w))
    number = {w: k for k, w in enumerate(order)}
    out = Index(number, [label for label, _ in split], [sorted({number[w] for w in ws}) for _, ws in split], [], [block_words(len(ws)) for _, ws in split])
    for k, tokens in enumerate(out.tokens):
        out.need.append(needed(len(tokens), percent))
        # a block that holds enough of the template holds one of its rarest len - need + 1 words
        for token in tokens[: len(tokens) - out.need[k] + 1]:
            out.prefix.setdefault(token, []).append(k)
    return out


def places(text: bytes, number: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many words a text has, and where which numbered ones stand."""
    n, at, which = 0, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for part in words_by_part(text):
        ids = np.fromiter((number.get(w, -1) for w in part), np.int64, len(part))
        held = np.flatnonzero(ids >= 0)
        at.append(held + n)
        which.append(ids[held])
        n += len(part)
    return n, np.concatenate(at), np.concatenate(which)


def blocks(at: np.ndarray, which: np.ndarray, idx: Index) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word, overlap) of the stretches of overlapping blocks that meet their template's threshold; the overlap is that of the best block.

    Every window of `span` words is a block. Prefix filter: only templates one of whose rarest words is there, and only windows around such a word. Length filter: the
    window holds `need` words of the template. Positional filter: the window's rarest word of the template leaves room for an overlap of `need`.
    """
    found, held = [], set(np.unique(which).tolist())
    for k in sorted({k for token in held if token in idx.prefix for k in idx.prefix[token]}):
        tokens, need, span = idx.tokens[k], idx.need[k], idx.span[k]
        if len(held.intersection(tokens)) < need:
            continue
        own = np.isin(which, tokens)
        p, order = at[own], np.searchsorted(tokens, which[own])
        seeds = np.flatnonzero(order <= len(tokens) - need)
        if not len(seeds):
            continue
        near = np.zeros(len(p) + 1, dtype=np.int32)  # words that a window shares with a seed
        np.add.at(near, np.searchsorted(p, p[seeds] - span + 1), 1)
        np.add.at(near, np.searchsorted(p, p[seeds] + span), -1)
        near = np.cumsum(near[:-1]) > 0
        p, order = p[near], order[near]
        ends = np.searchsorted(p, p + span)
        times, distinct, end = [0] * len(tokens), 0, 0
        spans: list[list[int]] = []
        places_, kinds = p.tolist(), order.tolist()
        for i, past in enumerate(ends.tolist()):
            while end < past:
                times[kinds[end]] += 1
                distinct += times[kinds[end]] == 1
                end += 1
            if past - i >= need and distinct >= need and any(times[: len(tokens) - need + 1]):
                first, last = places_[i], places_[past - 1]
                if spans and first <= spans[-1][1]:
                    spans[-1][1], spans[-1][2] = last, max(spans[-1][2], distinct)
                else:
                    spans.append([first, last, distinct])
            times[kinds[i]] -= 1
            distinct -= times[kinds[i]] == 0
        found += [(k, *s) for s in spans]
    return found


def phrase_places(at: np.ndarray, which: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where all words of a phrase stand one after another."""
    out = at[which == phrase[0]]
    for k, number in enumerate(phrase[1:], 1):
        out = np.intersect1d(out, at[which == number] - k, assume_unique=True)
    return out


_BLOCK = pa.struct([("label", pa.string()), ("template", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("overlap", pa.int32()), ("containment", pa.float64())])
_BLOCKS = "array<struct<label: string, template: string, first_word: long, last_word: long, overlap: int, containment: double>>"


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of a bounded vocabulary stands in all texts. Counted in each task, summed by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for _, texts in chunks(batch):
                for t in texts:
                    for part in words_by_part(t):
                        n.update(filter(vocabulary.__contains__, part))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.toLocalIterator()}


def find_notices(docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), percent: int = PERCENT) -> DataFrame:
    """Docs (doc_id, text) with `blocks`: every stretch of text that holds `percent` of a template's distinct words within a block (label, template, first_word, last_word, overlap, containment).

    A block is any run of words as long as the template and a quarter more. Words are numbered from the rarest of the whole corpus on, so the words of a template's prefix are
    rare and few windows are looked at; all filters are exact. Templates go to the tasks in groups of at most GROUP_BYTES, one joined after another in the same pass
    over the texts: nothing is shuffled but the counts of template words. Repeated rows stay as they are, null and empty texts have no block, a null doc_id is kept. Other columns are dropped.
    """
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(None).cast(_BLOCKS).alias("blocks"))
    for group in groups(((t, len(t[1])) for t in templates), GROUP_BYTES):
        vocabulary = {w for _, text in group for w in words(text.encode())}
        kept = [t for t in group if words(t[1].encode())]
        idx = index(kept, word_counts(docs, vocabulary), percent)

        def join(batches: Iterator[pa.RecordBatch], kept: list = kept, idx: Index = idx) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in chunks(batch):
                    cells = []
                    for t, before in zip(texts, part.column("blocks").to_pylist(), strict=True):
                        _, at, which = places(t, idx.number)
                        rows = [{"label": idx.labels[k], "template": kept[k][1], "first_word": a, "last_word": z, "overlap": n, "containment": n / len(idx.tokens[k])} for k, a, z, n in blocks(at, which, idx)]
                        cells.append((before or []) + rows)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(cells, pa.list_(_BLOCK))], names=["doc_id", "text", "blocks"])

        out = out.mapInArrow(join, out.schema)
    return out


def find_phrases(docs: DataFrame, phrases: Sequence[tuple[str, str]] = tuple(PHRASES)) -> DataFrame:
    """Docs (text, ...) with n_words, n_base (places of all phrases), first_word and last_word (their smallest and largest start, else null) and base_labels (distinct, sorted)."""
    split = [(words(text.encode()), label) for text, label in phrases]
    number = {w: k for k, w in enumerate(sorted({w for ws, _ in split for w in ws}))}
    coded = [([number[w] for w in ws], label) for ws, label in split]
    own = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                rows = []
                for t in texts:
                    n, at, which = places(t, number)
                    starts = [(phrase_places(at, which, p), label) for p, label in coded]
                    every = np.concatenate([s for s, _ in starts])
                    rows.append((n, len(every), int(every.min()) if len(every) else None, int(every.max()) if len(every) else None, sorted({label for s, label in starts if len(s)})))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64()] * 4 + [pa.list_(pa.string())])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *columns], names=[*own, "n_words", "n_base", "first_word", "last_word", "base_labels"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    base_labels are those of phrases that stand word by word, labels also those of notices found by `find_notices`; both distinct, sorted and joined by commas, empty if there are none.
    score is the highest containment found: 1 for a phrase, that of the best block else, 0 without either.
    """
    found = find_phrases(find_notices(docs)).drop("text")
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("blocks", lambda b: b["label"]))))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
