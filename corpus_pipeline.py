"""A cleaning pipeline over `documents`: toxic documents go, near copies go, repeated passages go, leaked benchmark items go; what is left is encoded.

Every stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and returns a DataFrame, which is written and read again as the next
one's docs. All rows that a stage was given and does not reject go on; rows go by `row_key`, so a null doc_id is no exception. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_digests
from tessera.llm.common import written
from tessera.llm.decontaminate import find_leaks
from tessera.llm.queries import table
from tessera.llm.recompression import remove_repeats, row_key
from tessera.llm.setsketch import near_duplicates
from tessera.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the row's key in the place of its id, so that rows are told apart that share an id or have none."""
    return docs.select(row_key().alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents but those whose row's key is a doc_id of `gone`. Equal rows have one key: they share their text, and so what is decided on it."""
    keys = gone.select(F.col("doc_id").alias("key")).distinct()
    return docs.select(*COLUMNS, row_key().alias("key")).join(keys.hint("merge"), "key", "left_anti").select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not predict toxic. Each row by its own text: of rows that share an id only the toxic ones go, and a toxic row without id goes too."""
    scored = score_toxicity(_keyed(docs), table(spark, sf_dir, "labels"), learn_from=docs)
    return _without(docs, scored.filter("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, a null one last. Rows go by `row_key`, so a null id is linked like any other; of rows of the same id and text one stays."""
    rows = docs.select(*COLUMNS, row_key().alias("key"))
    grouped = near_duplicates(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = rows.select("key", "doc_id").distinct()
    by_id = written(grouped.join(ids, "key").select("key", "component_id", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key").alias("rank")), "groups")
    # a large group meets by its rows' keys, which are its own, not by the group
    first = by_id.groupBy("component_id").agg(F.min("rank").alias("first")).select(F.col("first.key").alias("key"))
    gone = by_id.select("key").join(first.hint("merge"), "key", "left_anti")
    left = rows.join(gone.hint("merge"), "key", "left_anti")
    # few rows occur more than once: only their texts are dealt by key
    often = written(rows.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"), "repeated")
    one = left.join(often.hint("merge"), "key").groupBy("key").agg(F.min(F.struct(COLUMNS)).alias("row")).select("row.*")
    return left.join(often.hint("merge"), "key", "left_anti").select(COLUMNS).union(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words and more that start anywhere else too. Texts that lose nothing stay as they are; n_chars follows the text."""
    cut = remove_repeats(docs).filter("n_removed > 0").select("key", F.col("kept_text").alias("cut_text")).dropDuplicates(["key"])
    of = docs.select(*COLUMNS, row_key().alias("key")).join(cut.hint("merge"), "key", "left")
    n_chars = F.when(F.col("cut_text").isNull(), F.col("n_chars")).otherwise(F.length("cut_text"))
    return of.select("doc_id", F.coalesce("cut_text", "text").alias("text"), "lang", "source", n_chars.cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row by its own text, as in `drop_toxic`."""
    return _without(docs, find_leaks(_keyed(docs), table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return encode_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]
#: Compression distances, near-copy search and byte-pair encoding are beyond SQL; the tests follow near copies, passages and encoding by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, name)
    return docs
