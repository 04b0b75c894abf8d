"""Comparison of results with expected ones, and checks of manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.batches import arrow_schema, pack, unpack


#: Places of an image whose rows are compared in one bucket.
PLACES = 1 << 12


def golden_diff(actual: DataFrame, expected: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, side, n): how many rows of a key differ, as multisets: 'changed' where both sides have a row that the other lacks, 'extra' and 'missing' for what only actual or only expected has beyond these.

    Rows are counted, so a row that one side has more often is told. Rows of both sides are dealt by their other keys and a stretch of the last key (by its hash, if it is no integer), and packed to chunks before they are shuffled, so a row takes a
    few bytes there; where the chunks meet, equal rows go in pairs. Only what is left is counted by Spark, row by row. An image of any size is many stretches. Nulls equal nulls, in keys and values.
    """
    marked = lambda df, one: df.select(*keys, *values, F.lit(one).alias("_one"))
    both, place = marked(actual, 1).unionByName(marked(expected, -1)), keys[-1]
    whole = dict(both.dtypes)[place] in ("tinyint", "smallint", "int", "bigint")
    stretch = F.floor(F.col(place) / PLACES) if whole else F.pmod(F.xxhash64(place), F.lit(PLACES))
    kinds = arrow_schema(both)

    def cancel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in unpack(batches, kinds):  # a bucket that is cut here is put together by the count below
            sums = rows.group_by([*keys, *values], use_threads=False).aggregate([("_one", "sum")]).rename_columns([*keys, *values, "_one"])
            yield from sums.filter(pc.field("_one") != 0).select(kinds.names).cast(kinds).to_batches(1 << 16)

    left = pack(both, F.xxhash64(*keys[:-1], stretch)).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(cancel, both.schema)
    surplus = left.groupBy(*keys, *values).agg(F.sum("_one").alias("_n")).filter("_n != 0")
    of_key = surplus.groupBy(*keys).agg(F.sum(F.greatest("_n", F.lit(0))).alias("_extra"), F.sum(F.greatest(-F.col("_n"), F.lit(0))).alias("_missing"))
    changed = F.least("_extra", "_missing")
    sides = F.array(*(F.struct(F.lit(side).alias("side"), n.alias("n")) for side, n in (("changed", changed), ("extra", F.col("_extra") - changed), ("missing", F.col("_missing") - changed))))
    return of_key.select(*keys, F.inline(F.filter(sides, lambda s: s["n"] > 0)))


def mismatches(diff: DataFrame, group: str = "image_id") -> DataFrame:
    """(group, side, n_keys, n_different): keys and rows of `golden_diff` by group and side; groups without any are not listed."""
    return diff.groupBy(group, "side").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_different"))


def transform_check(image_transforms: DataFrame) -> DataFrame:
    """(image_id, type, error) for transforms that an image's manifest (image_id, step, type) lists twice."""
    return image_transforms.groupBy("image_id", "type").agg(F.count("*").alias("n")).filter("n > 1").select("image_id", "type", F.lit("repeated_transform").alias("error"))
