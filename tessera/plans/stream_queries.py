"""Registered streaming queries: over what the tables hold, then compared with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.functions.bytes import argb, color_slot
from tessera.plans import media_queries as Q
from tessera.sources.shared import shared_dir
from tessera.streaming.media import catalog_table, stream_cache_hits, stream_catalog


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def st1(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "catalog")
    X.media(spark, d).write.parquet(f"{at}/in")
    files = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    stream_catalog(files, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return catalog_table(spark, f"{at}/out", "catalog")


def st2(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "hits")
    cells = X.vec_px(spark, d).withColumn("argb", argb())
    cells.select("image_id", "pos", color_slot(F.col("argb"), 4).alias("slot"), "argb").write.parquet(f"{at}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    out = stream_cache_hits(rows).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{at}/out")


QUERIES = {"st1_stream_catalog": st1, "st2_stream_cache_hits": st2}
ORACLE_SQL = {
    "st1_stream_catalog": Q.ORACLE_SQL["f5_image_catalog"],
    "st2_stream_cache_hits": X.sql(f"WITH c AS (SELECT image_id, pos, {Q._ARGB} AS argb, {Q._SLOT.format(Q._ARGB, 1 << 28)}::INT AS slot FROM v_vec_px) SELECT image_id, pos, coalesce(lag(argb) OVER (PARTITION BY image_id, slot ORDER BY pos), 0) = argb AND pos > 0 AS hit FROM c"),
}
