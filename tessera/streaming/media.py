"""Streaming forms: a catalog of new files, and cache hits with state by key and slot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from tessera.operators.container import chunk_rows, error_rows, image_catalog, walk_files


TABLES = ("chunks", "catalog", "quarantine")


def stream_catalog(files: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """New files (a stream of file_id, path, content) into Parquet tables below sink: chunks, catalog, quarantine, each in folders by batch (batch=n). Runs over what is there, then ends; started again it goes on.

    Every batch owns its folder and overwrites it: a batch that failed half way and is run again leaves its rows once. Read the tables by `catalog_table`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        walked = walk_files(batch).persist()
        for name, rows in zip(TABLES, (chunk_rows(walked), image_catalog(walked), error_rows(walked)), strict=True):
            rows.write.mode("overwrite").parquet(f"{sink}/{name}/batch={batch_id}")
        walked.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catalog_table(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """One of the tables of `stream_catalog`, all batches."""
    return spark.read.parquet(f"{sink}/{name}").drop("batch")


def stream_cache_hits(pixels: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(image_id, pos, hit) of a stream (image_id LONG, pos LONG, slot INT, argb LONG). Within a batch rows are put in order of pos.

    The state of a key is the last value of each of its slots, one array beside another: a batch reads and writes it once. It is bounded by the
    slots. With a time to live, idle keys are forgotten; such a query runs batches for its timeouts without end, so it must not be asked to
    end when its input does (the trigger availableNow).
    """

    def hits(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        got = pd.concat(list(rows)).sort_values("pos", kind="stable")
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        before = got.groupby("slot")["argb"].shift()
        first = before.isna()
        before[first] = got.loc[first, "slot"].map(last).fillna(0)
        yield pd.DataFrame({"image_id": key[0], "pos": got["pos"], "hit": (got["pos"] > 0) & (before.astype("int64") == got["argb"])})
        last |= got.groupby("slot")["argb"].last().to_dict()
        state.update(([int(k) for k in last], [int(v) for v in last.values()]))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return pixels.groupBy("image_id").applyInPandasWithState(hits, "image_id long, pos long, hit boolean", "slots array<int>, colors array<long>", "append", "ProcessingTimeTimeout" if ttl_ms else "NoTimeout")
