"""Whole images in batches: many small ones at a time, a large one by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets that rows are dealt to before they are packed, and rows that a task gathers for that, or unpacks at a time.
BUCKETS, GATHERED = 1 << 14, 1 << 20
_THIN = [pa.uint8(), pa.uint16(), pa.uint32(), pa.uint64()]


def _thin(column: pa.Array, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Integers as differences from the one before in their chunk where these span less, else from the least, in as few bytes as hold them; and for each chunk (number of the type, differences or not, first, least). Other columns as they are, of type -1."""
    form = np.zeros((len(edges) - 1, 4), dtype=np.int64)
    if not pa.types.is_signed_integer(column.type) or column.null_count:
        form[:, 0] = -1
        return column, form
    v = column.to_numpy().astype(np.int64)
    steps = np.diff(v, prepend=v[:1])
    steps[edges[:-1]] = 0
    spans = [int(x.max()) - int(x.min()) for x in (v, steps)]
    diff = int(spans[1] < spans[0])
    rest, kind = steps if diff else v, next(k for k in range(4) if spans[diff] < 1 << (8 << k))
    form[:] = np.stack([np.full(len(form), kind), np.full(len(form), diff), v[edges[:-1]], np.full(len(form), rest.min())], axis=1)
    return pa.array((rest - rest.min()).view(np.uint64).astype(_THIN[kind].to_pandas_dtype())), form


def pack(df: DataFrame, deal: Column) -> DataFrame:
    """(bucket, n, form, data): the rows, dealt to buckets by a number, in chunks of columns that take a few bytes a row. A task gathers rows until there are enough for chunks of some size; a bucket has many chunks."""

    def chunks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        order = np.argsort(rows.column("_bucket").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        ids = rows.column("_bucket").to_numpy()
        edges = starts_of(ids)
        thin, forms = zip(*(_thin(c.chunk(0), edges) for c in rows.drop_columns(["_bucket"]).columns), strict=True)
        table = pa.RecordBatch.from_arrays(list(thin), names=[str(k) for k in range(len(thin))])
        plain = [table.slice(a, b - a).serialize() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        form = np.concatenate([np.array([[p.size] for p in plain]), *forms], axis=1)
        data = [pa.compress(p, "zstd", asbytes=True) for p in plain]
        return pa.RecordBatch.from_arrays([pa.array(ids[edges[:-1]], pa.int32()), pa.array(np.diff(edges), pa.int32()), pa.array(list(form), pa.list_(pa.int64())), pa.array(data, pa.binary())], names=["bucket", "n", "form", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= GATHERED:
                yield chunks(held)
                held, n = [], 0
        if held:
            yield chunks(held)

    return df.withColumn("_bucket", F.pmod(deal, F.lit(BUCKETS)).cast("int")).mapInArrow(run, "bucket int, n int, form array<bigint>, data binary")


def unpack(chunks: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of `pack` chunks, with the bucket of each, a bounded number at a time."""

    def table(held: list[list]) -> pa.Table:
        whole = []
        for own, parts in zip(schema, zip(*held, strict=True), strict=True):
            if all(isinstance(p, np.ndarray) for p in parts):
                whole.append(pa.array(np.concatenate(parts)).cast(own.type))
            else:
                whole.append(pa.chunked_array([pa.array(p).cast(own.type) if isinstance(p, np.ndarray) else p for p in parts], own.type))
        return pa.Table.from_arrays(whole, schema=schema)

    def columns(form: list[int], data: bytes) -> list[np.ndarray | pa.Array]:
        forms = [form[k : k + 4] for k in range(1, len(form), 4)]
        kinds = pa.schema([(str(k), _THIN[f[0]] if f[0] >= 0 else own.type) for k, (f, own) in enumerate(zip(forms, schema, strict=True))])
        out = []
        for (kind, diff, first, least), c in zip(forms, pa.ipc.read_record_batch(pa.decompress(data, form[0], "zstd"), kinds).columns, strict=True):
            v = c if kind < 0 else c.to_numpy().astype(np.int64) + least
            out.append(np.cumsum(v) + (first - v[0]) if diff else v)
        return out

    held, ids, n = [], [], 0
    for batch in chunks:
        for bucket, size, form, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if n and n + size > GATHERED:
                yield table(held), np.concatenate(ids)
                held, ids, n = [], [], 0
            held.append(columns(form, data))
            ids.append(np.full(size, bucket))
            n += size
    if held:
        yield table(held), np.concatenate(ids)


def whole_buckets(parts: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.Table]:
    """Unpacked rows, sorted by bucket, cut anew so that no bucket lies in two."""
    held, bucket = [], None
    for table, ids in parts:
        if held and bucket != ids[0]:
            yield pa.concat_tables(held)
            held = []
        bucket, last = ids[-1], int(np.argmax(ids == ids[-1]))
        if last:
            yield pa.concat_tables([*held, table.slice(0, last)])
            held = []
        held.append(table.slice(last))
    if held:
        yield pa.concat_tables(held)


def merged_counts(counts: DataFrame, by: list[str], deal: list[str]) -> DataFrame:
    """(by..., total, n_distinct, squares) of the histograms (by..., symbol, n) that tasks counted in parts: sum, number and sum of squares of the counts. `deal`: those of `by` that Spark deals the packed counts by; only these are shuffled, once."""
    counts = counts.select(*by, "symbol", "n")
    kinds = arrow_schema(counts)
    schema = counts.select(*by).schema.add("total", "long").add("n_distinct", "long").add("squares", "double")
    results = arrow_schema(counts.select(*by, F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("n_distinct"), F.lit(0.0).alias("squares")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(unpack(batches, kinds)):
            n = rows.group_by([*by, "symbol"], use_threads=False).aggregate([("n", "sum")])
            each = n.column("n_sum").cast(pa.float64())
            n = n.append_column("one", pa.array(np.ones(len(n), np.int64))).append_column("squares", pc.multiply(each, each))
            sums = n.group_by(by, use_threads=False).aggregate([("n_sum", "sum"), ("one", "sum"), ("squares", "sum")])
            yield from sums.select([*by, "n_sum_sum", "one_sum", "squares_sum"]).rename_columns(results.names).cast(results).to_batches(1 << 16)

    return pack(counts, F.xxhash64(*deal)).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, schema)


def arrow_schema(df: DataFrame, schema: str | None = None) -> pa.Schema:
    """The Arrow schema of a DataFrame's rows, or of rows of another schema, inside tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if schema else df.schema)


def whole_images(parts: Iterator[pd.DataFrame], key: str = "image_id") -> Iterator[pd.DataFrame]:
    """Frames that are sorted by a key, cut anew so that no image lies in two: what a batch begins of its last image waits for the next batch."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if part.empty:
            continue
        ids = part[key].to_numpy()
        if held and held[-1][key].iloc[-1] != ids[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        last = int(np.argmax(ids == ids[-1]))
        if last:
            yield pd.concat([*held, part.iloc[:last]], ignore_index=True)
            held = []
        held.append(part.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def by_image(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: list[str]) -> DataFrame:
    """run over frames of whole images, each sorted by `order`. Pixels are packed before Spark deals them out, to buckets of images; a task unpacks some buckets at a time and sorts their images, so it has no group of its own for each of many
    small ones, and no row of its own in the shuffle for each pixel. image_id must not be null."""
    kinds, results = arrow_schema(df), arrow_schema(df, schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        parts = (rows.to_pandas().assign(_bucket=ids) for rows, ids in unpack(batches, kinds))
        for frame in whole_images(parts, "_bucket"):
            yield run(frame.drop(columns="_bucket").sort_values(["image_id", *order], ignore_index=True))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in each(batches):
            for k in range(0, len(frame), GATHERED):
                yield pa.RecordBatch.from_pandas(frame.iloc[k : k + GATHERED], schema=results, preserve_index=False)

    return pack(df, F.xxhash64("image_id")).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rows, schema)


def starts_of(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]).astype(np.int64)


class Grid:
    """Pixels (image_id, y, x, in this order, each place once) of many images, and where the neighbours of each stand; n stands for none.

    Top-left and top-right are reached through the pixel above: where that is missing, so are they. Past the last pixel of the row above, top-right is the first pixel (x = 0) of the pixel's own row.
    """

    def __init__(self, frame: pd.DataFrame):
        self.n = n = len(frame)
        self.image = np.repeat(np.arange(len(starts_of(frame.image_id.to_numpy())) - 1), np.diff(starts_of(frame.image_id.to_numpy())))
        self.x, self.y = frame.x.to_numpy(np.int64), frame.y.to_numpy(np.int64)
        self.width, height = int(self.x.max()) + 2, int(self.y.max()) + 2
        self.key = (self.image * height + self.y + 1) * self.width + self.x + 1
        self.left, self.top = self._find(self.key - 1), self._find(self.key - self.width)
        has_top = self.top < n
        self.corner = np.where(has_top, self._find(self.key - self.width - 1), n)
        row = self.key // self.width
        ends = np.append(row[1:] != row[:-1], True)
        above_ends = has_top & ends[np.minimum(self.top, n - 1)]
        right = np.where(has_top, self._find(self.key - self.width + 1), n)
        self.right = np.where(above_ends, self._find(row * self.width + 1), right)

    def _find(self, key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, key)
        at[at == self.n] = 0
        return np.where(self.key[at] == key, at, self.n)

    def waves(self) -> Iterator[np.ndarray]:
        """Pixels on one skewed diagonal x + 2 y, of all images: none of them needs another, and all that they need is in waves before."""
        wave = self.x + 2 * self.y
        order = np.argsort(wave, kind="stable")
        edges = starts_of(wave[order])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield order[a:b]
