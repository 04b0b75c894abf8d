"""Files in, blobs and tables out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of the binaryFile source, which a stream has to be told.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def read_media(spark: SparkSession, path: str, glob: str = "*.webp") -> DataFrame:
    """(file_id, path, content, length) of every file below a path; file_id is a hash of the path. Spark's file sources pass over empty files, so these have no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("file_id"), "path", "content", "length")


def stream_media(spark: SparkSession, path: str, glob: str = "*.webp") -> DataFrame:
    """The same as a stream of new files."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("file_id"), "path", "content", "length")


def write_media(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Blobs or derived tables as Parquet, in folders by a hash of the key, so that one image's rows are read from one folder."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_bucket(table: DataFrame, key: str, value: int, buckets: int = 64) -> DataFrame:
    """The rows of one key of a table of `write_media`: only the folder of its bucket is read."""
    spark = table.sparkSession
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value).cast(dict(table.dtypes)[key])), F.lit(buckets))).first()[0]
    return table.filter((F.col("bucket") == int(bucket)) & (F.col(key) == value)).drop("bucket")


#: Ends each file that `write_files` writes, after the id in sixteen digits; RIFF tells its own size, so readers pass over both.
_END = b"\n"
_TAIL = 16 + len(_END)
#: Folders of `write_files`.
FOLDERS = 256


def write_files(files: DataFrame, path: str) -> None:
    """(file_id LONG, content BINARY) as one file each, in folders by a hash of the id. Ids must be unique and not null; an empty or null content gives a file of its tail alone.

    The bytes are written as they are by the text sink, one row a file, with the id and a line feed at the end: `read_files` takes them off again. A folder is written by one task and moved into place as a whole, and
    there are as many to list, however many files there are.
    """
    whole = F.concat(F.coalesce("content", F.unhex(F.lit(""))), F.encode(F.lpad(F.hex("file_id"), 16, "0"), "US-ASCII"))
    dealt = files.select(F.pmod(F.xxhash64("file_id"), F.lit(FOLDERS)).alias("folder"), whole.cast("string").alias("content")).repartition("folder")
    dealt.write.partitionBy("folder").option("lineSep", _END.decode()).option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path, content, length) of the files of `write_files`, by the source of binary files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    n = F.col("length").cast("int") - _TAIL
    file_id = F.conv(F.decode(F.substring("content", n + 1, 16), "US-ASCII"), 16, -10).cast("long")
    return files.select(file_id.alias("file_id"), "path", F.substring("content", 1, n).alias("content"), (F.col("length") - _TAIL).alias("length"))


def explode_pixels(images: DataFrame, most_rows: int = 1 << 18) -> DataFrame:
    """(image_id, pos, x, y, r, g, b, a) from images (image_id, width, height, rgba BINARY); the buffer becomes columns in a task, in batches of bounded size. A short buffer gives its complete pixels; an image without id or width, or of width 0, gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, width, data in zip(*(batch.column(c).to_pylist() for c in ("image_id", "width", "rgba")), strict=True):
                if image_id is None or not width or width < 0:
                    continue
                cells = np.frombuffer(data or b"", dtype=np.uint8)[: len(data or b"") // 4 * 4].reshape(-1, 4).astype(np.int32)
                for i in range(0, len(cells), most_rows):
                    pos = np.arange(i, min(len(cells), i + most_rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), image_id, dtype=np.int64)), pa.array(pos), pa.array((pos % width).astype(np.int32)), pa.array((pos // width).astype(np.int32)), *(pa.array(np.ascontiguousarray(cells[pos, k])) for k in range(4))], names=["image_id", "pos", "x", "y", "r", "g", "b", "a"])

    return images.select("image_id", "width", "rgba").mapInArrow(run, "image_id long, pos long, x int, y int, r int, g int, b int, a int")
