"""What the operators of this subpackage share: working tables, batches and hashing.

Intermediate results are Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``. They cut lineage and outlive any executor.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: long texts stay far below a worker's memory, on both sides of the pipe.
BATCH_ROWS, BATCH_BYTES = 2048, 2 << 20
#: Bytes of text that one step of numpy work takes at a time: it needs up to a hundred times that.
SLICE_BYTES = 1 << 19


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session may go without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillspark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Workspace:
    """Working tables of one run of an operator."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.top = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.written = 0
        prepare(spark)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write df and read it again, in a folder of its own even if the name was used before; the shuffle files of the job go when it ends."""
        path = self.paths[name] = f"{self.top}/{name}-{self.written}"
        self.written += 1
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing will read any more."""
        if path := self.paths.pop(name, None):
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) without any other column but those named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Cut Arrow batches so that each piece holds about `most` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def fill(column: pa.Array) -> pa.Array:
    return pa.compute.fill_null(column, "")


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each value starts (and the last ends)."""
    column = fill(column) if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    starts = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, starts - starts[0]


#: Byte is white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(body: np.ndarray, starts: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and the index of each text's first word (and the last's end)."""
    inside = np.empty(len(body) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(gap[body], out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    cut = np.zeros(len(body) + 1, bool)
    cut[starts] = True
    # a text's end also ends a word that would run on into the next text
    run_on = cut & inside[1:] & inside[:-1]
    begin = np.flatnonzero((edge & inside[1:]) | run_on)
    end = np.flatnonzero((edge & inside[:-1]) | run_on)
    return begin, end, np.searchsorted(begin, starts)


MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


def span_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of values[i] * base**i; a span's hash is the difference times base**-start."""
    up, _ = powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def word_hashes(body: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes wherever they stand."""
    sums = span_sums(body.astype(np.uint64) + np.uint64(1), powers)
    _, down = powers.get(len(body) + 1)
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
