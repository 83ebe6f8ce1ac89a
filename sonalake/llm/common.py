"""What the operators of this subpackage share: tables in the shared folder, tokens, hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the contracts: space, tab, newline, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and characters that a Python step holds at once.
SLICE_ROWS, SLICE_CHARS = 1024, 8_000_000

_written: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="sonalake-"))
    return _local[0]


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and lost executors cost no recomputation.

    by: columns that have a folder for each value, so that a reader of one value opens no others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes what written() has left; results built on it can't be read afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its folder goes with the cluster's own cleaning
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df, to be broadcast if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


#: Key rows that are broadcast at most (about 100 bytes each).
KEY_ROWS = 200_000


def packed(documents: DataFrame, *more: Column) -> DataFrame:
    """All columns as one struct `row`, doc_id, and more: no name that an operator needs can clash with a column."""
    return documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"), "doc_id", *more)


def _same(rows: DataFrame, keys: DataFrame, names: list[str]) -> tuple[DataFrame, Column]:
    other = sized(keys.select(*(F.col(c).alias(f"key_{c}") for c in names)), keys.count(), KEY_ROWS)
    return other, reduce(and_, (rows[c].eqNullSafe(other[f"key_{c}"]) for c in names))


def without(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """rows(names, ...) that agree with no row of keys(names); null agrees with null. keys is counted, so let it be written."""
    other, same = _same(rows, keys, names)
    return rows.join(other, same, "left_anti")


def one_each(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """rows(row, names, ...) with one of those that agree in names, the first by its columns; keys(names) has a row for each of rows.

    Only rows that do repeat are shuffled, and each task passes on one of a group.
    """
    again = written(keys.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*names), "again")
    if again.isEmpty():
        return rows
    other, same = _same(rows, again, names)
    first = F.row_number().over(Window.partitionBy(*names).orderBy(F.to_json("row")))
    some = rows.join(other, same, "left_semi").withColumn("nth", first).where("nth = 1").drop("nth")
    return rows.join(other, same, "left_anti").unionByName(some)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


def crc_mod_py(value: int | None, modulus: int) -> int:
    return -1 if value is None else zlib.crc32(str(value).encode()) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words of the contracts with A-Z lower-cased: both methods of bytes know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with bounded rows and characters, however long its texts are."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(size, done + chars, side="right"))))
        yield batch.slice(start, end - start)
        start = end


def keeping() -> None:
    """Freed memory stays with the process until released(): arrays made again and again cost no new pages each time."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD, glibc's own upper bound
        libc.mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD


def released() -> None:
    """Gives freed memory back to the system: a Python worker lives on after its task, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def collected(spark: SparkSession) -> None:
    """Each executor's JVM collects its garbage and gives freed heap and buffers back: else they stay as large as any earlier stage made them.

    One small task for each core, so each executor gets some if none is busy;
    where -XX:+DisableExplicitGC is set, nothing happens.
    """
    cores = spark.sparkContext.defaultParallelism
    done = F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")
    spark.range(0, cores, 1, cores).select(done).write.format("noop").mode("overwrite").save()


def map_batches(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType, chars: int = SLICE_CHARS) -> DataFrame:
    """mapInArrow over bounded slices; make() runs once in each task and returns the step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in slices(batch, text, chars):
                if (out := step(piece)) is not None:
                    yield out
        del step
        released()

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
