"""What the corpus operators share: the shared folder, written tables, null-safe columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import shared_dir

#: Rows of an Arrow batch. Texts can be long, so batches are kept short.
BATCH_ROWS = 256
#: And bytes, where single texts are very long.
BATCH_BYTES = 4 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage ends there and a lost
    executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str, *columns: Column | str) -> DataFrame:
    """``columns`` of each row of ``docs`` with an id of the row, ``rid``, as a written table: read again, a row has the same id in every job."""
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), *columns), name)


def named(docs: DataFrame, name: str, *columns: Column | str) -> DataFrame:
    """As ``numbered``, without a copy where ``docs`` is read from files: ``rid`` is then the file's number and the row's place in the file, which
    are the same however the files are split. In ``docs`` no row of a file may stand twice."""
    try:
        file = docs.metadataColumn("_metadata")
        place = docs.select(file["file_path"].alias("file"), file["row_index"].alias("at"))
    except AnalysisException:  # not a table of files
        return numbered(docs, name, *columns)
    files = sorted(r.file for r in place.select("file").distinct().collect())  # names only
    number = docs.sparkSession.createDataFrame(list(enumerate(files)), "n long, file string")
    rows = docs.select(F.struct(*columns).alias("row"), file["file_path"].alias("file"), file["row_index"].alias("at"))
    return rows.join(F.broadcast(number), "file").select((F.shiftleft("n", 33) + F.col("at")).alias("rid"), "row.*")


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/sparkloom/" in f:
                p = spark._jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: What empties the large caches of a Python worker; operators that have one add to it.
WORKER_CACHES: list[Callable[[], None]] = []


def free_worker() -> None:
    """Give back what tasks left in this Python worker, which Spark uses again."""
    for clear in WORKER_CACHES:
        clear()
    give_back()


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(work: Task) -> Task:
    """``work`` of a task, after which its memory goes back to the system: the Python worker stays, idle or for other operators, beside the heap of its executor."""

    @wraps(work)
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        try:
            yield from work(batches)
        finally:
            free_worker()

    return rows


def tidy_groups(work: Callable[..., pd.DataFrame]) -> Callable[..., pd.DataFrame]:
    """As ``tidy``, for functions of groups in pandas: memory goes back after each group."""

    @wraps(work)
    def rows(*groups):
        try:
            return work(*groups)
        finally:
            free_worker()

    rows.__signature__ = inspect.signature(work)  # Spark reads the number of parameters
    return rows


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows, found without counting further than that."""
    return df.limit(most + 1).count() <= most


def semi(df: DataFrame, keys: DataFrame, on: list[str], most: int = 200_000) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (distinct). Keys are broadcast only when counted to be
    at most ``most``; beyond that the join shuffles and adaptive execution splits hot keys."""
    return df.join(F.broadcast(keys) if small(keys, most) else keys, on, "left_semi")


def likely(df: DataFrame, met: DataFrame, column: str, most_bits: int = 27) -> DataFrame:
    """``df`` without most of what has no ``column`` (hashes) of ``met``, so that it needn't be shuffled to find out: a bitmap, in rows of 64 places, is
    broadcast. It has 16 places and more for each row of ``met``, but at most ``2**most_bits``; with more rows it only lets more through."""
    bits = min(most_bits, max(16, (16 * met.count()).bit_length()))
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    inside = place.bitwiseAND(F.lit(63)).cast("int")
    bitmap = met.groupBy(F.shiftright(place, 6).alias("_row")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), inside)).alias("_bits"))
    found = df.withColumn("_row", F.shiftright(place, 6)).join(F.broadcast(written(bitmap, "bitmap")), "_row")
    return found.where(F.call_function("shiftrightunsigned", F.col("_bits"), inside).bitwiseAND(F.lit(1)) == 1).drop("_row", "_bits")


def in_words(text: Column) -> Column:
    """Number of words of a text: runs of bytes that are no ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
