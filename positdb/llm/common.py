"""Shared helpers of the training-data operators: work folder, table access, Arrow mapping."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the maximal runs of bytes outside this set (ASCII white space only).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch of rows for Python, by ``bound_batches``.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or an own one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="positdb-work-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that this process has made, and names of those that are tables of the catalog.
_made: list[str] = []
_named: dict[str, str] = {}


def new_folder(spark: SparkSession, tag: str) -> str:
    _made.append(f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def work_tables() -> int:
    """How many work tables there are; ``clear_work`` can spare these."""
    return len(_made)


def clear_work(spark: SparkSession, since: int = 0, keep: str | None = None, until: int | None = None) -> int:
    """Delete the work tables made after the first ``since`` (of the first ``until``), but for ``keep``; returns their number.

    What was made from them must have been written or read before.
    """
    gone = [x for x in _made[since:until] if x != keep]
    _made[since:until] = [x for x in _made[since:until] if x == keep]
    for folder in gone:
        if folder in _named:
            spark.sql(f"DROP TABLE IF EXISTS {_named.pop(folder)}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it again.

    A lost executor then costs a read of these files, not a new run of what made them.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, tag)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, column: str, tag: str) -> DataFrame:
    """``stored``, in as many buckets by ``column`` as the session has shuffle partitions.

    Joins on the column then read it without a shuffle.  The table has a name in the session's catalog.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, tag)
    _named[folder] = folder.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", folder).saveAsTable(_named[folder], format="parquet")
    return spark.read.table(_named[folder])


def id_crc32(doc_id: Column) -> Column:
    """zlib's CRC-32 of the id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def crc32_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, most: int = 0) -> DataFrame:
    """``mapInArrow`` with a function that is made once a task and turns one batch, of ``most`` rows if given, into columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in (part for b in batches for part in ([b.slice(i, most) for i in range(0, b.num_rows, most)] if most else [b])):
            columns = work(batch)
            arrays = [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in target]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)

    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """From now on this session's batches of rows for Python end at ``BATCH_BYTES`` too, or at its own bound if that is less.

    By default they end at 10 000 rows, however long these are, and the JVM and the worker each hold a batch more than once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(BATCH_BYTES + 1))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def keep_memory() -> None:
    """Have glibc keep freed memory in this worker: arrays of some MB are else given back and zeroed anew each time."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD: no more than this stays
        mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD: the largest value that all versions take


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts of a column as UTF-8 bytes; null counts as empty."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
