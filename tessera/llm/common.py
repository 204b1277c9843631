"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One or more characters other than blank, tab, LF, VT, FF and CR: a word.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch that goes to a Python worker, unless the session says otherwise.
BATCH_BYTES = "2m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_OWN_DIRS: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Batches to Python workers are bounded by bytes, so long texts do not make them large. A
    bound that the session already has stays."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def released(of: Callable) -> Callable:
    """``of`` (a function of batches), which gives memory back to the system when its task ends:
    idle workers keep nothing."""

    def run(batches):
        try:
            yield from of(batches)
        finally:
            release()

    return run


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without ``spark.checkpoint.dir``, a folder of
    our own in local mode, where all run on one machine; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="tessera-")
    return f"file://{_OWN_DIRS[app]}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove all tables that operators of this application stored. What was made from them and
    is not written yet cannot be computed any more."""
    drop_path(spark, _own_dir(spark))


_made: list[list[str]] = []


@contextlib.contextmanager
def tables_of():
    """The paths that are made while this is open, in a list."""
    own: list[str] = []
    _made.append(own)
    try:
        yield own
    finally:
        _made.pop()


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for own in _made:
        own.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: cuts the lineage, and
    what later jobs read survives the loss of any executor. ``clean`` removes such tables."""
    path = new_path(df.sparkSession, label)
    # no more files than the cluster has use for
    df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: Column) -> DataFrame:
    """``df`` in as many partitions as a shuffle has, which adaptive execution leaves as they
    are: for small tables that the next step makes large. The key is salted: an exchange by the
    same key just before would else count as this one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(F.lit(31), key))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame, *but: str) -> Column:
    """All columns of a row as one, so that no column made beside it can clash with them."""
    held = [F.col(quoted(c)) for c in df.columns if c not in but]
    return F.struct(*held) if held else F.struct(F.lit(0).alias("none"))


def unfolded(df: DataFrame, row: str, columns: list[str], **new: Column) -> DataFrame:
    """The columns that ``whole_row`` put into ``row``, in their order, some of them anew."""
    return df.select(*(new[c].alias(c) if c in new else F.col(f"{row}.{quoted(c)}") for c in columns))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df``, which must be cheap to count (a stored table), marked for broadcast if it has at
    most ``max_rows`` rows; otherwise unmarked, and the join shuffles."""
    return F.broadcast(df) if df.count() <= max_rows else df


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` (without a column ``part``) with the place of each row in this order, from 1, in
    column ``name``. Rows are dealt into ranges, each range is counted and numbered by itself; the driver
    gathers one count per range."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "numbered")
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    before, total = [0] * ranges, 0
    for part in sorted(counts):
        before[part:] = [total] * (len(before) - part)
        total += counts[part]
    first = F.element_at(F.lit(before), F.col("part") + 1) if before else F.lit(0)
    return dealt.withColumn(name, F.row_number().over(Window.partitionBy("part").orderBy(*order)) + first).drop("part")


def row_key(*cols: str | Column) -> list[Column]:
    """128 bits that name a row by its content, nulls included: equal rows have equal keys.
    The second half salts both ends, so the halves do not collide together."""
    return [
        F.xxhash64(*cols).alias("rk1"),
        F.xxhash64(F.lit(7919), *cols, F.lit("rk")).alias("rk2"),
    ]


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with a text or binary column compressed, for texts that a join must move. Whoever
    takes it up reads it by ``unpacked``."""
    rows = df.withColumn(column, F.col(column).cast("binary"))
    schema = rows.schema

    def of(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            small = pa.array([press.compress(x.as_buffer()) if x.is_valid else None for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([small if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    small_batches(df.sparkSession)
    return rows.mapInArrow(released(of), schema)


def unpacked(values: pa.Array) -> Iterator[bytes | None]:
    """The values of a column that ``packed`` compressed, one at a time."""
    press = zstandard.ZstdDecompressor()
    for x in values:
        yield press.decompress(x.as_buffer()) if x.is_valid else None


def size_in_words(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_GAP, -1), "")), F.lit(0)).cast("long")
