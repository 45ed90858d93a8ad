"""What the operators of this subpackage share: tables, scratch tables, names, Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waymark.session import ship

#: Rows handed to a Python worker at once; texts of any length pass, so few rows keep a batch small.
BATCH_ROWS = 500
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """For operators that run Python: ships the package and bounds an Arrow batch by rows; a lower bound of the session stays."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where that is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="waymark-")
        shared_dir.own = base
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name below that of the application, which goes when the driver's process ends."""
    own = f"{shared_dir(spark)}/waymark/{spark.sparkContext.applicationId}"
    if own not in _tidied:
        _tidied.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


_tidied: set[str] = set()


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped
        _remove(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, outlives executors, and later reads prune columns.

    The written table replaces the shuffles that made it, so their files go at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    _made.paths.append(path)
    return out


class _Made(threading.local):
    """Folders of the tables that stored() wrote in this thread and that drop() has not removed."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Removes tables that stored() returned and nothing will read again."""
    for t in tables:
        _remove(t.sparkSession, t.scratch)
        if t.scratch in _made.paths:
            _made.paths.remove(t.scratch)


def made_since(before: set[str]) -> list[str]:
    """Of this thread's tables those that were not there then."""
    return [p for p in _made.paths if p not in before]


def mark() -> set[str]:
    return set(_made.paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes those of the folders that are still there."""
    for path in [p for p in paths if p in _made.paths]:
        _remove(spark, path)
        _made.paths.remove(path)


def purge(spark: SparkSession) -> None:
    """Removes all scratch tables of the application; call when no result that reads them is needed."""
    _remove(spark, f"{shared_dir(spark)}/waymark/{spark.sparkContext.applicationId}")
    _made.paths.clear()


def free_name(taken: Iterable[str], name: str) -> str:
    """name, or with underscores added until no column has it (Spark's names ignore case)."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name += "_"
    return name


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., and the new name of each: inside an operator no name clashes or needs quotes."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), {c: f"c{k}" for k, c in enumerate(df.columns)}


def add_columns(df: DataFrame, column: str, new: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """df with new columns (names get _ if taken) made in Python workers: make() is called once a task and gives a function
    from a batch of the column's values to a list for each new column."""
    small_batches(df.sparkSession)
    given, name = plain(df)
    schema = T.StructType([*given.schema.fields, *(T.StructField(f"n{k}", t) for k, (_, t) in enumerate(new))])
    arrow, at = to_arrow_schema(schema), given.columns.index(name[column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        for b in batches:
            made = values(b.column(at).to_pylist())
            yield pa.record_batch([*b.columns, *(pa.array(v, arrow.field(b.num_columns + k).type) for k, v in enumerate(made))], schema=arrow)

    return given.mapInArrow(run, schema).toDF(*df.columns, *(free_name(df.columns, n) for n, _ in new))


def crc_part(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id is no training row of anything and counts as remainder -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))
