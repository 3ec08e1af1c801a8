"""Where shared intermediate results go, and frames cut off from their lineage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir. One of this machine only if that is unset and the master is local, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return place or f"file://{_local()}"


_own: list[str] = []


def _local() -> str:
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="checkpoints-"))
    return _own[0]


def unused(names: list[str], wanted: str) -> str:
    """A column name that none of the names is equal to, whatever their case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session's settings while frames are computed here, and as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Texts go to Python workers in batches of so many bytes, as two copies of a batch are held outside the heap.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
_CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Files of a shared folder that is mounted (file:) are written without Hadoop's checksum layer. That one starts the program chmod for each file and each
#: checksum file, and while it starts a second process with all of the executor's memory is there; without it, checkpoints start none and Parquet one for a file and one for its folder. Other stores are not concerned.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@contextlib.contextmanager
def _hadoop(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Hadoop's settings while frames are computed here, and as they were afterwards."""
    own = spark.sparkContext._jsc.hadoopConfiguration()
    before = {k: own.getRaw(k) for k in conf}
    for k, v in conf.items():
        own.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            own.unset(k) if v is None else own.set(k, v)


def settled(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder; later reads do not depend on any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    with _set(df.sparkSession, _BATCHES), _hadoop(df.sparkSession, _PLAIN):
        return df.checkpoint(eager=True)


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """As settled(), as compressed Parquet in the shared folder: for frames of many rows. The shuffle files that led to it go with the write; pages are read with their checksums. files: at most so many, each written by one task."""
    spark, place = df.sparkSession, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _set(spark, _BATCHES | _CLEANUP):
        (df.coalesce(files) if files else df).write.options(**_PLAIN).parquet(place)
    return spark.read.schema(df.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(place)


#: Clears what an operator's tasks hand on within a worker, for the tasks of others.
handed_on: list[Callable[[], None]] = []


def freeing(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *, hands_on: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function over Arrow batches. Workers live on: what other operators handed on is cleared first, unless the function uses it, and free memory goes back to the machine at the end."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from batchplan.llm import spark_io  # the worker's own module, not a copy that came with the function

        for clear in () if hands_on else spark_io.handed_on:
            clear()
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run
