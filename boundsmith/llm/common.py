"""Shared helpers: the shared folder, written stages, Python workers and text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from weakref import WeakValueDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []
_COLLECTING: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a session of one machine (tests) uses a temporary folder of
    its own; on a cluster that would lose rows, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _FALLBACK:
            _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="boundsmith-"))
        path = _FALLBACK[0]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compressed: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors and lets every later read see the
    same rows.  Returns the DataFrame and the path, for :func:`discard`.  Only stages
    that hold whole documents are worth compression, whose buffers lie outside the heap.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    for paths in _COLLECTING:
        paths.append(path)
    df.write.option("compression", "snappy" if compressed else "none").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written stages that no later plan reads."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextmanager
def stages_of_a_block() -> Iterator[list[str]]:
    """The paths of all stages that are written inside the block.

    An operator returns a plan that reads its last stages; who has written that
    plan's rows elsewhere can discard them.
    """
    paths: list[str] = []
    _COLLECTING.append(paths)
    try:
        yield paths
    finally:
        _COLLECTING.remove(paths)


# Python workers -----------------------------------------------------------------

#: Bytes of rows that a Python worker is handed at once; a row may be larger.
BATCH_BYTES = 8 << 20
#: Longer keys are computed each time, so a number of entries bounds the bytes.
LONGEST_KEY = 64
_CACHES: WeakValueDictionary[int, Cache] = WeakValueDictionary()


class Cache(dict):
    """What ``make`` gives for a key, kept for at most ``entries`` keys of bounded length.

    Keys that are met are young; :meth:`turn` makes them the old ones once they are
    half of ``entries``, and the old ones that weren't met meanwhile go.
    """

    def __init__(self, entries: int, make: Callable | None = None) -> None:
        super().__init__()
        self.half, self.make, self.old = entries // 2, make, {}
        _CACHES[id(self)] = self

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEY:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()

    def release(self) -> None:
        self.clear()
        self.old = {}


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _release() -> None:
    for cache in list(_CACHES.values()):
        cache.release()
    _give_back()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:  # noqa: ANN001
    """``df.mapInArrow(run, schema)`` by tasks that leave nothing behind in their worker.

    Python workers serve one task after the other, of any operator.  Batches are kept
    small (a setting of the session, on which no result depends), freed memory goes
    back to the system after each, and the caches end with the task.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                _give_back()

        try:
            yield from run(fed())
        finally:
            _release()

    return df.mapInArrow(task, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
