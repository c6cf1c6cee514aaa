"""What operators share about the session: the shared folder, settled tables, Python workers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Bytes of an Arrow batch that goes to a Python worker, where the session names none: the worker and the
#: executor hold a few batches each, whatever the length of the texts.
BATCH_BYTES = "4m"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share. Where the session names none
    and runs on one machine, a temporary folder is set for the rest of the session; on a cluster a
    missing setting is an error, for every executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="chainloom-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/chainloom"


def _on_disk(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


#: Whether the shuffle files of a query go when it has ended, and not when the driver happens to collect its plan.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For every scratch() that is open, the tables settled in it.
_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files: a written table is read from its own files alone."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def settle(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor costs
    no recomputation of what stands before it. The folder goes when the session's driver ends, with the
    scratch() around it, or with discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        # names here are digests in hex, which only a codec with entropy coding makes shorter
        df.write.option("compression", "zstd").parquet(path)
    files, place = _on_disk(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes all tables that are settled within it at its end, but for those given to what it yields, which belong to the scratch() around it, if
    any. So nothing that is read later may still rest on the others."""
    own, kept = [], []
    _SCRATCH.append(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _SCRATCH.pop()
        discard(*[df for df in own if not any(df is k for k in kept)])
        if _SCRATCH:
            _SCRATCH[-1].extend(kept)


def settled(df: DataFrame, what: str = "table") -> DataFrame:
    """The table itself where it is a settled one, or else settled now."""
    return df if vars(df).get("settled_at") else settle(df, what)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt over all shuffle partitions, those with equal values together, for work that is far larger than the bytes it reads: a small file is
    one partition, whatever is done with its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Rows of a table for which spread() sees to a shuffle partition, where its caller names no other number.
SPREAD_ROWS = 200_000


def spread(*tables: DataFrame, rows: int = SPREAD_ROWS) -> None:
    """Raises the session's number of shuffle partitions to one for so many rows of the largest table, and never lowers it: so the
    memory of a task does not grow with the table, whatever number the session began with. Adaptive execution still puts small partitions together."""
    spark = tables[0].sparkSession
    wanted = -(-max(df.count() for df in tables) // rows)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", wanted)


def discard(*tables: DataFrame | None) -> None:
    """Deletes settled tables that nothing reads any more; any other DataFrame is left alone."""
    for df in tables:
        if df is not None and (path := vars(df).get("settled_at")):
            files, place = _on_disk(df.sparkSession, path)
            files.delete(place, True)


def workers(spark: SparkSession) -> None:
    """Lets Python workers import this library from where the driver has it, and bounds their batches. To
    be called by every operator that sends a function of this library to Python workers."""
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


_HELD: dict[str, object] = {}


def held(owner: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task for one operator; another operator's task ends it."""
    if owner not in _HELD:
        let_go(owner)
        _HELD[owner] = make()
    return _HELD[owner]


def let_go(owner: str | None = None) -> None:
    """Frees what other operators' tasks have left in this worker process, and gives free memory back to
    the machine, as an executor's workers are reused for all that follows."""
    for other in [x for x in _HELD if x != owner]:
        del _HELD[other]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
