"""Session helpers: shared scratch tables, code shipping, input tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; texts are long, so a batch is kept small.
BATCH_ROWS = 1000

#: A setting of the session, unset by default: tasks that each table read is dealt over.
TASKS = "spark.attestor.tasks"

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, by Spark's reader only (any file system).

    Where the session sets TASKS, the rows are dealt over so many tasks, for files of few row groups, which no scan can split.
    """
    table, n = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.conf.get(TASKS, None)
    return table.repartition(int(n)) if n else table


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and put this package on the executors' path, once per application."""
    held = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(held)) <= BATCH_ROWS:  # a smaller bound of the caller's stays
        spark.conf.set(held, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"attestor_code_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def tidied(task):
    """A task over Arrow batches that gives memory back at its end.

    Python workers go on to other tasks, and their executor's memory is bounded: large arrays are mapped on their own,
    so that freeing them returns them, and what the allocators keep is returned at the end.
    """

    def run(batches):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        try:
            yield from task(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Give back what the allocators of this process keep of freed memory."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local master, where all is one process, may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="attestor-"))


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with a copy that survives lost executors, and fixes row ids. The
    folder goes when the driver ends, or at release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestor-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._attestor_path = path
    return out


def settle(df: DataFrame, label: str, deal: bool = True) -> DataFrame:
    """materialise(), with ``deal`` in files of the size that adaptive execution aims at, after which Spark may drop the shuffle
    files of what is no longer referred to."""
    out = materialise(df.hint("rebalance") if deal else df, label)
    forget(df.sparkSession)
    return out


def forget(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


def discard(table: DataFrame) -> None:
    """Delete a table of materialise() that nothing will read any more."""
    path = table._attestor_path
    _written[:] = [x for x in _written if x[1] != path]
    _delete(table.sparkSession, path)


@contextmanager
def scratch():
    """Tables that materialise() writes within go at the end."""
    before = len(_written)
    try:
        yield
    finally:
        release(before)


def release(before: int = 0) -> None:
    """Delete the tables that materialise() has written, but for the first ``before`` of them."""
    while len(_written) > before:
        _delete(*_written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended; the folder is scratch space
        pass


atexit.register(release)


def crc_bucket(col, mod: int):
    """crc32 of an id's decimal text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))
