"""Session helpers: shared scratch tables, table access and shipping the package to executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: An explicit broadcast is used only for sides whose counted rows times this many bytes stay below BROADCAST_BYTES.
BROADCAST_BYTES = 32 << 20
#: Rows with whole texts that reach a Python worker at a time, at most.
TEXT_ROWS = 1000


def session(app: str = "fernspan", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings this library expects (AQE, UTC, skew joins)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker (once for each Spark context).

    Also bounds what a Python worker gets at a time: rows here hold whole texts, and Spark's default is 10,000 of them.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_fernspan_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="fernspan_ship_")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "fernspan_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("fernspan", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._fernspan_shipped = True


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands Python workers at most so many rows at a time (texts and packed blocks are large rows)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Hands freed memory back to the system: in a Python worker, since workers are reused and an executor may keep several, and in the driver, which lives on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(run: Callable, *caches: dict) -> Callable:
    """A function over Arrow batches that empties the given caches and releases memory when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            for c in caches:
                c.clear()
            release()

    return wrapped


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir, or what setCheckpointDir() named, or in local mode (tests) a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and (named := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = named.get()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        root = getattr(spark.sparkContext, "_fernspan_scratch", None)
        if root is None:
            folder = tempfile.mkdtemp(prefix="fernspan_scratch_")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = spark.sparkContext._fernspan_scratch = "file://" + folder
    if "://" not in root:  # name the file system, so that readers outside Spark find the same one
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        root = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
        root = "file:///" + root[6:].lstrip("/") if root.startswith("file:/") else root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/fernspan/{spark.sparkContext.applicationId}/{label}_{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes all that this application wrote to the shared folder; results that still read it end with it."""
    drop_path(spark, f"{scratch_root(spark)}/fernspan/{spark.sparkContext.applicationId}")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Kept:
    """A written table in the shared folder: lineage ends here, so a lost executor costs no recomputation of what came before."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def keep(df: DataFrame, label: str) -> DataFrame:
    return Kept(df, label).df


def tidy(spark: SparkSession, *done: Kept) -> None:
    """Drops tables that nothing reads any more, has the JVM look for shuffle files that no frame needs, and gives the driver's memory back."""
    for k in done:
        k.drop()
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES
