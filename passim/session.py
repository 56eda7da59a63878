"""Session helpers: the shared work folder, checkpoints and size budgets."""

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table (in bytes) sent to every executor. Each operator that
# broadcasts measures or proves the size first and has another plan above it.
BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes of an Arrow batch that text columns are sent to Python in.
TEXT_BATCH_BYTES = 4 * 1024 * 1024
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_folders: dict[str, str] = {}
_stored: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it gets a temporary
    folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = _local_folders.get(sc.applicationId)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="passim-")
            _local_folders[sc.applicationId] = folder
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, key: tuple, build: Callable[[str], None]) -> str:
    """The path of a derived table, built by ``build(path)`` once per application."""
    entry = (spark.sparkContext.applicationId, *key)
    if entry not in _stored:
        path = new_folder(spark, str(key[0]))
        build(path)
        _stored[entry] = path
    return _stored[entry]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing the rows to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_within(df: DataFrame, max_rows: int | None, row_bytes: int) -> DataFrame:
    """Add a broadcast hint only if ``max_rows`` proves the table small enough.

    Without a proof the table is returned unchanged and the optimizer picks
    the join from its own statistics.
    """
    if max_rows is not None and max_rows * row_bytes <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send texts to Python in batches of few bytes.

    A batch lies in the executor's memory outside the heap and in the worker's
    at once, for every task. Jobs that start later have the session's setting.
    """
    old = spark.conf.get(_BATCH_BYTES)
    keep_batches_small(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, old)


def keep_batches_small(spark: SparkSession) -> None:
    """As ``small_batches``, for the session from now on.

    For programs whose rows go to Python when their caller writes them.
    """
    spark.conf.set(_BATCH_BYTES, f"{TEXT_BATCH_BYTES}b")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a scan over all cores if it has fewer splits than there are cores.

    A few files of few row groups would otherwise leave most cores idle in the
    text-heavy steps that follow. A table with enough splits passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _hadoop(spark, path)
    return files.exists(place)


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file, if there is none; of several writers one succeeds."""
    files, place = _hadoop(spark, path)
    try:
        files.create(place, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def remove_file(spark: SparkSession, path: str) -> bool:
    """Delete one file; whether there was one."""
    files, place = _hadoop(spark, path)
    return files.delete(place, False)
