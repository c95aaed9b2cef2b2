"""Session defaults and the shared folder for data that must outlive its executors."""

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

# Streaming state on disk: it may outgrow executor memory.
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "presage", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC times, ANSI casts and AQE. ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(_STATE_STORE, _ROCKSDB)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def state_on_disk(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB. Stateful processors run on no other store; a query
    restarted from its checkpoint keeps the store that it began with."""
    spark.conf.set(_STATE_STORE, _ROCKSDB)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Only a local session may go without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="presage-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_OWN_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It belongs to this application, which removes it by ``release`` or at
    its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _OWN_PATHS:
        atexit.register(_release_at_exit, spark)
    _OWN_PATHS.append(path)
    return path


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except (Py4JError, OSError):  # the JVM has gone first
        pass


def release(spark: SparkSession) -> int:
    """Remove every path that ``new_path`` has given so far, on whatever file system the shared folder is, and say
    how many there were. Frames read from them can't be used any more."""
    context, n = spark.sparkContext, len(_OWN_PATHS)
    if context._jsc is None:  # stopped: the folder's owner has to clean up
        return 0
    jvm = context._jvm
    while _OWN_PATHS:
        path = jvm.org.apache.hadoop.fs.Path(_OWN_PATHS.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return n


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files.

    Use it where one frame feeds many jobs (iterative fits, several scalar
    statistics); later readers prune columns and row groups.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
