"""Session helpers: build a local session for tests/bench, tune runtime confs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL confs every job relies on. Applied only where the session has no
# explicit value, so a cluster's own settings win.
RUNTIME_CONFS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Window buffers: a row block's frame stays in the fast in-memory row array instead of
# switching to the external one at 4,096 rows.
# Only applied when the launch configuration leaves the setting alone.
LAUNCH_DEFAULTS = {
    "spark.sql.windowExec.buffer.in.memory.threshold": "131072",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONFS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    launch = spark.sparkContext.getConf()
    for key, value in LAUNCH_DEFAULTS.items():
        if not launch.contains(key):
            spark.conf.set(key, value)
    # Timezone matters for date math against the oracle: always pin UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "barlake") -> SparkSession:
    """Local session for tests and the bench (the cluster brings its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a local session (tests) gets a folder of its own; a cluster session
    fails, because its executors would each write to a disk that the others don't see.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="barlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


_STAGED: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: several readers share
    it, nothing is cached, and a lost executor costs no recomputation. ``release`` deletes it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the staged tables of this process; results that still read them must be done."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)


#: Bytes of an Arrow batch where tasks hold whole texts, about; Spark's own 64 MB stand several times in a JVM and its workers.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets the executors' Python workers import this package (as ``--py-files`` does)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside pass rows to Python in batches of BATCH_BYTES; a session's own setting wins."""
    own = spark.conf.get(_BATCH_CONF, None)
    if own is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_BATCH_CONF)
