"""Session helpers: recommended settings and the shared scratch folder."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that suit the operators on a cluster. Partition sizes are left to
# AQE: start from many shuffle partitions and let it coalesce or split them.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def utc(spark: SparkSession) -> SparkSession:
    """Event times are UTC wall clock; pin the session zone so casts agree."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Python gets rows in Arrow batches of about 4 MB; a session that names another size keeps it.

    Spark's own bound is 64 MB beside 10,000 rows. Each task holds such batches
    outside the heap, on their way out and back, and its Python worker holds
    copies; rows with whole texts fill them.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, CLUSTER_CONF[size])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where the session names none and runs in one process (local tests) a
    temporary folder is made and remembered in the session; a cluster without a
    shared folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("logrill.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="logrill-")
        spark.conf.set("logrill.scratch.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/logrill/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the queries that run here are removed as each ends, not when the driver happens to collect its garbage.

    What a query has written does not need them. A chain of steps thus holds the shuffles of one step at a time.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df, name: str):
    """Write a result that several jobs reuse and read it back; its shuffle files go at once."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Delete the folder of a materialized result that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def numbers_below(spark: SparkSession, path: str) -> list[int]:
    """The n of the folders named v=n in a folder."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(jvm_path)] if files.exists(jvm_path) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
