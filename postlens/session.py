"""Session helpers: defaults for a local run, shared scratch space, lineage cuts."""

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; a fresh local one only where none is configured."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="postlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Delete the stored copies this application has made; frames that read them end with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(job_folder(spark))
    path.getFileSystem(conf).delete(path, True)


def job_folder(spark: SparkSession) -> str:
    """One folder for each application below the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as a zip made by the driver."""
    context = spark.sparkContext
    if getattr(context, "_postlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="postlens-zip-"), "postlens_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._postlens_shipped = True


#: Bytes of an Arrow batch at most; a task holds a few of them.
ARROW_BYTES = 16 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most_bytes: int = ARROW_BYTES) -> None:
    """Lower the session's bytes of an Arrow batch to ``most_bytes`` where they are more.

    A batch of 10,000 rows of long texts takes any amount of memory, once in the JVM and again in Python.
    """
    most = spark.conf.get(_ARROW_BYTES, None)
    if most is None or not most.isdigit() or int(most) > most_bytes:
        spark.conf.set(_ARROW_BYTES, str(most_bytes))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's part of the shared folder."""
    return f"{job_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder once, so later steps read fixed partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved_copy(df: DataFrame, label: str) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stored bytes up to which a frame may be sent to every executor.
BROADCAST_BYTES = 4 << 20


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of what is stored at a path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def broadcast_if_small(df: DataFrame, label: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A stored copy, marked for broadcast only when its files have at most ``max_bytes``."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    return F.broadcast(copy) if stored_bytes(df.sparkSession, path) <= max_bytes else copy
