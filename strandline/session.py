"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings a job should run with.  They are advice for whoever builds the
# session; nothing below depends on them for correct results.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
}


def local_session(cores: int | str = 8, app: str = "strandline", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Where it is unset, a session whose driver is its only process gets a folder
    of its own; on any cluster, a local one included, that is an error, because
    a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The path for the JVM and the file system that holds it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses; it goes when the session ends."""
    path = os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")
    jvm_path, files = file_system(spark, path)
    files.deleteOnExit(jvm_path)
    return path


def materialise(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with ``options`` of the writer, and go on from the written table.

    Used where several jobs read the same intermediate table.  The files
    survive the loss of executors, and their statistics let the optimizer
    choose join strategies for what follows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once.

    Workers import functions by name; they may run elsewhere, or with another
    search path than the driver.
    """
    package = Path(__file__).parent
    if spark.sparkContext.applicationId in _SHIPPED or not package.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    path = scratch_path(spark, package.name) + ".zip"
    jvm_path, files = file_system(spark, path)
    out = files.create(jvm_path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    files.deleteOnExit(jvm_path)
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)
