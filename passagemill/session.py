"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Kernels hold one Arrow batch at a time; whole texts make rows wide, so batches stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str, cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A ``local[n]`` session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is used only by a ``local`` master that names none.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return os.path.join(tempfile.gettempdir(), "passagemill-scratch")


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the scratch folder and reads it back, cutting its lineage.

    The files survive the loss of executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go once it has ended; else they stay until the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def forget(*tables: DataFrame) -> None:
    """Deletes written tables (see ``persist_table``) that nothing reads any more; the rest of the run has the space."""
    for table in tables:
        # Listed files are URIs, so blanks and the like are escaped.
        files = [unquote(file) for file in table.inputFiles()]
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in files}:
            if scratch_dir(spark).rstrip("/").rsplit("/", 1)[-1] != folder.rsplit("/", 2)[-2]:
                raise ValueError(f"{folder} is not in the scratch folder")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="passagemill-")
    archive = shutil.make_archive(
        os.path.join(folder, "passagemill"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
