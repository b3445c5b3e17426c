"""Session settings and the shared-folder helper that cuts lineage safely."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("packetloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: `spark.checkpoint.dir` of the session.

    Only where it is unset (tests, local runs) a machine-local folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    local = "file://" + tempfile.mkdtemp(prefix="packetloom-shared-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"packetloom-{spark.sparkContext.applicationId}")


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that were not written yet can no longer be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Later reads prune columns, do not recompute, and survive the loss of any executor.
    """
    spark = df.sparkSession
    path = os.path.join(_own_folder(spark), f"{label}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.mode("error").parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One input table, pruned to `columns`."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application; they need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="packetloom-code-")) / "packetloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark
