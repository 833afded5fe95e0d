"""Session helpers: table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for a Spark context, so that they need no copy of it in their path."""
    sc = spark.sparkContext
    if getattr(sc, "_graupel_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # else it runs from an archive that was sent already
        archive = os.path.join(tempfile.mkdtemp(prefix="graupel-package-"), "graupel.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.relpath(path, os.path.dirname(root)))
        sc.addPyFile(archive)
    sc._graupel_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where the session names none and runs on one machine (tests) a temporary
    folder of our own is set, and removed at the end; on a cluster a folder that all machines share must be named."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="graupel-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared checkpoint folder and continues from there, so that nothing above is
    computed twice and a lost executor costs no more than the current stage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
