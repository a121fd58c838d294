"""Sessions, and the settings that operators read from them."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "chatloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHATLOOM_DRIVER_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where that is unset and the master is local, as in tests, a temporary one.

    A cluster without the setting raises: a folder of one machine is lost with it. Checkpoints that no plan refers to any more
    are removed where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as in ``local_session``.
    """
    sc = spark.sparkContext
    here = sc.getCheckpointDir()
    if here:
        return here
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="chatloom-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as the session has cores, for Python stages over one small file.

    The reader makes splits of a core's share of the files down to ``spark.sql.files.openCostInBytes`` (4 MB) each, so
    only tables below half the cores times that size, a few MB a core, are shuffled here; any larger scan passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
