"""Session helpers for tests, the bench and local runs.

On a cluster the session comes from the platform; only ``spark.checkpoint.dir``
matters to this library (see :func:`basketlens.sources.loaders.shared_dir`), and
it is read from the session, never overridden.  ``local_session`` sets one only
when it is unset, which is the test situation.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "basketlens") -> SparkSession:
    builder = (SparkSession.builder
               .master(f"local[{cores}]")
               .appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a scratch one only if unset."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    scratch = tempfile.mkdtemp(prefix="basketlens-ckpt-")
    spark.sparkContext.setCheckpointDir(scratch)      # the conf key is static; set the context's dir
    return spark.sparkContext.getCheckpointDir() or scratch
