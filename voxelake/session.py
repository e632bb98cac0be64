"""Session helper with the settings that every part of the library assumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with AQE, UTC and LAST_WIN map merges; ``conf`` overrides any setting."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(master).appName("voxelake")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes and rows of binary content that go to a Python worker at a time.
BATCH_BYTES, BATCH_ROWS = 64 << 20, 1000


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Have rows go to Python workers in batches of bounded size; smaller settings of the session stay."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int("".join(c for c in spark.conf.get(key) if c in "-0123456789"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset a session on one machine gets a temporary folder; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="voxelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
