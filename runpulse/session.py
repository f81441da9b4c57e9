"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results. All can be set on a running session.
REQUIRED = {
    # Months, cursors and rendered instants are defined in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated key in a JSON object keeps its last value instead of voiding the document.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings that only change speed.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows grow after the shuffles (JSON is rendered and parsed there), so their size on the
    # wire understates the work: do not merge small partitions as eagerly as by default.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # One vectorized batch holds this many event documents, some of which are megabytes long.
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Half the size of the default codec on event documents, and no slower to read.
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app_name: str = "runpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with every setting above; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the result-changing settings to a session somebody else built."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, so that driver and executors are one process,
    a temporary folder of this machine serves; it goes when the process ends.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if not named:
            folder = tempfile.mkdtemp(prefix="runpulse-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(named or folder)
    return (named or context.getCheckpointDir()).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
