"""Session settings and the shared scratch location.

On a cluster the scratch folder is whatever ``spark.checkpoint.dir`` names (a
shared filesystem); it is read from the session and only filled in here when
unset, as in local tests.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of this package expects. AQE re-plans joins and partition
# counts from runtime sizes; the broadcast threshold is Spark's own size check
# for dimension sides (anything above it is sort-merge joined).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT methods over 8000 bytes of bytecode; past that a
    # whole-stage-codegen stage is slower than the non-fused operators.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "adlens", **conf) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULT_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made and set for the session, but only in
    ``local`` mode, where one machine runs everything. On a cluster each executor would
    write to its own disk and later reads would miss those files, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder shared by driver and executors (master {master})")
    base = tempfile.mkdtemp(prefix="adlens-")
    spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    ``spark.checkpoint.dir`` names that location (see ``shared_base``).
    """
    base = shared_base(spark)
    path = os.path.join(base, f"{name or 'scratch'}-{uuid.uuid4().hex[:12]}") if "://" not in base else (
        f"{base.rstrip('/')}/{name or 'scratch'}-{uuid.uuid4().hex[:12]}"
    )
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` usable: reuse the session's folder or set a local one."""
    base = shared_base(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base
