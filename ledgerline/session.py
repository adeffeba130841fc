"""Session construction and cluster-safe settings."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on; a cluster deployment may override any of
# them through spark-defaults, these are only applied when unset.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # size-checked broadcast of small dimensions (planner estimate, then
    # AQE's runtime size); fact tables never fit under it
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "ledgerline",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session with the library's defaults applied.

    ``master`` is only set when given (a cluster submit supplies its own).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for lineage cuts and intermediate tables.

    On a cluster ``spark.checkpoint.dir`` names a shared, reliable folder and
    is used as is. Only when it is unset under a local master (tests) a private
    scratch folder is created, which goes when Python ends; elsewhere that is an error. ``DataFrame.checkpoint()`` is enabled for the
    same folder where the session exposes its ``SparkContext``.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all "
                               "executors share; a machine-local one is made for local masters only")
        if "ckpt" not in _LOCAL_DIRS:
            _LOCAL_DIRS["ckpt"] = tempfile.mkdtemp(prefix="ledgerline-ckpt-",
                                                   dir=os.environ.get("TMPDIR", "/tmp"))
            atexit.register(shutil.rmtree, _LOCAL_DIRS["ckpt"], ignore_errors=True)
        configured = _LOCAL_DIRS["ckpt"]
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


_LOCAL_DIRS: dict[str, str] = {}
