"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants; a cluster's own values win where already set.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of a frame nobody references any more are deleted by the cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "labelflow", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20,
               max_shuffle_partitions: int = 200_000) -> dict[str, str]:
    """Settings sized to the input: scan splits of ``target_partition_bytes`` and an initial
    shuffle partition count of one per such split (AQE coalesces small ones at run time and
    splits skewed ones), so a shuffle task never holds much more than one split's worth of
    rows. 100 TB → ~400k splits, capped at ``max_shuffle_partitions`` shuffle partitions."""
    parts = max(200, min(max_shuffle_partitions, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


#: Bytes of an Arrow batch that goes to a Python worker with texts or pictures. Rows alone are no
#: bound: 10,000 prompts with their exemplars are hundreds of MB, several times over as objects.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes, where they are not bounded closer yet or in
    another unit by the user."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "2147483647").lower().removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_SHIPPED: set[int] = set()


def _context(spark):
    """The ``SparkContext`` of a classic session; None for a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 — Connect sessions have no SparkContext
        return None


def ship_package(spark: SparkSession) -> None:
    """Make ``labelflow`` importable in the Python workers (pandas UDFs, ``mapInPandas``): zip
    the package once per driver process and ``addPyFile`` it, as ``--py-files`` would (a
    Spark Connect session gets it with ``addArtifacts``)."""
    sc = _context(spark)
    key = id(sc._jsc) if sc is not None else id(spark)
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="labelflow-pkg-"), "labelflow.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(key)


def needs_shared_folder(master: str) -> bool:
    """True unless driver and executors are one process on one machine (``local`` masters)."""
    return not (master == "local" or master.startswith("local["))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Only a local session without one gets a fresh
    local folder; on a cluster each machine would write its own, so that is an error."""
    sc = _context(spark)
    if sc is None:  # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if needs_shared_folder(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; "
                               f"master {sc.master} has no common local disk")
        conf_dir = tempfile.mkdtemp(prefix="labelflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return conf_dir
