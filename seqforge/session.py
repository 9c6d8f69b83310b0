"""Session helpers: building a session for tests/bench and resolving the checkpoint folder.

Operators never build sessions themselves; they take the session from the DataFrame they are given.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at any scale: AQE re-plans joins and partition counts at runtime, skew-join
# splitting handles hot keys, UTC keeps timestamps comparable with the oracle. Broadcast joins are
# chosen only at runtime from measured shuffle sizes (the static, estimate-based threshold is off).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  app: str = "seqforge", extra: dict | None = None) -> SparkSession:
    """Local session used by tests and bench. On a cluster, use the cluster's session instead."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", memory))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local session (one machine, as in tests and bench) may
    leave it unset: a fresh scratch folder is then registered. On a cluster an unset folder is an
    error, because a machine-local folder is not seen by the other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="seqforge-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back: cuts the lineage,
    survives lost executors, and fixes values that must not be recomputed (partition ids, row ids)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scale_conf(input_bytes: float, total_cores: int, target_partition_bytes: int = 256 * 1024 * 1024,
               executor_memory_gb: float = 16.0, cores_per_executor: int = 4) -> dict[str, str]:
    """Settings sized for the data instead of the defaults.

    * file splits: ``maxPartitionBytes`` so that each task reads about ``target_partition_bytes``
      (parquet is splittable; zstd CSV/JSON is one task per file, so prefer many input files);
    * shuffle partitions: enough that an average shuffle partition stays near the target (AQE then
      coalesces small ones), and at least three waves of tasks over all cores;
    * AQE advisory size and skew thresholds: a partition five times the median and above
      ``4 x target`` is split (the hot-key case: one key with a third of the rows);
    * broadcast decided at runtime only: the estimate-based static threshold is off and AQE
      broadcasts a side whose measured shuffle output is under 32 MB.

    Example: 100 TB on 1,000 executors x 8 cores -> ``scale_conf(100e12, 8000)``.
    """
    per_task_memory = executor_memory_gb * 1024 ** 3 * 0.6 / max(cores_per_executor, 1)
    target = int(min(target_partition_bytes, per_task_memory / 4))
    shuffle_parts = max(int(input_bytes // target), total_cores * 3, 8)
    return {
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target),
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }
