"""Written intermediates that cut lineage and carry true sizes.

A staged table lives in the folder the cluster names in ``spark.checkpoint.dir``.
It survives the loss of executors, and since it is a plain Parquet table its
real byte size reaches the optimizer: a small one is broadcast, a large one is
sort-merged, without a hint in the code.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        root = tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp")
        _local_roots[app] = root
        atexit.register(shutil.rmtree, root, True)
    return _local_roots[app]


def new_stage_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{stage_root(spark)}/{app}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a reader of the written table."""
    spark = df.sparkSession
    path = new_stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete every table this application has staged; at the end of a job, when its outputs are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{stage_root(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lanes(spark: SparkSession) -> int:
    """Partitions for CPU-heavy exploded work, whose input bytes are tiny.

    AQE sizes partitions by bytes, which would put thousands of packed series in
    one task although each expands to a whole fold of rows. So the configured number
    holds, and more where the cluster has more cores; there is no upper bound.
    """
    configured = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, configured, spark.sparkContext.defaultParallelism)


def side_by_side(tasks: list) -> list:
    """Results of independent calls whose Spark jobs may share the cluster at one time."""
    if len(tasks) < 2:
        return [task() for task in tasks]
    with ThreadPoolExecutor(max_workers=min(len(tasks), 4)) as pool:
        return [f.result() for f in [pool.submit(task) for task in tasks]]
