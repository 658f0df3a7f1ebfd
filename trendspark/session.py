"""Session helpers: one place for the settings every operator relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Settings the operators assume. Everything that depends on the cluster (shuffle partitions, memory, broadcast
#: threshold) stays with the caller; AQE coalesces and splits partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "trendspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` wins over them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _shared(spark: SparkSession) -> str:
    """The folder for intermediate results that driver and executors share: the one the cluster names in
    ``spark.checkpoint.dir``. Where it is unset (local tests) a temporary folder of this machine is used, which is only
    right because driver and executors then share it; it goes when the process ends."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            shared = tempfile.mkdtemp(prefix="trendspark-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return shared or sc._jsc.sc().getCheckpointDir().get()


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` and what is to be seen of it once it ran: its rows, and what else is named. Costs no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]), seen


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that lineage is cut and a lost executor costs nothing. The files go with the
    DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as :func:`get_spark` does."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: str) -> DataFrame:
    """``df`` as a table in the shared folder, one part per value of ``by``: a filter on ``by`` reads its part alone. For results
    that several plans read in part. The folder is the application's own and is deleted when the driver ends."""
    spark = df.sparkSession
    own = f"{_shared(spark).rstrip('/')}/trendspark-{spark.sparkContext.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.Path(own).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm.org.apache.hadoop.fs.Path(own))
    return spark.read.schema(df.schema).parquet(path)
