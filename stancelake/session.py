"""Session set-up and materialisation on shared storage.

Iterative operators cut their lineage by writing a table below the folder the
cluster names in ``spark.checkpoint.dir``.  That folder is shared by all
executors, so a lost executor costs nothing that was already written.  Only
where the setting is absent (tests, a laptop) a local folder is used instead.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_scratch: dict[str, str] = {}


def build_session(app: str = "stancelake", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str = "8g") -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; cluster settings win over these."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` if the session names one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="stancelake-")
        atexit.register(_forget, _scratch[app])
    return "file://" + _scratch[app]


def _forget(path: str) -> None:
    import shutil

    if os.path.isdir(path):
        shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: the plan ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is already gone
        pass


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """``df`` with an observation: its measures are known once ``df`` has been computed, without another pass."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in measures.items()]), seen


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for work that is heavy on CPU.

    A table in few small files would otherwise keep most cores idle; one with enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later step reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            _drop(df.sparkSession, path)
