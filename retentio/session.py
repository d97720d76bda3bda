"""Session settings and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
OPEN_FILES = "32"  # bucket files of one task; it sorts the rows beyond them


def spark_session(app: str = "retentio", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what the results depend on, whatever session the caller brings."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """One session setting for the tables written inside the block, then as it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a session in one process (``local[n]``, as in tests) gets a folder of
    its own; on a cluster, where executors would not see such a folder, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="retentio-")
    return _FALLBACK[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/retentio/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage", compression: str | None = None, buckets: str | None = None) -> DataFrame:
    """Write once, read many: cuts lineage, survives executor loss and keeps column pruning.

    A written table is used rather than ``checkpoint()`` because the latter evaluates its
    input twice and stores rows, so later single-column passes would read everything.

    ``buckets`` names a key: the table is written in as many buckets of it as shuffles have
    partitions, so that later joins and groups by that key do not move its rows again. A task
    holds a shuffle partition or a few, so it keeps their files open instead of sorting its rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if buckets is None:
        df.write.parquet(path, compression=compression)
        return spark.read.schema(df.schema).parquet(path)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = df.write.bucketBy(count, buckets)
    if compression is not None:
        written = written.option("compression", compression)
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES):
        written.saveAsTable(name, format="parquet", path=path)
    return spark.table(name)
