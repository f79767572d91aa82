"""Session creation, the shared work folder and size-checked broadcasts."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle: int = 8, app: str = "sieveline") -> SparkSession:
    """Session for tests and bench; on a cluster the caller brings a configured session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SIEVELINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees, from `spark.checkpoint.dir`; local mode may fall back to /tmp.

    The folder is used as configured: without a scheme it is on the default file system, and a
    path of a mounted share serves a cluster as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@functools.cache
def _own_folder(application: str) -> str:
    """Spark lets nobody set `spark.checkpoint.dir` in a running session, so the folder is kept here."""
    return tempfile.mkdtemp(prefix="sieveline-")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `drop_scratch` removes what this process has put there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Remove the scratch tables of this process and give their number.

    For whoever consumes results: a lazy result reads its scratch tables, so call it once results
    are written, and not while others of this process still run.
    """
    gone = 0
    while _SCRATCH:
        target = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return gone


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application; installed workers use it as well."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="sieveline-package-"), "sieveline")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(context.applicationId)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder; survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rewrite a source of a few megabytes, which Spark would read in one task, with one file per
    core before steps that multiply its rows. Anything larger is left as it is; the size is the
    planner's estimate, so nothing runs to find out."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES:
        return df
    return written(df.repartition(df.sparkSession.sparkContext.defaultParallelism), "spread")


BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `df` if it holds at most `limit` rows and BROADCAST_BYTES, else hand it back for a
    shuffle join."""
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit or table.nbytes > BROADCAST_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


def local_frame(spark: SparkSession, rows, schema) -> DataFrame:
    """A frame over driver-side rows of a known small size (grids, fitted constants)."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    names = struct.fieldNames()
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    table = pa.table(
        [pa.array(list(v), type=arrow.field(i).type) for i, v in enumerate(columns)], schema=arrow
    )
    return spark.createDataFrame(table, struct)
