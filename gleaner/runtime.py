"""Session, scratch tables and size checks shared by the operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A hash relation of this many estimated bytes is cheap to ship to every
# executor; anything larger goes through a shuffle join.
BROADCAST_BYTES = 256 << 20
_ROW_OVERHEAD = 64


def session(app: str = "gleaner", cores: int | str = "*", partitions: int | None = None, **conf) -> SparkSession:
    """A local session for tests and timing; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


@functools.cache
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="gleaner-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the cluster names it.

    Falls back to a temporary folder for ``local`` masters only, where driver
    and executors are one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/gleaner/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_scratch()


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def file_exists(spark: SparkSession, name: str) -> bool:
    """Whether a file or folder is there, on whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the intermediate tables made inside when it is left. Results must
    have been written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Call it when every
    result that reads them has been written."""
    _delete(spark, scratch_root(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared Parquet table and read it back.

    Cuts lineage in a way that survives lost executors, and gives the planner
    true sizes for its own broadcast decisions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Rebalance a bare scan that has fewer splits than there are cores.

    A no-op for large inputs; only small or unsplittable inputs are shuffled.
    Call it on a plain file scan, before any aggregation or join.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def computed(df: DataFrame, name: str, column) -> DataFrame:
    """Add a costly column so that it is evaluated exactly once per row.

    A filter on a plain projection is pushed below it with the expression
    copied in, which would extract or parse every row twice. A generator's
    output cannot be inlined.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(column)).alias(name))


def _width(column, kind: str):
    if kind.startswith(("array", "map", "struct")):
        raise ValueError("only flat columns can be measured")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0))
    return F.lit(16)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` (flat columns) with one aggregation and compare to ``limit``."""
    width = functools.reduce(lambda a, b: a + b, [_width(F.col(n), t) for n, t in df.dtypes], F.lit(_ROW_OVERHEAD))
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    return size <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after the rows were measured to be within ``limit``."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df
