"""Session settings, table loading, and the one place lineage is cut."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: A side is broadcast only when Spark's own size estimate of it is below this.
BROADCAST_BYTES = 64 * 1024 * 1024

#: Spark's default size of a file split.
SPLIT_BYTES = 128 * 1024 * 1024

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def prepare(spark: SparkSession) -> SparkSession:
    """Set the SQL options results depend on; leave cluster sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def build_session(app: str = "tablesense", cpus: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One Parquet table; binary columns are never selected."""
    return drop_binary(spark.read.parquet(f"{path}/{name}.parquet"))


def load_tables(
    spark: SparkSession, path: str, names: Iterable[str] = TABLES
) -> dict[str, DataFrame]:
    prepare(spark)
    return {name: load_table(spark, path, name) for name in names}


def drop_binary(df: DataFrame) -> DataFrame:
    keep = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.BinaryType)]
    return df if len(keep) == len(df.columns) else df.select(*keep)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the cluster's shared folder, so a lost executor costs no recompute.

    ``spark.checkpoint.dir`` is read from the session; ``shared_root`` says what holds without it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate data: ``spark.checkpoint.dir``, else the warehouse folder.

    On a cluster, executors do not see each other's local folders: there, a warehouse folder that is
    local is refused and ``spark.checkpoint.dir`` must be set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or warehouse.startswith("/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The name of a fresh folder that all executors can reach."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def as_catalogue(df: DataFrame) -> DataFrame:
    """Fix a catalogue (one row per column, table or finding) so later steps do not recompute it.

    Only for frames whose size is the width of a schema; data rows never come here.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate is under ``limit``.

    Above it the frame is returned untouched and Spark joins by shuffle, with AQE
    splitting skewed partitions.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame, floor_bytes: int = 1 << 20) -> DataFrame:
    """Split an input that arrives in fewer partitions than there are cores.

    A table stored as one unsplittable piece would run all per-cell work in one
    task.  Files and split size tell from the plan alone how many partitions a scan gets; inputs that
    already have a partition per core, as any large table does, are returned untouched.
    """
    spark = df.sparkSession
    cores, size = spark.sparkContext.defaultParallelism, estimated_bytes(df)
    if size < floor_bytes:
        return df
    parts = max(len(df.inputFiles()), size // SPLIT_BYTES)
    return df.repartition(cores) if 0 < parts * 2 <= cores else df


def in_pieces(df: DataFrame, rows_each: int, rows: int | None = None) -> DataFrame:
    """Split so that a task gets about ``rows_each`` rows, and what it groups in memory stays the same at any size.

    ``rows`` are the rows of ``df`` where the caller knows them; else they are counted.  Small inputs stay as they are.
    """
    rows = df.count() if rows is None else rows
    if rows <= rows_each:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_each)))


def metadata_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of metadata rows (one per column or table), never of data rows."""
    return spark.createDataFrame(rows, schema)


def family(data_type: T.DataType) -> str:
    """Storage family used when two columns are compared."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "text"


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType)) or (
        isinstance(data_type, T.DecimalType) and data_type.scale > 0
    )


def is_scalar(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_scalar(f.dataType)]


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact row count per table: one narrow aggregate each, unioned into one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
