"""Sinks: correction-safe partition upsert, snapshots, text exports, shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# NULL and empty are both an empty cell, and blanks inside a cell stay.
_CSV_OPTIONS = {
    "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared directory that `spark.checkpoint.dir` names; a session that
    names none gets one in its warehouse, which driver and executors share as well."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(rows: DataFrame, name: str) -> DataFrame:
    """Write a reduced table once and read it back, for jobs which need it several times.

    The written table cuts the lineage: a lost executor re-reads it instead of scanning the facts
    again, and several consumers share one pass over them.
    """
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def _path(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held, held.getFileSystem(spark._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing a folder."""
    held, system = _path(spark, path + "/_SUCCESS")
    return system.exists(held)


def remove_folder(spark: SparkSession, path: str) -> None:
    held, system = _path(spark, path)
    system.delete(held, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders directly inside a folder, by name; none if it does not exist."""
    held, system = _path(spark, path)
    found = system.listStatus(held) if system.exists(held) else []
    return sorted(f"{path}/{f.getPath().getName()}" for f in found if f.isDirectory())


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly inside a folder; none if it does not exist."""
    held, system = _path(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(held) if f.isFile()) if system.exists(held) else []


# Partition values that are named as literals in the filter of a scan, so that it prunes while it is planned. More
# of them are joined, which prunes while it runs if Spark finds the join side small, and is right in any case.
LITERALS = 1_000


def touched_partitions(incoming: DataFrame, partition: str) -> list | None:
    """The partition values of a batch, or None if there are more than LITERALS."""
    found = [row[0] for row in incoming.select(partition).distinct().limit(LITERALS + 1).collect()]
    return found if len(found) <= LITERALS else None


def only_partitions(stored: DataFrame, partition: str, values: list) -> DataFrame:
    """Rows of the named partitions, as literals that the scan prunes by."""
    known = [v for v in values if v is not None]
    condition = F.col(partition).isin(known) if known else F.lit(False)
    return stored.filter(condition | F.col(partition).isNull() if None in values else condition)


def only_touched(stored: DataFrame, incoming: DataFrame, partition: str) -> DataFrame:
    """Rows of the partitions that a batch has."""
    values = touched_partitions(incoming, partition)
    if values is not None:
        return only_partitions(stored, partition, values)
    wanted = incoming.select(F.col(partition).alias("_wanted")).distinct()
    return stored.join(wanted, stored[partition].eqNullSafe(wanted["_wanted"]), "left_semi")


def overwrite_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in `rows`. Rows are clustered by partition first, so a
    task writes few files; the rebalance lets adaptive execution split a hot date over many tasks
    and merge small ones."""
    rows.hint("rebalance", partition).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(partition).parquet(path)


def overwrite_folder(rows: DataFrame, path: str, partition: str) -> None:
    """Write a folder anew, clustered as in `overwrite_partitions`."""
    rows.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)


def write_snapshot(rows: DataFrame, path: str, snapshot_date: str) -> None:
    """One dated snapshot; `current` is the highest date and needs no second copy."""
    dated = rows.withColumn("snapshot_date", F.lit(snapshot_date).cast("date"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "snapshot_date"
    ).parquet(path)


def current_snapshot(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("snapshot_date").alias("snapshot_date"))
    return rows.join(newest, "snapshot_date", "left_semi")


def csv_lines(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """CSV text lines in fixed column order, NULL as an empty cell."""
    cells = df.select(*columns)
    return cells.select(
        F.to_csv(F.struct(*cells.columns), _CSV_OPTIONS).alias("line")
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV_OPTIONS).csv(path, header=True)


def json_lines(df: DataFrame) -> DataFrame:
    """Compact JSON with sorted keys; NULL fields stay."""
    return df.select(
        F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line")
    )


def write_json(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path, ignoreNullFields=False)
