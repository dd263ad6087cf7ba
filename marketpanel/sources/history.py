"""Dated history: observations by month with a declared schema, and snapshots that are appended once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpanel.functions.text import row_hash
from marketpanel.operators.skew import content_digest
from marketpanel.schemas import OBSERVATION
from marketpanel.sources import versions
from marketpanel.sources.adapters import SourceSpec, with_default_provenance
from marketpanel.sources.sinks import overwrite_partitions

MONTH = "month"
# Columns that history got later; older partitions lack them and read as null.
PROVENANCE = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("source_role", T.StringType()),
    T.StructField("source_precedence", T.IntegerType()), T.StructField("dataset_semantics", T.StringType()),
])
HISTORY = T.StructType([*OBSERVATION.fields, *PROVENANCE.fields])


def write_history(rows: DataFrame, path: str) -> None:
    """Replace the months that `rows` has. Columns are those of HISTORY as far as there are any."""
    held = [c for c in HISTORY.fieldNames() if c in rows.columns]
    typed = [F.col(c).cast(HISTORY[c].dataType).alias(c) for c in held]
    overwrite_partitions(rows.select(*typed, F.trunc("transaction_date", "month").alias(MONTH)), path, MONTH)


def history_slice(spark: SparkSession, path: str, start: dt.date, end: dt.date, legacy: SourceSpec | None = None) -> DataFrame:
    """Observations from `start` to `end`, both included, under the declared schema.

    Files are not read for their schema. The months of the range are literals on the partition column, so other
    partitions are pruned while the scan is planned. Rows from before provenance columns get those of `legacy`.
    """
    schema = T.StructType([*HISTORY.fields, T.StructField(MONTH, T.DateType())])
    months = F.col(MONTH).between(F.lit(start.replace(day=1)), F.lit(end.replace(day=1)))
    rows = spark.read.schema(schema).parquet(path).filter(months & F.col("transaction_date").between(F.lit(start), F.lit(end))).drop(MONTH)
    return rows if legacy is None else with_default_provenance(rows, legacy)


class SnapshotChanged(ValueError):
    """A dated snapshot is stored with other content."""


def append_snapshot(rows: DataFrame, path: str, snapshot_date: dt.date, revise: bool = False) -> str:
    """Store the snapshot of a date once: "written", "unchanged" if the same set of rows is stored already (no byte is
    written), "revised" if other rows are stored and may be replaced; else SnapshotChanged. Sets are compared by a
    digest that does not depend on order. The revision before stays until `versions.vacuum`."""
    spark, day = rows.sparkSession, snapshot_date.isoformat()
    hashed = rows.select(row_hash(*[F.col(f"`{c}`") for c in sorted(rows.columns)]).alias("h"))
    found = content_digest(hashed, [], F.substring("h", 8, 64)).select("content_hash").first()
    digest = found.content_hash.rsplit(":", 1)[-1]
    stored = versions.version_of(spark, path, day)
    if stored is not None and stored.endswith(digest):
        return "unchanged"
    if stored is not None and not revise:
        raise SnapshotChanged(f"{path}: {day} is stored with other content")
    number = 0 if stored is None else int(stored.split("-")[3][1:]) + 1
    dated = rows.withColumn("snapshot_date", F.lit(day).cast("date"))
    touched = spark.range(1).select(F.lit(day).cast("date").alias("snapshot_date"))
    versions.commit(dated, path, f"{day}-r{number}-{digest}", "snapshot_date", touched)
    return "written" if stored is None else "revised"


def snapshots(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """All dated snapshots, by `snapshot_date`."""
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return versions.current(spark, path, "snapshot_date", T.StructType([*declared.fields, T.StructField("snapshot_date", T.DateType())]))
