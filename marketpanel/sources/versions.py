"""Tables whose partitions are replaced as a whole, by versions behind a pointer.

A commit writes the new versions of the partitions that it touches into a folder of its own, then a pointer table
that names them; the pointers count once that table is complete. Rows of another version are never changed, so a
reader sees each commit whole or not at all, a crash leaves the table as it was, and a commit that ran before (a
replayed batch) is known by its name. A table has one writer at a time; a second one is refused at its commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpanel.sources.sinks import folders, is_complete, only_touched, overwrite_folder, remove_folder

VERSION = "written_by"
_POINTERS = "commit string, seq bigint, value string, is_mark boolean"
# Pointer folders that are folded into one once there are more.
FOLD_BEYOND = 50


class ConcurrentWriter(RuntimeError):
    """Another writer has committed since this one read the table."""


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    complete = [f for f in folders(spark, f"{path}/commits") if is_complete(spark, f)]
    return spark.read.schema(_POINTERS).parquet(*complete) if complete else None


def _newest(pointers: DataFrame) -> DataFrame:
    """(value, commit): the version of each partition that counts."""
    return pointers.filter("NOT is_mark").groupBy("value").agg(F.max_by("commit", "seq").alias("commit"))


def _last(pointers: DataFrame | None) -> int:
    return 0 if pointers is None else pointers.agg(F.max("seq")).first()[0] or 0


def committed(spark: SparkSession, path: str, name: str) -> bool:
    held = _pointers(spark, path)
    return held is not None and not held.filter(F.col("commit") == name).isEmpty()


def current(spark: SparkSession, path: str, partition: str, schema: T.StructType | str | None = None, touched: DataFrame | None = None) -> DataFrame | None:
    """The rows that count, or None before the first commit; only those of the partitions that `touched` has, if given.

    With a `schema`, its columns are read as declared; one that older versions lack is null in them.
    """
    held = _pointers(spark, path)
    if held is None:
        return None
    reader = spark.read
    if schema is not None:
        declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        reader = reader.schema(T.StructType([*declared.fields, T.StructField(VERSION, T.StringType())]))
    rows = reader.parquet(f"{path}/rows")
    if touched is not None:
        rows = only_touched(rows, touched, partition)
    newest = _newest(held)
    of_version = (rows[VERSION] == newest["commit"]) & rows[partition].cast("string").eqNullSafe(newest["value"])
    return rows.join(newest, of_version, "left_semi").drop(VERSION)


def commit(rows: DataFrame, path: str, name: str, partition: str, touched: DataFrame, seen: int | None = None) -> None:
    """Replace the partitions that `touched` has by those of `rows`, as commit `name`.

    A partition without rows becomes empty. `seen` is what `last_commit` gave before the table was read; if another
    commit has come since, nothing is changed. A name that is committed already does nothing.
    """
    spark = rows.sparkSession
    if committed(spark, path, name):
        return
    before = _last(_pointers(spark, path)) if seen is None else seen
    overwrite_folder(rows, f"{path}/rows/{VERSION}={name}", partition)
    values = touched.select(F.col(partition).cast("string").alias("value")).distinct().withColumn("is_mark", F.lit(False))
    mark = spark.range(1).select(F.lit(None).cast("string").alias("value"), F.lit(True).alias("is_mark"))
    held = _pointers(spark, path)
    if _last(held) != before:
        raise ConcurrentWriter(f"{path}: commit {_last(held)} came after {before}")
    pointers = values.unionByName(mark).select(F.lit(name).alias("commit"), F.lit(before + 1).cast("bigint").alias("seq"), "value", "is_mark")
    pointers.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{before + 1}")
    if len(folders(spark, f"{path}/commits")) > FOLD_BEYOND:
        fold(spark, path)


def version_of(spark: SparkSession, path: str, value: str | None) -> str | None:
    """Name of the commit whose rows of a partition count, or None."""
    held = _pointers(spark, path)
    found = None if held is None else _newest(held).filter(F.col("value").eqNullSafe(F.lit(value))).first()
    return None if found is None else found.commit


def last_commit(spark: SparkSession, path: str) -> int:
    return _last(_pointers(spark, path))


def fold(spark: SparkSession, path: str) -> None:
    """All pointers that count, and the names of all commits, in one folder. A crash in between leaves pointers twice,
    which does no harm."""
    held = _pointers(spark, path)
    if held is None:
        return
    last, old = _last(held), folders(spark, f"{path}/commits")
    newest = _newest(held).select(F.col("value").alias("_value"), F.col("commit").alias("_commit"))
    counts = (held["commit"] == newest["_commit"]) & held["value"].eqNullSafe(newest["_value"])
    kept = held.filter("NOT is_mark").join(newest, counts, "left_semi").unionByName(held.filter("is_mark")).distinct()
    target = f"{path}/commits/{last}-all"
    if not is_complete(spark, target):
        kept.coalesce(1).write.mode("overwrite").parquet(target)
    for folder in old:
        if folder != target:
            remove_folder(spark, folder)


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the folders of commits of which no partition counts any more; returns how many. Not while others read."""
    held = _pointers(spark, path)
    if held is None:
        return 0
    wanted = {f"{path}/rows/{VERSION}={row.commit}" for row in _newest(held).select("commit").distinct().collect()}
    gone = [f for f in folders(spark, f"{path}/rows") if f not in wanted]
    for folder in gone:
        remove_folder(spark, folder)
    return len(gone)
