"""Query registry and the publishing rules shared by all registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpanel.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def publish(df: DataFrame) -> DataFrame:
    """Plain published types: whole numbers BIGINT, dates as text, lists joined by a bar."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(kind, T.DecimalType):
            c = c.cast("bigint") if kind.scale == 0 else c.cast("double")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, "|")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, oracle: str | None = None):
    def register(job: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: publish(job(Tables(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = oracle
        return job

    return register
