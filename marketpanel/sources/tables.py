"""The given tables and the bindings which read them as market feeds."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.functions.numeric import int_div

SEMANTICS = "wholesale_market_daily_transaction"

# Fixed values of the test binding: months in which an item is in season; one item has no entry.
SEASON_MONTHS = {
    "ECONOMY": (1, 2, 3, 4, 11, 12),
    "LARGE": (5, 6, 7, 8, 9),
    "SMALL": (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12),
    "STANDARD": (3, 4, 5, 9, 10, 11),
}

# Fixed values of the test binding: the item dimension
# (id, display name, category, enabled, crop codes, season names, aliases, registry names).
ITEMS = (
    ("ring", "MACHINERY", "fruit", True, tuple(f"Brand#{i}" for i in range(1, 9)) + ("E1", "E2", "E3"),
     ("small ring", "red ring"), ("HOUSEHOLD",), ("click",)),
    ("bolt", "FURNITURE", "vegetable", True, tuple(f"Brand#{i}" for i in range(9, 16)) + ("E4", "E5"),
     ("blue bolt", "small bolt"), (), ("view", "purchase")),
    ("gear", "BUILDING", "vegetable", False, tuple(f"Brand#{i}" for i in range(16, 19)) + ("E9",),
     ("red gear",), (), ()),
)


def _array(values) -> str:
    inner = ", ".join(f"'{v}'" for v in values)
    return f"array({inner})" if values else "CAST(array() AS array<string>)"


class Tables:
    """Lazy readers of one data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def observations(self) -> DataFrame:
        return observations(self.read("lineitem"), self.read("part"), self.read("supplier"))

    @cached_property
    def feed(self) -> DataFrame:
        return feed(self.observations)

    @cached_property
    def items(self) -> DataFrame:
        rows = ", ".join(
            f"('{i}', '{name}', '{category}', {str(on).lower()}, {_array(codes)}, {_array(seasons)}, "
            f"{_array(aliases)}, {_array(traces)})"
            for i, name, category, on, codes, seasons, aliases, traces in ITEMS
        )
        return self.spark.sql(
            f"SELECT * FROM VALUES {rows} AS t(canonical_id, display_name, category, enabled, "
            "market_crop_codes, seasonality_names, aliases, traceability_names)"
        )

    @cached_property
    def raw_market(self) -> DataFrame:
        return raw_market(self.observations)

    @cached_property
    def seasons(self) -> DataFrame:
        rows = ", ".join(
            f"('{item}', array({', '.join(map(str, months))}))" for item, months in SEASON_MONTHS.items()
        )
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(canonical_id, months)")


def _units(price: Column, quantity: Column) -> Column:
    return int_div(F.round(price * 100).cast("bigint"), quantity.cast("bigint"))


def observations(lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    """Line items as market observations: brand is the crop code, part type the item, nation of the
    supplier the market. Some rows have zero price or volume or carry a test-data mark.

    Facts are exchanged once, by the part, at any size of the tables: all that a line item says is put into narrow
    columns before, and texts are made of them after. The parts of a task are hashed, so the facts are not sorted.
    """
    quantity = F.col("l_quantity")
    facts = lineitem.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("_day"), "s_nationkey",
        F.when((F.col("l_returnflag") == "A") & (quantity == 2), F.lit(0).cast("bigint"))
        .otherwise(_units(F.col("l_extendedprice"), quantity)).alias("_price"),
        F.when((F.col("l_returnflag") == "R") & (quantity == 1), F.lit(0).cast("bigint"))
        .otherwise(quantity.cast("bigint") * 100).alias("_volume"),
        (F.col("l_discount") == 0.1).alias("_marked"),
        F.when(F.col("l_linestatus") == "F", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("_role"),
    )
    return (
        facts.join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("batch_no"),
            F.col("l_linenumber").alias("page_no"),
            F.col("l_partkey").alias("row_a"),
            F.col("l_suppkey").alias("row_b"),
            F.col("_day").alias("transaction_date"),
            F.col("s_nationkey").alias("market_code"),
            F.col("p_brand").alias("crop_code"),
            F.col("p_name").alias("crop_name_raw"),
            F.nullif(F.col("p_type"), F.lit("PROMO")).alias("canonical_id"),
            F.col("_price").alias("price_c"),
            F.col("_volume").alias("volume_c"),
            F.when(F.col("_marked"), " Fixture ").otherwise("2002-01-01T00:00:00Z").alias("fetched_at"),
            F.when(F.col("l_linenumber") < 7, "success").alias("source_status"),
            F.when(F.col("_role") == 0, "authoritative_final").when(F.col("_role") == 1, "provisional")
            .otherwise("validation").alias("source_role"),
            F.concat(F.lit("src_"), (F.col("l_suppkey") % 4).cast("string")).alias("source_id"),
            F.when(F.col("l_suppkey") % 4 == 3, 20).otherwise(10).alias("source_precedence"),
        )
    )


ARRIVAL = ("batch_no", "page_no", "row_a", "row_b")
IDENTITY = ("transaction_date", "market_code", "crop_code", "dataset_semantics")


def feed(observations: DataFrame) -> DataFrame:
    """Observations keyed by month, so that one economic identity arrives several times, with a
    business hash which often stays equal from one arrival to the next."""
    from marketpanel.functions.text import row_hash

    level = int_div(F.col("price_c"), F.lit(50000).cast("bigint"))
    month = F.trunc("transaction_date", "month")
    keyed = observations.select(
        *ARRIVAL,
        F.col("transaction_date").alias("observed_on"),
        month.alias("transaction_date"),
        "market_code", "crop_code", F.lit(SEMANTICS).alias("dataset_semantics"), "canonical_id",
        "price_c", "volume_c", "source_role", "source_id", "source_precedence",
        level.alias("level"),
    )
    return keyed.withColumn("row_hash", row_hash(*[F.col(c) for c in (*IDENTITY, "level")]))


def _decimal_text(units: Column) -> Column:
    whole, rest = int_div(units, F.lit(100).cast("bigint")), units % 100
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 2, "0"))


def raw_market(observations: DataFrame) -> DataFrame:
    """Observations as landed text: era dates, padded codes, decimal text, some broken cells."""
    from marketpanel.functions.dates import to_era_text

    broken = F.col("row_a") % 97
    return observations.select(
        *ARRIVAL,
        F.when(broken == 1, "115.02.30").otherwise(to_era_text(F.col("transaction_date"))).alias("trade_date"),
        F.concat(F.lit(" "), F.col("crop_code")).alias("crop_code"),
        F.col("crop_name_raw").alias("crop_name"),
        F.when(broken == 6, "").otherwise(F.col("market_code").cast("string")).alias("market_code"),
        F.concat(F.lit(" market "), F.col("market_code").cast("string")).alias("market_name"),
        F.when(F.col("row_b") % 3 != 0, F.concat(F.lit("N0"), (F.col("row_b") % 3).cast("string"))).alias("category_code"),
        _decimal_text(F.col("price_c") + 100).alias("high_price"),
        F.when(F.col("row_a") % 11 != 0, _decimal_text(F.col("price_c"))).alias("mid_price"),
        F.when(broken == 5, "x").otherwise(_decimal_text(int_div(F.col("price_c"), F.lit(2).cast("bigint")))).alias("low_price"),
        "fetched_at",
        # A third decimal on every fifth row, beside small and large prices.
        F.when(broken == 2, "NaN").when(broken == 3, "-1")
        .otherwise(F.concat(_decimal_text(F.col("price_c")), F.when(F.col("row_a") % 5 == 0, "5").otherwise(""))).alias("avg_price"),
        F.when(broken == 4, "12d").otherwise(_decimal_text(F.col("volume_c"))).alias("volume"),
        "source_id",
    )
