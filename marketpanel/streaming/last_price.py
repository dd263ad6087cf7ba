"""Previous valid price per item as a stateful operator, right under corrections and late days."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUTPUT = "canonical_id string, transaction_date date, price_u6 bigint, previous_date date, previous_u6 bigint, revision bigint"
_COLUMNS = [c.split()[0] for c in _OUTPUT.split(", ")]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def affected(days: list, prices: dict, day) -> list:
    """The days whose row changes with the price of `day`: itself and those after it up to the next valid one."""
    at = bisect_left(days, day)
    out = [days[at]]
    for later in days[at + 1:]:
        out.append(later)
        if prices[later] is not None:
            break
    return out


def previous_valid(days: list, prices: dict, day) -> tuple:
    for at in range(bisect_left(days, day) - 1, -1, -1):
        if prices[days[at]] is not None:
            return days[at], prices[days[at]]
    return None, None


class PriceHistory(StatefulProcessor):
    """State is the price of each day of an item, null for a day without a valid one. Rows come in any order, a later
    one of the same day corrects it; what a row changes is sent again: its own day and its followers up to the next
    valid day. A hot item has one entry a day, not its transactions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prices = handle.getMapState("prices", "day date", "price_u6 bigint")
        self.revision = handle.getValueState("revision", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        prices = {k[0]: v[0] for k, v in self.prices.iterator()} if self.prices.exists() else {}
        revision = (self.revision.get()[0] if self.revision.exists() else 0) + 1
        days, changed = sorted(prices), set()
        for frame in rows:
            for day, price in zip(frame["transaction_date"], frame["price_u6"]):
                price = None if pd.isna(price) else int(price)
                if day not in prices:
                    days.insert(bisect_right(days, day), day)
                elif prices[day] == price:
                    continue
                prices[day] = price
                self.prices.updateValue((day,), (price,))
                changed.update(affected(days, prices, day))
        self.revision.update((revision,))
        out = [(key[0], day, prices[day], *previous_valid(days, prices, day), revision) for day in sorted(changed)]
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"price_u6": "Int64", "previous_u6": "Int64"})

    def close(self) -> None:
        pass


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that keeps stream state on disk; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def previous_price_stream(daily: DataFrame, path: str, checkpoint: str):
    """`daily` is a stream of (canonical_id, transaction_date, price_u6), of a `stateful_session`. Each batch appends
    the rows that it changes."""
    out = daily.groupBy("canonical_id").transformWithStateInPandas(
        statefulProcessor=PriceHistory(), outputStructType=_OUTPUT, outputMode="Append", timeMode="None"
    )
    return (
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def previous_prices(spark: SparkSession, path: str) -> DataFrame:
    """The rows that count now: of each item and day the latest revision."""
    fields = [c for c in _COLUMNS if c not in ("canonical_id", "transaction_date")]
    newest = spark.read.parquet(path).groupBy("canonical_id", "transaction_date").agg(F.max_by(F.struct(*fields), "revision").alias("r"))
    return newest.select("canonical_id", "transaction_date", "r.price_u6", "r.previous_date", "r.previous_u6")
