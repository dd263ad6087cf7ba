import datetime as dt
import random

from marketpanel.streaming import last_price

DAY = dt.date(2026, 8, 1)
SCHEMA = "canonical_id string, transaction_date date, price_u6 bigint"


def expected(rows):
    """Previous valid price of each item and day, from the last row of each."""
    now = {}
    for item, day, price in rows:
        now[item, day] = price
    out = {}
    for item, day in now:
        before = [(d, p) for (i, d), p in now.items() if i == item and d < day and p is not None]
        out[item, day] = (now[item, day], *max(before, default=(None, None)))
    return out


def test_late_days_and_corrections_repair_their_followers(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), DAY + dt.timedelta(days=rng.randrange(25)), rng.choice([None, *range(5)])) for _ in range(160)]
    own = last_price.stateful_session(spark)
    for k in range(4):
        part = rows[k * 40:k * 40 + 40]
        last = list({(i, d): (i, d, p) for i, d, p in part}.values())  # one row a day and batch, as in the daily table
        spark.createDataFrame(last, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = own.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        last_price.previous_price_stream(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        got = {(r.canonical_id, r.transaction_date): (r.price_u6, r.previous_date, r.previous_u6) for r in last_price.previous_prices(spark, str(tmp_path / "t")).collect()}
        assert got == expected(rows[:k * 40 + 40])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != last_price.STATE_STORE


def test_a_price_changes_its_followers_up_to_the_next_valid_day():
    days, prices = [1, 2, 3, 4, 5], {1: 9, 2: None, 3: None, 4: 7, 5: 8}
    assert last_price.affected(days, prices, 2) == [2, 3, 4] and last_price.affected(days, prices, 5) == [5]
    assert last_price.previous_valid(days, prices, 4) == (1, 9) and last_price.previous_valid(days, prices, 1) == (None, None)
