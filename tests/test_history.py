import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketpanel.sources import history, sinks, versions
from marketpanel.sources.adapters import SourceSpec

SPEC = SourceSpec("s", "https://feed.example", "authoritative_final", "daily", 10, "1.0", "v1")


def observations(spark, days, **more):
    rows = spark.createDataFrame([(dt.date(2026, 1, 1) + dt.timedelta(days=d), 1, "c", d) for d in days], "transaction_date date, market_code int, crop_code string, price_c bigint")
    return rows.withColumns({k: F.lit(v) for k, v in more.items()})


def test_a_slice_reads_its_months_under_the_declared_schema(spark, tmp_path):
    path = str(tmp_path / "h")
    history.write_history(observations(spark, range(0, 31), source_id="s"), path)  # January, before there were roles
    history.write_history(observations(spark, range(31, 120), source_id="s", source_role="provisional", source_precedence=5, dataset_semantics="daily"), path)
    out = history.history_slice(spark, path, dt.date(2026, 1, 30), dt.date(2026, 2, 2), SPEC)
    plan = out._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "month" in pruned and "2026-01-01" in pruned and "2026-02-01" in pruned
    assert {f.split("month=")[1].split("/")[0] for f in history.history_slice(spark, path, dt.date(2026, 1, 30), dt.date(2026, 2, 2)).inputFiles()} <= {"2026-01-01", "2026-02-01", "2026-03-01", "2026-04-01"}
    rows = {r.transaction_date.isoformat(): (r.source_role, r.source_precedence, r.volume_c) for r in out.collect()}
    assert rows == {"2026-01-30": ("authoritative_final", 10, None), "2026-01-31": ("authoritative_final", 10, None), "2026-02-01": ("provisional", 5, None), "2026-02-02": ("provisional", 5, None)}
    # A month written again replaces that month alone.
    history.write_history(observations(spark, [3], source_id="t"), path)
    assert history.history_slice(spark, path, dt.date(2026, 1, 1), dt.date(2026, 12, 31)).count() == 90


def test_snapshots_are_appended_once(spark, tmp_path):
    path, day = str(tmp_path / "s"), dt.date(2026, 8, 1)
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert history.append_snapshot(rows, path, day) == "written"
    before = sinks.folders(spark, f"{path}/rows"), versions.last_commit(spark, path)
    assert history.append_snapshot(rows.orderBy(F.desc("k")), path, day) == "unchanged"
    assert (sinks.folders(spark, f"{path}/rows"), versions.last_commit(spark, path)) == before
    with pytest.raises(history.SnapshotChanged):
        history.append_snapshot(rows.distinct(), path, day)
    assert history.append_snapshot(rows.distinct(), path, day, revise=True) == "revised"
    assert history.append_snapshot(rows, path, day, revise=True) == "revised"  # back to the first content is a revision, too
    assert history.append_snapshot(rows.limit(0), path, dt.date(2026, 8, 2)) == "written"
    held = history.snapshots(spark, path, "k int, v string")
    assert sorted((str(r.snapshot_date), r.k) for r in held.collect()) == [("2026-08-01", 1), ("2026-08-01", 2), ("2026-08-01", 2)]
    assert versions.version_of(spark, path, "2026-08-01").startswith("2026-08-01-r2-")
