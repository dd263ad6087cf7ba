"""What the facts take along through exchanges, whatever the size of the tables beside them."""

import re

from pyspark.sql import functions as F

from marketpanel.operators import scope
from marketpanel.plans import contracts as contract_plans
from marketpanel.plans import ingest
from marketpanel.plans import scope as scope_plans
from marketpanel.plans import streams as stream_plans
from marketpanel.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def _plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_facts_are_exchanged_once_and_not_sorted(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # The part table is beyond the threshold, the supplier table is not.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        plan = _plan(Tables(spark, SF).observations)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert "hashpartitioning(l_partkey" in plan and "hashpartitioning(l_suppkey" not in plan


def test_cells_are_hashed_without_a_sort(spark):
    plan = _plan(scope.grid_cells(scope_plans.checked(Tables(spark, SF))))
    assert re.search(r"HashAggregate\(keys=\[transaction_date#\d+, market_code", plan)
    assert not re.search(r"SortAggregate\(key=\[transaction_date#\d+, market_code", plan)


def test_days_of_manifests_do_not_exchange_the_facts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        plan = _plan(scope_plans.checked(Tables(spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [transaction_date" in plan and "SortMergeJoin [transaction_date" not in plan


def test_cells_keep_the_row_of_the_lowest_price_and_volume(spark):
    most = 2**63 - 2
    rows = spark.createDataFrame([
        (1, 5, 9, "n", "a", None), (1, 5, 7, "n", "a", None), (1, 4, 1, "n", "a", "fixture"), (1, 6, 0, "n", "a", None),
        (2, most, most, "n", "a", None), (3, 0, 0, "n", "a", None), (3, 0, 0, "n", "a", None), (4, 1, 1, "n", "a", "provenance_unknown"),
        (5, 2, 2, None, "n", None), (5, 2, 2, "n", None, None), (6, None, 3, "n", "a", None), (6, 1, 1, "n", "a", None),
    ], "market_code int, price_c bigint, volume_c bigint, crop_name_raw string, canonical_id string, reason string")
    cells = scope.grid_cells(rows.withColumns({"transaction_date": F.lit("2024-01-01").cast("date"), "crop_code": F.lit("c"), "source_id": F.lit("s")}))
    assert {r.market_code: (r.price_c, r.volume_c, r.has_conflict, r.has_unknown) for r in cells.collect()} == {
        1: (5, 7, True, False), 2: (most, most, False, False), 3: (0, 0, False, False), 4: (None, None, False, True), 5: (2, 2, True, False),
        6: (None, 3, True, False)}


def test_hashes_of_upserted_rows_are_made_after_the_exchanges(spark):
    plan = _plan(ingest.upsert(Tables(spark, SF)))
    last = plan[:plan.index("Exchange")]
    assert "sha2(" in last and "sha2(" not in plan[len(last):]


def test_run_documents_write_no_hashes_of_rows(spark, monkeypatch):
    written = {}
    kept = contract_plans.materialize
    monkeypatch.setattr(contract_plans, "materialize", lambda rows, name: written.setdefault(name, kept(rows, name)))
    contract_plans._documents(Tables(spark, SF))
    assert "row_hash" not in written["run-feed"].columns
    assert all("observation_id" not in rows.columns for rows in written.values())


def test_a_stream_of_many_files_is_taken_in_by_two_batches(spark, monkeypatch):
    batches = []
    merge = stream_plans.resolution.merge_resolution
    monkeypatch.setattr(stream_plans.resolution, "merge_resolution", lambda rows, path, name: (batches.append(name), merge(rows, path, name)))
    # As many files a part as a larger table has.
    monkeypatch.setattr(stream_plans, "materialize", lambda rows, name: rows.repartition(4))
    stream_plans.stream_resolve(Tables(spark, SF))
    assert len(batches) == 2
