"""The event log on disk."""

from newsflow import catalog

SF_DIR = "/root/testdata/sf0.001"


def test_days_of_the_log_are_pruned(spark):
    days = catalog.all_queries()["source_event_days"](spark, SF_DIR)
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert days.count() > 0
    whole = catalog.all_queries()["source_event_log"](spark, SF_DIR)
    assert whole.count() == spark.read.parquet(f"{SF_DIR}/events.parquet").count()
