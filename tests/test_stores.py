"""Stored job tables: batches are pruned, and jobs meet their results without a shuffle."""

import uuid

import pytest
from pyspark.sql import functions as F

from listingloom.operators import batches as B
from listingloom.plans.views import view
from listingloom.sources import stores

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def stored(spark):
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("jobs", "results")]
    jobs = stores.store_jobs(view(spark, FOLDER, "jobs"), names[0], buckets=4)
    results = stores.store_results(view(spark, FOLDER, "job_results"), names[1], buckets=4)
    yield jobs, results
    stores.drop_tables(spark, *names)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_prunes_the_others(spark, stored):
    jobs, _ = stored
    one = B.jobs_of_batch(jobs, "b7")
    assert "PartitionFilters: [isnotnull(batch_id" in plan(one)
    read = {p for p in one.inputFiles()}
    assert read and all("batch_id=b7" in p for p in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert one.count() == B.jobs_of_batch(view(spark, FOLDER, "jobs"), "b7").count() > 100


def test_results_join_without_an_exchange(spark, stored):
    jobs, results = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = B.job_result_rows(jobs, results)
        assert "SortMergeJoin" in plan(rows) and "Exchange" not in plan(rows)
        plain = B.job_result_rows(view(spark, FOLDER, "jobs"), view(spark, FOLDER, "job_results"))
        assert "Exchange" in plan(plain)
        columns = sorted(plain.columns)
        assert sorted(map(str, rows.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
