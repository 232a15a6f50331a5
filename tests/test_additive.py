"""Additive days are shuffled once, before their rows are cut into buckets."""

from strandline.operators import within
from strandline.sources.tables import measurements


def test_one_shuffle_serves_all_aggregations(spark):
    m = measurements(spark, "/root/testdata/sf0.001")
    plan = within.additive(m.withColumn("pos", m.owner % 2), ["owner", "local_date", "pos"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")
