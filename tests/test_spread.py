"""Payloads made of a small file are parsed by all cores, and once."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import normalize as nz
from strandline.plans import normalize_queries
from strandline.sources.tables import spread

SF = "/root/testdata/sf0.001"


def test_parts_grow_with_the_rows_and_lose_none(spark):
    df = spark.range(1000).coalesce(1)
    assert spread(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = spread(df, "id", rows=10)
    assert got.rdd.getNumPartitions() == 100 and got.agg(F.sum("id"), F.count("*")).first() == (499500, 1000)
    assert spread(df.limit(0), "id").count() == 0


def test_payloads_are_spread(spark):
    assert normalize_queries.scale(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("parse", [nz.scale_measures, nz.sleep_record, nz.watch_activities])
def test_a_body_is_parsed_once(spark, parse):
    raw = spark.createDataFrame([(1, "{}"), (2, None), (3, "{broken")], "raw_id long, body string")
    df = parse(raw)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1 and df.count() == 0
