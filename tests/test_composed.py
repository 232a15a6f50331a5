"""Days composed of the hours that have rows, without a list of those that have none."""

from pyspark.sql import functions as F

from strandline.operators import strategy


def test_hours_without_rows_count_by_the_length_of_the_day(spark):
    hour, day = 3_600_000_000, 23 * 3_600_000_000
    rows = [(1, 0, 0, 20.0, None, 1.0), (1, 0, 2, 5.0, "implausible", 0.5), (1, 3, 2, 30.0, None, 1.0), (2, 4, 1, 1.0, "implausible", 0.5)]
    df = spark.createDataFrame([(*r, hour, day) for r in rows], "owner int, hour long, pos int, value double, reason string, coverage double, elapsed long, day long")
    out = strategy.compose(df, ["owner"], 3)
    got = {(r.owner, r.pos): (r.group_status, r.group_value, round(r.group_coverage * 23, 9), r.supplied, r.value, r.hours, r.groups, r.selected, r.status, r.exceeds) for r in out.collect()}
    one = (50.0, 2, 2, None, "calculated", True)
    none = (None, 0, 0, None, "no_data", False)
    assert got == {
        (1, 0): ("selected", 20.0, 1.0, True, *one), (1, 1): ("no_data", None, 0.0, False, *one), (1, 2): ("selected", 30.0, 1.5, True, *one),
        (2, 0): ("no_data", None, 0.0, False, *none), (2, 1): ("below_quality", None, 0.5, False, *none), (2, 2): ("no_data", None, 0.0, False, *none),
    }


def test_composing_shuffles_no_more_rows_than_there_are(spark):
    from strandline.plans import resolution

    plan = resolution.composed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # the hours that groups lack were a table to join with
