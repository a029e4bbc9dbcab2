"""What the replicates' curves cost the driver: the draws are not repeated in the plan, the rows not broadcast."""

from __future__ import annotations

import pytest

from tidewright.operators import bootstrap


def _rows(spark):
    return spark.range(300).selectExpr("id", "cast(id % 3 = 0 as int) as y", "(id * 37 % 101) / 100.0 as score", "id div 6 as label_id")


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_draws_are_made_for_the_counts_only(spark):
    drawn = bootstrap.exact(_rows(spark), 5, "id")
    for found in (bootstrap.bootstrap_areas(drawn), bootstrap.bands(drawn, steps=11)):
        plan = _plan(found)
        assert "md5" not in plan and "boot-scores" in plan


def test_rows_are_not_broadcast_to_the_draws(spark):
    drawn = bootstrap.exact(_rows(spark), 5, "id")
    drawn.count()
    assert "BroadcastHashJoin" not in _plan(drawn) and "ShuffledHashJoin" in _plan(drawn)


@pytest.mark.parametrize("replicates", [1, 4])
def test_replicates_keep_all_draws(spark, replicates):
    rows = _rows(spark)
    drawn = bootstrap.exact(rows, replicates, "id")
    assert {(x["boot_id"], x["count"]) for x in drawn.groupBy("boot_id").count().collect()} == {(b, 300) for b in range(replicates)}
    want = bootstrap.draws(300, replicates, rows).groupBy("boot_id", "row_no").count().collect()
    got = drawn.groupBy("boot_id", "id").count().collect()  # ids are 0 to 299 in order, as row numbers are
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
