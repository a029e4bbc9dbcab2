"""Model queries read segments that were written once; no fit or score makes them again."""

from __future__ import annotations

import pytest

from tidewright.plans import queries

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["gbt_scores", "baseline_calibrated", "calibrated_ensemble", "tree_attributions"])
def test_scores_come_from_written_segments(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_inputs_are_the_segments_with_folds(spark, monkeypatch):
    """What is written is what the lazy plan has."""
    got = queries._inputs(spark, SMALL)
    monkeypatch.setattr(queries, "staged", lambda df, name: df)
    want = queries._inputs(spark, SMALL)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
