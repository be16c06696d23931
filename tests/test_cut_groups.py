"""Queries with every group cut into blocks of a few rows must still equal their SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from demospan.operators import ordered

DIR = "/root/testdata/sf0.001"
NAMES = ["streaks", "gripper_machine", "done_prefix", "arc_length", "step_deltas", "norm_stats", "compress_runs", "replan_points", "segment_contiguity_violations", "block_splits"]


@pytest.mark.parametrize("name", NAMES)
def test_cut_groups_change_nothing(spark, monkeypatch, name):
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", 3)
    assert compare(spark, connect(DIR), DIR, name, entry.queries()[name], entry.oracle_sql()[name]) is None
