"""Connected components: right on awkward edges, and few shuffles a round."""

import random

import pytest
from demospan.operators import components as K

from .llm.test_dedup import union_find


def graphs():
    rng = random.Random(2)
    mixed = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    return [[], [(1, 1), (None, 2), (3, None)], [(i, i + 1) for i in range(40)], [(500, i) for i in range(60)], [*mixed, *mixed, *[(b, a) for a, b in mixed]]]


@pytest.mark.parametrize("number", range(5))
def test_components_of_awkward_edges(spark, number):
    edges = graphs()[number]
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    got = sorted(map(tuple, K.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == sorted(union_find(sorted({x for e in real for x in e}), real).items())


def test_a_round_needs_no_job_of_its_own_to_see_its_end(spark, monkeypatch):
    context, plain, rounds = spark.sparkContext, K.cut_lineage, []

    def cut(df):
        rounds.append(1)
        return plain(df)

    monkeypatch.setattr(K, "cut_lineage", cut)
    context.setJobGroup("components", "components")
    try:
        K.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("components"))
    print("jobs", jobs, "rounds", len(rounds))
    assert jobs <= 7 * len(rounds)
