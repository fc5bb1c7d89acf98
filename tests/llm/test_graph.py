"""Connected components, by rounds and in one task."""

import numpy as np
import pytest

from lattica.llm import graph


def by_hand(edges):
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    while any(least[a] != least[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    return least


def cases():
    draw = np.random.default_rng(5)
    path = [(i, i + 1) for i in range(60)]
    return {"path": path, "far": [(-(1 << 62), 5), (5, 1 << 62), (7, 7), (5, 5)], "random": draw.integers(0, 150, (110, 2)).tolist(), "star": [(0, i) for i in range(1, 50)] + [(99, 98)]}


@pytest.mark.parametrize("edges", cases().values(), ids=cases())
def test_same_by_rounds_and_in_one_task(spark, monkeypatch, edges):
    df = spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long")
    found = []
    for most in (0, graph.TASK_EDGES):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        rows = [tuple(r) for r in graph.components(df).select("node", "component").collect()]
        found.append(dict(rows))
        assert len(rows) == len(found[-1])
    assert found[0] == found[1] == by_hand([tuple(map(int, e)) for e in edges])


def test_few_edges_take_few_jobs(spark):
    """What the driver keeps of each job adds up over the runs of a session: a long path was some hundred jobs."""
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    context.setJobGroup("few-edges", "components")
    graph.components(df).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("few-edges")) <= 12
