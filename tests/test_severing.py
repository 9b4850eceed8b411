"""Severing: components cut in a task against the rounds of joins, and how many jobs it takes."""

from __future__ import annotations

import random
import uuid

import pytest

from lamella.operators import graph as G


def cut_by_rounds(nodes, edges, most):
    """The definition: search, cut the lightest edges of every long component, search again. Limits by node."""
    at = dict(nodes)
    done, open_ = {}, [(set(at), edges)]
    while open_:
        inside, lines = open_.pop()
        name = {v: v for v in inside}
        while True:
            before = dict(name)
            for a, b, _ in lines:
                name[a] = name[b] = min(name[a], name[b])
            if before == name:
                break
        for c in set(name.values()):
            own = {v for v in inside if name[v] == c}
            inner = [e for e in lines if e[0] in own]
            span = max(at[v] for v in own) - min(at[v] for v in own) + 1
            if span <= max(most[v] for v in own) or not inner:
                done |= dict.fromkeys(own, c)
            else:
                least = min((w for *_, w in inner if w is not None), default=None)
                open_.append((own, [e for e in inner if least is not None and e[2] is not None and e[2] > least]))
    return done


def drawn(seed, n=24, lines=34):
    rng = random.Random(seed)
    nodes = [(v, rng.randrange(9)) for v in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice([None, 0.5, 1.0, 1.0, 2.0, 2.0, 3.0, 7.0])) for _ in range(lines)]
    return nodes, edges, {v: rng.choice([1, 2, 3, 5]) for v in range(n)}


@pytest.mark.parametrize("first", range(0, 400, 100))
def test_pieces_follow_the_definition(first):
    for seed in range(first, first + 100):
        nodes, edges, most = drawn(seed)
        want = cut_by_rounds(nodes, edges, most)
        whole = cut_by_rounds(nodes, edges, dict.fromkeys(most, 100))
        for c in set(whole.values()):
            own = [v for v in whole if whole[v] == c]
            inner = [e for e in edges if whole[e[0]] == c]
            got = G._pieces(own, [dict(nodes)[v] for v in own], [most[v] for v in own], *([e[k] for e in inner] for k in range(3)))
            assert dict(zip(own, got)) == {v: want[v] for v in own}, seed


@pytest.mark.parametrize("whole", [0, 32_768])
def test_severing_in_tasks_and_by_rounds(spark, monkeypatch, whole):
    """No component or every one of them is cut in a task."""
    monkeypatch.setattr(G, "WHOLE", whole)
    nodes, most = [(v, v) for v in range(6)], dict.fromkeys(range(6), 3)
    edges = [(v, v + 1, w) for v, w in enumerate([2.0, None, 1.0, 2.0, 3.0])]
    got = G.sever_components(spark.createDataFrame([(v, z, str(most[v])) for v, z in nodes], "node long, z int, channel string"), spark.createDataFrame(edges, "a long, b long, weight double"), {str(m): m for m in set(most.values())})
    assert {r.node: r.component for r in got.collect()} == cut_by_rounds(nodes, edges, most)


def test_many_cuts_take_few_jobs(spark):
    """A chain whose weights all differ is cut once a weight; by rounds of joins that were hundreds of jobs."""
    nodes = spark.createDataFrame([(v, v) for v in range(40)], "node long, z int")
    edges = spark.createDataFrame([(v, v + 1, v) for v in range(39)], "a long, b long, weight long")
    spark.sparkContext.setJobGroup("severing", "severing")
    got = {r.node: r.component for r in G.sever_components(nodes, edges, 3).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("severing"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {v: min(v, 37) for v in range(40)}
    assert jobs < 150, jobs


def test_dense_ids_work_labels_out_once(spark):
    """Labels that differ each time they are worked out still meet their own ids."""

    def named(frames):
        for frame in frames:
            yield frame.assign(component=[uuid.uuid4().int >> 65 for _ in range(len(frame))])

    labels = spark.range(40).selectExpr("id % 2 AS core", "id AS node").mapInPandas(named, "core long, node long, component long")
    got = sorted((r.core, r.cell_id_3d, r.node) for r in G.assign_cell_ids(labels).collect())
    assert got == [(core, i + 1, 2 * i + core) for core in (0, 1) for i in range(20)]
