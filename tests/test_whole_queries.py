"""Queries over all their rows, against brute force on a small fixture."""

import random

import pytest

from faultspark.plans.registry import QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng, folder = random.Random(2), tmp_path_factory.mktemp("small")
    lines = [(o, rng.choice([50, rng.randint(1, 60)]), rng.randint(1, 5), rng.choice([1, k]), 1.0 * rng.randint(1, 50), rng.choice("RN")) for o in range(30) for k in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 71)], "p_partkey bigint").write.parquet(f"{folder}/part.parquet")
    return str(folder), lines


def chains(lines, order):
    out = []
    for o in {x[0] for x in lines}:
        rows = sorted((x for x in lines if x[0] == o), key=order)
        out += list(zip(rows, rows[1:]))
    return out


def test_components_of_all_links(spark, small):
    folder, lines = small
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in chains(lines, lambda x: (x[3], x[1], x[2], x[4])):
        if a[1] != b[1]:
            x, y = sorted((find(a[1]), find(b[1])))
            top[y] = x
    assert {tuple(r) for r in QUERIES["block_merge_components_all"](spark, folder).collect()} == {(x, find(x)) for x in list(top)}


def test_slices_of_all_starts(spark, small):
    folder, lines = small
    edges = {(max(a[1], b[1]), min(a[1], b[1]), int(b[5] == "R")) for a, b in chains(lines, lambda x: (x[3], x[1], x[2], x[5])) if a[1] != b[1]}
    seen = todo = {(k, 4) for k in range(1, 71)}
    while todo:
        todo = {(s, t - dt) for n, t in todo for d, s, dt in edges if d == n and t >= dt} - seen
        seen = seen | todo
    assert sorted(map(tuple, QUERIES["slice_timed_all"](spark, folder).collect())) == sorted(seen)
    assert sorted(r.node for r in QUERIES["slice_static_all"](spark, folder).collect()) == list(range(1, 71))
    got = {r.node for r in QUERIES["slice_scope_limited_all"](spark, folder).collect()}
    assert {k for k in range(2, 71, 2)} <= got <= set(range(1, 71))


def test_tied_signals_stay(spark, small):
    folder, lines = small
    drives = [(x[2], x[0] * 100 + x[3] * 10, x[1]) for x in lines] + [(x[1] + 1000000, x[0] * 100 + x[3] * 10 + 1, x[1]) for x in lines]
    want = {s: min((q, b) for t, q, b in drives if t == s)[1] for s in {d[0] for d in drives}}
    assert dict(map(tuple, QUERIES["nav_first_wins_ties"](spark, folder).collect())) == want
