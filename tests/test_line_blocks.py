"""block_by_line against brute force, with little room for broadcasts."""

import random

import pytest

from faultspark.operators import spectrum
from faultspark.plans.registry import QUERIES


@pytest.fixture
def little_room(spark):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64k")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_lines_of_blocks_are_not_broadcast(spark, tmp_path, little_room):
    rng = random.Random(4)
    parts = [(k, rng.randint(1, 50)) for k in range(1000)]
    lines = [(rng.randrange(1100),) for _ in range(2000)]
    spark.createDataFrame(parts, "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    held = {x: [p for p, size in parts if p % 10 == x % 10 and p <= x <= p + size] for (x,) in lines}
    assert sorted(map(tuple, QUERIES["block_by_line"](spark, str(tmp_path)).collect())) == sorted((x, min(p)) for x, p in held.items() if p)


def test_block_that_ends_before_it_begins(spark):
    blocks = spark.createDataFrame([(1, 0, 9, 5), (2, 0, 5, 7), (3, 0, 7, 7), (4, 0, None, 8)], "bid int, scope int, lo bigint, hi bigint")
    lines = spark.createDataFrame([(0, x) for x in (4, 5, 7, 8, 9, None)], "scope int, line bigint")
    assert sorted((r.line, r.bid) for r in spectrum.lines_to_blocks(lines, blocks).collect()) == [(5, 2), (7, 2)]
