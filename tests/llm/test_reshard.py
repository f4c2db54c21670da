import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from broadloom.llm.reshard import assign_blocks, reshard, transfer_plan
from broadloom.session import new_path


def test_plan_moves_the_least():
    rng = random.Random(1)
    for _ in range(50):
        n, m = rng.randrange(1, 6), rng.randrange(1, 7)
        supply = [rng.randrange(0, 100) for _ in range(n)]
        total = sum(supply)
        capacity = [total // m + (j < total % m) for j in range(m)]
        plan = transfer_plan(supply, capacity)
        assert [sum(f for (i, _), f in plan.items() if i == k) for k in range(n)] == supply
        assert all(sum(f for (_, j), f in plan.items() if j == k) <= capacity[k] for k in range(m))
        stay = sum(min(supply[k], capacity[k]) for k in range(min(n, m)))
        assert sum(f for (i, j), f in plan.items() if i != j) == total - stay


def test_plan_with_costs_against_all_assignments():
    price = {(0, 0): 0, (0, 1): 5, (0, 2): 1, (1, 0): 2, (1, 1): 0, (1, 2): 4}
    plan = transfer_plan([2, 3], [1, 1, 3], lambda i, j: price[i, j])
    assert sum(f * price[k] for k, f in plan.items()) == 2 * 1 + 1 * 2 + 1 * 0 + 1 * 4
    with pytest.raises(ValueError):
        transfer_plan([5], [4])


def test_blocks_follow_the_plan():
    out = assign_blocks([(0, b, 10) for b in range(10)], {(0, 0): 40, (0, 1): 60})
    assert Counter(j for _, _, j in out) == {0: 4, 1: 6}


def test_rows_files_and_slots(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(0, 300), "hot" if i % 3 == 0 else f"s{i % 11}", "a") for i in range(600)]
    rows += [(None, None, None, "b"), (5, "again", "hot", "c"), (5, "again", "hot", "c"), (700, "z" * 2000, "hot", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, shard string")
    out = reshard(df, F.pmod(F.xxhash64("source"), F.lit(5)), 5, 6, new_path(spark, "t"), rows_per_file=50)
    got = out.rows.collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in got), key=repr) == sorted((r[:3] for r in rows), key=repr)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2500
    assert spark.read.parquet(out.path).count() <= len(rows) and set(out.rewritten) <= set(range(6))


def test_nothing_to_do_and_empty(spark):
    df = spark.createDataFrame([(i, "same") for i in range(8)], "doc_id bigint, text string")
    out = reshard(df, F.pmod("doc_id", F.lit(2)), 2, 2, new_path(spark, "t"))
    assert out.rewritten == [] and sorted((r.doc_id % 2, r.shard) for r in out.rows.collect()) == [(0, 0)] * 4 + [(1, 1)] * 4
    assert reshard(df.limit(0), F.lit(0), 2, 2, new_path(spark, "t")).rows.collect() == []


def test_rows_that_repeat_are_spread(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(20, 60)) for i in range(12000)] + [(77, "the same row again and again")] * 6000 + [(None, None)] * 500
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = reshard(df, F.pmod(F.xxhash64("doc_id"), F.lit(3)), 3, 4, new_path(spark, "t"), rows_per_file=500)
    got = out.rows.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += len(r.text or "") + 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) <= 1.01 * min(size.values())
