import random

import pytest
from pyspark.sql import functions as F

from storyloom.llm import packing


def test_pack_is_feasible_and_tight():
    r = random.Random(1)
    sizes = [r.randint(1, 900) for _ in range(3000)]
    plan = packing.pack(sizes, [256, 1024])
    used = {}
    for s, (c, cap) in zip(sizes, plan):
        used.setdefault((c, cap), []).append(s)
    assert all(sum(v) <= cap for (_, cap), v in used.items())
    assert sum(sizes) / sum(cap for _, cap in used) > 0.98
    # downsized: no container's contents fit the next smaller capacity
    assert all(sum(v) > 256 for (_, cap), v in used.items() if cap == 1024)
    assert packing.pack([], [4]) == [] and packing.pack([4, 4], [4]) in ([(0, 4), (1, 4)], [(1, 4), (0, 4)])


@pytest.mark.parametrize("seed", range(4))
def test_joint_capacities_beat_every_single_opening_size(seed):
    r = random.Random(seed)
    capacities = [256, 1024, 4096]
    sizes = [min(4095, max(1, int(r.lognormvariate(4.8, 1.3)))) for _ in range(4000)]
    plan = packing.pack(sizes, capacities)
    total = sum(cap for _, cap in set(plan))

    def single(opening):
        """Best fit of falling sizes where every container is opened at one size, then downsized."""
        room = []
        for s in sorted(sizes, reverse=True):
            fits = [k for k, (free, _) in enumerate(room) if free >= s]
            if fits:
                k = min(fits, key=lambda k: room[k][0])
                room[k] = (room[k][0] - s, room[k][1])
            else:
                cap = next(c for c in capacities if c >= max(s, opening))
                room.append((cap - s, cap))
        return sum(next(c for c in capacities if c >= cap - free) for free, cap in room)

    assert total <= min(single(c) for c in capacities)


def test_containers(spark):
    r = random.Random(2)
    items = spark.createDataFrame([(i, r.choice([1, 5, 30, 255, 256, 700]), 0) for i in range(500)] + [(1000, 5000, 0), (1001, 0, 0), (None, 3, 0)], "item_id long, size int, bucket int")
    out = packing.containers(items, [256], bucket_items=100).cache()
    total = items.where("item_id is not null").agg(F.sum("size")).first()[0]
    assert out.agg(F.sum("piece_size")).first()[0] == total
    assert out.groupBy("container_id").agg(F.sum("piece_size").alias("u")).where("u > 256").count() == 0
    whole = items.where("size <= 256").select("item_id")
    assert out.join(whole, "item_id").groupBy("item_id").count().where("count > 1").count() == 0
    gaps = out.groupBy("item_id").agg(F.sum("piece_size").alias("s"), F.max(F.col("piece_start") + F.col("piece_size")).alias("e")).where("s <> e")
    assert gaps.count() == 0
    assert packing.containers(items.where("false"), [256]).count() == 0
    with pytest.raises(ValueError):
        packing.containers(items, [])


def test_measured_and_each(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "one two three"), (1, "one"), (2, None), (3, ""), (4, "hello " * 3000)], "id long, text string")
    sizes = {r.item_id: r["size"] for r in packing.measured(docs, "id", "text").collect()}
    assert set(sizes) == {1, 4} and sizes[1] == 3 and sizes[4] > 2900
    caps = spark.createDataFrame([("s", 256), ("l", 4096), ("bad", None)], "size_name string, capacity int")
    out = packing.containers_of_each(packing.measured(docs, "id", "text"), caps)
    assert {(r.size_name, r.n) for r in out.groupBy("size_name").agg(F.sum("piece_size").alias("n")).collect()} == {(s, sum(sizes.values())) for s in "sl"}
