import random

from pyspark.sql import functions as F

from storyloom.llm import splits

NARR = "narr_id long, narrative_num string, participant_code string, family_code string, source_file string, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], NARR)


def groups(spark, rows):
    return {r.narr_id: r.group_id for r in splits.tied_narratives(table(spark, rows)).collect()}


def test_spellings_tie(spark):
    rows = [(1, "7", "P-00001", None, "a/FLSA_007.txt"), (2, "0007.0", None, "n/a", "untitled.txt"), (3, "#99", "p_0000001", "-", None), (4, "98", "P 4", "F-4", "flsa_7.TXT"), (5, "97", "unknown", "none", "untitled.txt"), (6, "96", "P-?", "F4", ""), (7, "FLSA 95", "", "", "x.txt"), (None, "7", None, None, None), (7, "95", None, None, None)]
    assert groups(spark, rows) == {1: 1, 2: 1, 3: 1, 4: 1, 6: 1}


def test_empty(spark):
    assert groups(spark, []) == {}


def test_components_against_union_find(spark):
    r = random.Random(2)
    n = 300
    rows = [(i, str(i) if r.random() < 0.8 else str(r.randint(0, n)), f"P-{r.randint(0, 250)}", f"F-{r.randint(0, 400)}" if r.random() < 0.5 else None, f"F_{i}.txt") for i in range(n)]
    # a chain in id order and a hub
    rows += [(1000 + i, f"{5000 + i}", f"P-{9000 + i // 2}", f"F-{9000 + (i + 1) // 2}", None) for i in range(60)]
    rows += [(2000 + i, f"{7000 + i}", "P-77777", None, None) for i in range(150)]
    parent = {x[0]: x[0] for x in rows}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    seen = {}
    for row in rows:
        for kind, v in zip("npfs", row[1:]):
            if v is not None:
                k = (kind, v)
                if k in seen:
                    a, b = sorted((find(row[0]), find(seen[k])))
                    parent[b] = a
                seen[k] = row[0]
    size = {}
    for x in parent:
        size[find(x)] = size.get(find(x), 0) + 1
    want = {x: find(x) for x in parent if size[find(x)] > 1}
    assert groups(spark, rows) == want


def test_largest_differencing():
    out = splits.largest_differencing([8, 7, 6, 5, 4], 2)
    sums = [sum(w for w, b in zip([8, 7, 6, 5, 4], out) if b == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) <= 2
    assert splits.largest_differencing([], 3) == []
    r = random.Random(1)
    w = [r.randint(1, 9) for _ in range(500)]
    out = splits.largest_differencing(w, 10)
    sums = [sum(x for x, b in zip(w, out) if b == k) for k in range(10)]
    assert max(sums) - min(sums) <= 1


def test_splits_keep_groups_and_shares(spark):
    r = random.Random(3)
    rows = [(i, str(i // 2 if r.random() < 0.3 else i), f"P-{r.randint(1, 3000)}", None, None) for i in range(2000)]
    ex = spark.createDataFrame([(i, r.randint(0, 1999), r.choice([0.0, 1.5, 3.0, None, 9.0]), None) for i in range(4000)], "example_id long, narr_id long, score double, loaded_at timestamp")
    share = spark.createDataFrame([("train", 0.66), ("validation", 0.17), ("test", 0.17)], "split_name string, target_share double")
    out = splits.assign_splits(table(spark, rows), ex, share, bucket_rows=400).cache()
    assert out.count() == 2000 and out.where("split_name is null").count() == 0
    assert out.groupBy("group_id").agg(F.countDistinct("split_name").alias("k")).where("k > 1").count() == 0
    got = {r.split_name: r["count"] / 2000 for r in out.groupBy("split_name").count().collect()}
    assert abs(got["train"] - 0.66) < 0.02 and abs(got["test"] - 0.17) < 0.02
    none = splits.assign_splits(table(spark, []), ex, share)
    assert none.count() == 0


def test_allotment_reaches_the_shares():
    r = random.Random(3)
    bins = [(f"s{k % 9}", k // 9, float(r.randint(3, 9))) for k in range(400)]
    shares = {"train": 0.66, "valid": 0.17, "test": 0.17}
    out = splits.allot_bins(bins, shares)
    total = sum(w for *_, w in bins)
    for name, share in shares.items():
        assert abs(sum(w for s, b, w in bins if out[s, b] == name) / total - share) < 0.002
    assert splits.allot_bins([], shares) == {} and set(splits.allot_bins([("a", 0, 1.0)], {"x": 1.0}).values()) == {"x"}
