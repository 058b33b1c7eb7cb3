"""Splits that keep related records together (problem 1).

1. ``narrative_keys``  every code that ties narratives, in one spelling each;
2. ``components``      connected components by random-mate contraction, all in shuffles;
3. ``assign_splits``   largest-differencing (Karmarkar-Karp) balance of the components into
                       equal bins, then whole bins to splits by target share.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.session import checkpoint, hot_keys, salted_lookup

# Spellings of a missing or placeholder code.
PLACEHOLDERS = ["", "-", "--", "?", "na", "n/a", "n.a.", "nan", "nil", "none", "null", "unknown", "anonymous", "anon", "untitled", "unnamed", "missing", "tbd", "test", "x", "xx", "xxx"]

#: Components one LDM task balances at most, on average.
BUCKET_ROWS = 20_000
#: Equal bins of each stratum.
BINS = 48


def _clean(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c.cast("string"), r"[\s ​﻿]+", " ")))


def _code(c: Column, letters: bool) -> Column:
    """Letters (if they count) and the number without padding; null for what names nothing."""
    t = F.regexp_replace(_clean(c), r"\.0+$", "")
    digits = F.regexp_replace(F.regexp_replace(t, r"[^0-9]", ""), r"^0+(?=\d)", "")
    head = F.regexp_replace(t, r"[^\p{L}]", "") if letters else F.lit("")
    return F.when(t.isin(PLACEHOLDERS) | (digits == ""), None).otherwise(F.concat(head, F.lit(":"), digits))


def _file(c: Column) -> Column:
    """File name without folder, letter case and zero padding; null for what names nothing."""
    base = F.element_at(F.split(_clean(c), r"[/\\]"), -1)
    stem = F.regexp_replace(base, r"\.[a-z0-9]{1,5}$", "")
    return F.when(stem.isin(PLACEHOLDERS) | (F.regexp_replace(stem, r"[^\p{L}\p{N}]", "") == ""), None).otherwise(F.regexp_replace(base, r"(?<!\d)0+(?=\d)", ""))


def narrative_keys(narratives: DataFrame) -> DataFrame:
    """Rows ``(node, key)``: narrative and a 64-bit hash of one of its codes. Placeholder codes give no row.

    Null ``narr_id`` rows are left out; repeated rows and ties give one row. Other columns are ignored.
    """
    pairs = F.array(
        F.struct(F.lit("n").alias("kind"), _code(F.col("narrative_num"), False).alias("code")),
        F.struct(F.lit("p").alias("kind"), _code(F.col("participant_code"), True).alias("code")),
        F.struct(F.lit("f").alias("kind"), _code(F.col("family_code"), True).alias("code")),
        F.struct(F.lit("s").alias("kind"), _file(F.col("source_file")).alias("code")),
    )
    rows = narratives.where("narr_id is not null").select(F.col("narr_id").alias("node"), F.explode(pairs).alias("k")).where("k.code is not null")
    return rows.select("node", F.xxhash64("k.kind", "k.code").alias("key")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the bipartite graph ``(node, key)``: rows ``(node, group_id)``, ``group_id`` the smallest node.

    Every round, each node takes the node of smallest pseudo-random rank it shares a key with as its parent,
    and the graph is contracted: ``distinct(parent, key)``. At least a constant share of the nodes goes in each
    round, so the rounds grow with the logarithm of the longest chain; keys of one node end and drop out.
    A key with a third of all rows is pre-aggregated for its smallest rank and joined back salted. Nothing but
    counts and at most ``1 / HOT_SHARE`` hot keys reaches the driver.
    """
    edges = checkpoint(edges.where("node is not null and key is not null"))
    member = edges.select("node").distinct().withColumn("at", F.col("node"))
    now, seed = edges, 0
    while True:
        # keys of a single node tie nothing any more
        size = now.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min(F.struct(F.xxhash64(F.col("node"), F.lit(seed)).alias("rank"), F.col("node").alias("id"))).alias("best"))
        live = size.where("lo <> hi").select("key", "best")
        hot = hot_keys(now, "key")
        step = salted_lookup(now, live, "key", hot)
        parent = checkpoint(step.groupBy("node").agg(F.min("best").alias("best")).select(F.col("node").alias("at"), F.col("best.id").alias("to")))
        if parent.isEmpty():
            break
        # a parent may have a parent of its own in this round; it is followed in the next one
        hot_at = hot_keys(member, "at")
        member = checkpoint(salted_lookup(member, parent, "at", hot_at, "left").select("node", F.coalesce("to", "at").alias("at")))
        renamed = parent.withColumnRenamed("at", "node")
        hot_node = hot_keys(now, "node")
        now = checkpoint(salted_lookup(salted_lookup(now, live.select("key"), "key", hot), renamed, "node", hot_node).select(F.col("to").alias("node"), "key").distinct())
        seed += 1
    least = member.groupBy("at").agg(F.min("node").alias("group_id"))
    return salted_lookup(member, least, "at", hot_keys(member, "at")).select("node", "group_id")


def tied_narratives(narratives: DataFrame) -> DataFrame:
    """``(narr_id, group_id)`` for each narrative that shares a split with at least one other.

    An empty table gives no rows; a narrative with placeholder or null codes only ties with nobody.
    """
    c = checkpoint(components(narrative_keys(narratives)))
    shared = c.groupBy("group_id").agg(F.max("node").alias("last")).where("last <> group_id").select("group_id")
    return salted_lookup(c, shared, "group_id", hot_keys(c, "group_id")).select(F.col("node").alias("narr_id"), "group_id")


def largest_differencing(weights: list[float], k: int) -> list[int]:
    """Bin of each weight, by the multiway largest-differencing method.

    The two partial partitions of largest spread are merged, heaviest bin of one onto the lightest of the
    other, until one is left. Bins come out in order of weight, heaviest first. Ties break by position.
    """
    if not weights:
        return []
    heap = [(-w, i, [w] + [0.0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    serial = len(weights)
    while len(heap) > 1:
        _, _, sums, sets = heapq.heappop(heap)
        _, _, sums2, sets2 = heapq.heappop(heap)
        merged = []
        for j in range(k):
            a, b = sets[j], sets2[k - 1 - j]
            if len(a) < len(b):
                a, b = b, a
            a.extend(b)
            merged.append((sums[j] + sums2[k - 1 - j], a))
        merged.sort(key=lambda m: -m[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], serial, [m[0] for m in merged], [m[1] for m in merged]))
        serial += 1
    out = [0] * len(weights)
    for b, items in enumerate(heap[0][3]):
        for i in items:
            out[i] = b
    return out


def allot_bins(bins: list[tuple[str, int, float]], shares: dict[str, float]) -> dict[tuple[str, int], str]:
    """Split of each ``(stratum, bin)``: heaviest first, to the split furthest below its share overall and in the stratum.

    Then bins are moved until no move brings the overall shares nearer; of equal moves, one from the stratum where the
    split is furthest above its share.
    """
    total = sum(w for *_, w in bins) or 1.0
    by: dict[str, float] = {}
    for s, _, w in bins:
        by[s] = by.get(s, 0.0) + w
    norm = sum(shares.values()) or 1.0
    want = {k: v / norm for k, v in shares.items()}
    have = dict.fromkeys(want, 0.0)
    inside = {(s, k): 0.0 for s in by for k in want}
    out = {}
    for s, b, w in sorted(bins, key=lambda x: (-x[2], x[0], x[1])):
        best = max(sorted(want), key=lambda k: want[k] * total - have[k] + want[k] * by[s] - inside[s, k])
        out[s, b] = best
        have[best] += w
        inside[s, best] += w
    # whole bins move from the split most above its share to the one most below, while that brings both nearer
    weight = {(s, b): w for s, b, w in bins}
    while len(want) > 1:
        over, under = max(sorted(want), key=lambda k: have[k] - want[k] * total), min(sorted(want), key=lambda k: have[k] - want[k] * total)
        spare, lack = have[over] - want[over] * total, want[under] * total - have[under]
        moved = [(abs(spare - weight[x]) + abs(lack - weight[x]), want[over] * by[x[0]] - inside[x[0], over], x) for x, k in out.items() if k == over]
        if not moved or min(moved)[0] >= spare + lack - 1e-9:
            return out
        x = min(moved)[2]
        out[x] = under
        for k, sign in ((over, -1), (under, 1)):
            have[k] += sign * weight[x]
            inside[x[0], k] += sign * weight[x]
    return out


def assign_splits(narratives: DataFrame, examples: DataFrame, shares: DataFrame, bins: int = BINS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(narr_id, group_id, split_name)`` for every narrative; tied narratives are never apart.

    Components are weighted by their narratives and put into a stratum by their mean example score (latest row
    of each example, out-of-domain scores left out). In each stratum and hash bucket of about ``bucket_rows``
    components, largest differencing makes ``bins`` equal bins; bins of equal rank are joined over the buckets,
    in turns heaviest to lightest and back, so that at most strata times ``bins`` rows reach the driver, where
    whole bins are allotted. ``split_share`` has one row a split. Narratives without examples form a stratum.
    """
    ids = narratives.where("narr_id is not null").select(F.col("narr_id").alias("node")).distinct()
    comp = checkpoint(ids.join(components(narrative_keys(narratives)), "node", "left").select("node", F.coalesce("group_id", "node").alias("group_id")))
    latest = examples.where("narr_id is not null").groupBy("example_id").agg(F.max_by(F.struct("narr_id", "score"), F.struct("loaded_at", "score")).alias("r"))
    per = latest.where("r.score in (0, 1, 1.5, 2, 3)").groupBy(F.col("r.narr_id").alias("node")).agg(F.sum("r.score").alias("sum"), F.count("*").alias("n"))
    weight = comp.join(per, "node", "left").groupBy("group_id").agg(F.count("*").cast("double").alias("w"), F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    weight = weight.select("group_id", "w", F.coalesce(F.round(F.col("sum") / F.col("n") * 4).cast("int").cast("string"), F.lit("none")).alias("stratum"))
    weight = checkpoint(weight)
    buckets = max(1, -(-weight.count() // bucket_rows))
    weight = weight.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)).cast("int"))

    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "group_id"], ascending=[False, True])
        b = pd.Series(largest_differencing(pdf.w.tolist(), bins), index=pdf.index)
        if int(pdf.bucket.iloc[0]) % 2:
            b = bins - 1 - b
        return pdf.assign(bin=b.astype("int32"))[["group_id", "stratum", "w", "bin"]]

    binned = checkpoint(weight.groupBy("stratum", "bucket").applyInPandas(balance, "group_id long, stratum string, w double, bin int"))
    sums = [(r.stratum, r.bin, r.w) for r in binned.groupBy("stratum", "bin").agg(F.sum("w").alias("w")).collect()]  # at most strata x bins
    share = {r.split_name: r.target_share for r in shares.where("split_name is not null and target_share > 0").select("split_name", "target_share").distinct().collect()}
    spark = narratives.sparkSession
    alloc = spark.createDataFrame([(s, b, k) for (s, b), k in allot_bins(sums, share).items()] if share else [], "stratum string, bin int, split_name string")
    placed = binned.join(F.broadcast(alloc), ["stratum", "bin"], "left").select("group_id", "split_name")
    return salted_lookup(comp, placed, "group_id", hot_keys(comp, "group_id")).select(F.col("node").alias("narr_id"), "group_id", "split_name")
