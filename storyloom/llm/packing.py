"""Filling fixed-capacity containers with items (problem 7).

Variable-capacity best-fit: the permitted lengths are optimised jointly. Items (texts measured in tokens of a public
tokenizer) go, longest first, into the open container they fit most tightly. Where none is open, a container of the
capacity of least cost is opened: of the capacities that hold the item, the one that the items still to come would
leave least unused. At the end every container is downsized to the smallest capacity that holds its contents.
Only an item longer than the largest capacity is divided, at token boundaries.
"""

from __future__ import annotations

import base64
import importlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.session import checkpoint, union_all

#: Vocabulary file (a name of the installed tokenizer package, or a path).
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Items one packing task handles on average; tasks are independent, so each leaves at most a few containers open.
BUCKET_ITEMS = 50_000


@cache
def encoder(name: str):
    """Tokenizer of a rank file; nothing needs a network."""
    import tiktoken

    pkg = importlib.import_module("public_tokenizers")
    path = name if "/" in name else pkg.path(name)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pkg.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, tokenizer: str = TOKENIZER) -> int:
    return len(encoder(tokenizer).encode_ordinary(text))


def measured(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(item_id, size)``: tokens of each text; null ids, null and empty texts give no row, of repeated ids the longest counts."""

    @F.pandas_udf(T.IntegerType())
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(tokenizer)
        for texts in it:
            yield pd.Series([len(x) for x in enc.encode_ordinary_batch(texts.tolist(), num_threads=1)], dtype="int32")

    rows = df.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("item_id"), count(text_col).alias("size"))
    return rows.groupBy("item_id").agg(F.max("size").alias("size")).where("size > 0")


def _unused(free: int, top: int, distinct: list[int], left: dict[int, int]) -> int:
    """Room that stays free if a container is filled from the items left, each time with the largest that fits."""
    k = bisect_right(distinct, min(free, top)) - 1
    while k >= 0 and free >= distinct[0]:
        n = min(left[distinct[k]], free // distinct[k])
        free -= n * distinct[k]
        k = min(k - 1, bisect_right(distinct, free) - 1)
    return free


def pack(sizes: list[int], capacities: list[int]) -> list[tuple[int, int]]:
    """``(container, capacity)`` of every item (each at most the largest capacity), by best fit of falling sizes.

    The cost of opening a capacity is the share of it left unused by ``_unused``; of equal ones the largest is opened.
    """
    capacities = sorted(set(capacities))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    distinct = sorted(set(sizes))
    left: dict[int, int] = {}
    for s in sizes:
        left[s] = left.get(s, 0) + 1
    where = [0] * len(sizes)
    room: list[tuple[int, int]] = []  # (free, container), sorted
    used: list[int] = []
    for i in order:
        s = sizes[i]
        left[s] -= 1
        at = bisect_left(room, (s, -1))
        if at < len(room):
            free, c = room.pop(at)
        else:
            c, free = len(used), min((x for x in capacities if x >= s), key=lambda x: (_unused(x - s, s, distinct, left) / x, -x))
            used.append(0)
        used[c] += s
        where[i] = c
        if free - s:
            insort(room, (free - s, c))
    final = [capacities[bisect_left(capacities, u)] for u in used]
    return [(c, final[c]) for c in where]


def containers(items: DataFrame, capacities: list[int], bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """``(container_id, capacity, item_id, piece_no, piece_start, piece_size)``: all items in containers of the capacities.

    ``items`` is ``(item_id, size)``. An item above the largest capacity is divided into pieces of that capacity and a
    rest (``piece_start`` in tokens); no other item is divided. Items are spread over hash buckets of about
    ``bucket_items``, each packed by itself, so the containers one bucket can't fill are a fixed number per
    ``bucket_items`` items. Full pieces of the largest capacity need no packing and never enter a bucket.
    An empty table gives no row.
    """
    caps = sorted({int(c) for c in capacities if c and c > 0})
    if not caps:
        raise ValueError("no capacity")
    top = caps[-1]
    pieces = items.where("item_id is not null and size > 0").select("item_id", "size", F.posexplode(F.sequence(F.lit(0), (F.col("size") - 1).cast("long"), F.lit(top).cast("long"))).alias("piece_no", "piece_start"))
    pieces = pieces.select("item_id", "piece_no", "piece_start", F.least(F.lit(top).cast("long"), F.col("size") - F.col("piece_start")).alias("piece_size"))
    full = pieces.where(F.col("piece_size") == top).select(F.concat_ws("-", F.lit("f"), "item_id", "piece_no").alias("container_id"), F.lit(top).alias("capacity"), "item_id", "piece_no", "piece_start", "piece_size")
    rest = checkpoint(pieces.where(F.col("piece_size") < top))
    buckets = max(1, -(-rest.count() // bucket_items))
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("item_id", "piece_no"), F.lit(buckets)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "piece_no"])
        plan = pack(pdf.piece_size.tolist(), caps)
        b = int(pdf.bucket.iloc[0])
        return pdf.assign(container_id=[f"{b}-{c}" for c, _ in plan], capacity=[cap for _, cap in plan])[["container_id", "capacity", "item_id", "piece_no", "piece_start", "piece_size"]]

    kind = items.schema["item_id"].dataType.simpleString()
    packed = rest.groupBy("bucket").applyInPandas(fill, f"container_id string, capacity int, item_id {kind}, piece_no int, piece_start long, piece_size long")
    return packed.unionByName(full)


def fill_summary(packed: DataFrame) -> DataFrame:
    """``(capacity, containers, tokens, fill)`` of a packing."""
    each = packed.groupBy("container_id", "capacity").agg(F.sum("piece_size").alias("used"))
    total = each.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return total.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def containers_of_each(items: DataFrame, sizes: DataFrame, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """All items in containers of each size by itself: ``containers`` for every row of ``sizes(size_name, capacity)``, with its ``size_name``.

    The sizes are a handful of rows (one packing each); null and non-positive capacities are left out, equal names keep the greatest capacity.
    """
    items = checkpoint(items)
    rows = sizes.where("capacity > 0").groupBy("size_name").agg(F.max("capacity").alias("capacity")).orderBy("capacity", "size_name").collect()
    parts = [containers(items, [r.capacity], bucket_items).withColumn("size_name", F.lit(r.size_name)) for r in rows]
    if not parts:
        raise ValueError("no capacity")
    return union_all(parts)
