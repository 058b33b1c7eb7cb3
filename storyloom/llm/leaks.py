"""Evaluation texts leaking into training text (problem 8), by a prefix-filtered set join.

A document leaks an item if an item-sized window of it holds, in the item's order, at least half of the item's
words. Then it misses at most ``n - t`` of the item's ``n`` words (``t = ceil(n / 2)``), so of the ``n - t + k``
rarest distinct words it must hold ``k``: those prefix words are joined, the pairs below ``k`` are dropped (a length
bound without false negatives), and the rest is verified exactly by position.

Words are cut in one place, ``words_column`` on the JVM; the join and the verification work on those arrays.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.session import checkpoint

#: Share of the item's words a document must hold.
SHARE = 0.5
#: Prefix words a pair must share.
PREFIX_EXTRA = 8
#: A verification window holds this many times the item's words, and ``SLACK`` words more.
WINDOW, SLACK = 1.5, 8
#: Bytes of driver memory per character of the items that are broadcast (words, codes, positions, with room to spare).
BYTES_PER_CHAR = 64

_NO_SPACES = r"぀-ヿ㐀-䶿一-鿿가-힯฀-๿"


def words_column(text: Column) -> Column:
    """Lower-case words; scripts without spaces go by character. Letter case, punctuation and layout don't count."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9[\p{{L}}\p{{M}}\p{{N}}&&[^{_NO_SPACES}]]]++|[\p{{L}}\p{{M}}\p{{N}}&&[{_NO_SPACES}]]"), F.lit(0))


class Item:
    """An item's words as codes: its length, the least number of words to hold, and each code's positions, last first."""

    __slots__ = ("at", "least", "n")

    def __init__(self, codes: Sequence):
        self.n = len(codes)
        self.least = math.ceil(self.n * SHARE)
        self.at: dict = {}
        for k in range(self.n - 1, -1, -1):
            self.at.setdefault(codes[k], []).append(k)


def held(places: Sequence[int], codes: Sequence, item: Item) -> int:
    """Most words of the item, in its order, that any window of the document holds; exact from ``item.least`` on, else 0.

    ``places`` are the positions of the document's words that are words of the item, ``codes`` those words. A window
    may start at every one of them. The words it shares with the item in any order (counted as often as the item
    has them) bound its chain from above; windows are visited by falling bound, until none can beat the best chain.
    """
    if len(places) < item.least:
        return 0
    at = item.at
    size = int(item.n * WINDOW) + SLACK
    have: dict = {}
    bound, e, total = 0, 0, len(places)
    open_: list[tuple[int, int, int]] = []
    for s in range(total):
        stop = places[s] + size
        while e < total and places[e] < stop:
            c = codes[e]
            k = have[c] = have.get(c, 0) + 1
            if k <= len(at[c]):
                bound += 1
            e += 1
        if bound >= item.least:
            open_.append((-bound, s, e))
        c = codes[s]
        if have[c] <= len(at[c]):
            bound -= 1
        have[c] -= 1
    best = item.least - 1
    for b, s, e in sorted(open_):
        if -b <= best:
            break
        # longest strictly increasing chain of item positions
        tails: list[int] = []
        for c in codes[s:e]:
            for k in at[c]:
                q = bisect_left(tails, k)
                if q == len(tails):
                    tails.append(k)
                else:
                    tails[q] = k
        best = max(best, len(tails))
    return best if best >= item.least else 0


def share_held(doc: Sequence, item: Item) -> float:
    """Share of the item's words that a window of the document's words holds, exact from ``SHARE`` on, else 0."""
    places = [p for p, w in enumerate(doc) if w in item.at]
    return held(places, [doc[p] for p in places], item) / item.n


def _prefixes(documents: DataFrame, items: DataFrame, extra: int) -> DataFrame:
    """``(word, item_id, need)``: the prefix words of each item, rarest in the corpus first, and how many a document must hold."""
    sizes = items.select("item_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("d"), F.explode(F.array_distinct("w")).alias("word"))
    vocabulary = sizes.select("word").distinct()
    frequency = documents.select(F.explode(F.array_distinct("w")).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").count()
    ranked = sizes.join(frequency, "word", "left").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("count", F.lit(0)), "word")))
    missing = F.col("n") - F.ceil(F.col("n") * SHARE)
    need = F.greatest(F.lit(1), F.least(F.lit(extra), F.col("d") - missing))
    return ranked.where(F.col("rank") <= missing + need).select("word", "item_id", need.cast("int").alias("need"))


class Index:
    """Prefix words and item words as codes of one vocabulary, in flat arrays."""

    def __init__(self, prefix: list, items: list):
        words = sorted({w for r in items for w in r.w})
        code = {w: k for k, w in enumerate(words)}
        self.words = pa.array(words, pa.string())
        self.ids = np.array([r.item_id for r in items], dtype=np.int64)
        row = {r.item_id: k for k, r in enumerate(items)}
        self.items = [Item([code[w] for w in r.w]) for r in items]
        self.need = np.ones(len(items), dtype=np.int32)
        by_code = sorted((code[r.word], row[r.item_id], r.need) for r in prefix)
        self.owner = np.array([i for _, i, _ in by_code], dtype=np.int32)
        self.first = np.searchsorted([c for c, *_ in by_code], np.arange(len(words) + 1))
        for _, i, n in by_code:
            self.need[i] = n

    def find(self, words: pa.ListArray) -> Iterator[tuple[int, int, float]]:
        """``(document, item, share)`` of a batch of documents, each a list of words."""
        codes = pc.index_in(words.flatten(), value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = np.flatnonzero(codes >= 0)
        doc = np.searchsorted(ends, at, side="right")
        codes = codes[at]
        # the join with the prefix words: distinct (document, word), each repeated for the items that own the word
        pair = np.unique(doc.astype(np.int64) * len(self.words) + codes)
        d, c = pair // max(1, len(self.words)), pair % max(1, len(self.words))
        n = self.first[c + 1] - self.first[c]
        owner = self.owner[np.repeat(self.first[c] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        found, count = np.unique(np.repeat(d, n) * len(self.items) + owner, return_counts=True)
        found = found[count >= self.need[found % len(self.items)]]
        bounds = np.searchsorted(doc, np.arange(len(sizes) + 1))
        last, places, own = -1, [], []
        for f in found.tolist():
            k, i = divmod(f, len(self.items))
            if k != last:
                last = k
                lo, hi = bounds[k], bounds[k + 1]
                places, own = at[lo:hi].tolist(), codes[lo:hi].tolist()
            item = self.items[i]
            keep = [j for j, x in enumerate(own) if x in item.at]
            h = held([places[j] for j in keep], [own[j] for j in keep], item)
            if h:
                yield k, i, h / item.n


def broadcast_limit(spark: SparkSession) -> int:
    """Characters of items that the driver can index: its memory over ``BYTES_PER_CHAR``, a sixteenth of it at most."""
    memory = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.sparkContext.getConf().get("spark.driver.memory", "1g"))
    return memory // 16 // BYTES_PER_CHAR


def leaked_items(documents: DataFrame, items: DataFrame, extra: int = PREFIX_EXTRA, broadcast_chars: int | None = None) -> DataFrame:
    """``(doc_id, item_id, share)`` of every item a document leaks; share = item words held in order by one window.

    Null ids and texts and wordless texts give no row, empty tables none; an item repeated under its id is taken
    once (greatest text), a document repeated under its id counts with each of its texts (greatest share). Document
    frequencies are of the whole corpus. Item tables are only broadcast if their texts are at most
    ``broadcast_chars`` characters (summed first; ``broadcast_limit`` by default); else all joins shuffle and the
    item's words are joined per pair. Both ways give the same rows: words are cut once and verified by ``held``.
    """
    spark = documents.sparkSession
    items = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    items = checkpoint(items.select(F.col("item_id").cast("long"), F.length("text").alias("chars"), words_column(F.col("text")).alias("w")).where(F.size("w") > 0))
    documents = documents.where("doc_id is not null and text is not null").select("doc_id", words_column(F.col("text")).alias("w"))
    limit = broadcast_limit(spark) if broadcast_chars is None else broadcast_chars
    small = (items.agg(F.sum("chars")).first()[0] or 0) <= limit
    prefix = checkpoint(_prefixes(documents, items, extra))
    if small:
        # the join with the prefix words, the count and the verification in one pass over the texts, without a shuffle
        known = items.select("item_id", "w").orderBy("item_id").collect()
        if not known:
            return spark.createDataFrame([], T.StructType([documents.schema["doc_id"], T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType())]))
        index = spark.sparkContext.broadcast(Index(prefix.collect(), known))
        kind = T.StructType([documents.schema["doc_id"], T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType())])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in batches:
                rows = list(own.find(b.column(1)))
                ids = b.column(0).take(pa.array([k for k, *_ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([int(own.ids[i]) for _, i, _ in rows], pa.int64()), pa.array([s for *_, s in rows], pa.float64())], ["doc_id", "item_id", "share"])

        rows = documents.mapInArrow(find, kind)
    else:

        @F.pandas_udf(T.DoubleType())
        def share(docs: pd.Series, own: pd.Series) -> pd.Series:
            return pd.Series([share_held(list(d), Item(list(w))) for d, w in zip(docs, own, strict=True)], dtype=float)

        held_words = documents.select("doc_id", F.explode(F.array_distinct("w")).alias("word"))
        pairs = held_words.join(prefix, "word").groupBy("doc_id", "item_id").agg(F.count("*").alias("k"), F.first("need").alias("need")).where("k >= need").select("doc_id", "item_id")
        pairs = pairs.join(items.select("item_id", F.col("w").alias("item_w")), "item_id")
        rows = pairs.join(documents, "doc_id").select("doc_id", "item_id", share.asNondeterministic()("w", "item_w").alias("share")).where(F.col("share") >= SHARE)
    return rows.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
