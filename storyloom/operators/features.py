"""Terms, TF-IDF, splits and top features."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import ngrams, tokens
from storyloom.operators.ranking import global_row_number, hash_range, low_bits, portable_hash
from storyloom.session import HOT_SHARE, checkpoint, driver_share, hot_keys, salted_lookup, spread

#: Bytes that a broadcast term takes with its numbers, besides four a character.
TERM_BYTES = 128


def terms(docs: DataFrame, id_col: str, text_col: str, max_n: int = 1) -> DataFrame:
    """``(id, term, tf)``: counts of the 1- to ``max_n``-grams of ``\\w*`` tokens (empty tokens included)."""
    # tokens are a column of their own: inside the n-gram lambdas they would be made again for every position
    words = docs.where(F.col(text_col).isNotNull()).select(id_col, tokens(F.col(text_col)).alias("_w"))
    rows = words.select(id_col, F.explode(F.col("_w") if max_n == 1 else ngrams(F.col("_w"), max_n)).alias("term"))
    return rows.groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def top_terms(counts: DataFrame, limit: int) -> DataFrame:
    """The vocabulary cap: ``limit`` terms of greatest total count, ties by term."""
    return counts.groupBy("term").agg(F.sum("tf").alias("tf")).orderBy(F.desc("tf"), "term").limit(limit)


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(counts: DataFrame, id_col: str, n_docs: int, frequency: DataFrame | None = None) -> DataFrame:
    """``(id, term, tf, df, idf, tfidf)``: tf times ``ln((1+n)/(1+df)) + 1``, rows scaled to length 1.

    ``frequency`` and ``n_docs`` come from the training documents (intended) or from ``counts`` itself.
    """
    df_ = document_frequency(counts) if frequency is None else frequency
    # the empty term is in nearly every document: rows of such terms are spread
    rows = salted_lookup(counts, df_, "term", hot_keys(counts, "term")).withColumn("idf", F.log((1 + F.lit(float(n_docs))) / (1 + F.col("df"))) + 1)
    rows = rows.withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return rows.withColumn("norm", norm).select(id_col, "term", "tf", "df", "idf", (F.col("raw") / F.col("norm")).alias("tfidf"))


def refit_tfidf(split: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, term, observed, intended)``: tf-idf of the test documents of a split by document frequencies of their own
    (observed) and of the training documents (intended; null for terms these do not hold, each scaled to length 1).

    Ids are unique. Only texts are shuffled: a document's terms are counted, weighed and scaled where it lies, and the
    terms' frequencies are broadcast if they fit ``driver_share``, else joined with salts.
    """
    spark = split.sparkSession
    # a null term more in every document counts the documents
    words = F.array_append(F.coalesce(F.array_distinct(tokens(F.col(text_col))), F.array().cast("array<string>")), F.lit(None).cast("string"))
    seen = split.select("is_train", F.explode(words).alias("term")).groupBy("term").agg(F.count_if(~F.col("is_train")).alias("own"), F.count_if("is_train").alias("known"))
    seen = checkpoint(seen.where("own > 0 or term is null"))
    n = seen.where("term is null").first() or {"own": 0, "known": 0}
    lookup = seen.where("term is not null")
    own = F.log((1 + F.lit(float(n["own"]))) / (1 + F.col("own"))) + 1
    known = F.when(F.col("known") > 0, F.log((1 + F.lit(float(n["known"]))) / (1 + F.col("known"))) + 1)
    weights = lookup.select("term", own.alias("_o"), known.alias("_i"))
    rows = terms(spread(split.where("not is_train").select(id_col, text_col), id_col), id_col, text_col)
    size, total = lookup.agg(F.coalesce(F.sum(4 * F.length("term") + TERM_BYTES), F.lit(0)), F.coalesce(F.sum("own"), F.lit(0))).first()
    if size <= driver_share(spark):
        rows = rows.join(F.broadcast(weights), "term")
    else:
        hot = max(total * HOT_SHARE, 1000)
        rows = salted_lookup(rows, weights, "term", {r.term: math.ceil(r.own / hot) for r in lookup.where(F.col("own") > F.lit(hot)).collect()})
    raw = {"observed": F.col("tf") * F.col("_o"), "intended": F.col("tf") * F.col("_i")}
    norm = {c: F.sqrt(F.sum(x * x).over(Window.partitionBy(id_col))) for c, x in raw.items()}
    return rows.select(id_col, "term", *[(x / norm[c]).alias(c) for c, x in raw.items()])


def train_test_split(df: DataFrame, id_col: str, share: float = 0.66) -> DataFrame:
    """``is_train`` for exactly ``ceil(n * share)`` rows in the order of a portable hash of the id; pairs stay together.

    Rows are counted by hash range; only the range that holds the last training row is ranked, so rows of the others
    are neither sorted nor shuffled.
    """
    rows = df.withColumn("_b", hash_range(F.col(id_col)))
    counts = dict(rows.groupBy("_b").count().collect())  # at most BUCKETS rows
    take, upto, before, edge = math.ceil(sum(counts.values()) * share), 0, 0, -1
    for edge in sorted(b for b in counts if b is not None):
        before, upto = upto, upto + counts[edge]
        if upto >= take:
            break
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(portable_hash(F.col(id_col)), id_col))
    apart = rows.where(F.col("_b") != edge).withColumn("is_train", F.col("_b") < edge)
    ranked = rows.where(F.col("_b") == edge).withColumn("is_train", rank <= take - before)
    return apart.unionByName(ranked).drop("_b")


def unpaired_split(df: DataFrame, id_col: str, label: str, share: float = 0.66) -> DataFrame:
    """The observed split: texts and labels shuffled by orders of their own and put together by position."""
    n = df.count()
    left = global_row_number(df.drop(label).withColumn("_h", portable_hash(F.col(id_col))), "_h", [id_col])
    right = global_row_number(df.select(F.col(id_col).alias("_i"), label).withColumn("_h", portable_hash(low_bits(F.col("_i")) + 7)), "_h", ["_i"]).select("rn", label)
    return left.join(right, "rn").withColumn("is_train", F.col("rn") <= F.ceil(F.lit(n) * F.lit(share))).drop("_h", "rn")


def shuffle_orders(n: int, seed: int = 42, lists: int = 2) -> list[list[int]]:
    """Positions after shuffling ``lists`` lists of ``n`` items one after the other from one seed, as the observed split
    does it (swap i with ``int(random() * (i + 1))`` from the end). Sequential by nature, for bounded ``n``."""
    r = random.Random(seed)
    out = []
    for _ in range(lists):
        order = list(range(n))
        for i in range(n - 1, 0, -1):
            j = int(r.random() * (i + 1))
            order[i], order[j] = order[j], order[i]
        out.append(order)
    return out


def top_features(coefs: DataFrame, n: int, by: str = "label") -> DataFrame:
    """The ``n`` terms of greatest coefficient of each class, with their rank (ties by term)."""
    w = Window.partitionBy(by).orderBy(F.desc("coef"), "term")
    return coefs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def joined_features(top: DataFrame, by: str = "label") -> DataFrame:
    """One row a class: its top terms in rising order of coefficient, joined with ``', '``."""
    return top.groupBy(by).agg(F.expr("listagg(term, ', ') within group (order by coef, term desc)").alias("features"))


def top_and_bottom(coefs: DataFrame, n: int) -> DataFrame:
    """``n`` greatest and ``n`` smallest terms of one coefficient vector."""
    top = coefs.orderBy(F.desc("coef"), "term").limit(n).withColumn("side", F.lit("top"))
    low = coefs.orderBy("coef", "term").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)

