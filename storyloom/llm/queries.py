"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm import encoding, language, leaks, packing, pii, sentences, splits, turns
from storyloom.session import checkpoint, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_narratives(table(spark, d, "narrative"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "narrative"), table(spark, d, "example"), table(spark, d, "split_share"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per split, whether its share of the narratives is within 0.2 points of the wanted one (or a narrative of it), and the groups that are apart."""
    rows = checkpoint(p1_splits(spark, d))
    apart = rows.groupBy("group_id").agg(F.countDistinct("split_name").alias("n")).where("n > 1").agg(F.count("*").alias("groups_apart"))
    have = rows.groupBy("split_name").agg(F.count("*").alias("n"))
    want = table(spark, d, "split_share").select("split_name", (F.col("target_share") / F.sum("target_share").over(Window.partitionBy())).alias("share"))  # a row a split
    off = F.abs(F.coalesce("n", F.lit(0)) / F.lit(max(rows.count(), 1)) - F.col("share"))
    return want.join(F.broadcast(have), "split_name", "left").crossJoin(F.broadcast(apart)).select("split_name", (off <= max(0.002, 1 / max(rows.count(), 1))).alias("near"), "groups_apart")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "example"), "example_id", "text", keep_text=False).withColumnRenamed("rec_id", "example_id")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "example"), "example_id", "text").withColumnRenamed("rec_id", "example_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "example"), "example_id", "text").select(F.col("rec_id").alias("example_id"))


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "example"), "example_id", "text").withColumnRenamed("rec_id", "example_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "passage"), table(spark, d, "example")).select("scene_id", "turn_no", "speaker").distinct()


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "passage"), table(spark, d, "example"))


def _both(spark: SparkSession, d: str, operator) -> DataFrame:
    examples = operator(table(spark, d, "example"), "example_id", "text").withColumn("origin", F.lit("example"))
    return examples.unionByName(operator(table(spark, d, "scene"), "scene_id", "scene_name").withColumn("origin", F.lit("scene")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, sentences.sentence_offsets).select("origin", "rec_id", F.explode("ends").alias("sent_end"))


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, sentences.sentences)


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return packing.measured(table(spark, d, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers of the permitted capacities, optimised jointly."""
    sizes = table(spark, d, "container_size").where("capacity > 0").groupBy("capacity").agg(F.min("size_name").alias("size_name"))
    packed = packing.containers(_measured(spark, d), [r.capacity for r in sizes.select("capacity").collect()])
    return packed.withColumnRenamed("item_id", "doc_id").join(F.broadcast(sizes), "capacity")  # a row a capacity


def p7_each(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers of each capacity by itself."""
    return packing.containers_of_each(_measured(spark, d), table(spark, d, "container_size")).withColumnRenamed("item_id", "doc_id")


def p7_complete(spark: SparkSession, d: str) -> DataFrame:
    """Per document, whether it is whole in ``p7_containers``, and in one piece unless longer than every capacity; and the containers above their capacity."""
    packed = checkpoint(p7_containers(spark, d))
    over = packed.groupBy("container_id", "capacity").agg(F.sum("piece_size").alias("used")).where("used > capacity").agg(F.count("*").alias("over_capacity"))
    top = table(spark, d, "container_size").agg(F.max("capacity").alias("top"))
    each = packed.groupBy("doc_id").agg(F.sum("piece_size").alias("held"), F.max(F.col("piece_start") + F.col("piece_size")).alias("end"), F.count("*").alias("pieces"))
    each = each.join(_measured(spark, d).withColumnRenamed("item_id", "doc_id"), "doc_id", "full").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(over))  # one row each
    whole = F.coalesce((F.col("held") == F.col("size")) & (F.col("end") == F.col("size")) & ((F.col("pieces") == 1) | (F.col("size") > F.col("top"))), F.lit(False))
    return each.select("doc_id", whole.alias("whole"), "over_capacity")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.relabelled(table(spark, d, "documents"))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_shares": p1_shares,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_turns": p4_turns,
    "p6_found": p6_found,
    "p6_sentences": p6_sentences,
    "p7_containers": p7_containers,
    "p7_each": p7_each,
    "p7_complete": p7_complete,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_languages": p9_languages,
}

_PLACEHOLDERS = ", ".join(f"'{p}'" for p in splits.PLACEHOLDERS)


def _sql_code(column: str, letters: bool) -> str:
    t = rf"regexp_replace(lower(trim(regexp_replace({column}, '\s+', ' ', 'g'))), '\.0+$', '')"
    digits = rf"ltrim(regexp_replace({t}, '[^0-9]', '', 'g'), '0')"
    full = rf"regexp_replace({t}, '[^0-9]', '', 'g')"
    head = rf"regexp_replace({t}, '[^\p{{L}}]', '', 'g')" if letters else "''"
    return f"case when {t} in ({_PLACEHOLDERS}) or {full} = '' then null else {head} || ':' || case when {digits} = '' then '0' else {digits} end end"


_BASE = "list_last(string_split(replace(lower(trim(source_file)), chr(92), '/'), '/'))"
_STEM = rf"regexp_replace({_BASE}, '\.[a-z0-9]{{1,5}}$', '')"
_SQL_FILE = rf"case when {_STEM} in ({_PLACEHOLDERS}) or regexp_replace({_STEM}, '[^\p{{L}}\p{{N}}]', '', 'g') = '' then null else regexp_replace({_BASE}, '(^|[^0-9])0+([0-9])', '\1\2', 'g') end"

ORACLES: dict[str, str] = {
    "p1_shares": "select split_name, true as near, cast(0 as bigint) as groups_apart from split_share",
    "p7_complete": "select distinct doc_id, true as whole, cast(0 as bigint) as over_capacity from documents where doc_id is not null and length(text) > 0",
    "p1_found": f"""with recursive k as (select narr_id, 'n' || {_sql_code("narrative_num", False)} k from narrative union select narr_id, 'p' || {_sql_code("participant_code", True)} from narrative
 union select narr_id, 'f' || {_sql_code("family_code", True)} from narrative union select narr_id, 's' || {_SQL_FILE} from narrative),
 e as (select distinct a.narr_id x, b.narr_id y from k a join k b on a.k = b.k where a.narr_id is not null and b.narr_id is not null),
 r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
 select x as narr_id, min(y) as group_id from r group by x having count(distinct y) > 1""",
}
