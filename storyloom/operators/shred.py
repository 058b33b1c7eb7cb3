"""Deeply nested records into related flat tables (problem 5), by adjacency-table shredding.

``adjacency``  every payload as rows (raw_id, node, parent, label, ordinal, kind, scalar);
``entities``   object nodes joined with their scalar children and pivoted into one row for each
               scene, passage and example, linked to the parent by position.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.session import checkpoint

NODES = "array<struct<node int, parent int, label string, ordinal int, kind string, scalar string>>"

# The levels of the tree, and the containers that hold a level's records under their names.
LEVELS = ["scene", "passage", "example"]
CONTAINERS = {"scenes": "scene", "passages": "passage", "examples": "example"}
#: Attributes of each level in the flat tables.
FIELDS = {
    "scene": ["scene_name", "scene_agency", "scene_communion", "scene_score", "word_count"],
    "passage": ["speaker", "text"],
    "example": ["dimension", "score", "text"],
}
#: Labels of an element's own text.
TEXT_LABELS = ["value", "text", "_value"]


class _Members(list):
    """JSON object as its (key, value) pairs; a key may repeat."""


def _label(key: str) -> str:
    return key.strip().lstrip("@_#$").strip().replace("-", "_").lower()


def _scalar(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _json_nodes(payload: str) -> list[tuple]:
    """Adjacency rows of a JSON payload (also one encoded twice); ``ValueError`` if it can't be read as a whole."""
    value = payload
    for _ in range(3):
        if not isinstance(value, str):
            break
        value = json.loads(value.lstrip("﻿"), object_pairs_hook=_Members)
    out: list[tuple] = []
    # depth-first with an explicit stack: nesting is bounded by the reader alone
    stack = [(value, -1, "", 0)]
    while stack:
        v, parent, label, ordinal = stack.pop()
        if v is None:
            continue
        if isinstance(v, list) and not isinstance(v, _Members):
            stack.extend((x, parent, label, i) for i, x in reversed(list(enumerate(v))))
            continue
        node = len(out)
        if isinstance(v, _Members):
            out.append((node, parent, label, ordinal, "object", None))
            stack.extend((x, node, _label(k), i) for i, (k, x) in reversed(list(enumerate(v))))
        else:
            out.append((node, parent, label, ordinal, "scalar", _scalar(v)))
    return out


def _xml_nodes(payload: str) -> list[tuple]:
    """Adjacency rows of an XML payload; attributes are scalar children, text is the child ``text``."""
    out: list[list] = []
    open_: list[int] = []
    seen: list[int] = []

    def start(name: str, attrs: list[str]) -> None:
        parent = open_[-1] if open_ else -1
        ordinal = 0
        if open_:
            ordinal = seen[-1]
            seen[-1] += 1
        node = len(out)
        out.append([node, parent, _label(name.rpartition(":")[2]), ordinal, "object", None])
        open_.append(node)
        seen.append(0)
        for i in range(0, len(attrs), 2):
            out.append([len(out), node, _label(attrs[i]), i // 2, "scalar", attrs[i + 1]])

    texts: dict[int, list[str]] = {}

    def end(_: str) -> None:
        node = open_.pop()
        seen.pop()
        text = "".join(texts.pop(node, []))
        if text.strip():
            out.append([len(out), node, "text", 0, "scalar", text])

    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: texts.setdefault(open_[-1], []).append(s) if open_ else None

    def no_entities(*_) -> None:
        raise ValueError("entity declarations are refused")

    parser.EntityDeclHandler = no_entities
    parser.Parse(payload.lstrip("﻿ \t\r\n"), True)
    return [tuple(x) for x in out]


def parse_payload(payload: str | None, kind: str | None) -> list[tuple] | None:
    """Adjacency rows, or None if the payload can't be read as a whole. Without a known kind the first character decides."""
    if payload is None or not payload.strip():
        return None
    xml = kind.strip().lower() == "xml" if kind and kind.strip().lower() in ("xml", "json") else payload.lstrip("﻿ \t\r\n").startswith("<")
    try:
        return _xml_nodes(payload) if xml else _json_nodes(payload)
    except (ValueError, RecursionError, expat.ExpatError):
        return None


def adjacency(records: DataFrame) -> DataFrame:
    """``(raw_id, node, parent, label, ordinal, kind, scalar)`` of all readable payloads; nodes count in document order.

    A ``raw_id`` sent more than once is read from its latest row (``received_at``, then ``payload``). Null
    ``raw_id``, null, empty and unreadable payloads give no rows. Columns other than ``raw_id``, ``payload``,
    ``payload_kind`` and ``received_at`` are ignored.
    """

    @F.pandas_udf(NODES)
    def shred(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for payload, kind in it:
            yield pd.Series([parse_payload(p, k) for p, k in zip(payload, kind, strict=True)], dtype=object)

    latest = records.where("raw_id is not null").groupBy("raw_id").agg(F.max_by(F.struct("payload", "payload_kind"), F.struct("received_at", "payload")).alias("r"))
    return latest.select("raw_id", F.inline(shred("r.payload", "r.payload_kind")))


def _position(level: str) -> Column:
    return (F.row_number().over(Window.partitionBy("raw_id", "parent_entity").orderBy("node")) - 1).cast("int").alias(f"{level}_idx")


def entities(records: DataFrame, fields: bool = True) -> DataFrame:
    """One row for each scene, passage and example with parent positions and, with ``fields``, the fields of its level.

    Columns ``raw_id, level, scene_idx, passage_idx, example_idx`` (positions of levels below the row's own are
    -1; they count from 0 within the parent, in payload order), ``scene_name, scene_agency, scene_communion,
    scene_score, word_count, speaker, dimension, score, text`` as strings, null where absent.

    Children may stand in a list, alone, or under their names in a container; an example may be plain text. The
    adjacency table is written once (checkpoint). Object nodes are placed by joins of ids alone; last, they are joined
    with their scalar children on (raw_id, node), pivoted. Without ``fields`` scalars never leave the reader.
    """
    nodes = adjacency(records)
    nodes = checkpoint(nodes if fields else nodes.drop("scalar"))
    containers = nodes.where(F.col("label").isin(list(CONTAINERS)) & (F.col("kind") == "object")).select("raw_id", F.col("node").alias("parent"), F.col("parent").alias("above"), F.col("label").alias("container"))
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONTAINERS.items() for x in kv]), F.col("container")), F.col("label"))
    level = F.when(F.col("container").isNotNull() & (F.col("kind") == "scalar") & (F.col("container") != "examples"), None).otherwise(level)
    named = nodes.join(containers, ["raw_id", "parent"], "left").withColumns({"parent": F.coalesce("above", "parent"), "level": level})
    entity = F.col("level").isin(LEVELS) & ((F.col("kind") == "object") | (F.col("level") == "example"))
    own = checkpoint(named.where(entity).select("raw_id", "node", "parent", "level"))

    def placed(name: str, above: DataFrame | None, keys: list[str]) -> DataFrame:
        rows = own.where(F.col("level") == name).select("raw_id", "node", "parent")
        rows = rows if above is None else rows.join(above.select("raw_id", F.col("node").alias("parent"), *keys), ["raw_id", "parent"])
        return rows.withColumn("parent_entity", F.col("parent")).select("raw_id", "node", *keys, _position(name))

    scene = placed("scene", None, [])
    passage = placed("passage", scene, ["scene_idx"])
    example = placed("example", passage, ["scene_idx", "passage_idx"])
    index = [f"{x}_idx" for x in LEVELS]
    parts = [df.withColumns({"level": F.lit(name), **{f"{x}_idx": F.lit(-1) for x in LEVELS[i + 1 :]}}).select("raw_id", "node", "level", *index) for i, (df, name) in enumerate([(scene, "scene"), (passage, "passage"), (example, "example")])]
    flat = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if not fields:
        return flat.select("raw_id", "level", *index)
    names = sorted({f for fs in FIELDS.values() for f in fs} - {"text"})
    # the fields of a node are its scalar children; a plain-text example is its own
    child = named.where("kind = 'scalar'").select("raw_id", F.when(F.col("level") == "example", F.col("node")).otherwise(F.col("parent")).alias("node"), F.col("node").alias("at"), F.when(F.col("level") == "example", F.lit("")).otherwise(F.col("label")).alias("label"), "scalar", "level")
    child = child.where("level not in ('scene', 'passage')")
    first = lambda which: F.min_by(F.when(which, F.col("scalar")), F.when(which, F.col("at")))
    pivot = child.groupBy("raw_id", "node").agg(*[first(F.col("label") == f).alias(f) for f in names], first(F.col("label").isin([*TEXT_LABELS, ""])).alias("text"))
    return flat.join(pivot, ["raw_id", "node"], "left").select("raw_id", "level", *index, *names, "text")


def entity_table(records: DataFrame, level: str) -> DataFrame:
    """The flat table of one level, with keys of the levels above it."""
    keys = LEVELS[: LEVELS.index(level) + 1]
    return entities(records).where(F.col("level") == level).select("raw_id", *[f"{x}_idx" for x in keys], *FIELDS[level])
