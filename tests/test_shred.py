import json

from storyloom.operators import shred

SCHEMA = "raw_id long, payload_kind string, payload string, received_at timestamp, node int"


def rows(spark, payloads):
    data = [(i, k, p, None, 0) for i, k, p in payloads]
    df = shred.entities(spark.createDataFrame(data, SCHEMA))
    return {(r.raw_id, r.scene_idx, r.passage_idx, r.example_idx): r for r in df.collect()}


TREE = {"narrative": {"_narrative_num": "1", "scene": [{"_scene_name": "High Point", "_scene_agency": 2.0, "passage": [{"_speaker": "R", "example": [{"_score": 1.5, "_VALUE": "a"}, "plain"]}, {"@speaker": "I", "#text": "hm", "example": None}]}, {"passage": {"speaker": "R", "example": "alone"}}]}}


def test_shapes(spark):
    got = rows(spark, [(1, "json", json.dumps(TREE)), (2, "json", json.dumps(json.dumps(TREE["narrative"]))), (3, "json", json.dumps({"data": {"narrative": {"scenes": {"High Point": {"passage": []}, "Low Point": {"passage": {"text": "x"}}}}}}))])
    keys = {(0, -1, -1), (0, 0, -1), (0, 0, 0), (0, 0, 1), (0, 1, -1), (1, -1, -1), (1, 0, -1), (1, 0, 0)}
    assert {k[1:] for k in got if k[0] == 1} == keys == {k[1:] for k in got if k[0] == 2}
    assert {k[1:] for k in got if k[0] == 3} == {(0, -1, -1), (1, -1, -1), (1, 0, -1)}
    assert got[1, 0, -1, -1].scene_agency == "2.0" and got[1, 0, 0, -1].speaker == "R" and got[1, 0, 1, -1].text == "hm"
    assert got[1, 0, 0, 0].score == "1.5" and got[1, 0, 0, 1].text == "plain" and got[1, 1, 0, 0].text == "alone"


def test_xml(spark):
    xml = '<?xml version="1.0"?><narrative narrative_num="1"><scene scene_name = "Low Point" scene_agency="1.0"><passage speaker="R"><example score="2.0"><![CDATA[a & b]]></example><example>c</example></passage></scene></narrative>'
    got = rows(spark, [(1, "xml", xml), (2, None, xml)])
    assert len(got) == 8
    assert got[1, 0, 0, 0].text == "a & b" and got[1, 0, 0, 0].score == "2.0" and got[2, 0, -1, -1].scene_name == "Low Point"


def test_unreadable_and_empty(spark):
    bad = [(1, "json", '{"scene": [{'), (2, "xml", "<narrative><scene>"), (3, "json", None), (4, "json", ""), (5, "json", "null"), (6, "json", "[]"), (None, "json", json.dumps(TREE)), (7, "xml", '<!DOCTYPE a [<!ENTITY e "x">]><narrative><scene/></narrative>')]
    assert rows(spark, bad) == {}
    assert rows(spark, [(1, "json", "null")]) == {}


def test_repeated_record_counts_once(spark):
    import datetime as dt

    t = dt.datetime(2020, 1, 1)
    data = [(1, "json", json.dumps({"scene": {"passage": []}}), t, 0), (1, "json", json.dumps(TREE), t + dt.timedelta(1), 0), (1, "json", json.dumps(TREE), t + dt.timedelta(1), 0)]
    assert shred.entities(spark.createDataFrame(data, SCHEMA)).count() == 8


def test_entity_table(spark):
    df = shred.entity_table(spark.createDataFrame([(1, "json", json.dumps(TREE), None, 0)], SCHEMA), "passage")
    assert df.columns == ["raw_id", "scene_idx", "passage_idx", "speaker", "text"] and df.count() == 3


def test_long_text(spark):
    long = "x" * 300_000
    got = rows(spark, [(1, "json", json.dumps({"scene": {"passage": {"text": long}}}))])
    assert len(got[1, 0, 0, -1].text) == 300_000
