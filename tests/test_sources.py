from storyloom.sources import readers, writers
from storyloom.operators import segment


def test_transcripts(spark, tmp_path):
    (tmp_path / "FLSA_007.txt").write_text("7\nHIGH POINT\n\nI: hello  \n   \nR: hi \n")
    (tmp_path / "notes.txt").write_text("x\n")
    rows = readers.read_transcripts(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.narrative_num, r.line) for r in rows] == [(7, "HIGH POINT"), (7, "I: hello"), (7, ""), (7, "R: hi")]
    assert {r.narrative_num for r in readers.missing_numbers(spark, readers.read_transcripts(spark, str(tmp_path)), 6, 8).collect()} == {6, 8}


def test_scores(spark, tmp_path):
    path = tmp_path / "NarrativeScores.csv"
    path.write_text("num," + ",".join(f"h{i}" for i in range(12)) + "\n7,a,b,3,4,5,c,d,8,9,10,e,f\tnote,x\n")
    row = readers.read_scores(spark, str(path)).first()
    assert (row.narrative_num, row.high_agency, row.low_communion, row.turning_communion) == ("7", "a", "d", "f")


def test_xml_round_trip(spark, tmp_path):
    lines = [(7, i, x) for i, x in enumerate(["HIGH POINT", "I: q?", "R:  a & b", "LOW POINT", "R: c"])]
    passages = segment.scene_passages(spark.createDataFrame(lines, "narrative_num int, line_no int, line string"))
    trees = writers.narrative_trees(passages)
    writers.write_narrative_xml(trees, str(tmp_path / "out"))
    flat = readers.flat_examples(readers.read_narrative_xml(spark, str(tmp_path / "out"), 1, 7))
    got = {(int(r.narrative_num), r.scene_idx, r.passage_idx, r.speaker, r.passage_text or "") for r in flat.collect()}
    assert got == {(r.narrative_num, r.scene_idx, r.passage_idx, r.speaker, r.text) for r in passages.collect()}
    assert readers.read_narrative_xml(spark, str(tmp_path / "out"), 8).count() == 0
    assert "<scene " in trees.select(writers.xml_column().alias("x")).first().x


def test_scenes_parquet(spark, tmp_path):
    df = spark.range(3)
    writers.write_scenes(df, str(tmp_path / "s"))
    assert readers.read_scenes(spark, str(tmp_path / "s")).count() == 3
