import datetime as dt

from storyloom.streaming import scoring

SCHEMA = "example_id long, text string, score double, loaded_at timestamp"


def test_stream(spark, tmp_path):
    t = dt.datetime(2020, 1, 1)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "One. Two.", 2.0, t), (1, "One. Two.", 2.0, t), (2, None, 1.0, t), (3, "x", 9.0, t)], SCHEMA).write.parquet(src)
    for _ in range(2):
        scoring.write_stream(scoring.labelled_sentences(scoring.example_stream(spark, src, SCHEMA)), out, str(tmp_path / "cp")).awaitTermination(60)
    got = {(r.example_id, r.sentence.strip(), r.label) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "one", 1), (1, "two", 1), (3, "x", None)} and spark.read.parquet(out).count() == 3
