import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import evaluate, features, models, ordinal, ranking, responses, scoring, segment, weights
from storyloom.plans import queries


def passages_of(spark, transcripts):
    rows = [(k, i, line) for k, lines in transcripts.items() for i, line in enumerate(lines)]
    out = {}
    for r in segment.scene_passages(spark.createDataFrame(rows, "narrative_num int, line_no int, line string")).orderBy("narrative_num", "scene_idx", "passage_idx").collect():
        out.setdefault(r.narrative_num, []).append((r.scene_idx, r.passage_idx, r.speaker, r.text))
    return out


def sequential(lines):
    """The segmentation as a state machine over the lines."""
    import re

    tags = {"I": "Interviewer", "R": "Respondent"}
    scenes, scene, speaker, passage = [], None, "Interviewer", ""
    for line in lines:
        head, colon, _ = line.partition(":")
        tag = tags.get(head) if colon else None
        if line.upper() in ("HIGH POINT", "LOW POINT", "TURNING POINT"):
            if scene is not None:
                scene.append((speaker, passage))
                passage = ""
            scene, speaker = [], "Interviewer"
            scenes.append(scene)
        elif tag is None:
            passage += " " + line
        elif tag == speaker:
            passage += " " + re.sub(r"\A\w*\s*\w*:\s*", "", line)
        elif scene is not None:
            scene.append((speaker, passage))
            speaker, passage = tag, re.sub(r"\A\w*\s*\w*:\s*", "", line)
    if scene is None:
        return []
    scene.append((speaker, passage))
    return [(i, j, s, t) for i, ps in enumerate(scenes) for j, (s, t) in enumerate(ps)]


def test_segmentation_cases(spark):
    got = passages_of(spark, {1: ["R: low", "HIGH POINT", "R: b: c"], 2: ["hello", "HIGH POINT", "I: a"], 3: ["HIGH POINT", "R: a", "X: y", "r: z"], 4: ["no heading"], 5: ["Low Point"]})
    assert got == {
        1: [(0, 0, "Interviewer", ""), (0, 1, "Respondent", "b: c")],
        2: [(0, 0, "Interviewer", " hello a")],
        3: [(0, 0, "Interviewer", ""), (0, 1, "Respondent", "a X: y r: z")],
        5: [(0, 0, "Interviewer", "")],
    }


def test_segmentation_random(spark):
    r = random.Random(3)
    kinds = ["HIGH POINT", "low point", "I: q", "R: a", "more", "R: b c", "I: w: z", "odd: x"]
    cases = {k: [r.choice(kinds) for _ in range(r.randint(1, 14))] for k in range(80)}
    got = passages_of(spark, cases)
    for k, lines in cases.items():
        assert got.get(k, []) == sequential(lines)


def test_score_sheet_last_line_wins(spark):
    cols = "line_no long, narrative_num string, high_agency string, high_communion string, low_agency string, low_communion string, turning_agency string, turning_communion string, extra string"
    df = spark.createDataFrame([(1, "7", "a", "b", "c", "d", "e", "f", "x"), (2, "7", "g", None, "i", "j", "k", "l", "x"), (3, None, "z", "z", "z", "z", "z", "z", "x")], cols)
    got = {(r.narrative_num, r.scene_name, r.agency, r.communion) for r in segment.scene_scores(df).collect()}
    assert got == {("7", "HIGH POINT", "g", None), ("7", "LOW POINT", "i", "j"), ("7", "TURNING POINT", "k", "l")}


def test_records_and_sentence_scores(spark):
    scenes = spark.createDataFrame([(1, 0), (1, 1)], "narr_id long, scene_idx int")
    ex = spark.createDataFrame([(1, 0, 2, 0, 10, "I did it. It was good.", 2.0), (1, 0, 4, 0, 11, "Then nothing happened.", 0.0)], "narr_id long, scene_idx int, passage_idx int, example_idx int, example_id long, text string, score double")
    rec = responses.scene_records(scenes, ex)
    assert {(r.scene_idx, r.text, len(r.examples)) for r in rec.collect()} == {(0, " I did it. It was good. Then nothing happened.", 2), (1, "", 0)}
    clean = responses.clean_records(rec)
    for observed in (False, True):
        got = [(r.sentence_idx, r.sentence, r.score) for r in scoring.scored_sentences(clean, observed).orderBy("sentence_idx").collect()]
        assert [g[2] for g in got if g[1].strip()] == [2.0, 2.0, 0.0]
        assert got[0][1] == "  i did it"
    assert responses.clean_records(rec, drop_blank=True).count() == 1


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (1, None, "c"), (None, 9, "d")], "id int, at int, v string")
    assert [tuple(r) for r in responses.latest(df, "id", ["at"]).collect()] == [(1, 9, "b")]


def test_roc_area(spark):
    r = random.Random(5)
    rows = [(bool(r.random() < 0.4), float(r.randint(0, 30))) for _ in range(700)]
    pos, neg = [s for p, s in rows if p], [s for p, s in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "p boolean, s double")
    assert ranking.roc_area(df, "p", "s", cuts=8).first().auc == pytest.approx(want)
    assert ranking.roc_area(df.where("p"), "p", "s").first().auc is None
    assert ranking.roc_area(df.where("false"), "p", "s").first().auc is None


def test_global_row_number(spark):
    df = spark.range(1000).withColumn("h", ranking.portable_hash(F.col("id")))
    got = [r.rn for r in ranking.global_row_number(df, "h", ["id"]).orderBy("h", "id").collect()]
    assert got == list(range(1, 1001))


def test_split_is_exact_and_paired(spark):
    df = spark.range(101).withColumn("label", F.col("id") % 3)
    out = features.train_test_split(df, "id")
    assert out.where("is_train").count() == 67 and out.where("label <> id % 3").count() == 0
    other = features.unpaired_split(df, "id", "label")
    assert other.count() == 101 and other.where("label <> id % 3").count() > 20
    assert features.train_test_split(df.where("false"), "id").count() == 0


def test_tfidf_rows_have_length_one(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "id int, doc string")
    counts = features.terms(docs, "id", "doc")
    out = features.tfidf(counts, "id", 2)
    for r in out.groupBy("id").agg(F.sum(F.col("tfidf") ** 2).alias("n")).collect():
        assert r.n == pytest.approx(1)
    idf = {r.term: r.idf for r in out.collect()}
    assert idf["b"] == pytest.approx(1) and idf["a"] == pytest.approx(np.log(3 / 2) + 1)


@pytest.mark.parametrize("scores, expected", [((-1, 1, 0), 1), ((-1, 0, -1), -1), ((0, 0), None)])
def test_rollup(spark, scores, expected):
    df = spark.createDataFrame([(1, s) for s in scores], "k int, s int")
    assert evaluate.passage_rollup(df, ["k"], "s").first().rollup == expected


def test_lift_prediction_ties_give_zero(spark):
    df = spark.createDataFrame([(0.2, 0.3, 0.5), (0.6, 0.2, 0.2), (0.4, 0.25, 0.35)], "a double, b double, c double")
    got = [r.prediction for r in evaluate.predict_from_probs(df, "a", "b", "c").collect()]
    assert got[0] == 1 and got[1] == -1


def test_grid(spark):
    grid = evaluate.param_grid(spark)
    assert grid.count() == 1600 and grid.agg(F.min("c"), F.max("c")).first() == (1e-4, 0.1)
    best = {r.which: r for r in evaluate.grid_best(grid.withColumn("roc", F.lit(0.5))).collect()}
    assert (best["best"].max_feat, best["best"].ngram) == (300, 1) and best["worst"].max_feat == 300


def test_normalize(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,)], "weight double")
    assert [r.normalized for r in weights.normalize_weights(df).orderBy("weight").collect()] == [0.0, 2.0]
    zero = spark.createDataFrame([(0.0,)], "weight double")
    assert weights.normalize_weights(zero).first().normalized is None


def test_word_weights_default_to_zero(spark):
    docs = spark.createDataFrame([(1, "alpha béta", 1)], "id int, doc string, label int")
    coefs = spark.createDataFrame([("alpha", 1, 0.5)], "term string, label int, coef double")
    tf = spark.createDataFrame([(1, "alpha", 0.4)], "id int, term string, tfidf double")
    got = {(r.word, round(r.weight, 6)) for r in weights.word_weights(docs, "id", "doc", "label", coefs, tf).collect()}
    assert got == {("alpha", 0.2), ("bta", 0.0)}


def test_observed_label_collapse():
    assert ordinal.observed_class_index([-1, -1, 0, 0, 1, 1]) == [2] * 6


def test_class_index(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (None,)], "s int")
    assert {(r.s, r.y) for r in ordinal.class_index(df, "s").collect()} == {(-1, 0), (0, 1), (1, 2)}


def test_ordinal_gradient():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(40, 3)), r.integers(0, 4, 40)
    w, theta = r.normal(size=3), np.array([-1.0, 0.2, 1.1])
    _, g = ordinal.loss_and_gradient(x, y, w, theta)
    for i in range(6):
        z = np.concatenate([w, theta])
        lo, hi = z.copy(), z.copy()
        lo[i] -= 1e-6
        hi[i] += 1e-6
        num = (ordinal.loss_and_gradient(x, y, hi[:3], hi[3:])[0] - ordinal.loss_and_gradient(x, y, lo[:3], lo[3:])[0]) / 2e-6
        assert g[i] == pytest.approx(num, abs=1e-4)


def test_models_learn(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 2))
    y = np.digitize(x @ [2.0, -1.0], [-1.0, 1.0])
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "x array<double>, y int")
    fit = ordinal.OrdinalLogistic.fit(df, "x", "y", 3)
    assert df.where(fit.predict("x") == F.col("y")).count() > 270
    assert fit.theta[0] < fit.theta[1]
    ovr = models.OneVsRest.fit(df, "x", "y")
    assert df.where(ovr.predict("x") == F.col("y")).count() > 200
    ridge = models.Ridge.fit(df, "x", "y", alpha=2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(2), xc.T @ yc)
    assert np.allclose(ridge.coefs, want, atol=1e-3)


def test_shuffle_orders_are_permutations_and_differ():
    a, b = features.shuffle_orders(50)
    assert sorted(a) == sorted(b) == list(range(50)) and a != b
    assert features.shuffle_orders(50) == [a, b] and features.shuffle_orders(0) == [[], []]


def test_grid_search_varies_every_parameter(spark):
    texts = ["he went away alone", "she took the lead and won", "we sat and talked", "they lost the house again", "i decided to go on", "nothing was planned at all"]
    rows = spark.createDataFrame([(i, texts[i % 6] + " " + texts[(i * 5 + i // 7) % 6], (i * 7 + i // 5) % 3 - 1) for i in range(120)], "id long, doc string, label int")
    train, test = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    got = models.grid_search(evaluate.param_grid(spark, 8, 14, 6, n_c=2, c_from=-2, c_to=0, max_ngram=2), train, test, "id", "doc", "label").collect()
    assert [(r.max_feat, r.c, r.ngram) for r in got] == [(m, c, n) for m in (8, 14) for c in (0.01, 1.0) for n in (1, 2)]
    assert len({r.roc for r in got}) > 2
    for r in (got[0], got[7]):
        assert abs(1 - models.cell_roc(train, test, "id", "doc", "label", r.max_feat, r.c, r.ngram).first().loss - r.roc) < 0.01


def test_registered_grid_is_whole(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(queries.models, "grid_search", lambda cells, *_: seen.update(n=cells.count()))
    monkeypatch.setattr(queries, "docs", lambda *_: spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "example_id long, label int, doc string"))
    queries.grid_search(spark, "")
    assert seen["n"] == 1600


def test_model_mae_takes_all_folds_and_fits_fully(spark, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def split(rows, id_col, folds):
        seen["folds"] = folds
        return shuffle_split(rows, id_col, 1)

    def fit(*args, **kwargs):
        seen["fit"] = kwargs
        raise Stop

    shuffle_split = evaluate.shuffle_split
    monkeypatch.setattr(queries, "vectors", lambda *_: spark.createDataFrame([(i, [float(i)], i % 3 - 1) for i in range(30)], "vec_id long, x array<double>, label int"))
    monkeypatch.setattr(queries.evaluate, "shuffle_split", split)
    monkeypatch.setattr(queries.ordinal.OrdinalLogistic, "fit", fit)
    with pytest.raises(Stop):
        queries.model_mae(spark, "")
    assert seen == {"folds": 50, "fit": {}}


@pytest.mark.parametrize("shift", [0, 3_474_701_532, 10**12, 2**62])
def test_portable_hash_of_large_keys(spark, shift):
    keys = [shift, shift + 1, shift + 999]
    got = spark.createDataFrame([(k,) for k in keys], "id long").select(ranking.portable_hash(F.col("id")).alias("h")).collect()
    assert [r.h for r in got] == [k * 2654435761 % 2**32 for k in keys]


def by_hash(keys, of=lambda k: k):
    return sorted(keys, key=lambda k: (of(k) * 2654435761 % 2**32, k))


def test_train_test_split_of_large_keys(spark):
    keys = [10**12 + 7 * k for k in range(100)]
    rows = features.train_test_split(spark.createDataFrame([(k,) for k in keys], "id long"), "id").collect()
    assert {r.id for r in rows if r.is_train} == set(by_hash(keys)[:66]) and len(rows) == 100


def test_split_counts_of_large_keys(spark, monkeypatch):
    monkeypatch.setattr(queries, "docs", lambda *_: spark.range(2**62, 2**62 + 50).select(F.col("id").alias("example_id"), F.lit(1).alias("label"), F.lit("a").alias("doc")))
    assert {r.is_train: r.n for r in queries.QUERIES["split_counts"](spark, "").collect()} == {True: 33, False: 17}


def test_unpaired_split_of_the_largest_keys(spark):
    keys = [2**63 - 1 - 3 * k for k in range(50)]
    rows = features.unpaired_split(spark.createDataFrame([(k, str(k)) for k in keys], "id long, label string"), "id", "label").collect()
    left, right = by_hash(keys), by_hash(keys, lambda k: k + 7)
    assert {r.id: (int(r.label), r.is_train) for r in rows} == {a: (b, at < 33) for at, (a, b) in enumerate(zip(left, right, strict=True))}


@pytest.mark.parametrize("shift", [10**12, 2**62])
def test_shuffle_split_of_large_keys(spark, shift):
    keys = [shift + 5 * k for k in range(100)]
    rows = evaluate.shuffle_split(spark.createDataFrame([(k,) for k in keys], "id long"), "id", 3).collect()
    for f in range(3):
        assert {r.id for r in rows if r.fold == f and r.is_test} == set(by_hash(keys, lambda k: k * 31 + 1009 * (f + 1))[:10])  # noqa: B023


def large_docs(spark, n):
    return spark.range(n).select((F.col("id") + 2**62).alias("example_id"), (F.col("id") % 3 - 1).cast("int").alias("label"), F.concat_ws(" ", F.lit("word"), F.when(F.col("id") % 3 == 2, "won").otherwise("lost"), F.col("id").cast("string")).alias("doc"))


def test_complete_folds_of_large_keys(spark, monkeypatch):
    monkeypatch.setattr(queries, "docs", lambda *_: large_docs(spark, 60))
    assert {r.fold for r in queries.QUERIES["complete_folds"](spark, "").collect()} == set(range(50))


def test_tfidf_refit_of_large_keys(spark, monkeypatch):
    monkeypatch.setattr(queries, "docs", lambda *_: large_docs(spark, 60))
    rows = queries.tfidf_refit(spark, "").collect()
    assert {r.example_id for r in rows} == set(by_hash(range(2**62, 2**62 + 60))[40:]) and all(r.observed for r in rows)
    assert all((r.intended is None) == r.term.isdigit() for r in rows)


@pytest.mark.parametrize("most", [1 << 22, 30])
def test_areas_of_blocks_are_those_of_all_pairs(spark, most):
    r = np.random.default_rng(3)
    blocks = [(r.random(50) < 0.4, r.integers(-9, 9, (50, 3)) * 10**11) for _ in range(4)]
    blocks[0][1][:, 2] = 10**12
    got = models._areas(spark.sparkContext.parallelize(blocks, 4), 3, 200, most)
    high, value = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
    for q in range(3):
        a, b = value[high, q][:, None], value[~high, q][None, :]
        assert got[q] == ((a > b) + (a == b) / 2).mean()
    assert models._areas(spark.sparkContext.parallelize([(np.ones(3, bool), np.zeros((3, 1), np.int64))], 1), 1, 3) == {}
    assert models._areas(spark.sparkContext.parallelize([], 1), 2, 0) == {}


@pytest.mark.parametrize("ngram", [1, 3])
def test_counts_of_lines_are_those_of_terms(spark, ngram):
    rows = spark.createDataFrame([(1, 0, "a b a  b. c"), (2, 1, ""), (3, 1, "b c b c"), (4, 1, None)], "id int, label int, doc string")
    terms = features.terms(rows, "id", "doc", ngram)
    want = {r.term: (r.tf, r.df) for r in terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).collect()}
    assert {r.term: (r.tf, r.df) for r in models._counts(models._lines(rows, "label", "doc"), ngram).collect()} == want


def test_roc_cell_of_large_keys(spark, monkeypatch):
    monkeypatch.setattr(queries, "docs", lambda *_: large_docs(spark, 60))
    assert queries.roc_cell(spark, "").first().loss < 0.01


def test_tfidf_refit_shuffles_only_texts(spark, monkeypatch):
    monkeypatch.setattr(queries, "docs", lambda *_: large_docs(spark, 600))
    out = queries.tfidf_refit(spark, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(example_id") == 1 and "SortMergeJoin" not in plan
    rows = {(r.example_id, r.term): (r.observed, r.intended) for r in out.collect()}
    monkeypatch.setattr(features, "driver_share", lambda _: 0)  # terms that do not fit are joined with salts
    again = queries.tfidf_refit(spark, "").collect()
    assert len(again) == len(rows) and rows == {(r.example_id, r.term): (r.observed, r.intended) for r in again}
    assert {k for k, _ in rows} == set(by_hash(range(2**62, 2**62 + 600))[396:])
    for k in {k for k, _ in rows}:
        for side in (0, 1):
            assert sum(v[side] ** 2 for (i, _), v in rows.items() if i == k and v[side]) == pytest.approx(1, abs=1e-5)


def test_split_with_null_and_equal_keys(spark):
    keys = [None] * 50 + [7] * 30 + list(range(100, 120))
    rows = features.train_test_split(spark.createDataFrame([(k,) for k in keys], "id long"), "id").collect()
    assert len(rows) == 50 and all(r.is_train for r in rows)  # 66 of 100 rows, of which 50 have no key
    rows = features.train_test_split(spark.createDataFrame([(k,) for k in keys[50:]], "id long"), "id").collect()
    assert len(rows) == 50 and sum(r.is_train for r in rows) == 33


def test_split_ranks_one_range(spark):
    """Nothing is broadcast that takes a pass to compute: rows of the other ranges are only compared."""
    df = spark.range(5000)
    out = features.train_test_split(df, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Union" in plan
    assert {r.id for r in out.collect() if r.is_train} == set(by_hash(range(5000))[:3300])


def test_folds_wait_for_no_broadcast(spark):
    """What is broadcast is a row a fold that the driver holds already, not a pass over the table."""
    out = evaluate.shuffle_split(spark.range(500), "id", 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "HashAggregate" not in plan
    for f in range(4):
        assert {r.id for r in out.collect() if r.fold == f and r.is_test} == set(by_hash(range(500), lambda k: k * 31 + 1009 * (f + 1))[:50])  # noqa: B023


def test_complete_folds_need_every_class_of_the_table(spark):
    rows = [(0, 1, False), (0, 2, False), (0, None, False), (1, 1, False), (1, 2, True), (2, 1, False), (3, 1, True), (3, 2, True)]
    assert [r.fold for r in evaluate.complete_folds(spark.createDataFrame(rows, "fold int, label int, is_test boolean"), "label").collect()] == [0]
