"""Queries of the core operators: (spark, sf_dir) -> DataFrame, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import maths, text
from storyloom.functions.stem import stem_text
from storyloom.operators import evaluate, features, models, ordinal, ranking, responses, scoring, segment, shred, weights
from storyloom.session import checkpoint, shared_folder, table, union_all
from storyloom.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]

#: Terms of the vocabulary cap in ``top_terms``.
VOCABULARY = 500
#: Weights and thresholds of the ordinal queries.
ORDINAL_W, ORDINAL_THETA = [0.02, -1.5, 2.0], [0.2, 0.6, 1.1, 1.5, 2.0, 2.6, 3.0]
#: The cell of ``roc_cell``, one of the grid.
CELL = {"max_feat": 300, "c": 0.1, "ngram": 1}


# --- views of the test tables ---


def passages(spark: SparkSession, d: str) -> DataFrame:
    """One row a passage, the latest loaded."""
    return responses.latest(table(spark, d, "passage"), "passage_id", ["loaded_at", "speaker", "text"])


def examples(spark: SparkSession, d: str) -> DataFrame:
    """One row an example, the latest loaded."""
    return responses.latest(table(spark, d, "example"), "example_id", ["loaded_at", "score", "coder_code"])


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Transcript lines rebuilt from scenes and passages: a heading a scene, then ``label: text`` a passage."""
    head = table(spark, d, "scene").where("scene_name is not null").groupBy("narr_id", "scene_idx").agg(F.min("scene_name").alias("line")).select("narr_id", "scene_idx", F.lit(-1).alias("a"), F.lit(-1).cast("long").alias("b"), "line")
    body = passages(spark, d).where("text is not null").select("narr_id", "scene_idx", F.col("passage_idx").alias("a"), F.col("passage_id").alias("b"), F.concat(F.coalesce(F.concat("speaker", F.lit(": ")), F.lit("")), F.regexp_replace("text", "\n", " ")).alias("line"))
    rows = head.unionByName(body).where("narr_id is not null")
    order = F.expr("row_number() over (partition by narr_id order by scene_idx, a, b)")
    return rows.select("narr_id", order.alias("line_no"), "line")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Response records of all scenes."""
    own = responses.respondent_examples(examples(spark, d), passages(spark, d))
    return responses.scene_records(table(spark, d, "scene"), own)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return responses.clean_records(records(spark, d))


def docs(spark: SparkSession, d: str) -> DataFrame:
    """``(example_id, label, doc)``: cleaned example texts with their labels, of rows loaded at once the same on every reading."""
    rows = table(spark, d, "example").select("example_id", "loaded_at", "score", "coder_code", "text")
    return responses.latest(rows, "example_id", ["loaded_at", "score", "coder_code", "text"]).where("text is not null").select("example_id", text.score_label(F.col("score")).alias("label"), text.clean_text(F.col("text")).alias("doc"))


def doc_terms(spark: SparkSession, d: str) -> DataFrame:
    return features.terms(docs(spark, d), "example_id", "doc")


def doc_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return features.tfidf(checkpoint(doc_terms(spark, d)), "example_id", docs(spark, d).count())


def class_coefs(spark: SparkSession, d: str, tfidf: DataFrame | None = None) -> DataFrame:
    """``(label, term, coef)``: mean tf-idf of a term in the documents of a class, as stand-in for coefficients."""
    tfidf = doc_tfidf(spark, d) if tfidf is None else tfidf
    labelled = docs(spark, d).where("label is not null").select("example_id", "label")
    sums = tfidf.join(labelled, "example_id").groupBy("label", "term").agg(F.sum("tfidf").alias("s"))
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    return sums.join(F.broadcast(sizes), "label").select("label", "term", F.round(F.col("s") / F.col("n"), 9).alias("coef"))


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Labelled examples with three made-up probabilities that sum to 1."""
    e = examples(spark, d).where("text is not null")
    a, b, c = F.length("text") % 7 + 1, F.col("example_id") % 5 + 1, F.length("text") % 11 + 1
    total = (a + b + c).cast("double")
    return e.select("example_id", text.score_label(F.col("score")).alias("label"), (a / total).alias("low"), (b / total).alias("no"), (c / total).alias("high"))


def line_items(spark: SparkSession, d: str) -> DataFrame:
    """``(l_orderkey, l_linenumber, x, y)``: three numbers and the class index of the line number."""
    x = F.array((F.col("l_quantity")).cast("double"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), (F.col("l_linenumber") - 1).cast("int").alias("y"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 3 - 1).cast("int").alias("label"))


def six(c) -> F.Column:
    return F.round(c, 6)


# --- text ---


def _text_query(fn, name: str) -> Query:
    return lambda spark, d: examples(spark, d).where("text is not null").select("example_id", fn(F.col("text")).alias(name))


def speaker_tags(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("narr_id", "line_no", text.tag_of(F.col("line")).alias("tag"), text.speaker_of(F.col("line")).alias("speaker"), text.is_heading(F.col("line")).alias("heading"))


def stemmed_text(spark: SparkSession, d: str) -> DataFrame:
    base = text.squeeze_spaces(text.remove_non_alphabet(text.remove_parentheses(F.col("text"))))
    return examples(spark, d).where("text is not null").select("example_id", F.lower(stem_text(base)).alias("stemmed"))


def blank_filter(intended: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = cleaned(spark, d)
        return (rows.where(F.trim("text") != "") if intended else rows).select("narr_id", "scene_idx", F.length("text").alias("n_chars"))

    return run


def file_names(spark: SparkSession, d: str) -> DataFrame:
    digits = F.trim("narrative_num")
    return table(spark, d, "narrative").where(digits.rlike("^[0-9]{1,9}$")).select("narr_id", text.file_name(digits).alias("file_name")).distinct()


# --- scenes and sentences ---


def scene_passages(spark: SparkSession, d: str) -> DataFrame:
    return segment.scene_passages(lines(spark, d), "narr_id")


def scene_scores_joined(spark: SparkSession, d: str) -> DataFrame:
    scenes = table(spark, d, "scene").where("scene_id is not null").select("scene_id", "narrative_num", "scene_name").distinct()
    return segment.with_scene_scores(scenes, segment.scene_scores(table(spark, d, "narrative_score"))).select("scene_id", "narrative_num", "scene_name", "agency", "communion")


def scene_examples(spark: SparkSession, d: str) -> DataFrame:
    """One row an example of a scene's array, with its position."""
    return records(spark, d).select("narr_id", "scene_idx", F.posexplode("examples").alias("k", "e")).select("narr_id", "scene_idx", "k", "e.text", "e.score")


def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Longest overlap of every sentence with every example of its scene."""
    rows = scoring.sentence_rows(cleaned(spark, d))
    return rows.select("narr_id", "scene_idx", "sentence_idx", F.posexplode(F.transform("examples", lambda e: text.longest_run(F.col("words"), e.words))).alias("k", "overlap"))


def containment(spark: SparkSession, d: str) -> DataFrame:
    """First example of the scene that contains the sentence."""
    rows = scoring.sentence_rows(cleaned(spark, d))
    at = F.array_min(F.filter(F.transform("examples", lambda e, k: F.when(F.contains(e.text, F.col("sentence")), k)), lambda k: k.isNotNull()))
    return rows.select("narr_id", "scene_idx", "sentence_idx", at.alias("k")).where("k is not null")


def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored_sentences(cleaned(spark, d)).select("narr_id", "scene_idx", "sentence_idx", "score")


# --- features and splits ---


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return features.train_test_split(docs(spark, d).select("example_id", "label"), "example_id")


def fold_rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.shuffle_split(docs(spark, d).where("label is not null").select("example_id", "label"), "example_id", 50)


def grid(spark: SparkSession, d: str) -> DataFrame:
    """All 1,600 cells with a made-up value (no data is read)."""
    value = (F.col("i") * 37 + F.col("j") * 101 + F.col("k") * 53) % 97
    return evaluate.param_grid(spark).withColumn("roc", value / 100.0)


# --- evaluation and weights ---


def rollup_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = examples(spark, d).select("passage_id", text.score_label(F.col("score")).alias("label")).where("label is not null and passage_id is not null")
    return evaluate.passage_rollup(rows, ["passage_id"], "label")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.predict_from_probs(probabilities(spark, d), "low", "no", "high")


def labelled_predictions(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).where("label is not null")


def mae_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_predictions(spark, d).select("label", "prediction", (F.col("example_id") % 5).alias("fold"), F.lit("lift").alias("model"))
    return evaluate.mean_absolute_error(rows, ["model"], "label", "prediction").select("model", six("mae").alias("mae"))


def weight_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).where("label is not null")
    tfidf = checkpoint(doc_tfidf(spark, d).select("example_id", "term", "tfidf"))
    return weights.word_weights(rows, "example_id", "doc", "label", class_coefs(spark, d, tfidf), tfidf)


def scaled_weights(spark: SparkSession, d: str) -> DataFrame:
    """Word weights on the scale of the highlight colours."""
    rows = checkpoint(weight_rows(spark, d).withColumn("weight", six("weight")))
    return weights.normalize_weights(rows).withColumn("normalized", six("normalized"))


def normalized_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = line_items(spark, d).select("l_orderkey", "l_linenumber", F.element_at("x", 1).alias("weight"))
    return weights.normalize_weights(rows)


# --- models ---


def ovr_logistic(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    model = models.OneVsRest.fit(rows, "x", "label", c=1.0)
    return rows.select("vec_id", "label", model.predict("x").alias("prediction"), six(F.element_at(model.probabilities("x"), 1)).alias("p_low"))


def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = line_items(spark, d)
    model = models.Ridge.fit(rows, "x", "y")
    return rows.select("l_orderkey", "l_linenumber", model.predict("x", rounded=True).alias("prediction"))


def ordinal_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("y", F.col("label") + 1)
    model = ordinal.OrdinalLogistic.fit(rows, "x", "y", 3)
    return rows.select("vec_id", "y", model.predict("x").alias("prediction"))


def roc_cell(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpoint(features.train_test_split(docs(spark, d).where("label is not null"), "example_id"))
    # a grid of one cell: its rows stay sparse in memory, those of ``cell_roc`` become dense arrays
    cell = spark.createDataFrame([(0, 0, 0, CELL["max_feat"], CELL["c"], CELL["ngram"])], "i int, j int, k int, max_feat int, c double, ngram int")
    return models.grid_search(cell, rows.where("is_train"), rows.where("not is_train"), "example_id", "doc", "label").select((1 - F.col("roc")).alias("loss"))


def grid_search(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpoint(features.train_test_split(docs(spark, d).where("label is not null"), "example_id"))
    return models.grid_search(evaluate.param_grid(spark), rows.where("is_train"), rows.where("not is_train"), "example_id", "doc", "label")


def model_mae(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute error of the ordinal, logistic and ridge models over folds that hold every class."""
    rows = vectors(spark, d).withColumn("y", F.col("label") + 1)
    folds = checkpoint(evaluate.shuffle_split(rows, "vec_id", 50))
    parts = []
    for r in evaluate.complete_folds(folds, "y").collect():
        train, test = folds.where(f"fold = {r.fold} and not is_test"), folds.where(f"fold = {r.fold} and is_test")
        for name, p in (("ordinal", ordinal.OrdinalLogistic.fit(train, "x", "y", 3).predict("x")), ("logistic", models.OneVsRest.fit(train, "x", "y").predict("x")), ("ridge", models.Ridge.fit(train, "x", "y").predict("x", rounded=True))):
            parts.append(test.select(F.lit(name).alias("model"), "fold", "y", p.cast("double").alias("p")))
    return evaluate.mean_absolute_error(union_all(parts), ["model"], "y", "p")


def tfidf_refit(spark: SparkSession, d: str) -> DataFrame:
    """tf-idf of the test part by document frequencies of its own (observed) and of the training part (intended)."""
    split = features.train_test_split(docs(spark, d).select("example_id", "doc"), "example_id")
    return features.refit_tfidf(split, "example_id", "doc").select("example_id", "term", six("observed").alias("observed"), six("intended").alias("intended"))


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder all executors share; what is written there stays until the folder is cleared."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def score_sheet_read(spark: SparkSession, d: str) -> DataFrame:
    """The score sheet written as the CSV file it comes from, and read by position."""
    sheet = table(spark, d, "narrative_score").where("line_no is not null")
    cells = ["narrative_num", *[c for c in sheet.columns if c not in ("line_no", "narrative_num")]]
    rows = sheet.select("line_no", F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells]).alias("value"))
    head = spark.createDataFrame([(-(2**62), ",".join(cells))], "line_no long, value string")
    path = scratch(spark, "scores")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("line_no").select("value").write.text(path)  # one file, as the sheet is one
    return readers.read_scores(spark, path).drop("line_no")


def missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the usual range without a narrative."""
    found = table(spark, d, "narrative").where(F.trim("narrative_num").rlike("^[0-9]{1,9}$")).select(F.trim("narrative_num").alias("narrative_num"))
    return readers.missing_numbers(spark, found, 1, 164)


def scenes_read(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned scenes written and read again."""
    path = scratch(spark, "scenes")
    writers.write_scenes(cleaned(spark, d), path)
    return readers.read_scenes(spark, path).select("narr_id", "scene_idx", F.length("text").alias("n_chars"))


def xml_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Scene passages written as XML and read again."""
    path = scratch(spark, "narratives")
    writers.write_narrative_xml(writers.narrative_trees(scene_passages(spark, d), "narr_id"), path)
    flat = readers.flat_examples(readers.read_narrative_xml(spark, path))
    return flat.select(F.col("narrative_num").cast("long").alias("narr_id"), "scene_idx", "scene_name", "passage_idx", "speaker", F.coalesce("passage_text", F.lit("")).alias("text"))


QUERIES: dict[str, Query] = {
    "scene_passages": scene_passages,
    "respondent_examples": lambda s, d: responses.respondent_examples(examples(s, d), passages(s, d)).select("example_id", "passage_id", "score"),
    "respondent_examples_agency": lambda s, d: responses.respondent_examples(examples(s, d), passages(s, d), "agency").select("example_id", "passage_id", "score"),
    "strip_parens": _text_query(text.remove_parentheses, "stripped"),
    "alpha_only": _text_query(text.remove_non_alphabet, "alpha"),
    "squeeze_spaces": _text_query(text.squeeze_spaces, "squeezed"),
    "clean_text": _text_query(text.clean_text, "cleaned"),
    "stemmed_text": stemmed_text,
    "blank_filter_observed": blank_filter(False),
    "blank_filter_intended": blank_filter(True),
    "speaker_tag": speaker_tags,
    "strip_speaker": lambda s, d: lines(s, d).select("narr_id", "line_no", text.remove_speaker(F.col("line")).alias("stripped")),
    "file_names": file_names,
    "scene_scores_unpivot": lambda s, d: segment.scene_scores(table(s, d, "narrative_score")),
    "scene_scores_joined": scene_scores_joined,
    "scene_text": lambda s, d: records(s, d).select("narr_id", "scene_idx", "text"),
    "scene_examples": scene_examples,
    "sentences": lambda s, d: scoring.scene_sentences(cleaned(s, d)),
    "word_overlap": word_overlap,
    "containment": containment,
    "sentence_scores": sentence_scores,
    "score_labels": lambda s, d: examples(s, d).select("example_id", "score", text.score_label(F.col("score")).alias("label")),
    "train_test_split": lambda s, d: split_rows(s, d).select("example_id", "label", "is_train"),
    "split_counts": lambda s, d: split_rows(s, d).groupBy("is_train").agg(F.count("*").alias("n")),
    "unpaired_split": lambda s, d: features.unpaired_split(docs(s, d).select("example_id", "label"), "example_id", "label"),
    "tokens": lambda s, d: doc_terms(s, d).groupBy("term").agg(F.sum("tf").alias("tf")),
    "ngram_terms": lambda s, d: features.terms(docs(s, d), "example_id", "doc", 3).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")),
    "top_terms": lambda s, d: features.top_terms(doc_terms(s, d), VOCABULARY),
    "doc_freq": lambda s, d: features.document_frequency(doc_terms(s, d)),
    "tfidf": lambda s, d: doc_tfidf(s, d).select("example_id", "term", six("tfidf").alias("tfidf")),
    "class_term_weights": lambda s, d: class_coefs(s, d).select("label", "term", six("coef").alias("coef")),
    "top_features_by_class": lambda s, d: features.top_features(class_coefs(s, d), 20).select("label", "term", "rank"),
    "joined_features": lambda s, d: features.joined_features(features.top_features(class_coefs(s, d), 20)),
    "top_bottom_features": lambda s, d: features.top_and_bottom(class_coefs(s, d).where("label = 1"), 15).select("term", "side"),
    "auc_low_high": lambda s, d: ranking.roc_area(probabilities(s, d).where("label <> 0").select((F.col("label") == 1).alias("p"), F.round(F.col("high") - F.col("low"), 9).alias("s")), "p", "s").select(six("auc").alias("auc")),
    "predict_from_probs": lambda s, d: predictions(s, d).select("example_id", "prediction"),
    "passage_rollup": rollup_rows,
    "confusion_recall": lambda s, d: evaluate.recall_by_class(labelled_predictions(s, d), "label", "prediction").select("label", "n", six("recall").alias("recall")),
    "accuracy": lambda s, d: evaluate.accuracy(labelled_predictions(s, d), "label", "prediction").select(six("accuracy").alias("accuracy")),
    "mae": mae_rows,
    "param_grid": lambda s, d: evaluate.param_grid(s).select("max_feat", F.round("c", 9).alias("c"), "ngram"),
    "grid_best": lambda s, d: evaluate.grid_best(grid(s, d)).select("which", "max_feat", F.round("c", 9).alias("c"), "ngram", "roc"),
    "grid_pivot": lambda s, d: evaluate.grid_pivot(grid(s, d), 2),
    "cv_folds": lambda s, d: fold_rows(s, d).select("fold", "example_id", "is_test"),
    "complete_folds": lambda s, d: evaluate.complete_folds(fold_rows(s, d), "label"),
    "sigmoid": lambda s, d: line_items(s, d).select("l_orderkey", "l_linenumber", six(maths.sigmoid((F.element_at("x", 1) - 25) * 2)).alias("p")),
    "softplus": lambda s, d: line_items(s, d).select("l_orderkey", "l_linenumber", six(maths.softplus_neg((F.element_at("x", 1) - 25) * 2)).alias("p")),
    "ordinal_objective": lambda s, d: ordinal.objective(line_items(s, d), "x", "y", ORDINAL_W, ORDINAL_THETA).select(F.round("objective", 2).alias("objective")),
    "ordinal_predict": lambda s, d: line_items(s, d).select("l_orderkey", "l_linenumber", maths.ordinal_class(F.round(maths.dot(F.col("x"), ORDINAL_W), 9), ORDINAL_THETA).alias("k")),
    "class_index": lambda s, d: ordinal.class_index(examples(s, d).where("score is not null").select("example_id", "score"), "score").select("example_id", F.col("y").cast("int").alias("y")),
    "normalize_weights": lambda s, d: normalized_rows(s, d).select("l_orderkey", "l_linenumber", six("normalized").alias("normalized")),
    "highlight": lambda s, d: weights.colored_words(normalized_rows(s, d)).select("l_orderkey", "l_linenumber", "highlight"),
    "word_weights": lambda s, d: weight_rows(s, d).select("example_id", "word_idx", "word", six("weight").alias("weight")),
    "colored_text": lambda s, d: weights.colored_text(weights.colored_words(scaled_weights(s, d)), "example_id"),
    "residuals": lambda s, d: labelled_predictions(s, d).select("example_id", (F.col("prediction") - F.col("label")).alias("residual")),
    "class_column": lambda s, d: docs(s, d).where("label is not null").select("example_id", F.element_at(F.array(F.lit("low"), F.lit("no"), F.lit("high")), F.col("label") + 2).alias("column")),
    "tfidf_refit": tfidf_refit,
    "grid_search": grid_search,
    "model_mae": model_mae,
    "color_key": lambda s, d: weights.color_key(s),
    "ovr_logistic": ovr_logistic,
    "ridge_fit": ridge_fit,
    "ordinal_fit": ordinal_fit,
    "roc_cell": roc_cell,
    "xml_roundtrip": xml_roundtrip,
    "score_sheet_read": score_sheet_read,
    "missing_numbers": missing_numbers,
    "scenes_read": scenes_read,
    "p5_found": lambda s, d: shred.entities(table(s, d, "tagged_record"), fields=False).select("raw_id", "scene_idx", "passage_idx", "example_idx"),
    "p5_scene": lambda s, d: shred.entity_table(table(s, d, "tagged_record"), "scene"),
    "p5_passage": lambda s, d: shred.entity_table(table(s, d, "tagged_record"), "passage"),
    "p5_example": lambda s, d: shred.entity_table(table(s, d, "tagged_record"), "example"),
}
