from collections import Counter

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from turnlab.learning import features, models, scoring, splits
from turnlab.operators import build


@pytest.fixture(scope="module")
def conversations(spark):
    data = [(i, i // 6, ["greeting", "inform", "request", "thanks", "ap"][(i * (1 + i // 6)) % 5],
             "Compliance" if (i // 6) % 2 and i % 3 == 0 else "Resistance" if i % 3 == 0 else "Neutral",
             f"word{i % 4} thing", int(i % 5 == 0)) for i in range(180)]
    return spark.createDataFrame(
        data, "idx long, dialogue_id long, da_label string, pr_label string, sentence string, eml_label int")


def test_split_is_exact_and_stable(conversations, rows):
    one, two = (splits.stratified_split(conversations.repartition(n), "pr_label", "idx") for n in (1, 7))
    assert rows(one, "idx", "split") == rows(two, "idx", "split")
    sizes = Counter((r["pr_label"], r["split"]) for r in one.collect())
    for label in ("Compliance", "Resistance", "Neutral"):
        n = sizes[label, "train"] + sizes[label, "test"]
        assert sizes[label, "test"] == int(n * 0.2 + 0.5)


def test_split_narrows_its_ranges(spark, monkeypatch, rows):
    df = spark.range(900).select(F.col("id").alias("idx"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    want = rows(splits.stratified_split(df, "y", "idx"), "idx", "split")
    monkeypatch.setattr(splits, "RANGE_BITS", 2)
    assert rows(splits.stratified_split(df, "y", "idx"), "idx", "split") == want


def test_random_split_and_bound(spark):
    df = spark.range(4000).withColumnRenamed("id", "idx")
    sizes = dict(map(tuple, splits.random_split(df, "idx").groupBy("split").count().collect()))
    assert sizes["train"] + sizes["test"] == 4000 and 2650 < sizes["train"] < 2950
    one, two = ({r[0] for r in splits.bounded(df.repartition(n), "idx", 50).collect()} for n in (1, 6))
    assert one == two and len(one) == 50


def test_ordered_split(conversations):
    got = splits.ordered_split(conversations.repartition(5)).groupBy("split").agg(F.min("idx"), F.max("idx")).collect()
    assert {tuple(r) for r in got} == {("train", 0, 143), ("test", 144, 179)}


def test_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "y string")
    got = {(r["y"], round(r["weight"], 6)) for r in splits.add_class_weight(df, "y").collect()}
    assert got == {("a", round(8 / 12, 6)), ("b", 2.0)}


def test_sequence_features(conversations):
    acts = features.common_acts(conversations)
    row = features.sequence_features(conversations, acts).where("dialogue_id = 0").first()
    assert row["sequence_length"] == 6 and row["first_da"] == "greeting" and row["last_da"] == "greeting"
    assert row["da_diversity"] == pytest.approx(5 / 6) and row["da_greeting_count"] == 2
    assert row["da_greeting_ratio"] == pytest.approx(2 / 6)
    assert (row["has_request_inform"], row["has_greeting_closing"], row["starts_with_greeting"], row["ends_with_thanks"]) == (1, 0, 1, 0)


def test_rules_against_counting(conversations):
    tx = models.act_transactions(conversations, build.conversation_outcome(conversations))
    sets = [set(r["items"]) for r in tx.collect()]
    for r in models.outcome_rules(tx, 0.1, 0.3).collect():
        left, goal = set(r["antecedent"].split(",")), r["outcome"]
        both = sum(left | {goal} <= s for s in sets)
        alone = sum(left <= s for s in sets)
        assert r["support"] == pytest.approx(both / len(sets)) and r["confidence"] == pytest.approx(both / alone)


def test_text_features(conversations):
    model = Pipeline(stages=features.tfidf_stages()).fit(conversations)
    vector = model.transform(conversations).first()["text_features"]
    assert sum(v * v for v in vector.values) == pytest.approx(1) and len(vector.indices) == 3
    assert set(model.stages[4].vocabulary) == {"thing"} | {f"word{i}" for i in range(4)} | {f"word{i} thing" for i in range(4)}


def test_weights_table_is_the_stages(conversations):
    stages = Pipeline(stages=features.tfidf_stages()).fit(conversations)
    words = stages.stages[4].vocabulary
    want = {(r["idx"], words[i]): v for r in stages.transform(conversations).collect()
            for i, v in zip(r["text_features"].indices, r["text_features"].values)}
    got = {(r["idx"], r["term"]): r["weight"] for r in features.tfidf_weights(conversations, "idx").collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: v for k, v in got.items() if k in want}
    assert all(v == 0 for k, v in got.items() if k not in want)


def test_mode_of_a_tie_is_the_least(spark):
    t = spark.createDataFrame([(None, None, "b", "ap"), ("x", 1, "a", None), ("y", 0, None, "pa")],
                              "sentence string, eml_label int, pr_label string, da_label string")
    got = features.prepare_rows(t, categories=["pr_label"]).collect()
    assert [(r["sentence"], r["eml_label"], r["pr_label"]) for r in got] == [("", 0, "b"), ("x", 1, "a"), ("y", 0, "a")]


def test_each_act(spark):
    t = spark.createDataFrame([(1, 5, "b,a"), (1, 3, "c"), (1, 4, None)], "dialogue_id long, idx long, da_label string")
    assert [r["act"] for r in features.each_act(t).orderBy("at").collect()] == ["c", "b", "a"]


def test_models_fit_and_rank(conversations, spark):
    t = conversations.withColumn("eml_label", (F.col("pr_label") == "Compliance").cast("int"))
    model = models.fit_eml_model(t, trees=2, depth=3)
    scored = model.transform(models.eml_rows(t))
    assert scored.where("prediction = label").count() == t.count()
    top = models.feature_importance(spark, model.stages[-1], scored, top=3).first()
    assert top["rank"] == 1 and top["feature"].startswith("pr_onehot")


def test_forest_needs_conversations(conversations):
    table = features.sequence_features(conversations, ["ap"]).limit(3).withColumn("outcome", F.lit("Compliance"))
    with pytest.raises(ValueError):
        models.fit_outcome_forest(table)


def test_forest_reads_its_table_once(spark):
    """The stages of the fit read a kept table; the features of a conversation are not made again for each of them."""
    seen = spark.sparkContext.accumulator(0)

    def number(x):
        seen.add(1)
        return x % 7

    table = spark.range(80).select(F.col("id").alias("dialogue_id"), F.udf(number, "long")("id").alias("sequence_length"),
                                   F.lit("a").alias("first_da"), F.lit("b").alias("last_da"),
                                   F.when(F.col("id") % 2 == 0, "Compliance").otherwise("Resistance").alias("outcome"))
    model = models.fit_outcome_forest(table, trees=3, depth=2)
    assert seen.value == 80 and len(model.stages[-1].trees) == 3


def test_scoring_in_batches(spark):
    df = spark.createDataFrame([(i, "x y" if i % 2 else None) for i in range(150)], "id long, text string").repartition(3)
    got = scoring.score(df, "text", scoring.lexicon_scorer([["x", "y"], ["z"]]), batch=7).collect()
    assert all(r["probs"] == ([2.0, 0.0] if r["id"] % 2 else [0.0, 0.0]) for r in got) and len(got) == 150


def test_distinct_texts_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def run(texts):
            seen.add(len(texts))
            return [[float(len(x))] for x in texts]
        return run

    data = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else "" if i % 11 == 0 else f"text {i % 5}" * (i % 4)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, text string").repartition(5)
    got = {r["id"]: (r["text"], r["probs"]) for r in scoring.score_distinct(df, "text", load, batch=4).collect()}
    assert got == {i: (x, [float(len(x or ""))]) for i, x in data}
    assert seen.value == len({x or "" for _, x in data})
    assert scoring.score_distinct(df.limit(0), "text", load).columns == ["id", "text", "probs"]
