"""Classifiers on labels and text, importances and association rules."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, OneHotEncoder, StringIndexer
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from turnlab.functions.counts import rows_n
from turnlab.learning import boosting
from turnlab.learning.features import assembler, known_terms, label_index_stage, prepare_rows, tfidf_stages
from turnlab.learning.splits import add_class_weight
from turnlab.vocab import DA_CODES, VALID_PR

DA_COLUMNS = ["da_" + c for c in DA_CODES]


class BoostedModel:
    """Feature stages and a boosted model; ``outputs`` names its classes or flags."""

    def __init__(self, pipeline, booster, outputs):
        self.pipeline, self.booster, self.outputs = pipeline, booster, list(outputs)
        self.stages = [*pipeline.stages, booster]

    def features(self, rows):
        return self.pipeline.transform(rows)

    def transform(self, rows):
        """``rows`` with ``features``, ``probabilities`` (one per output) and ``prediction``: for classes the number of the most
        probable one (the first of equals), for one flag 0.0 or 1.0, for several flags an array of 0 and 1."""
        scored = boosting.transform(self.features(rows), self.booster)
        p = F.col("probabilities")
        if self.booster.loss == "softmax":
            guess = (F.array_position(p, F.array_max(p)) - 1).cast("double")
        elif len(self.outputs) == 1:
            guess = (p[0] > 0.5).cast("double")
        else:
            guess = F.transform(p, lambda x: (x > 0.5).cast("int"))
        return scored.withColumn("prediction", guess)


def _text_model(rows, stages, target, outputs, loss, trees, depth, rate):
    """A model of all ``rows``, which are kept until their terms are counted; ``target`` is an array of one number per output."""
    at = [isinstance(s, CountVectorizer) for s in stages].index(True)
    words = Pipeline(stages=stages[:at]).fit(rows)
    vocabulary = known_terms(words.transform(rows), stages[at])
    counted = vocabulary.transform(words.transform(rows))  # texts are read twice
    counted = counted.drop("sentence", "_tokens", "_words", "_pairs", "_terms").persist()
    rest = Pipeline(stages=stages[at + 1:]).fit(counted)
    shared = PipelineModel([*words.stages, vocabulary, *rest.stages])
    table = rest.transform(counted).select("features", target.cast("array<double>").alias("target"))
    rows.unpersist()
    fitted = BoostedModel(shared, boosting.fit(table, "target", loss, trees, depth, rate), outputs)
    counted.unpersist()
    return fitted


def _flags(columns):
    return F.array(*[F.col(c).cast("double") for c in columns])


def fit_pr_model(t, trees=150, depth=6, rate=0.1, vocabulary=5000,
                 inputs=("text_features", "eml_label", *DA_COLUMNS)):
    """Outcome from text, EML and acts (or fewer ``inputs``): one boosted model of all outcome classes (soft-max)."""
    rows = prepare_rows(t.where("pr_label is not null")).persist()
    classes = sorted(r[0] for r in rows.select("pr_label").distinct().collect())
    target = F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: (c == F.col("pr_label")).cast("double"))
    return _text_model(rows, tfidf_stages(vocabulary=vocabulary) + [assembler(inputs)], target, classes, "softmax",
                       trees, depth, rate)


def _outcome_onehot():
    return [StringIndexer(inputCol="pr_label", outputCol="_pr", stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCol="_pr", outputCol="pr_onehot", dropLast=False)]


def fit_eml_model(t, trees=150, depth=6, rate=0.1, vocabulary=5000,
                  inputs=("text_features", "pr_onehot", *DA_COLUMNS)):
    """EML from text, outcome and acts; the table to be scored must be prepared with ``eml_rows``."""
    rows = eml_rows(t).persist()
    stages = tfidf_stages(vocabulary=vocabulary) + _outcome_onehot() + [assembler(inputs)]
    return _text_model(rows, stages, _flags(["label"]), ["eml_label"], "logistic", trees, depth, rate)


def eml_rows(t):
    return prepare_rows(t, categories=["pr_label"]).withColumn("label", F.col("eml_label").cast("double"))


def fit_da_model(t, codes=tuple(DA_CODES), trees=150, depth=6, rate=0.1, vocabulary=5000,
                 inputs=("text_features", "eml_label", "pr_onehot")):
    """All acts by one boosted model with a flag for each act that some, but not all, rows of the fit have."""
    rows = prepare_rows(t.where("da_label is not null"), categories=["pr_label"]).persist()
    seen = rows.agg(*[F.avg("da_" + c).alias(c) for c in codes]).first()
    told = [c for c in codes if 0 < (seen[c] or 0) < 1]
    stages = tfidf_stages(vocabulary=vocabulary) + _outcome_onehot() + [assembler(inputs)]
    return _text_model(rows, stages, _flags(["da_" + c for c in told]), told, "logistic", trees, depth, rate)


def act_quality(scored, acts):
    """(act, n, n_true, accuracy, beats_majority) of rows scored by ``fit_da_model``, one row per act of the model."""
    each = [F.struct(F.lit(c).alias("act"), F.col("da_" + c).alias("gold"), F.col("prediction")[i].alias("guess"))
            for i, c in enumerate(acts)]
    long = scored.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    accuracy = F.avg((F.col("gold") == F.col("guess")).cast("double"))
    share = F.avg(F.col("gold").cast("double"))
    return long.groupBy("act").agg(rows_n().alias("n"), F.sum("gold").cast("long").alias("n_true"), accuracy.alias("accuracy"),
                                   (accuracy > F.greatest(share, 1 - share)).alias("beats_majority"))


def permuted_importance(model, rows, gold, key="idx", top=None):
    """Ranked (rank, feature, importance): the share of hits that ``rows``, a part kept from the fit, lose when one feature is
    dealt anew among them; features that the trees don't use lose none and are left out.

    Names are those of the assembled inputs; a text feature is named by its term.
    """
    table = model.features(rows)
    found = boosting.permutation_importance(table, model.booster, gold, key)
    names = feature_names(model.pipeline.stages, table)
    found = found.toPandas()  # at most one row per feature of the bounded vocabulary
    ranked = sorted(((names.get(int(f), f"f{f}"), float(v)) for f, v in zip(found["feature"], found["importance"])),
                    key=lambda r: (-r[1], r[0]))
    rows = [(i + 1, *r) for i, r in enumerate(ranked[:top] if top else ranked)]
    return table.sparkSession.createDataFrame(rows, "rank int, feature string, importance double")


def feature_names(stages, transformed, column="features"):
    """Names of an assembled vector's places; text features are called text_features=term."""
    groups = transformed.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for g in groups.values() for a in g}
    terms = next((s.vocabulary for s in stages if hasattr(s, "vocabulary")), [])
    of_text = lambda n: n.rpartition("_")[2] if n.startswith("text_features_") else None
    return {i: f"text_features={terms[int(of_text(n))]}" if of_text(n) and int(of_text(n)) < len(terms) else n
            for i, n in names.items()}


def held_out_quality(scored, gold, pred):
    """One row per gold class of a test part: its rows, and whether the accuracy over all of them beats always
    answering the commonest class."""
    whole = scored.agg(F.struct(F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("hit"), rows_n().alias("n"))).scalar()
    most = scored.groupBy(gold).agg(rows_n().alias("n")).agg(F.max("n")).scalar()
    return scored.groupBy(F.col(gold).alias("gold")).agg(rows_n().alias("n")).withColumn(
        "beats_majority", whole["hit"] * whole["n"] > most)


def fit_outcome_forest(features, label="outcome", trees=100, depth=10, seed=42, least=10):
    """Class-balanced random forest on conversation features; needs enough conversations."""
    labelled = features.where(F.col(label).isNotNull()).persist()  # the stages read it a dozen times
    n = labelled.count()
    if n < least:
        labelled.unpersist()
        raise ValueError(f"{n} labelled conversations, at least {least} needed")
    rows = add_class_weight(labelled, label)
    texts = ["first_da", "last_da"]
    numbers = [c for c, kind in rows.dtypes if kind in ("bigint", "int", "double") and c not in
               ("dialogue_id", "weight", "utterance_count")]
    stages = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep") for c in texts]
    stages += [OneHotEncoder(inputCol=f"_{c}", outputCol=f"{c}_onehot", dropLast=False) for c in texts]
    stages += [
        label_index_stage(label, "label"),
        assembler(numbers + [f"{c}_onehot" for c in texts]),
        RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight",
                               numTrees=trees, maxDepth=depth, seed=seed),
    ]
    fitted = Pipeline(stages=stages).fit(rows)
    labelled.unpersist()
    return fitted


def feature_importance(spark, model, transformed, top=None, prefix=None, column="features"):
    """Importance of every used feature by name, ranked; ``prefix`` keeps the label features.

    Names come from the assembled column's metadata. Only the importances (one number per feature)
    are on the driver.
    """
    groups = transformed.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for g in groups.values() for a in g}
    scores = model.featureImportances
    rows = [(names.get(int(i), f"f{i}"), float(v)) for i, v in zip(scores.indices, scores.values)]
    rows = [r for r in rows if prefix is None or r[0].startswith(prefix)]
    rows.sort(key=lambda r: (-r[1], r[0]))
    ranked = [(i + 1, *r) for i, r in enumerate(rows[:top] if top else rows)]
    return spark.createDataFrame(ranked, "rank int, feature string, importance double")


def act_transactions(t, outcomes, da="da_label"):
    """Distinct acts plus outcome of every conversation with a clear outcome.

    The set of a conversation is bounded by the act vocabulary.
    """
    acts = t.where(F.col(da).isNotNull()).groupBy("dialogue_id").agg(F.collect_set(da).alias("_acts"))
    clear = outcomes.where(F.col("outcome").isin(VALID_PR))
    return acts.join(clear, "dialogue_id").select(
        "dialogue_id", F.array_append(F.array_sort("_acts"), F.col("outcome")).alias("items"))


def outcome_rules(transactions, min_support=0.2, min_confidence=0.6):
    """Association rules from acts to one outcome with support, confidence and lift."""
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(
        transactions)
    targets = F.array(*[F.lit(v) for v in VALID_PR])
    rules = model.associationRules
    kept = rules.where((F.size("consequent") == 1) & F.arrays_overlap("consequent", targets)
                       & ~F.arrays_overlap("antecedent", targets))
    return kept.select(
        F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"),
        F.get("consequent", F.lit(0)).alias("outcome"), "support", "confidence", "lift")
