"""Boosted trees against a plain loop over rows, scoring and importances through Spark."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.linalg import SparseVector, DenseVector
from pyspark.sql import functions as F

from turnlab.learning import boosting, models, splits
from turnlab.learning.features import assembler, tfidf_stages
from turnlab.operators.ordering import least_rows


def plain_probabilities(loss, m):
    if loss == "softmax":
        e = [math.exp(x - max(m)) for x in m]
        return [x / sum(e) for x in e]
    return [1 / (1 + math.exp(-x)) for x in m]


def plain_margins(rows, target, loss, trees, depth, rate, least):
    """Margins of all rows after ``trees`` trees grown by trying every cut on every row."""
    n, outputs, width = len(rows), len(target[0]), len(rows[0])
    cuts = []
    for f in range(width):
        values = sorted(r[f] for r in rows if r[f] > 0)
        inner = sorted({values[len(values) * k // boosting.BINS] for k in range(1, boosting.BINS)}) if values else []
        cuts.append([0.0] + [c for c in inner if c < values[-1]] if len(values) >= least else [])
    margins = [[0.0] * outputs for _ in rows]

    def score(held, g, h):
        return sum(sum(g[i][k] for i in held) ** 2 / (sum(h[i][k] for i in held) + boosting.SHRINK) for k in range(outputs))

    def weight(held, h):
        return sum(map(sum, (h[i] for i in held)))

    for _ in range(trees):
        p = [plain_probabilities(loss, m) for m in margins]
        g = [[p[i][k] - target[i][k] for k in range(outputs)] for i in range(n)]
        h = [[p[i][k] * (1 - p[i][k]) for k in range(outputs)] for i in range(n)]
        leaves, level = [], [list(range(n))]
        for _ in range(depth):
            coming = []
            for held in level:
                best = None
                for f in range(width):
                    for c in cuts[f]:
                        right = [i for i in held if rows[i][f] > c]
                        left = [i for i in held if rows[i][f] <= c]
                        if min(len(left), len(right)) < least or min(weight(left, h), weight(right, h)) < boosting.LEAST_CURVATURE:
                            continue
                        gain = score(left, g, h) + score(right, g, h) - score(held, g, h)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, left, right)
                coming += best[1:] if best else []
                leaves += [] if best else [held]
            level = coming
        for held in leaves + level:
            for k in range(outputs):
                step = -rate * sum(g[i][k] for i in held) / (sum(h[i][k] for i in held) + boosting.SHRINK)
                for i in held:
                    margins[i][k] += step
    return margins


def fixture(seed, n=90, width=6):
    order = random.Random(seed)
    rows = [[order.choice([0, 0, round(order.random(), 2), order.randrange(3)]) for _ in range(width)] for _ in range(n)]
    kind = [0 if r[0] > 0.5 else 1 if r[1] > 0 and order.random() < .9 else 2 for r in rows]
    return rows, kind


def sparse(rows):
    x = np.array(rows, float)
    at = np.nonzero(x)
    return at[0], at[1], x[at]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("loss, outputs", [("softmax", 3), ("logistic", 1), ("logistic", 2)])
def test_same_trees_as_a_plain_loop(seed, loss, outputs):
    rows, kind = fixture(seed)
    target = [[float(k == c) for c in range(outputs)] for k in kind]
    model = boosting.learn(*sparse(rows), np.array(target), loss, trees=5, depth=3, rate=.3)
    x = np.array(rows, float)
    got = model.margins(lambda f: x[:, f], len(x))
    assert np.allclose(got, plain_margins(rows, target, loss, 5, 3, .3, boosting.LEAST_ROWS), atol=1e-9)


@pytest.mark.parametrize("loss, outputs", [("softmax", 3), ("logistic", 2)])
def test_trees_do_not_depend_on_the_order_of_rows(loss, outputs):
    rows, kind = fixture(7, n=700)
    order = np.random.default_rng(1).permutation(len(rows))
    made = [boosting.learn(*sparse([rows[i] for i in o]), np.array([[float(kind[i] == c) for c in range(outputs)] for i in o]), loss,
                           trees=4, depth=4) for o in (range(len(rows)), order)]
    assert made[0].trees == made[1].trees and made[0].gain == made[1].gain  # sums of gradients are exact


def test_only_the_smaller_child_is_counted(monkeypatch):
    rows, kind = fixture(8, n=900, width=12)
    seen, plain = [], boosting.Histograms.of_nodes
    monkeypatch.setattr(boosting.Histograms, "of_nodes",
                        lambda self, held, node, *rest: seen.append(len(held)) or plain(self, held, node, *rest))
    boosting.learn(*sparse(rows), np.array([[float(k == 0)] for k in kind]), "logistic", trees=3, depth=4)
    assert 3 <= len(seen) <= 9 and max(seen) <= 450  # of 900 rows; none for the last level, whose nodes are not split


@pytest.mark.parametrize("loss, outputs", [("softmax", 3), ("logistic", 1)])
@pytest.mark.parametrize("threads, stretch", [(1, 7), (3, 1 << 16), (4, 50), (20, 50)])
def test_same_trees_by_threads_and_stretches(monkeypatch, loss, outputs, threads, stretch):
    rows, kind = fixture(3, n=500, width=9)
    target = np.array([[float(k == c) for c in range(outputs)] for k in kind])
    plain = boosting.learn(*sparse(rows), target, loss, trees=4, depth=4)
    monkeypatch.setattr(boosting, "_STRETCH", stretch)
    model = boosting.learn(*sparse(rows), target, loss, trees=4, depth=4, threads=threads)
    assert model.trees == plain.trees and model.gain == plain.gain


def test_terms_are_counted_as_rows_and_ties_go_to_the_least(spark, monkeypatch):
    def fit(*_):
        raise AssertionError("a text's terms were kept as objects")
    monkeypatch.setattr(CountVectorizer, "fit", fit)
    monkeypatch.setattr(CountVectorizer, "_fit", fit)
    texts = ["dd cc bb aa", "aa dd zz", "zz yy", "bb cc"]
    table = spark.createDataFrame([(i, t, [float(i % 2)]) for i, t in enumerate(texts)], "idx int, sentence string, y array<double>")
    model = models._text_model(table, tfidf_stages(vocabulary=4) + [assembler(["text_features"])], F.col("y"), ["odd"], "logistic", 2, 2, .1)
    assert next(s.vocabulary for s in model.pipeline.stages if hasattr(s, "vocabulary")) == ["aa", "bb", "cc", "dd"]  # zz is as common


def test_fit_score_and_importance(spark):
    rows, kind = fixture(9, n=400)
    vectors = [SparseVector(6, [i for i, v in enumerate(r) if v], [v for v in r if v]) if n % 2 else DenseVector(r)
               for n, r in enumerate(rows)]
    table = spark.createDataFrame(
        [(n, v, [float(k == c) for c in range(3)], k) for n, (v, k) in enumerate(zip(vectors, kind))],
        ["idx", "features", "target", "kind"])
    models_ = [boosting.fit(table.repartition(n), "target", trees=20, depth=3) for n in (1, 5)]
    assert [t.feature for t in models_[0].trees] == [t.feature for t in models_[1].trees]
    scored = boosting.transform(table, models_[0]).orderBy("idx").collect()
    x = np.array(rows, float)
    want = models_[0].probabilities(models_[0].margins(lambda f: x[:, f], len(x)))
    assert np.allclose([r.probabilities for r in scored], want)
    assert np.mean(want.argmax(axis=1) == np.array(kind)) > .9
    found = {r.feature: r.importance for r in boosting.permutation_importance(table, models_[0], "kind", "idx").collect()}
    assert sorted(found) == models_[0].used() and set(sorted(found, key=found.get)[-2:]) == {0, 1}
    assert boosting.permutation_importance(table.limit(0), models_[0], "kind", "idx").where("importance is not null").count() == 0


@pytest.mark.parametrize("loss, outputs", [("softmax", 3), ("logistic", 2)])
def test_tasks_that_share_the_features_make_the_same_model(spark, loss, outputs):
    rows, kind = fixture(5, n=300, width=7)
    rows, kind = rows + rows[:40], kind + kind[:40]  # equal rows
    table = spark.createDataFrame([(SparseVector(7, [i for i, v in enumerate(r) if v], [v for v in r if v]),
                                    [float(k == c) for c in range(outputs)]) for r, k in zip(rows, kind)], ["features", "target"])
    one, *others = (boosting.fit(table.repartition(n), "target", loss, trees=4, depth=3, tasks=n) for n in (1, 3, 8))
    assert len(one.trees) == 4 and all(m.trees == one.trees and m.gain == one.gain for m in others)  # 8: a task without features


def test_a_fit_takes_as_many_tasks_as_its_values_are_worth(spark):
    assert [boosting._tasks(spark, n * boosting.ENTRIES) for n in (0, 1, 3, 99)] == [1, 1, 3, 8]


def plain_importance(model, rows, gold, order):
    """Hits lost when the rows in ``order`` each take the next one's value of a feature."""
    def guess(row):
        total = list(model.base)
        for t in model.trees:
            at = 0
            while t.feature[at] >= 0:
                at = t.right[at] - (row[t.feature[at]] <= t.threshold[at])
            total = [a + b for a, b in zip(total, t.value[at])]
        return total.index(max(total))

    out = {}
    for f in model.used():
        dealt = {i: [*rows[i][:f], rows[j][f], *rows[i][f + 1:]] for i, j in zip(order, order[1:] + order[:1])}
        out[f] = sum((guess(rows[i]) == gold[i]) - (guess(dealt[i]) == gold[i]) for i in order) / len(order)
    return out


def test_importance_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_CHUNK", 64)
    rows, kind = fixture(9, n=200)
    model = boosting.learn(*sparse(rows), np.array([[float(k == c) for c in range(3)] for k in kind]), trees=6, depth=3)
    table = spark.createDataFrame([(i, DenseVector(r), k) for i, (r, k) in enumerate(zip(rows, kind))], ["idx", "features", "kind"])
    order = [r.idx for r in table.orderBy(F.xxhash64(F.lit(42), "idx")).collect()]
    found = {r.feature: r.importance for r in boosting.permutation_importance(table, model, "kind", "idx").collect()}
    assert found == pytest.approx(plain_importance(model, rows, kind, order))
    assert np.allclose(model.margins(lambda f: np.array(rows, float)[:, f], 200),
                       model.margins(lambda f: np.array(rows, float)[:, f], 200, model.trees))


def test_nothing_to_split():
    model = boosting.learn(*sparse([[0, 1]] * 4), np.array([[1.0], [0], [1], [0]]), "logistic")
    assert model.trees == [] and model.margins(None, 2).tolist() == [[0.0], [0.0]]
    with pytest.raises(ValueError):
        boosting.bin_values(np.array([0]), np.array([0]), np.array([-1.0]), 1)


def test_the_planted_word_and_act_lead(spark):
    order = random.Random(3)
    rows = [(i, f"{'bad' if i % 3 == 0 else 'fine'} {order.choice(['cat', 'dog', 'cow'])} told here", int(i % 3 == 0),
             order.choice(["Compliance", "Neutral"]), "ap,pa" if i % 2 else "ap" if i % 5 else "dc") for i in range(200)]
    t = spark.createDataFrame(rows, "idx long, sentence string, eml_label int, pr_label string, da_label string")
    both = splits.stratified_split(t, "eml_label", "idx")
    train, test = (both.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    model = models.fit_eml_model(train, trees=5, depth=3)
    first = models.permuted_importance(model, models.eml_rows(test), "label", top=3).first()
    assert first.feature in ("text_features=bad", "text_features=fine") and first.importance > .2 and first["rank"] == 1
    acts = models.fit_da_model(t, trees=10, depth=3)
    assert acts.outputs == ["ap", "dc", "pa"]


def test_least_rows_are_those_of_a_sort(spark):
    df = spark.range(5000).withColumn("_d", F.md5(F.col("id").cast("string"))).repartition(7)
    for most in (0, 1, 777, 5000, 9000):
        want = [r.id for r in df.orderBy("_d").limit(most).collect()]
        assert sorted(r.id for r in least_rows(df, F.col("_d"), "id", most).collect()) == sorted(want)
    assert least_rows(df.limit(0), F.col("_d"), "id", 3).count() == 0


def test_least_rows_of_repeated_keys_stay_spread(spark):
    df = spark.range(3000, numPartitions=6).withColumn("key", F.col("id") % 7).withColumn("_d", F.md5(F.col("key").cast("string")))
    for most in (1, 500, 2999):
        assert least_rows(df, F.col("_d"), "key", most).count() == most
    parts = least_rows(df, F.col("_d"), "key", 2000).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 6  # not in one task
