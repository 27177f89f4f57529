"""Boosted models of every labelled row, and the same trees however rows are dealt."""

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import functions as F

from turnlab.learning import boosting
from turnlab.plans.catalog import learning

ROWS = 126_000  # of which four fifths are fitted: more than the 100,000 that a fit once read


class Fitted(Exception):
    pass


@pytest.fixture(scope="module")
def texts(spark):
    n = F.col("id")
    return spark.range(ROWS, numPartitions=8).select(
        n.alias("idx"), (n % 100).alias("dialogue_id"), F.concat(F.lit("word"), n % 7, F.lit(" thing")).alias("sentence"),
        (n % 2).cast("int").alias("eml_label"),
        F.element_at(F.array(*map(F.lit, ("Compliance", "Neutral", "Resistance"))), (n % 3 + 1).cast("int")).alias("pr_label"),
        F.when(n % 2 == 0, "ap,il").otherwise("pa").alias("da_label")).persist()


QUERIES = ["eml_importance_table", "eml_model_importance", "eml_model_quality", "outcome_model_quality", "outcome_predictions", "act_model_report", "act_models_quality"]


@pytest.mark.parametrize("query", QUERIES)
def test_every_row_kept_for_the_fit_is_fitted(texts, monkeypatch, query):
    def fit(table, *_):
        raise Fitted(table.count())

    monkeypatch.setattr(boosting, "fit", fit)
    with pytest.raises(Fitted) as found:
        getattr(learning, query)(texts)
    assert found.value.args == (ROWS * 4 // 5,)


def table_of(spark, n, width, seed):
    """(table, rows x features, rows x outputs) with dense and sparse vectors, a feature that no row lacks and one of a few rows."""
    order = np.random.default_rng(seed)
    x = np.where(order.random((n, width)) < .4, np.round(order.random((n, width)) * 3, 1), 0)
    x[:, 0], x[:, 1], x[3:, 2] = 1 + order.integers(0, 3, n), .5, 0
    x[n // 2:] = x[:n - n // 2]  # equal rows
    kind = np.where(x[:, 3] > 1, 0, np.where(x[:, 4] > 0, 1, 2))
    y = (kind[:, None] == np.arange(3)).astype(float)
    rows = [(DenseVector(r) if i % 3 else SparseVector(width, {j: v for j, v in enumerate(r) if v}), t.tolist())
            for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["features", "target"]), x, y


def learned(x, y, loss, **how):
    at = np.nonzero(x)
    return boosting.learn(*at, x[at], y, loss, **how)


@pytest.mark.parametrize("loss, outputs", [("softmax", 3), ("logistic", 2)])
def test_same_trees_in_one_block_many_blocks_and_many_tasks(spark, monkeypatch, loss, outputs):
    table, x, y = table_of(spark, 400, 9, 1)
    table = table.withColumn("target", F.slice("target", 1, outputs))
    how = {"trees": 5, "depth": 4}
    want = learned(x, y[:, :outputs], loss, **how)
    assert len(want.trees) == 5
    monkeypatch.setattr(boosting, "_KEPT", 2)
    models = [boosting.fit(table, "target", loss, **how)]
    monkeypatch.setattr(boosting, "_BLOCK", 300)
    models += [boosting.fit(table.repartition(3), "target", loss, tasks=t, **how) for t in (None, 4)]
    assert all(m.trees == want.trees and m.gain == want.gain for m in models)


def test_cuts_are_those_of_all_values(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_PIVOTS", 3)
    _, x, y = table_of(spark, 300, 8, 2)
    x[:, 5] *= 1e-9
    x[:, 6] *= 1e12
    at = np.nonzero(x)
    *_, names, edges = boosting.bin_values(*at, x[at], len(x))
    raw = spark.sparkContext.parallelize([boosting._Raw(*arrow(part)) for part in np.array_split(x, 7)], 5)
    assert boosting._cuts(raw, len(x), x.shape[1], boosting.LEAST_ROWS) == (names, edges)
    assert names[0] == 0 and 1 not in names and 2 not in names


def arrow(x):
    import pyarrow as pa
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    return pa.array([{"type": 1, "size": None, "indices": None, "values": r.tolist()} for r in x], kind), np.zeros((len(x), 1))


def test_more_cells_than_two_bytes_tell():
    order = np.random.default_rng(3)
    rows, features = np.nonzero(order.random((60, 17_000)) < .25)
    x = np.zeros((60, 17_000))
    x[rows, features] = order.random(len(rows))
    y = (x[:, 16_990] > 0).astype(float)[:, None]
    want = learned(x, y, "logistic", trees=3, depth=2)
    *_, names, edges = boosting.bin_values(*np.nonzero(x), x[np.nonzero(x)], 60)
    blocks = [boosting._Raw(arrow(part)[0], target).binned(names, edges, np.zeros(1))
              for part, target in zip(np.array_split(x, 4), np.array_split(y, 4))]
    assert len(names) * boosting.BINS > 1 << 16 and blocks[0][1].dtype == np.int32
    histograms, target = boosting._joined(blocks, len(names) * boosting.BINS, 3)
    got = boosting._learn_binned(histograms, names, edges, target, "logistic", 3, 2, .1, boosting.LEAST_ROWS)
    assert got.trees == want.trees and names[int(np.searchsorted(names, 16_990))] == want.trees[0].feature[0]
