"""Agreement and classification quality.

Everything is derived from counts per (gold, predicted) pair or from one row of conditional counts.
"""

from pyspark.sql import functions as F

from turnlab.functions.counts import rows_n
from turnlab.functions.labels import strings
from turnlab.operators.tables import literal_table


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(tp, fp, fn):
    return _ratio(2.0 * tp, 2.0 * tp + fp + fn)


def _both(df, gold, pred):
    return df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())


def binary_metrics(df, gold, pred, positive=1):
    """Accuracy, precision, recall, F1 and the four counts of a two-class prediction."""
    y, p = F.col(gold) == positive, F.col(pred) == positive
    counts = _both(df, gold, pred).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn", _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"))


def confusion(df, gold, pred, labels):
    """Counts of every (gold, predicted) pair of a fixed label list, zeros included."""
    counts = (_both(df, gold, pred).where(F.col(gold).isin(labels) & F.col(pred).isin(labels))
              .groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(rows_n().alias("n")))
    frame = literal_table(df.sparkSession, "gold", "pred", rows=[(a, b) for a in labels for b in labels])
    return frame.join(counts, ["gold", "pred"], "left").na.fill(0, subset=["n"])


def _class_counts(df, gold, pred):
    pairs = _both(df, gold, pred).groupBy(
        F.col(gold).alias("y"), F.col(pred).alias("p")).agg(rows_n().alias("n"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("gold"), zero.alias("pred"), hit.alias("tp")),
        F.struct(F.col("p").alias("label"), zero.alias("gold"), F.col("n").alias("pred"), zero.alias("tp")))
    return (pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("label")
            .agg(F.sum("gold").alias("support"), F.sum("pred").alias("predicted"),
                 F.sum("tp").alias("tp")))


def class_report(df, gold, pred):
    """Precision, recall, F1 and support of every label that occurs on either side."""
    tp, support, predicted = (F.col(c) for c in ("tp", "support", "predicted"))
    return _class_counts(df, gold, pred).select(
        "label", _ratio(tp, predicted).alias("precision"), _ratio(tp, support).alias("recall"),
        _f1(tp, predicted - tp, support - tp).alias("f1"), "support")


def multiclass_metrics(df, gold, pred):
    """Accuracy with macro and support-weighted precision, recall and F1."""
    report = class_report(df, gold, pred)
    weight = F.sum("support")
    averages = [x for m in ("precision", "recall", "f1") for x in (
        F.avg(m).alias("macro_" + m), _ratio(F.sum(F.col(m) * F.col("support")), weight).alias("weighted_" + m))]
    hits = F.sum(F.col("recall") * F.col("support"))
    return report.agg(_ratio(hits, weight).alias("accuracy"), *averages, weight.alias("n"))


def _multilabel_counts(df, gold, pred, classes):
    legal = strings(classes)
    known = lambda a: F.array_sort(F.array_intersect(a, legal))
    aggs = [rows_n().alias("n"), F.count_if(known(F.col("y")) == known(F.col("p"))).alias("exact")]
    for i, c in enumerate(classes):
        a, b = f"array_contains(y, '{c}')", f"array_contains(p, '{c}')"
        aggs += [F.expr(f"count_if({a} AND {b}) AS tp{i}"), F.expr(f"count_if(NOT {a} AND {b}) AS fp{i}"),
                 F.expr(f"count_if({a} AND NOT {b}) AS fn{i}")]
    rows = df.select(F.col(gold).alias("y"), F.col(pred).alias("p"))
    return rows.where("y IS NOT NULL AND p IS NOT NULL").agg(*aggs)


def _total(prefix, classes):
    return sum((F.col(f"{prefix}{i}") for i in range(1, len(classes))), F.col(f"{prefix}0"))


def multilabel_metrics(df, gold, pred, classes):
    """Exact match, per-label accuracy, micro and macro F1 of label arrays, in one pass."""
    counts = _multilabel_counts(df, gold, pred, classes)
    tp, fp, fn = (_total(x, classes) for x in ("tp", "fp", "fn"))
    each = [_f1(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")) for i in range(len(classes))]
    cells = F.col("n") * len(classes)
    return counts.select(
        "n", _ratio(F.col("exact"), F.col("n")).alias("exact_match"),
        (1 - _ratio(fp + fn, cells)).alias("label_accuracy"), _f1(tp, fp, fn).alias("micro_f1"),
        (sum(each[1:], each[0]) / len(classes)).alias("macro_f1"))


def multilabel_report(df, gold, pred, classes):
    """Precision, recall, F1 and support per label of label arrays."""
    counts = _multilabel_counts(df, gold, pred, classes)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                 F.col(f"fn{i}").alias("fn")) for i, c in enumerate(classes)]))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.select(cells.alias("c")).select("c.*").select(
        "label", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"), (tp + fn).alias("support"))


def kappa(df, gold, pred, classes):
    """Cohen's kappa and PABAK over all (row, label) cells; Fleiss of two raters equals Cohen's."""
    counts = _multilabel_counts(df, gold, pred, classes)
    tp, fp, fn = (_total(x, classes) for x in ("tp", "fp", "fn"))
    cells = (F.col("n") * len(classes)).cast("double")
    observed = 1 - (fp + fn) / cells
    yes_y, yes_p = (tp + fn) / cells, (tp + fp) / cells
    chance = yes_y * yes_p + (1 - yes_y) * (1 - yes_p)
    return counts.select(observed.alias("label_accuracy"),
                         F.try_divide(observed - chance, 1 - chance).alias("cohen_kappa"),
                         F.try_divide(observed - chance, 1 - chance).alias("fleiss_kappa"),
                         (2 * observed - 1).alias("pabak"))


def error_rows(df, gold, pred, probs=None, first=None, order="idx"):
    """Misclassified rows, with the probabilities of the true and the predicted class if given.

    ``probs`` maps each label to its probability column; ``first`` keeps a report's leading rows.
    """
    wrong = _both(df, gold, pred).where(F.col(gold) != F.col(pred))
    if probs:
        of = lambda c: F.coalesce(*[F.when(F.col(c) == v, F.col(p)) for v, p in probs.items()])
        wrong = wrong.withColumn("true_prob", of(gold)).withColumn("pred_prob", of(pred))
    return wrong.orderBy(order).limit(first) if first else wrong


def majority_baseline(df, gold):
    """Accuracy of always answering the commonest label."""
    counts = df.where(F.col(gold).isNotNull()).groupBy(gold).agg(rows_n().alias("n"))
    return counts.agg(F.max_by(gold, F.struct("n", gold)).alias("label"),
                      (F.max("n") / F.sum("n")).alias("accuracy"))
