"""Expressions over per-class score arrays (one array per row, one value per class)."""

from pyspark.sql import functions as F

from turnlab.functions.labels import strings


def _col(col):
    return F.col(col) if isinstance(col, str) else col


def _labels(labels):
    return strings(labels)


def softmax(logits):
    """Class probabilities of raw scores; shifted by the largest score against overflow."""
    logits = _col(logits)
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def sigmoid(logits):
    return F.transform(_col(logits), lambda x: 1.0 / (1.0 + F.exp(-x)))


def top_label(probs, labels):
    """Label of the largest probability, the first one on a tie."""
    probs = _col(probs)
    return F.get(_labels(labels), (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))


def confidence(probs):
    return F.array_max(_col(probs))


def threshold_labels(probs, labels, threshold=0.5):
    """All labels above the threshold; the row's own best label when none is."""
    named = F.transform(_col(probs), lambda p, i: F.when(p > threshold, F.get(_labels(labels), i)))
    above = F.array_compact(named)
    return F.when(F.size(above) > 0, above).otherwise(F.array(top_label(probs, labels)))


def gated_label(probs, threshold=0.6, positive=1):
    """1 only when the positive class wins with at least the threshold."""
    probs = _col(probs)
    wins = F.array_position(probs, F.array_max(probs)) - 1 == positive
    return (wins & (F.array_max(probs) >= threshold)).cast("int")


def explode_probs(probs, labels, prefix="prob_"):
    """One probability Column per class."""
    return [F.get(_col(probs), F.lit(i)).alias(prefix + str(x)) for i, x in enumerate(labels)]
