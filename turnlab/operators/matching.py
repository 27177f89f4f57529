"""Joins between label tables and the turn table."""

from pyspark.sql import functions as F

KEYS = ("dialogue_id", "role", "turn")


def duplicate_keys(df, keys=KEYS):
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_per_key(labels, keys=KEYS, order=None):
    """A label table with one row per key: the first in ``order``, or where none is given the least values."""
    values = [c for c in labels.columns if c not in keys and c != order]
    row = F.struct(*values)
    first = F.min_by(row, order) if order else F.min(row)
    return labels.groupBy(*keys).agg(first.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in values])


def join_labels(t, *label_tables, keys=KEYS, order=None):
    """Left-join label tables onto the turns. Every label table is reduced to one row per key first, so the turns
    stay as many as they are; ``duplicate_keys`` tells which keys were repeated.

    All joins share one key, so the turn table is shuffled once.
    """
    out = t
    for labels in label_tables:
        out = out.join(one_per_key(labels, keys, order), list(keys), "left")
    return out


def cascade_match(left, right, levels, value, order="idx", name=None):
    """Value of the first matching row of ``right``, trying one key after the other.

    ``levels`` is a list of keys, a key being a list of column names or of
    ``(name, expression)`` pairs evaluated on both sides. On every level the first row in file order
    counts; if its value is NULL the next level is tried. The right side is reduced to one row per
    key before each join, so a frequent key cannot multiply rows.
    """
    name = name or value
    out, found = left, []
    for i, level in enumerate(levels):
        parts = [(c, F.col(c)) if isinstance(c, str) else c for c in level]
        keys = [f"_k{i}_{j}" for j in range(len(parts))]
        known = right.select(
            *[expr.alias(k) for k, (_, expr) in zip(keys, parts)], F.col(value), F.col(order))
        first = known.na.drop(subset=keys).groupBy(*keys).agg(
            F.min_by(value, order).alias(f"_v{i}"))
        out = out.withColumns({k: expr for k, (_, expr) in zip(keys, parts)})
        out = out.join(first, keys, "left")
        found.append(f"_v{i}")
    return out.select(*[c for c in left.columns if c != name],
                      F.coalesce(*found).alias(name))
