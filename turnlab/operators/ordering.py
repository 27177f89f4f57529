"""Global and per-group order without a single-task sort.

Values are counted first (so a value held by a third of the rows is one row), cut into ranges by
approximate quantiles and cumulated inside each range; range totals give the offset of a range.
The approximate quantiles only decide where the cuts lie, every result is exact.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RANGE = "_range"
_DIGESTS = 64   # tasks that share the work of finding the cuts


def ranges_of(df):
    """How many ranges values are cut into: as many as the session has shuffle partitions."""
    return max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cuts(values, col, ranges):
    """Approximate quantiles in two steps: of each hash part of the values, then of the parts' quantiles."""
    shares = [i / ranges for i in range(1, ranges)]
    part = F.pmod(F.xxhash64(col), F.lit(_DIGESTS))
    parts = values.groupBy(part.alias("_part")).agg(F.percentile_approx(col, shares, 10 * ranges).alias("_q"))
    return parts.select(F.explode("_q").alias("_q")).select(F.percentile_approx("_q", shares, 10 * ranges)).scalar()


def _below(cuts, x):
    """How many of the sorted cuts are smaller than x, by halving."""
    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        smaller = F.get(cuts, middle) < x
        return F.when(s["lo"] >= s["hi"], s).when(smaller, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))) \
            .otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve, lambda s: s["lo"])


def add_range(df, col, ranges=None, sample=None):
    """Add the number of the value range a row falls in; equal values share a range.

    ``sample`` is the expression the cuts are taken from, by default the column. The cuts only balance the ranges.
    """
    sample = F.col(col) if sample is None else sample
    placed = df.withColumn("_cuts", _cuts(df, sample, ranges or ranges_of(df)))
    cuts = F.coalesce(F.col("_cuts"), F.array())
    return placed.withColumn(_RANGE, F.when(F.col(col).isNull(), 0).otherwise(_below(cuts, F.col(col)))).drop("_cuts")


def cumulate(counts, x, measures, by=(), ranges=None):
    """Add ``below_<m>`` for every measure: its total over the smaller values of the group.

    ``counts`` has one row per group and value. ``total_<m>`` is the group's total.
    """
    # naming the measures keeps the input of the cuts equal to the main input: one shared exchange
    present = sum((F.col(m) for m in measures[1:]), F.col(measures[0])) > 0
    placed = add_range(counts, x, ranges, F.when(present, F.col(x)))
    inside = W.partitionBy(*by, _RANGE).orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    rows = placed.select("*", *[
        F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_in_{m}") for m in measures])
    group = W.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*by, _RANGE).agg(*[F.sum(m).alias(m) for m in measures])
    offsets = totals.select(
        *by, _RANGE,
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(group).alias(f"total_{m}") for m in measures])
    joined = rows.join(offsets, [*by, _RANGE], "left")
    return joined.select(
        *counts.columns,
        *[(F.col(f"_in_{m}") + F.col(f"_off_{m}")).alias(f"below_{m}") for m in measures],
        *[f"total_{m}" for m in measures])


def exact_quantiles(df, x, probabilities, by=(), ranges=None):
    """Exact quantiles (linear interpolation), one row per group and probability."""
    counts = (df.where(F.col(x).isNotNull()).groupBy(*by, x)
              .agg(F.count(F.lit(1)).alias("_n")))
    ranked = cumulate(counts, x, ["_n"], by, ranges)
    wanted = F.array(*[F.lit(float(q)) for q in probabilities])
    at = lambda q: q * (F.col("total__n") - 1)
    covers = lambda p: ((F.col("below__n") <= p)
                        & (p < F.col("below__n") + F.col("_n")))
    touched = F.filter(wanted, lambda q: covers(F.floor(at(q))) | covers(F.ceil(at(q))))
    hits = ranked.withColumn("q", F.explode(touched))
    low = F.max(F.when(covers(F.floor(at(F.col("q")))), F.col(x)))
    high = F.max(F.when(covers(F.ceil(at(F.col("q")))), F.col(x)))
    weight = F.max(at(F.col("q")) - F.floor(at(F.col("q"))))
    return hits.groupBy(*by, "q").agg(
        (low + weight * (high - low)).alias("value"), F.max("total__n").alias("n"))


def row_index(df, order, name="row_index", ranges=None):
    """Number the rows 0..n-1 in the order of a unique numeric column."""
    placed = add_range(df, order, ranges)
    inside = F.row_number().over(W.partitionBy(_RANGE).orderBy(order)).cast("long")
    totals = placed.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(F.lit(0)).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(_RANGE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return (placed.withColumn("_in", inside).join(offsets, _RANGE, "left")
            .select(*df.columns, (F.col("_in") - 1 + F.col("_off")).alias(name)))


def number_within(df, major, minor, name="row_index"):
    """Number the rows 0..n-1 in the order of a numeric column and, within its values, of further columns.

    The rows of one value of ``major`` are sorted in one task, so each value should have a bounded number of them.
    """
    counts = df.groupBy(major).agg(F.count(F.lit(1)).alias("_n"))
    below = cumulate(counts, major, ["_n"]).select(major, F.col("below__n").alias("_below"))
    inside = F.row_number().over(W.partitionBy(major).orderBy(*minor))
    return df.withColumn("_in", inside).join(below, major).select(
        *df.columns, (F.col("_in") - 1 + F.col("_below")).cast("long").alias(name))


def last_of_least(rows, wanted, by="_y", bucket="_b", order=("_h", "_key")):
    """A map from each value of ``by`` to the struct ``order`` of the last of its ``wanted(total)`` least rows, as a scalar.

    ``bucket`` is a number of about 20 bits that grows with ``order``. Rows are counted by bucket first (combined before
    the shuffle), and only those of the bucket that the cut falls in are put in order: no task gets the least rows of
    every partition.
    """
    each = W.partitionBy(by)
    counts = rows.groupBy(by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.select(
        by, bucket, "_n", F.sum("_n").over(each.orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)).alias("_upto"),
        wanted(F.sum("_n").over(each)).alias("_rank"))
    below = F.col("_upto") - F.col("_n")
    hit = placed.where((below < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))).select(
        by, bucket, (F.col("_rank") - below).alias("_left"))
    open_ = rows.join(hit, [by, bucket])  # one bucket of each value
    last = open_.withColumn("_r", F.row_number().over(each.orderBy(*order))).where(F.col("_r") == F.col("_left"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct(by, F.struct(*order).alias("_last"))))).scalar()


def least_rows(df, digest, key, most):
    """The ``most`` rows of least hexadecimal ``digest``, then least key (of equal ones, any).

    They stay in the partitions they lie in; only rows equal to the last one are put together, to be counted off.
    """
    rows = df.select(F.lit(0).alias("_y"), digest.alias("_h"), F.col(key).alias("_key"))
    rows = rows.withColumn("_b", F.conv(F.substring("_h", 1, 5), 16, 10).cast("int"))
    last = F.element_at(last_of_least(rows, lambda n: F.least(n, F.lit(most))), F.lit(0))
    own = F.struct(digest.alias("_h"), F.col(key).alias("_key"))
    below = rows.where(F.struct("_h", "_key") < last).agg(F.count(F.lit(1))).scalar()
    equal = df.where(own == last).withColumn("_nth", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.lit(0))))
    return df.where(own < last).unionByName(equal.where(F.col("_nth") <= most - below).drop("_nth"))
