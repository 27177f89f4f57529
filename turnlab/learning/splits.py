"""Reproducible splits and class weights."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlab.operators.ordering import last_of_least, least_rows, row_index

RANGE_BITS = 20     # of the hash, for the one histogram that finds the cuts


def stratified_split(df, label, key, test_share=0.2, seed=42):
    """Add ``split`` (train/test) with the exact share of every class in the test part.

    The test rows of a class are those with the smallest hashes of their key. The cut is found by one histogram of hash
    ranges; only the rows of the range it falls in are ranked. The table itself is not shuffled; what is looked
    up per row is one cut per class.
    """
    hashed = F.xxhash64(key, F.lit(seed))
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_y"), hashed.alias("_h"), F.col(key).alias("_key"))
    rows = rows.withColumn("_b", F.shiftright("_h", 64 - RANGE_BITS))
    lookup = last_of_least(rows, lambda n: F.floor(n * test_share + 0.5))
    mine = F.struct(hashed.alias("_h"), F.col(key).alias("_key"))
    is_test = F.coalesce(mine <= F.element_at(lookup, F.col(label)), F.lit(False))
    return df.where(F.col(label).isNotNull()).withColumn(
        "split", F.when(is_test, "test").otherwise("train"))


def ordered_split(df, order="idx", train_share=0.8):
    """Add ``split``: the first share of the rows in file order is train."""
    numbered = row_index(df, order, "_i")
    total = df.select(F.count(F.lit(1))).scalar()
    return numbered.withColumn("split", F.when(
        F.col("_i") < F.floor(total * train_share), "train").otherwise("test")).drop("_i")


def random_split(df, key, train_share=0.7, seed=42):
    """Add ``split`` by a digest of the row's key: about the share is train, the same rows however they lie."""
    cut = f"{min((1 << 32) - 1, round(train_share * (1 << 32))):08x}"
    drawn = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8)
    return df.withColumn("split", F.when(drawn < cut, "train").otherwise("test"))


def bounded(df, key, most, seed=42):
    """At most ``most`` rows, those of the smallest digest of their key: the bound of a fit's labelled rows."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(f"fit{seed}")))
    return least_rows(df, digest, key, most)


def class_weights(df, label):
    """Balanced weight n / (k * n_c) of every class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(0))
    weight = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def add_class_weight(df, label, name="weight"):
    """Add the balanced weight; the lookup holds one entry per class."""
    table = class_weights(df, label)
    lookup = table.agg(F.map_from_entries(F.collect_list(F.struct(label, "weight")))).scalar()
    return df.withColumn(name, F.element_at(lookup, F.col(label)))
