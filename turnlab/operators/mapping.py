"""Tables about a mapping dictionary and its use."""

from pyspark.sql import functions as F

from turnlab.operators.tables import literal_table


def mapping_coverage(df, col, mapping):
    """Labels that occur with their counts and whether the dictionary knows them."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("mapped", F.col("label").isin(list(mapping))))


def mapping_counts(df, raw, mapped):
    return df.where(F.col(raw).isNotNull()).groupBy(raw, mapped).agg(F.count(F.lit(1)).alias("n"))


def mapping_table(df, col, mapping):
    """Every dictionary entry with its result and how often the table uses it."""
    entries = literal_table(df.sparkSession, "label", "outcome", rows=list(mapping.items()))
    used = df.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    return entries.join(used, "label", "left").select(
        "label", "outcome", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def mapping_classes(spark, mapping):
    """Every class of a dictionary with its labels in dictionary order and their number."""
    entries = literal_table(spark, "at", "label", "outcome", rows=[(i, *e) for i, e in enumerate(mapping.items())])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "label"))), lambda r: r["label"])
    return entries.groupBy("outcome").agg(listed.alias("labels"), F.count(F.lit(1)).alias("n"))


def label_index(df, col, name="code", inverse="decoded"):
    """Alphabetical class number of a label column and the label it stands for."""
    from pyspark.ml.feature import IndexToString, StringIndexer

    model = StringIndexer(inputCol=col, outputCol=name, stringOrderType="alphabetAsc").fit(df)
    coded = model.transform(df)
    return IndexToString(inputCol=name, outputCol=inverse, labels=model.labels).transform(coded)
