"""Writers: tables, report bundles and pipe text."""

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from turnlab.schemas import MANIFEST


def write_csv(df, path, encoding="UTF-8"):
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)


def write_report(tables, directory, fmt="parquet"):
    """One directory per named table."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{directory}/{name}")


def _bundle_version(spark, directory):
    try:
        return spark.read.schema(MANIFEST).json(f"{directory}/manifest").agg(F.max("version")).first()[0] or 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def write_bundle(tables, directory, fmt="parquet"):
    """Named tables as one bundle, all or nothing, beside the earlier ones; ``sources.readers.read_bundle`` reads the newest.

    Tables go to a folder of this run. Only when all are written is the bundle named in the manifest, by one file that
    the writing job's commit moves into place. If a table fails, the earlier bundle stays the newest.
    """
    if not tables:
        raise ValueError("a bundle has at least one table")
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.option("header", True).format(fmt).save(f"{directory}/{run}/{name}")
    version = _bundle_version(spark, directory) + 1
    entries = spark.createDataFrame([(version, run, name, fmt, f"{run}/{name}") for name in tables], MANIFEST)
    entries.coalesce(1).write.mode("append").json(f"{directory}/manifest")


def pipe_lines(turns, speaker="speaker", text="utterance", labels="da_labels"):
    """``speaker|text|label,label`` as a one-column table."""
    packed = F.array_join(F.array_sort(F.array_distinct(F.col(labels))), ",")
    return turns.select(F.concat_ws("|", speaker, text, packed).alias("value"))


def write_pipe_turns(turns, path, **columns):
    pipe_lines(turns, **columns).write.mode("overwrite").text(path)


def findings(**tables):
    """Small result tables as rows of (section, item, metric, value).

    Each table is given as ``section=(df, item columns, metric columns)``.
    """
    def melt(section, df, items, metrics):
        item = F.concat_ws(" / ", *[F.col(c).cast("string") for c in items]) if items else F.lit("")
        cells = F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics]))
        return (df.select(F.lit(section).alias("section"), item.alias("item"), cells.alias("c"))
                .select("section", "item", "c.*"))

    return reduce(lambda a, b: a.unionByName(b), [melt(s, *spec) for s, spec in tables.items()])
