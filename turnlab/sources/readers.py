"""Readers with declared schemas."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlab.schemas import MANIFEST, all_string
from turnlab.vocab import TEXT_COLUMN_NAMES


class MissingColumns(ValueError):
    pass


def require_columns(df, cols):
    """The DataFrame itself, or an error that names the missing and the available columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns {missing}; available: {df.columns}")
    return df


def detect_text_column(df):
    """First column with a usual text name, otherwise the first column."""
    return next((c for c in df.columns if c.lower() in TEXT_COLUMN_NAMES), df.columns[0])


def read_csv(spark, path, schema, encoding="UTF-8", as_text=False, multi_line=False):
    """CSV with a header; ``as_text`` reads every column as string.

    ``multi_line`` allows line breaks in quotes, for which a file is read whole by one task.
    """
    return (spark.read.schema(all_string(schema) if as_text else schema)
            .option("header", True).option("encoding", encoding)
            .option("multiLine", multi_line).option("escape", '"').csv(path))


def read_csv_fallback(spark, path, schema, encodings=("UTF-8", "ISO-8859-1"), multi_line=False):
    """CSV whose files are each in UTF-8, or in the second encoding where some text of the file is no valid UTF-8.

    Read byte for byte (each byte as one character; separators, quotes and breaks are the same bytes in both); texts are
    decoded afterwards, each by what its own file holds. A replacement character that stands in a valid text is no
    sign. Whether a file is valid is combined before the shuffle, and only the invalid files are joined to the rows. The
    first encoding must be UTF-8, the second one in which ASCII characters are their own bytes.
    """
    texts = [f.name for f in schema.fields if f.dataType.typeName() == "string"]
    rows = read_csv(spark, path, schema, "ISO-8859-1", multi_line=multi_line)
    if not texts:
        return rows
    raw = lambda c: F.encode(F.col(c), "ISO-8859-1")
    named = rows.select("*", F.col("_metadata.file_path").alias("_file"))
    broken = F.lit(False)
    for c in texts:
        broken = broken | ~F.coalesce(F.is_valid_utf8(raw(c).cast("string")), F.lit(True))
    other = named.where(broken).select("_file").distinct().withColumn("_other", F.lit(True))
    decoded = [F.when(F.col("_other"), F.decode(raw(f.name), encodings[1])).otherwise(raw(f.name).cast("string"))
               .alias(f.name) if f.name in texts else F.col(f.name) for f in schema.fields]
    return named.join(other, "_file", "left").select(*decoded)


def read_turns(spark, path, schema, fmt="parquet", **options):
    """A turn table in Parquet or CSV."""
    if fmt == "csv":
        return read_csv(spark, path, schema, **options)
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def read_lines(spark, path):
    """(source, line_no, value): text files by line, numbered from 0 in their file without gaps, blank lines counted.

    A large file is read in splits by many tasks; a line belongs to the split it begins in. Lines of a split are numbered at
    the scan, splits of a file are counted first, and the table of one row per split gives each its first number.
    """
    split = ["source", "_start"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_start"),
        "value", F.monotonically_increasing_id().alias("_id"))
    counts = lines.groupBy(split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("source").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    offsets = counts.select(*split, (before - F.col("_first")).alias("_shift"))
    return lines.join(offsets, split).select("source", (F.col("_id") + F.col("_shift")).alias("line_no"), "value")


def _pipe_fields(lines, at_least):
    fields = F.split("value", r"\|")
    return lines.where((F.trim("value") != "") & (F.size(fields) >= at_least)).withColumn("f", fields)


def _field(i):
    return F.trim(F.get("f", F.lit(i)))


def read_pipe_utterances(spark, path):
    """``speaker|utterance|..|..|tag`` lines; blank lines and lines of fewer fields are skipped.

    ``line_no`` is the line's number in its file, skipped lines counted; the file itself is the conversation.
    """
    return _pipe_fields(read_lines(spark, path), 5).select(
        "source", "line_no",
        _field(0).alias("speaker"), _field(1).alias("utterance"),
        F.get("f", F.lit(2)).alias("f2"), F.get("f", F.lit(3)).alias("f3"), _field(4).alias("da"))


def read_pipe_turns(spark, path):
    """``speaker|text|labels`` lines; lines without text or labels are dropped."""
    turns = _pipe_fields(spark.read.text(path), 3).select(
        _field(0).alias("speaker"), _field(1).alias("utterance"),
        F.filter(F.transform(F.split(F.get("f", F.lit(2)), ","), lambda x: F.trim(x)),
                 lambda x: x != "").alias("da_labels"))
    return turns.where((F.col("utterance") != "") & (F.size("da_labels") > 0))


def null_profile(df, cols):
    """Missing and present values per column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(f"c{i}")).alias("nulls"),
                 F.col(f"c{i}").alias("present")) for i, c in enumerate(cols)]))
    return counts.select(cells.alias("c")).select("c.*")


def fill_defaults(df, text=(), numbers=()):
    """Missing text becomes '', missing numbers 0.0."""
    out = df.na.fill("", subset=list(text)) if text else df
    return out.na.fill(0.0, subset=list(numbers)) if numbers else out


def rename(df, mapping):
    """Keep exactly the mapped columns under their new names."""
    return df.select(*[F.col(a).alias(b) for a, b in mapping.items()])


def drop_null(df, subset):
    return df.na.drop(subset=list(subset))


def _last_bundle(spark, directory):
    entries = spark.read.schema(MANIFEST).json(f"{directory}/manifest")
    newest = entries.agg(F.max(F.struct("version", "run")).alias("at"))
    return entries.join(newest, F.struct("version", "run") == F.col("at")).drop("at")


def bundle_tables(spark, directory):
    """{name: (format, path)} of the newest complete bundle in a directory."""
    return {r["name"]: (r["format"], r["path"]) for r in _last_bundle(spark, directory).collect()}


def read_bundle(spark, directory, name):
    """One table of the newest complete bundle; what a failed writer left behind is never read."""
    tables = bundle_tables(spark, directory)
    if name not in tables:
        raise KeyError(f"no table {name} in the bundle; it holds {sorted(tables)}")
    fmt, path = tables[name]
    return spark.read.option("header", True).format(fmt).load(f"{directory}/{path}")
