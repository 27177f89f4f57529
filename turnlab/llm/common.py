"""Helpers that the operators of this subpackage share."""

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark):
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session one of our own where it is unset."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="turnlab-shared-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark, name):
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df, name, read=()):
    """``df`` written to the shared folder and read again: no lineage, nothing lost with an executor.

    ``read`` are tables of this function that nothing but ``df`` reads; they are deleted once ``df`` is written.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    done(*read)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def done(*tables):
    """Deletes tables of ``cut`` that nothing reads any more; other DataFrames are passed over."""
    for table in tables:
        path = vars(table).get("cut_path")
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def filter_of(keys, least=20, most=28):
    """(bits, broadcast) of a filter in front of a join: which values of its ``key`` (long) modulo ``bits`` are among ``keys``.

    About 16 bits a key, 2^``least`` to 2^``most``; of more keys it only lets more rows through. What comes to the driver are
    pieces of the filter, a bit each.
    """
    keys = keys.toDF("key")
    bits = 1 << min(most, max(least, (16 * keys.count()).bit_length()))
    at = F.pmod("key", F.lit(bits))
    pieces = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("piece"))
    marks = np.zeros(bits // 8 + 4096, np.uint8)  # pieces of 4096 bytes; the number 0 has one of its own
    for bucket, piece in pieces.collect():
        marks[4096 * bucket:4096 * (bucket + 1)] = np.frombuffer(piece, np.uint8)
    return bits, keys.sparkSession.sparkContext.broadcast(marks)


def is_marked(marks, column):
    """Whether the numbers of an Arrow column (a key modulo the bits) are in the filter's ``marks``."""
    at = column.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.where(at > 0, at - 1 + 8 * 4096, 0)  # as bitmap_bucket_number and bitmap_bit_position count
    return pa.array((marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))


def small_batches(spark, rows=500, size="8m"):
    """Bounds what a Python worker holds at once, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def with_columns(df, inputs, compute, added, raw=False):
    """``df`` with the columns ``added`` (a DDL string), computed batch by batch from the columns ``inputs``.

    ``compute`` takes one Python list (with ``raw`` an Arrow array) per input and returns one list or Arrow array per
    added column. A column of ``df`` that has the name of an added one is replaced.
    """
    small_batches(df.sparkSession)
    new = StructType.fromDDL(added)
    taken = {c.lower() for c in new.names}
    kept = df.select(*[F.col(_quoted(c)) for c in df.columns if c.lower() not in taken or c in inputs])
    stay = [c for c in kept.columns if c.lower() not in taken]
    schema = StructType([kept.schema[c] for c in stay] + list(new.fields))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        types = [f.type for f in to_arrow_schema(new)]
        for batch in batches:
            given = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            found = compute(*(given if raw else [x.to_pylist() for x in given]))
            made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(found, types, strict=True)]
            old = [batch.column(batch.schema.get_field_index(c)) for c in stay]
            yield pa.RecordBatch.from_arrays(old + made, names=stay + new.names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return kept.mapInArrow(run, schema)


def _quoted(name):
    return "`" + name.replace("`", "``") + "`"


#: A-Z only, as the contracts say; str.lower() would change other letters too.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def local_path(uri):
    """The file system and path of a URI, as pyarrow names them."""
    from pyarrow import fs
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", uri):
        uri = re.sub(r"^file:/+", "file:///", uri)
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri
