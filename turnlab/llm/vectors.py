"""Embedding near-duplicates: signs of random projections in several tables, exact cosine, connected components.

Equal vectors of a label are one class from the start. A class meets others in the buckets of its table signatures;
a bucket larger than BLOCK is cut into blocks, and every pair of blocks is a task's group of bounded size. Tasks
compute cosines in double precision by matrix products and give back, for each class, how many vectors it
links to, and a few links that join what is linked: never a pair each. A pair that shares buckets in
several tables counts in the first of them only.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnlab.llm.common import cut, small_batches
from turnlab.llm.components import connected_components

COSINE = 0.98
RECALL = 0.9999         # wanted for a pair exactly at the threshold; closer pairs are found more surely
BLOCK = 1024            # classes of a bucket compared at once
SEED = 7


def table_plan(n, cosine=COSINE, recall=RECALL):
    """(bits, tables) for ``n`` classes: bits grow with the logarithm of n, tables so that ``recall`` is kept."""
    bits = max(8, round(math.log2(max(2, n))) - 4)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def signatures(vectors, bits, tables, seed=SEED):
    """Bucket numbers (rows x tables) of an array of vectors of one dimension."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    positive = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return positive @ (1 << np.arange(bits, dtype=np.int64))


def usable(embedding="embedding", label="label"):
    """Whether a vector may link: a label, and a non-zero vector of finite components."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _stacked(column):
    """An Arrow column of lists as arrays of one dimension each: (rows, matrix)."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[starts[rows][:, None] + np.arange(d)]


def _sign(bits, tables):
    def run(batches):
        for batch in batches:
            found = np.zeros((len(batch), tables), np.int64)
            for rows, matrix in _stacked(batch.column(batch.schema.get_field_index("x"))):
                found[rows] = signatures(matrix, bits, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables),
                                             pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "signs"])
    return run


_KEYS, _WHOLE = ("bucket", "i", "j"), ("cid", "side", "copies", "tbl")


def _arrays(batch):
    """A batch as arrays by name; ``x`` as vectors of length one (all of a group have one dimension)."""
    at = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
    out = {c: at[c].to_numpy(zero_copy_only=False) for c in (*_KEYS, *_WHOLE)}
    out["signs"] = np.stack(at["signs"].to_numpy(zero_copy_only=False)) if len(batch) else np.empty((0, 0), np.int64)
    x = np.empty(len(batch), object)
    for rows, matrix in _stacked(at["x"]):
        matrix /= np.sqrt((matrix * matrix).sum(axis=1))[:, None]
        for row, vector in zip(rows.tolist(), matrix):
            x[row] = vector
    return out | {"x": x}


def _group_links(part, a, b, cosine):
    """Rows (class, links, to) of one group, the rows a to b of ``part``: how many vectors each class links to
    (``to`` itself), and links that join what the group links."""
    x, signs = np.stack(part["x"][a:b]), part["signs"][a:b]
    cid, copies, table = part["cid"][a:b], part["copies"][a:b], int(part["tbl"][a])
    one = part["side"][a:b] == 0
    within = part["i"][a] == part["j"][a]
    other = one if within else ~one
    near = x[one] @ x[other].T >= cosine
    if within:
        np.fill_diagonal(near, False)
    if not near.any():
        return []
    for t in range(table):  # met before
        near &= signs[one, t][:, None] != signs[other, t][None, :]
    counts = np.zeros(b - a, np.int64)
    counts[one] += near @ copies[other]
    if not within:
        counts[other] += near.T @ copies[one]
    out = [(int(cid[i]), int(counts[i]), int(cid[i])) for i in np.flatnonzero(counts)]
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return out
    p, q, near = cid[one][rows], cid[other][columns], near[np.ix_(rows, columns)]
    top, most = p.copy(), np.iinfo(np.int64).max
    while True:  # the least class that each reaches within the group
        below = np.minimum(q, np.where(near, top[:, None], most).min(axis=0))
        new = np.minimum(top, np.where(near, below[None, :], most).min(axis=1))
        if (new == top).all():
            break
        top = new
    pairs = {*zip(p.tolist(), top.tolist()), *zip(q.tolist(), below.tolist())}
    return out + [(m, 0, n) for m, n in pairs if m != n]


def _compare(cosine):
    """Over rows sorted by group; a group that goes on in the next batch is held."""
    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))],
                                          names=["cid", "links", "to"])

    def run(batches):
        held = None
        for batch in batches:
            part = _arrays(batch)
            if held is not None:
                part = {c: np.concatenate([held[c], part[c]]) for c in part} if len(batch) else held
            n = len(part["cid"])
            changes = np.zeros(max(0, n - 1), bool)
            for key in _KEYS:
                changes |= part[key][1:] != part[key][:-1]
            starts = [0, *(np.flatnonzero(changes) + 1).tolist()]
            out = []
            for a, b in zip(starts, starts[1:]):
                if b - a > 1:
                    out += _group_links(part, a, b, cosine)
            held = {c: v[starts[-1]:] for c, v in part.items()}
            yield as_batch(out)
        if held is not None and len(held["cid"]) > 1:
            yield as_batch(_group_links(held, 0, len(held["cid"]), cosine))
    return run


def near_duplicates(rows, vec_id="vec_id", embedding="embedding", label="label", cosine=COSINE, recall=RECALL):
    """One row per vector: vec_id, n_links, component_id and kept.

    Linked are pairs of equal, non-null label with a cosine of ``cosine`` or more. A vector that is null, zero or
    holds null or non-finite components links with nothing, nor do vectors of different lengths or without
    vec_id. Repeated rows are vectors of their own, linked to each other; an empty table gives no rows; other
    columns are not read.
    """
    spark = rows.sparkSession
    small_batches(spark)
    all_rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
                           F.col(embedding).alias("embedding"))
    fit = usable() & F.col("vec_id").isNotNull()
    x = F.transform("embedding", lambda v: v + F.lit(0.0).cast("float"))  # one zero only
    good = all_rows.where(fit).select("vec_id", "label", x.alias("x"))
    classes = cut(good.groupBy("label", "x").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
                  .withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits, tables = table_plan(classes.count(), cosine, recall)
    kind = dict(classes.dtypes)["x"]
    signed = cut(classes.select("cid", "label", "copies", "x").mapInArrow(
        _sign(bits, tables), f"cid long, label {dict(classes.dtypes)['label']}, copies long, x {kind}, "
        "signs array<long>"), "signed")
    met = signed.select("cid", F.posexplode("signs").alias("tbl", "sign"), "label", F.size("x").alias("d")).select(
        "cid", "tbl", F.xxhash64("label", "d", "tbl", "sign").alias("bucket"))
    sizes = (met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
             .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    shared = met.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("cid", "bucket"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = shared.select("cid", "tbl", "bucket", "own", other.alias("other")).select(
        "cid", "tbl", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"))
    full = paired.join(signed.select("cid", "copies", "x", "signs"), "cid")
    dealt = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "cid")
    compared = cut(dealt.select("bucket", "i", "j", "cid", "tbl", "side", "copies", "x", "signs").mapInArrow(
        _compare(cosine), "cid long, links long, to long"), "compared")
    labels = cut(connected_components(compared.where("cid != to").select(F.col("cid").alias("a"),
                                                                        F.col("to").alias("b"))), "labels")
    counts = compared.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = labels.join(classes.select(F.col("cid").alias("node"), "first"), "node")
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    placed = joined.join(least, "component").select(F.col("node").alias("cid"), "least")
    known = (classes.join(counts, "cid", "left").join(placed, "cid", "left")
             .select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("least", "first").alias("component_id")))
    linked = good.join(known, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = all_rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT * FROM u WHERE n > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND a.vec_id != b.vec_id
          WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a) USING (vec_id)
       LEFT JOIN (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a) USING (vec_id)
"""
