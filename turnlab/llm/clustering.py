"""Exact centroid clustering over subvector dictionaries.

Vectors of whole numbers are cut into blocks of neighbouring dimensions. A chunk of vectors keeps, for each block, the
distinct subvectors it holds and one code per vector: nothing is lost, and copies cost one code. A round computes the
squared distances of a dictionary's subvectors to all centroids once and sums them for the vectors by code. Dictionaries
belong to chunks, as in column files: one of a whole corpus of continuous values grows with it, and every round would
have to shuffle each block of each vector to it. A round is one pass over the written chunks; only sums of clusters
(clusters x dimensions, combined in each task) leave it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnlab.llm.common import cut

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
WIDTH = 2               # dimensions of a block
CHUNK = 16_384          # most vectors of a chunk
LARGEST = 1 << 27       # of a component as a whole number: 64 squared differences then fit a long

_CHUNKS = "ids array<long>, codes binary, sizes array<int>, words binary"


def scaled(vectors, vec_id="vec_id", embedding="embedding", dimensions=DIMENSIONS, scale=SCALE):
    """(vec_id, x) of the vectors that are kept: exactly ``dimensions`` components, none null or non-finite.

    x holds floor(scale * component) in double precision as longs.
    """
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where((F.size(x) == dimensions) & finite)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"),
                       F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("x"))


def first_centroids(rows, clusters=CLUSTERS, seed=SEED):
    """The vectors of the ``clusters`` rows whose ids have the least hash (then the least id and vector), in that order."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [r.x for r in rows.orderBy(F.sha2(named, 256), "vec_id", "x").limit(clusters).select("x").collect()]


def encode(matrix, width=WIDTH):
    """(codes, sizes, words) of an integer matrix (rows x dimensions).

    ``codes`` (blocks x rows) number a block's distinct subvectors in sorted order, ``sizes`` tells how many there are,
    ``words`` holds them one block after the other, padded with zeros where the last block is narrower.
    """
    codes, sizes, words = [], [], []
    for at in range(0, matrix.shape[1], width):
        part = np.zeros((len(matrix), width), np.int64)
        block = matrix[:, at:at + width]
        part[:, :block.shape[1]] = block
        order = np.lexsort(part.T[::-1])
        ranked = part[order]
        new = np.ones(len(part), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        code = np.empty(len(part), np.int32)
        code[order] = np.cumsum(new) - 1
        codes.append(code)
        sizes.append(int(new.sum()))
        words.append(ranked[new])
    return np.array(codes, "<i4"), sizes, np.concatenate(words).astype("<i4")


def decode(codes, sizes, words, dimensions, width=WIDTH):
    """The matrix that ``encode`` was given."""
    starts = np.cumsum([0, *sizes[:-1]])
    return np.concatenate([words[s + c] for s, c in zip(starts, codes)], axis=1)[:, :dimensions].astype(np.int64)


def distances(codes, sizes, words, centroids, width=WIDTH):
    """Squared distances (rows x clusters), summed from those of the distinct subvectors."""
    padded = np.zeros((len(centroids), width * len(sizes)), np.int64)
    padded[:, :centroids.shape[1]] = centroids
    total, start = np.zeros((codes.shape[1], len(centroids)), np.int64), 0
    for b, (code, size) in enumerate(zip(codes, sizes)):
        word = words[start:start + size].astype(np.int64)
        start += size
        apart = word[:, None, :] - padded[None, :, b * width:(b + 1) * width]
        total += (apart * apart).sum(axis=2)[code]
    return total


def _chunked(rows, dimensions, width, chunk):
    """The rows as chunks, a table of ``_CHUNKS``."""
    def packed(ids, matrix):
        codes, sizes, words = encode(matrix, width)
        return ids, codes.tobytes(), sizes, words.tobytes()

    def run(batches):
        held, count = [], 0

        def flush():
            ids = [i for part, _ in held for i in part]
            found = packed(ids, np.concatenate([m for _, m in held]))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(found, (
                pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.binary()))], ["ids", "codes", "sizes", "words"])

        for batch in batches:
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            if len(matrix) and np.abs(matrix).max() > LARGEST:
                raise OverflowError(f"a component is larger than {LARGEST} after scaling")
            ids = batch.column(0).to_pylist()
            for i in range(0, len(ids), chunk):
                if count + len(ids[i:i + chunk]) > chunk:
                    yield flush()
                    held, count = [], 0
                held.append((ids[i:i + chunk], matrix[i:i + chunk].astype(np.int32)))
                count += len(ids[i:i + chunk])
        if count:
            yield flush()

    return rows.select("vec_id", "x").mapInArrow(run, _CHUNKS)


def _read(batch, i, width):
    """ids, codes, sizes and words of a chunk."""
    ids, sizes = batch.column(0)[i].values, batch.column(2)[i].as_py()
    codes = np.frombuffer(batch.column(1)[i].as_py(), "<i4").reshape(len(sizes), -1)
    return ids, codes, sizes, np.frombuffer(batch.column(3)[i].as_py(), "<i4").reshape(-1, width)


def _sums(chunks, centroids, width):
    """How many vectors each centroid is nearest to, and their componentwise sums, as whole numbers."""
    k, dimensions = centroids.shape

    def run(batches):
        count, total = [0] * k, [[0] * dimensions for _ in range(k)]
        for batch in batches:
            for i in range(len(batch)):
                _, codes, sizes, words = _read(batch, i, width)
                near = distances(codes, sizes, words, centroids, width).argmin(axis=1)
                matrix = decode(codes, sizes, words, dimensions, width)
                for c in np.unique(near):
                    count[c] += int((near == c).sum())
                    total[c] = [a + b for a, b in zip(total[c], matrix[near == c].sum(axis=0).tolist())]
        used = [c for c in range(k) if count[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c in used for _ in range(dimensions + 1)], pa.int32()),
             pa.array([d for _ in used for d in range(-1, dimensions)], pa.int32()),
             pa.array([v for c in used for v in (count[c], *total[c])], pa.int64())], ["cluster", "dimension", "value"])

    parts = chunks.mapInArrow(run, "cluster int, dimension int, value long")
    found = parts.groupBy("cluster", "dimension").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    return {(r.cluster, r.dimension): int(r.value) for r in found}


def cluster(vectors, vec_id="vec_id", embedding="embedding", clusters=CLUSTERS, rounds=ROUNDS, dimensions=DIMENSIONS,
            scale=SCALE, seed=SEED, width=WIDTH, chunk=CHUNK):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that is kept.

    Components become floor(scale * x); vectors of another length, null ones and those with null or non-finite
    components are left out. Centroids start as the ``clusters`` vectors whose ids have the least hash (of fewer
    vectors: all of them). A round assigns every vector to the nearest centroid, the smaller number on ties, and moves
    each centroid that has any to the floor of their mean, componentwise; all sums are exact. Repeated ids and null
    ids are vectors of their own (a null id is hashed as the empty text); no vectors give no rows; other columns are not
    read. Components beyond 2^27 after scaling raise, since distances would not fit a long.
    """
    rows = scaled(vectors, vec_id, embedding, dimensions, scale)
    chunks = cut(_chunked(rows, dimensions, width, chunk), "chunks")
    centroids = np.array(first_centroids(rows, clusters, seed), np.int64).reshape(-1, dimensions)
    if not len(centroids):
        return chunks.sparkSession.createDataFrame([], _FOUND)
    for _ in range(rounds):
        sums, old = _sums(chunks, centroids, width), centroids
        centroids = np.array([[sums[c, d] // sums[c, -1] for d in range(dimensions)] if (c, -1) in sums else old[c]
                              for c in range(len(old))], np.int64)

    def assign(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids, codes, sizes, words = _read(batch, i, width)
                apart = distances(codes, sizes, words, centroids, width)
                near = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(near, pa.int32()), pa.array(apart[np.arange(len(near)), near], pa.int64())],
                    ["vec_id", "cluster", "distance"])

    found = cut(chunks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    each = F.create_map(*[F.lit(v) for c, t in inertia.items() for v in (c, t)])
    ends = F.create_map(*[F.lit(v) for c in inertia for v in (c, centroids[c].tolist())])
    return found.select("vec_id", "cluster", "distance", each[F.col("cluster")].cast("long").alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                        ends[F.col("cluster")].cast("array<long>").alias("centroid"))


_FOUND = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"


def digest(found):
    """The contract's columns."""
    name = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", name.alias("centroid_sha256"))


def _oracle(clusters=CLUSTERS, rounds=ROUNDS, dimensions=DIMENSIONS, scale=SCALE, seed=SEED):
    def assigned(name, before):
        return f"""
{name} AS MATERIALIZED (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT r, cluster, CAST(list_sum(list_transform(range(1, {dimensions + 1}),
               lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d FROM v, {before} c) GROUP BY r)"""

    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda e: CAST(floor({scale} * e::DOUBLE) AS BIGINT)) AS x
      FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: isfinite(e))) = {dimensions}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, x) - 1 AS cluster, x
                    FROM (SELECT *, sha256('{seed}:' || vec_id) AS h FROM v) ORDER BY h, vec_id, x LIMIT {clusters})"""]
    for n in range(rounds):
        steps.append(assigned(f"a{n}", f"c{n}"))
        steps.append(f"""
m{n} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT cluster, i, sum(x[i]) AS s, count(*) AS n
    FROM a{n} JOIN v USING (r), (SELECT unnest(range(1, {dimensions + 1})) AS i) GROUP BY cluster, i) GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (cluster))""")
    steps.append(assigned("last", f"c{rounds}"))
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM last JOIN v USING (r) JOIN c{rounds} c USING (cluster)"""


ORACLE = _oracle()
