"""Importance resampling towards a target: hashed n-gram features by overlapped scanning, Gumbel top-k drawing.

A text becomes lower-case words parted by single spaces. One overlapped scan of a regular expression, whose lookarounds
hold it to word boundaries, gives at every word the spans of the n-grams that begin there; the CRC of a span names
its bucket. Buckets are kept per document (two bytes a feature), so texts are scanned once: counts of both sides, gains and
weights come from the kept buckets. The drawing needs only a table of distinct scores in order, never a sort in one task.
"""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnlab.llm.common import cut, with_columns
from turnlab.operators.ordering import cumulate

BUCKETS = 10_000        # at most 65,536: a bucket is kept in two bytes
LONGEST = 3             # words of the longest feature
LEAST_WORDS = 20        # of a document that may be drawn
PERCENT = 5
SEED = 42

_APART = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SCALE = 1000


def gram_pattern(longest=LONGEST):
    """Matches at a word's start; group n is what an n-gram has beyond that of n - 1 words (a space and a word)."""
    more = b""
    for _ in range(longest - 1):
        more = rb"(?:( [^ ]++)" + more + rb")?"
    return regex.compile(rb"(?<= )([^ ]++)" + more + rb"(?= )")


def text_buckets(text, pattern, buckets=BUCKETS):
    """(number of words, buckets of all features in text order) of a text; null has none."""
    spaced = b" " + _APART.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()) + b" "
    crc32, found, words = zlib.crc32, [], 0
    parts = []
    for match in pattern.finditer(spaced, overlapped=True):
        words += 1
        crc = 0
        for part in match.groups():  # a longer n-gram's CRC goes on from that of the shorter one
            if part is None:
                break
            crc = crc32(part, crc)
            found.append(crc)
        if len(found) >= 1 << 16:
            parts.append((np.array(found, np.uint32) % buckets).astype("<u2"))
            found = []
    parts.append((np.array(found, np.uint32) % buckets).astype("<u2"))
    return words, np.concatenate(parts)


def featured(docs, text="text", buckets=BUCKETS, longest=LONGEST):
    """``docs`` with n_words (long) and buckets (binary, two bytes a feature) in place of columns so named."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be from 1 to 65,536")

    def compute(texts):
        pattern = gram_pattern(longest)
        found = [text_buckets(t, pattern, buckets) for t in texts]
        return [[n for n, _ in found], [b.tobytes() for _, b in found]]

    return with_columns(docs, [text], compute, "n_words long, buckets binary")


def bucket_counts(rows, buckets=BUCKETS):
    """How often each bucket occurs in ``rows`` (as ``featured`` gives them): an array of ``buckets`` numbers.

    A task counts its whole partition and gives back at most one row per bucket; only ``buckets`` sums reach the driver.
    """
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column(0):
                total += np.bincount(np.frombuffer(held.as_py(), "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    total = np.zeros(buckets, np.int64)
    total[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total


def gains(source, target):
    """Gain of each bucket in thousandths of a nat, from the counts of the source and of the target, one added to each."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(_SCALE * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs, target, doc_id="doc_id", text="text", buckets=BUCKETS, longest=LONGEST, seed=SEED):
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs``.

    weight is the sum of the gains of a row's features, by the counts of all ``docs`` and all of ``target`` (its column
    ``text``). score adds Gumbel noise that only depends on the seed and the id. Null and wordless texts have no feature and
    weight 0; repeated rows each count and each get a row; a null id draws the noise of an empty one; an empty target or
    an empty ``docs`` counts zero everywhere; other columns are not read.
    """
    rows = featured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", buckets, longest)
    rows = cut(rows.select("doc_id", "n_words", "buckets"), "features")
    aims = featured(target.select(F.col(text).alias("text")), "text", buckets, longest)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(aims, buckets))

    def compute(held):
        found = [np.frombuffer(b, "<u2") for b in held]
        return [[len(b) for b in found], [int(gain[b].sum()) for b in found]]

    weights = with_columns(rows, ["buckets"], compute, "n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-float(_SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weights.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def drawn(scored, percent=PERCENT, least_words=LEAST_WORDS):
    """``scored`` (as ``weighed`` gives it) with rank: 1, 2, 3, ... of the drawn rows, null of the others.

    Drawn are the floor(percent * n / 100) highest scores of the n rows of at least ``least_words`` words; ties go to the
    smaller id (null first), then to fewer features. Rows are numbered within a score, which noise keeps to few rows each;
    scores are put in order by ranges.
    """
    scored = cut(scored, "scored")
    may = F.col("n_words") >= least_words
    n = scored.where(may).count()
    wanted = n * percent // 100
    counts = scored.where(may).groupBy((-F.col("score")).alias("behind")).agg(F.count("*").alias("n"))
    above = cumulate(counts, "behind", ["n"]).where(F.col("below_n") < wanted)
    above = cut(above.select((-F.col("behind")).alias("of"), F.col("below_n").alias("above")), "scores-drawn")
    placed = scored.join(above, may & (F.col("score") == F.col("of")), "left").drop("of")
    order = Window.partitionBy("score").orderBy("doc_id", "n_features")
    place = (F.col("above") + F.row_number().over(order)).cast("long")
    near = placed.where("above IS NOT NULL").withColumn("rank", F.when(place <= wanted, place))
    rest = placed.where("above IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return near.unionByName(rest).drop("above")


def resample(docs, target, doc_id="doc_id", text="text", percent=PERCENT, least_words=LEAST_WORDS,
             buckets=BUCKETS, longest=LONGEST, seed=SEED):
    """Every row's features, weight, score and rank; see ``weighed`` and ``drawn``."""
    return drawn(weighed(docs, target, doc_id, text, buckets, longest, seed), percent, least_words)


def digest(found):
    """The contract's columns."""
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH chars AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
steps AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda b: 0::BIGINT),
                          lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) x(i))),
texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (SELECT row_number() OVER () AS r, side, id,
                 regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM texts, chars),
grams AS (SELECT r, side, array_to_string(w[s:s + n - 1], ' ') AS g
          FROM (SELECT r, side, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, (SELECT unnest([1, 2, 3]) AS n))),
crcs AS (SELECT g, xor(4294967295, list_reduce(
             [4294967295::BIGINT] || list_transform(range(octet_length(encode(g))),
                 lambda k: ('0x' || substr(hex(encode(g)), (2 * k + 1)::INT, 2))::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
         FROM (SELECT DISTINCT g FROM grams), steps),
held AS (SELECT r, side, bucket FROM grams JOIN crcs USING (g)),
s AS (SELECT bucket, count(*) AS n FROM held WHERE side = 's' GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM held WHERE side = 't' GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE
                / ((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS g
         FROM s FULL JOIN t USING (bucket)),
sums AS (SELECT r, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight
         FROM held JOIN gain USING (bucket) WHERE side = 's' GROUP BY r),
scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                      (('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT)
                  AS score
           FROM words LEFT JOIN sums USING (r) WHERE side = 's'),
may AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
        FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN place <= 5 * n // 100 THEN place END AS BIGINT) AS rank FROM may
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < 20
"""
