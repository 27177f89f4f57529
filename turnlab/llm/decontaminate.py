"""Benchmark decontamination by winnowing.

Of every WINDOW - GRAM + 1 neighbouring hashes of GRAM words the least is kept (the rightmost of equals), for training
and benchmark texts alike. A shared run of WINDOW words holds the same hashes on both sides and so the same kept one:
none is missed. Kept hashes of both sides are joined, each hit is extended to the windows around it, and those are
joined by their whole text. Items of fewer words are one window of their own length, for which every run is kept.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnlab.llm.common import ASCII_LOWER, cut, small_batches

WINDOW, GRAM = 10, 5
FILTER_BITS = 1 << 23   # of the fixed-size filter that tasks get; what passes wrongly fails the join
_CHUNK = 1 << 20        # bytes hashed at once; a longer text is hashed alone
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words_of(text):
    """Words of a text: runs of digits, letters a-z after lower-casing A-Z, and all beyond ASCII."""
    return _WORD.findall(text.translate(ASCII_LOWER)) if text else []


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n):
        if len(cls.up) < n:
            inverse = pow(int(_BASE), -1, 1 << 64)
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(inverse))], dtype=np.uint64)
        return cls.up, cls.down


class Words:
    """The words of some texts: hashes, the text each is in, and the bytes they lie in."""

    def __init__(self, texts):
        self.data = b" ".join(texts).lower()
        codes = np.frombuffer(self.data, np.uint8)
        edge = np.diff(np.r_[np.int8(0), _IS_WORD[codes].astype(np.int8), np.int8(0)])
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _Powers.of(len(codes) + 1)
        total = np.r_[np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:len(codes)])]
        self.hash = _mix((total[self.stop] - total[self.start]) * down[self.start])
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.text = np.searchsorted(begins, self.start, side="right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))  # word numbers where texts begin

    def grams(self, k):
        """Hashes of k words from each word on, and whether those lie in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        out = np.full(n, np.uint64(k))
        for j in range(k):
            out = out * _BASE + self.hash[j:j + n]
        return _mix(out), self.text[:n] == self.text[k - 1:]

    def winnowed(self):
        """Positions and hashes of the grams kept by winnowing."""
        grams, _ = self.grams(GRAM)
        n, span = len(self.hash) - WINDOW + 1, WINDOW - GRAM + 1
        if n <= 0:
            return np.empty(0, int), np.empty(0, np.uint64)
        least, at = grams[:n].copy(), np.arange(n)
        for j in range(1, span):
            other = grams[j:j + n]
            lower = other <= least
            least[lower], at[lower] = other[lower], np.flatnonzero(lower) + j
        at = np.unique(at[self.text[:n] == self.text[WINDOW - 1:]])
        return at, grams[at]

    def spelled(self, a, b):
        return self.data[self.start[a]:self.stop[b - 1]]


def _joined(raw):
    """Words of a stretch of bytes with one space between them."""
    return " ".join(_WORD.findall(raw.decode("utf-8", "replace")))


def _chunks(texts):
    """(first row, encoded texts) of bounded size; null is empty."""
    part, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if part and size + len(raw) > _CHUNK:
            yield first, part
            part, size, first = [], 0, i
        part.append(raw)
        size += len(raw)
    if part:
        yield first, part


def _places(hashes):
    """Bits of the filter that stand for hashes."""
    return hashes & np.uint64(FILTER_BITS - 1), (hashes >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)


_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
                    ("length", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()),
                    ("around", pa.string())])


def _find(passed, lengths, id_type):
    """A task: a row for each document (length 0) and one for each kept gram that passes the filter, with the
    words around it."""
    schema = _FOUND.set(1, pa.field("doc_id", id_type))

    def run(batches):
        bits = np.unpackbits(np.frombuffer(passed.value, np.uint8), bitorder="little").view(bool)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2).to_pylist()
            for first, part in _chunks(batch.column(1).to_pylist()):
                words, out = Words(part), []
                for i in range(len(part)):
                    out.append((row + first + i, first + i, hashes[first + i],
                                int(words.first[i + 1] - words.first[i]), 0, None, None, None, None))
                for length in lengths:
                    if length == WINDOW:
                        at, grams = words.winnowed()
                    else:
                        grams, whole = words.grams(length)
                        at, grams = np.flatnonzero(whole), grams[whole]
                    a, b = _places(grams)
                    keep = bits[a.astype(np.int64)] & bits[b.astype(np.int64)]
                    for p, g in zip(at[keep].tolist(), grams[keep].view(np.int64).tolist()):
                        i = int(words.text[p])
                        if length == WINDOW:
                            begin = max(int(words.first[i]), p - (WINDOW - GRAM))
                            end = min(int(words.first[i + 1]), p + WINDOW)
                        else:
                            begin, end = p, p + length
                        out.append((row + first + i, first + i, hashes[first + i], None, length, g,
                                    p - int(words.first[i]), p - begin, _joined(words.spelled(begin, end))))
                columns = list(zip(*out))
                columns[1] = ids.take(pa.array(columns[1], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
                    schema=schema)
            row += len(batch)
    return run


def benchmark_windows(benchmark, item_id="item_id", text="text"):
    """(item_id, length, window): the distinct windows of every item, words joined by spaces."""
    def run(batches):
        for batch in batches:
            out = []
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(value)
                length = min(WINDOW, len(words))
                out += {(item, length, " ".join(words[i:i + length])) for i in range(len(words) - length + 1) if words}
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "length", "window"), x)) for x in out],
                                             schema=pa.schema([batch.schema.field(0).with_name("item_id"),
                                                               ("length", pa.int32()), ("window", pa.string())]))
    kind = dict(benchmark.dtypes)[item_id]
    return benchmark.select(item_id, text).mapInArrow(run, f"item_id {kind}, length int, window string").distinct()


def _window_hashes(windows):
    """(length, hash): for windows of WINDOW words the gram that winnowing keeps in them, else their own hash."""
    def run(batches):
        for batch in batches:
            lengths, hashes = [], []
            for length, window in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Words([window.encode()])
                found = words.winnowed()[1] if length == WINDOW else words.grams(length)[0]
                lengths += [length] * len(found)
                hashes += found.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(hashes, pa.int64())],
                                             names=["length", "hash"])
    return windows.select("length", "window").distinct().mapInArrow(run, "length int, hash long").distinct()


def _filter(hashes):
    """The fixed-size filter: bits are combined in Spark, so the driver gets FILTER_BITS at most."""
    mask = FILTER_BITS - 1
    bit = F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask)))
    words = (hashes.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for w in words:
        out[w["word"]] = w["bits"]
    return out.tobytes()


def hits(docs, benchmark, doc_id="doc_id", text="text"):
    """(documents, windows, items): rows of documents with n_words, their occurring windows, and windows' items.

    ``documents`` has (row, doc_id, text_hash, n_words); ``windows`` (row, start, length, window) with word numbers
    from 0; ``items`` (window, length, item_id).
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = cut(benchmark_windows(benchmark), "windows")
    kept = cut(_window_hashes(items), "window-hashes")
    lengths = sorted(r["length"] for r in kept.select("length").distinct().collect())  # ten values at most
    passed = spark.sparkContext.broadcast(_filter(kept))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(text).alias("text_hash"))
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    found = cut(rows.mapInArrow(
        _find(passed, lengths, kind), f"row long, doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, n_words long, "
        "length int, hash long, at long, lead int, around string"), "found")
    documents = found.where("length = 0").select("row", "doc_id", "text_hash", "n_words")
    grams = found.where("length > 0").join(kept, ["length", "hash"], "left_semi")
    spelled = F.split("around", " ")
    first = F.greatest(F.lit(0), F.col("lead") - (WINDOW - GRAM))
    last = F.least(F.col("lead"), F.size(spelled) - WINDOW)
    places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    long = (grams.where(F.col("length") == WINDOW).select("row", "at", "lead", "length", spelled.alias("words"),
                                                          F.explode(places).alias("i"))
            .select("row", (F.col("at") - F.col("lead") + F.col("i")).alias("start"), "length",
                    F.array_join(F.slice("words", F.col("i") + 1, F.lit(WINDOW)), " ").alias("window")))
    short = grams.where(F.col("length") < WINDOW).select("row", F.col("at").alias("start"), "length",
                                                         F.col("around").alias("window"))
    known = items.select("length", "window").distinct()
    windows = long.union(short).distinct().join(known, ["length", "window"], "left_semi")
    return documents, windows, items


def contamination(docs, benchmark, doc_id="doc_id", text="text"):
    """One row per document: doc_id, text_hash, n_words, n_hit (words in occurring windows), n_items, items (their
    ids, sorted as text) and contaminated.

    Null and empty texts have no words and no hits. Repeated documents each get a row, repeated items count once
    by id, items without an id or words add nothing to n_items. An empty benchmark hits nothing, an empty table of
    documents gives no rows. Other columns are not read.
    """
    documents, windows, items = hits(docs, benchmark, doc_id, text)
    windows = cut(windows, "hits")
    order = Window.partitionBy("row").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    before = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = (windows.select("row", F.greatest(F.lit(0), end - F.greatest("start", before)).alias("new"))
               .groupBy("row").agg(F.sum("new").alias("n_hit")))
    named = (windows.select("row", "length", "window").distinct().join(items, ["length", "window"])
             .where("item_id IS NOT NULL").groupBy("row")
             .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (documents.join(covered, "row", "left").join(named, "row", "left")
            .select("doc_id", "text_hash", "n_words", hit.alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    (hit > 0).alias("contaminated")))


def decontaminate(docs, benchmark, doc_id="doc_id", text="text"):
    """The rows of ``docs`` that hold no benchmark window; columns stay as they are."""
    bad = cut(contamination(docs, benchmark, doc_id, text).where("contaminated")
              .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left_anti")


def digest(found):
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH chars AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents, chars),
b AS (SELECT item_id, w, least(10, len(w)) AS m FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, chars)
      WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS t
          FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM b)),
spans AS (SELECT r, s, m, array_to_string(w[s:s + m - 1], ' ') AS t
          FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s
                FROM d, (SELECT DISTINCT m FROM items) WHERE len(w) >= m)),
hit AS (SELECT r, s, m, t FROM spans WHERE (m, t) IN (SELECT (m, t) FROM items)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(s, s + m)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit JOIN items USING (m, t)) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
