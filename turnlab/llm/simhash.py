"""SimHash near-duplicates found with vantage-point trees.

Distinct fingerprints are dealt to the leaves of a tree whose inner nodes split by Hamming distance from a vantage
fingerprint. A fingerprint within the search radius of a split also visits the other side, so every linked pair meets
in exactly one leaf. Tasks continue the same tree below their leaf and compare what remains directly. Only links that
span a leaf's groups leave a task; a distributed search joins them to components.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from turnlab.llm.common import cut, filter_of, is_marked, with_columns
from turnlab.llm.components import connected_components

SEED = 42
SAMPLE = 65_536         # fingerprints that place the vantage points of the upper tree; every fingerprint is dealt
SHARD = 4_096           # fingerprints wanted in a leaf of the upper tree
BLOCK = 128             # fingerprints that a task compares directly
_CHUNK = 1 << 16        # shingles counted at once


def shingle_hashes(text, words=3):
    """XXH64 of every run of ``words`` words (a shorter text: of all its words), as unsigned numbers."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    stop = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(stop[:-words] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stop[words - 1:].tolist())], np.uint64)


def fingerprint(text, words=3):
    """Signed 64-bit number whose bits are set where over half of the shingle hashes have theirs set."""
    return majority(shingle_hashes(text or "", words))


def majority(hashes):
    """``fingerprint`` of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i:i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs, text="text", words=3, name="fp"):
    """``docs`` with the column ``name`` (long), the fingerprint of the whole text; of null or no words it is zero."""
    return with_columns(docs, [text], lambda texts: [[fingerprint(t, words) for t in texts]], f"`{name}` long")


def distance(fps, point):
    return np.bitwise_count(fps ^ point)


def choose_split(fps, tries=8):
    """(vantage point, radius) that splits ``fps`` most evenly among a few points, or None where none splits them."""
    best, share = None, 0
    for point in fps[np.linspace(0, len(fps) - 1, min(tries, len(fps))).astype(int)]:
        within = np.cumsum(np.bincount(distance(fps, point), minlength=65))
        smaller = np.minimum(within, len(fps) - within)
        radius = int(smaller.argmax())
        if smaller[radius] > share:
            best, share = (point, radius), smaller[radius]
        if 20 * share >= 9 * len(fps):
            break
    return best


class VantageTree:
    """The upper tree: rows (vantage point, radius, inside child, outside child); a negative child is leaf -1-child."""

    def __init__(self, sample, leaves):
        self.points, self.radii, self.inside, self.outside, self.leaves = [], [], [], [], 0
        self.root = self._grow(sample, max(1, len(sample) // max(1, leaves)))

    def _grow(self, fps, enough):
        split = choose_split(fps) if len(fps) > max(1, enough) else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        node = len(self.points)
        self.points.append(split[0])
        self.radii.append(split[1])
        self.inside.append(None)
        self.outside.append(None)
        within = distance(fps, split[0]) <= split[1]
        self.inside[node] = self._grow(fps[within], enough)
        self.outside[node] = self._grow(fps[~within], enough)
        return node

    def deal(self, fps, reach):
        """Arrays (leaf, position in fps, visiting): the home of each fingerprint and the leaves it must visit."""
        out, todo = [], [(self.root, np.arange(len(fps)), np.zeros(len(fps), bool))]
        while todo:
            node, rows, visiting = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((np.full(len(rows), -1 - node), rows, visiting))
                continue
            for child, keep, visits in sides(distance(fps[rows], self.points[node]), visiting, self.radii[node], reach):
                todo.append(((self.inside, self.outside)[child][node], rows[keep], visits))
        return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, int),) * 3


def sides(away, visiting, radius, reach):
    """What goes inside and what outside at a node: (child, rows, visiting there), by the triangle inequality.

    A row at home stays at home on its side; inside rows near the radius visit the outside (the pair needs
    one visit only). A visitor goes wherever something within ``reach`` of it may lie.
    """
    within = away <= radius
    inside = np.where(visiting, away.astype(int) - reach <= radius, within)
    outside = np.where(visiting, away.astype(int) + reach > radius, ~within | (away.astype(int) + reach > radius))
    return (0, inside, visiting[inside]), (1, outside, (visiting | within)[outside])


def leaf_links(fps, visiting, reach):
    """Links (a, b) that join what lies within ``reach`` in a leaf: at most one for each fingerprint and block."""
    found, todo = [], [(fps, visiting)]
    while todo:
        fps, visiting = todo.pop()
        home = fps[~visiting]
        if not len(home) or len(fps) < 2:
            continue
        split = choose_split(home) if len(home) > BLOCK else None
        if split:
            for _, keep, visits in sides(distance(fps, split[0]), visiting, split[1], reach):
                todo.append((fps[keep], visits))
            continue
        for i in range(0, len(home), 4 * BLOCK):
            for j in range(0, len(fps), 16 * BLOCK):
                found += _block_links(home[i:i + 4 * BLOCK], fps[j:j + 16 * BLOCK], reach)
    return found


def _block_links(home, others, reach):
    near = np.bitwise_count(home[:, None] ^ others[None, :]) <= reach
    near &= home[:, None] != others[None, :]
    rows, columns = near.any(axis=1), near.any(axis=0)
    if not rows.any():
        return []
    home, others, near = home[rows], others[columns], near[np.ix_(rows, columns)]
    top = np.arange(len(home))
    side = np.full(len(others), len(home))
    while True:
        side = np.where(near, top[:, None], len(home)).min(axis=0)
        new = np.where(near, side[None, :], len(home)).min(axis=1)
        if (new == top).all():
            break
        top = new
    links = [(home, home[top]), (others, home[side])]
    return [(a[a != b], b[a != b]) for a, b in links]


def links(fps, reach=2, column="fp"):
    """Links (a, b) between the distinct values of ``fps`` that join all pairs at ``reach`` or fewer bits.

    The upper tree is placed by a bounded sample (the SAMPLE values of least hash), every value is dealt to it.
    """
    rows = fps.select(F.col(column).alias("fp")).where("fp IS NOT NULL")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    leaves = min(SAMPLE // 4, -(-n // SHARD))
    tree = VantageTree(sample.view(np.uint64), leaves)

    def deal(batches):
        for part in batches:
            values = part["fp"].to_numpy(np.int64)
            leaf, at, visiting = tree.deal(values.view(np.uint64), reach)
            yield pd.DataFrame({"leaf": leaf.astype(np.int64), "fp": values[at], "visiting": visiting})

    def compare(part):
        fps = part["fp"].to_numpy(np.int64).view(np.uint64)
        found = leaf_links(fps, part["visiting"].to_numpy(bool), reach)
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64),) * 2
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    dealt = rows.mapInPandas(deal, "leaf long, fp long, visiting boolean")
    return dealt.groupBy("leaf").applyInPandas(compare, "a long, b long")


def components(docs, doc_id="doc_id", text="text", words=3, reach=2):
    """(doc_id, fp, component_id) of every row of ``docs``; component_id is the smallest id reachable over links.

    Equal fingerprints are one class from the start, whatever the number of copies. Null and wordless texts have
    fingerprint zero and are linked like any other. Repeated rows each get a row; a null id gets its group's
    component_id, null if the group has no other id; an empty table gives no rows; other columns are not read.
    """
    rows = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                            words=words).select("doc_id", "fp"), "fingerprints")
    return labelled(rows, lambda classes: links(classes, reach))


def labelled(rows, link):
    """(doc_id, fp, component_id) of ``rows`` (doc_id, fp), linked by ``link`` of the table of distinct fp."""
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = cut(connected_components(link(classes)), "labels")
    joined = classes.join(labels, classes.fp == labels.node).select("fp", "first", "component")
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    merged = joined.join(least, "component").select(F.col("fp").alias("of"), "least")
    known = classes.join(merged, classes.fp == merged.of, "left").select(
        F.col("fp").alias("of"), F.coalesce("least", "first").alias("component_id"))
    known = cut(known, "component-ids")  # so that both sides of the next join come from a shuffle, which can be split
    return rows.join(known, rows.fp == known.of).select("doc_id", "fp", "component_id")


def deduplicate(docs, doc_id="doc_id", text="text", words=3, reach=2):
    """The rows of ``docs`` whose id is the smallest of their component, once each; columns stay as they are.

    Of rows that repeat a kept id in the same component one stays (that of the least text); of a group without ids
    one row stays.
    """
    found = components(docs, doc_id, text, words, reach)
    return smallest_rows(docs, found, lambda rows, name: fingerprints(rows, text, words, name), doc_id, text)


def smallest_rows(docs, found, named, doc_id="doc_id", text="text"):
    """``deduplicate`` for components ``found``; ``named`` adds their fp to rows under a given name."""
    stay = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = (found.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__times"), F.count_if(stay).alias("__kept"))
           .where("__times > 1 OR __kept = 0"))
    ids = cut(ids, "not-single")
    same = F.col(doc_id).eqNullSafe(F.col("__id"))
    # Most rows stay as they are. Which these are a filter tells for certain, so only the others are shuffled with their texts.
    bits, shared = filter_of(ids.select(F.xxhash64("__id")))
    marked = F.arrow_udf(lambda at: is_marked(shared.value, at), "boolean")(F.pmod(F.xxhash64(doc_id), F.lit(bits)))
    told = docs.withColumn("__marked", marked)
    doubtful = told.where("__marked").drop("__marked")
    single = told.where("NOT __marked").drop("__marked").unionByName(doubtful.join(ids, same, "left_anti"))
    # Rows of a repeated id may lie in several components, so they are picked by their text's fp too.
    often = ids.where("__times > 1 AND __kept > 0")
    kept = found.where(stay).join(often.select("__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    kept = cut(kept.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).distinct(), "kept-texts")
    several = named(doubtful.join(often, same, "left_semi"), "__of")
    several = several.join(kept, same & (F.col("__of") == F.col("__fp")), "left_semi")
    one = several.groupBy(doc_id, "__of").agg(
        F.min_by(F.struct(*docs.columns), F.struct(text, F.xxhash64(text))).alias("__row"))
    return single.unionByName(one.select("__row.*"))


def digest(found):
    """The contract's columns."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
