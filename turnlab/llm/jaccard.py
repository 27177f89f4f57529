"""Near copies by SimHash and an exact check: all pairs of sets of five-word shingles of a Jaccard similarity of 0.8 or more.

Each set has a SimHash fingerprint. Those few bits apart are found by the vantage-point tree of ``simhash`` and are the first
candidates; similar ones are joined to components. Near copies may lie further apart (pairs of similarity 0.83 are found 11 and 17 bits
apart, where no tree over 64 bits passes anything over), so what fingerprints leave is found by shared shingles. Two sets of similarity ``least`` or more share a shingle among the first (1 - least) of each, in any order that is the
same for all sets (prefix filter). The order here is rarest first as far as a sample knows, which only saves work.
Sets that share such a shingle are candidates; shingles held by the same sets count as one group. Before two sets are compared
whole, their sketches are: a bit per bucket tells whether a set holds an odd number of shingles of it, so every bit that differs is a
shingle that only one of them holds, and most candidates that only share a passage are ruled out for certain, by
few bytes. In groups whose sets lie in several components, each set is first compared with one other. Where a group's sets
then still lie in several components, blocks of them are compared by sketch inside a task, and only pairs across components that a
sketch cannot rule out leave it. Where these are many for their sets, the sets leave it instead, once each: their texts
meet block by block in a task, which compares them whole and says what links it needs to join them, fewer than there are texts.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlab.llm.common import cut, done, filter_of, is_marked, with_columns
from turnlab.llm.components import connected_components
from turnlab.llm import simhash
from turnlab.llm.simhash import SEED, labelled, shingle_hashes, smallest_rows

WORDS = 5
LEAST = 0.8
REACH = 2               # bits that the fingerprints of first candidates differ in at most
SAMPLE = 4_096         # sets that tell which shingles are common; any order of shingles gives the same result
COMMON = 3              # of them that hold a common shingle
BLOCK = 512             # sets of a group that a task compares by sketch with as many others
FEW = 2                 # pairs a set of a block that leave its task as pairs
_KNOWN = 1 << 20        # common shingles looked up
_SEEN = 1 << 17         # set names that a task remembers, so as not to repeat its copies
_SKETCH = 1 << 17       # most bits of a sketch


def shingle_set(text, words=WORDS):
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text or "", words))


def set_name(found):
    """Signed 64-bit name of a set; sets of the same shingles have the same."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED)).astype(np.int64))


def named(docs, text="text", words=WORDS, name="fp"):
    """``docs`` with the column ``name`` (long), the name of the text's shingle set."""
    return with_columns(docs, [text],
                        lambda texts: [[set_name(shingle_set(t, words)) for t in texts]], f"`{name}` long")


def sketch(found):
    """Parities of a set's shingles by bucket, one to two bits a shingle (a power of two of bits)."""
    bits = min(_SKETCH, 1 << max(6, (len(found) - 1).bit_length()))
    counts = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def apart(one, other):
    """A number of shingles that two sketched sets differ in at least."""
    one, other = sorted((np.frombuffer(x, np.uint8) for x in (one, other)), key=len)
    while len(other) > len(one):
        other = other[:len(other) // 2] ^ other[len(other) // 2:]
    return int(np.bitwise_count(one ^ other).sum())


def may_be_similar(size, other_size, differ, least):
    """Whether sets of these sizes that differ in ``differ`` shingles or more may have a similarity of ``least``."""
    differ = np.maximum(differ, np.abs(size - other_size))
    return (1 + least) * differ <= (1 - least) * (size + other_size) + 1e-6


def similar(a, b, least):
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more, without rounding of the quotient."""
    if min(len(a), len(b)) < _share(least, max(len(a), len(b))):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= _share(least, len(a) + len(b) - both)


def _share(least, n):
    return math.ceil(least * n - 1e-9)


def _common(texts, n, words):
    """(shingles, how many sampled sets hold them), sorted: what a sample of about SAMPLE different texts knows to be common."""
    parts = 1 << 30
    chosen = texts.where(F.pmod(F.xxhash64("key"), F.lit(parts)) < math.ceil(parts * min(1, SAMPLE / max(1, n))))
    once = chosen.groupBy("key").agg(F.min("text").alias("text"))
    held = with_columns(once, ["text"], lambda found: [[shingle_set(t, words).view("<i8") for t in found]],
                        "held array<long>")
    counted = (held.select(F.explode("held").alias("shingle")).groupBy("shingle").count()
               .where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(_KNOWN).toPandas())
    counted = counted.sort_values("shingle")
    return counted["shingle"].to_numpy(np.int64), counted["count"].to_numpy(np.int64)


def _prefixes(texts, common, words, least):
    """(shingle, fp, often): the shingles of a set of which any set similar to it must share one, and whether the shingle is one
    of ``common``; copies mostly once a task."""
    seen = set()  # of one task, as each has a copy of this function

    def run(found):
        known, times = common.value
        names, out, rare = [], [], []
        for text in found:
            held = shingle_set(text, words)
            name = set_name(held)
            names.append(name)
            if name in seen:
                out.append([])
                rare.append(0)
                continue
            if len(seen) >= _SEEN:
                seen.clear()
            seen.add(name)
            held = held.view("<i8")
            take = len(held) - _share(least, len(held)) + 1 if len(held) else 0
            rare.append(len(held))
            if len(known):
                at = np.minimum(np.searchsorted(known, held), len(known) - 1)
                count = np.where(known[at] == held, times[at], 0)
                held = held[np.lexsort((held, count))]
                rare[-1] = int((count == 0).sum())
            out.append(held[:take])
        return [names, out, rare]

    made = with_columns(texts.select("text"), ["text"], run, "fp long, held array<long>, rare int")
    made = made.select(F.posexplode("held").alias("at", "shingle"), "fp", "rare")
    return made.select("shingle", "fp", (F.col("at") >= F.col("rare")).alias("often"))


def _shared(prefixes):
    """(shingle, fp), once each, of the shingles that several sets have; of those known to be common, whether one or several.

    One exchange. The sets of a shingle meet in a task only if it is not known to be common, so they are few.
    """
    salt = F.when(F.col("often"), F.col("fp")).otherwise(F.lit(0))
    meet = W.partitionBy("shingle", "salt")
    placed = prefixes.withColumn("salt", salt).withColumn("low", F.min("fp").over(meet)).withColumn("high", F.max("fp").over(meet))
    return placed.where("often OR low < high").select("shingle", "salt", "fp").distinct().select("shingle", "fp")


def _unless_apart(pairs, classes, least):
    """The pairs (a, b) whose sketches leave open that they are similar."""
    told = classes.select("fp", "size", "sketch")
    both = (pairs.join(told.toDF("a", "size_a", "one"), "a").join(told.toDF("b", "size_b", "other"), "b"))
    open_ = with_columns(both, ["size_a", "size_b", "one", "other"], lambda n, m, x, y: [
        [bool(may_be_similar(i, j, apart(a, b), least)) for i, j, a, b in zip(n, m, x, y)]], "open boolean")
    return open_.where("open").select("a", "b")


def _texts_of(texts, classes, names, words):
    """(fp, text): one text of each set of ``names`` (fp)."""
    bits, shared = filter_of(names.join(classes, "fp").select("key"))

    def pick(batches):  # a text that isn't needed is not made into a set, and copies go on once a task
        seen = set()
        for batch in batches:
            batch = batch.filter(is_marked(shared.value, batch.column(1)))
            found, kept = [], []
            for text in batch.column(0).to_pylist():
                name = set_name(shingle_set(text, words))
                if name not in seen:
                    found.append(name)
                    kept.append(text)
                    if len(seen) < _SEEN:
                        seen.add(name)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(kept, pa.string())], ["fp", "text"])

    # Texts travel rather than sets, which are larger and can't be compressed.
    few = texts.select("text", F.pmod("key", F.lit(bits)).alias("bit")).mapInArrow(pick, "fp long, text string")
    return few.groupBy("fp").agg(F.min("text").alias("text"))


def _compared(texts, classes, pairs, words, least):
    """The pairs (a, b) whose sets are similar."""
    pairs = cut(pairs, "pairs")
    few = _texts_of(texts, classes, pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), words)
    both = (pairs.join(few.select(F.col("fp").alias("a"), F.col("text").alias("one")), "a")
            .join(few.select(F.col("fp").alias("b"), F.col("text").alias("other")), "b"))
    told = with_columns(both, ["one", "other"], lambda x, y: [
        [similar(shingle_set(a, words), shingle_set(b, words), least) for a, b in zip(x, y)]], "near boolean")
    return cut(told.where("near").select("a", "b"), "near-pairs", read=[pairs])


def _open_pairs(size, component, sketches, least, own=None):
    """(x, ys): a row and those of other components, and other ``own`` if given, that its sketch leaves open; each pair once."""
    wide = np.array([len(x) for x in sketches], np.int64)
    for width in np.unique(wide):  # a sketch is only folded to those of sets of a like size
        ys = np.flatnonzero((wide >= width) & (least * wide <= 2 * width))
        bits = np.array([_folded(x, width) for x in sketches[ys]])
        for n in np.flatnonzero(wide[ys] == width):
            x = ys[n]
            other = (component[ys] != component[x]) & ((wide[ys] > width) | (ys > x))
            if own is not None:
                other &= own[ys] != own[x]
            far = np.bitwise_count(bits[other] ^ bits[n]).sum(axis=1, dtype=np.int64)
            y = ys[other]
            yield x, y[may_be_similar(size[y], size[x], far, least)]


def _by_block(part, named):
    """The rows of ``part`` of each value of the columns ``named``."""
    part = part.sort_values(named, kind="stable", ignore_index=True)
    key = part[named].to_numpy()
    cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(part)]):
        yield part.iloc[a:b]


def _open_across(held, classes, least):
    """(block, fp, component, other): pairs (fp, other) of the same group (shingle) in different components that sketches leave
    open; where there are over FEW a set, the sets instead, without other. ``block`` names the sets that such pairs join, so what
    several groups have in common counts once.

    ``held`` has (shingle, fp, component, size). A group of over BLOCK sets is cut into blocks, and each pair of blocks is
    compared by itself.
    """
    blocks = held.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n"))
    rows = blocks.agg(F.sum(F.col("blocks") * F.col("n"))).first()[0] or 0
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("long")
    placed = held.join(blocks.drop("n"), "shingle").join(classes.select("fp", "sketch"), "fp")
    placed = placed.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    placed = placed.select("shingle", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
                           "own", "fp", "component", "size", "sketch")
    # Most groups are small, so a call gets several thousand rows of them at once.
    place = F.pmod(F.xxhash64("shingle", "i", "j"), F.lit(1 + rows // (8 * BLOCK)))

    def compare(part):
        found = []
        for block in _by_block(part, ["shingle", "i", "j"]):
            size, own, component, fp = (block[c].to_numpy(np.int64) for c in ("size", "own", "component", "fp"))
            top, pairs = np.arange(len(block)), []
            for x, y in _open_pairs(size, component, block["sketch"].to_numpy(), least,
                                    None if block["i"].iat[0] == block["j"].iat[0] else own):
                if len(y):
                    pairs.append((x, y))
                    joined = np.unique(top[np.append(y, x)])
                    top[np.isin(top, joined)] = joined[0]
            for first in {top[x] for x, _ in pairs}:
                mine, rows = [(x, y) for x, y in pairs if top[x] == first], np.flatnonzero(top == first)
                if sum(len(y) for _, y in mine) > FEW * len(rows):
                    name = set_name(np.sort(fp[rows]))
                    found += [(name, f, c, None) for f, c in zip(fp[rows].tolist(), component[rows].tolist())]
                else:
                    found += [(0, min(fp[x], f), 0, max(fp[x], f)) for x, y in mine for f in fp[y]]
        block, fp, component, other = zip(*found) if found else ((),) * 4
        return pd.DataFrame({"block": np.array(block, np.int64), "fp": np.array(fp, np.int64),
                             "component": np.array(component, np.int64), "other": pd.array(other, "Int64")})

    found = placed.groupBy(place.alias("place")).applyInPandas(compare, "block long, fp long, component long, other long")
    return found.distinct()


def _linked_across(texts, classes, held, words, least):
    """Links (a, b) that join all similar pairs of the same group (shingle) in different components, as in ``_open_across``."""
    open_ = cut(_open_across(held, classes, least), "open")
    near = _compared(texts, classes, open_.where("other IS NOT NULL").select(F.col("fp").alias("a"), F.col("other").alias("b")), words, least)
    sets = open_.where("other IS NULL").drop("other")
    if sets.isEmpty():
        done(open_)
        return near
    told = sets.join(_texts_of(texts, classes, sets.select("fp").distinct(), words), "fp")
    place = F.pmod(F.xxhash64("block"), F.lit(1 + sets.count() // BLOCK))

    def compare(part):
        found = []
        for block in _by_block(part, ["block"]):
            component, fp = (block[c].to_numpy(np.int64, copy=True) for c in ("component", "fp"))
            held = [shingle_set(t, words) for t in block["text"]]
            sketches = np.array([sketch(x) for x in held], object)
            size = np.array([len(x) for x in held], np.int64)
            for x, ys in _open_pairs(size, component, sketches, least):
                for y in ys:
                    if component[x] != component[y] and similar(held[x], held[y], least):
                        found.append((fp[x], fp[y]))
                        component[component == component[y]] = component[x]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    links = told.groupBy(place.alias("place")).applyInPandas(compare, "a long, b long")
    return near.union(cut(links, "near-links", read=[open_]))


def _folded(raw, width):
    found = np.frombuffer(raw, np.uint8)
    while len(found) > width:
        found = found[:len(found) // 2] ^ found[len(found) // 2:]
    return found


def _by_fingerprint(classes, reach):
    """Pairs (a, b) of sets that join those whose SimHash fingerprints lie ``reach`` or fewer bits apart."""
    one = cut(classes.groupBy("bits").agg(F.min("fp").alias("first")), "fingerprints")
    same = classes.join(one, "bits").where("fp != first").select("fp", "first")
    near = simhash.links(one, reach, "bits").join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b")
    return same.union(near.select("x", "y")).toDF("a", "b"), one


def links(texts, classes, words=WORDS, least=LEAST, reach=REACH):
    """Links (a, b) that join all pairs of sets of similarity ``least`` or more.

    Those that fingerprints within ``reach`` bits propose come first; shared shingles find what these leave.

    ``texts`` has (text, key), ``key`` a hash of the text that tells it apart from most; ``classes`` has each set once: (fp, size,
    sketch, bits, key), ``bits`` its fingerprint and ``key`` that of one of its texts. Where ``classes`` is a table of ``cut``, it is deleted with the others.
    """
    context = texts.sparkSession.sparkContext

    def ordered(a, b):
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    def like(size, other):  # what sizes alone leave open, as in ``may_be_similar``
        a, b = F.col(size), F.col(other)
        return (1 + least) * F.abs(a - b) <= (1 - least) * (a + b) + 1e-6

    def near_of(pairs):
        return _compared(texts, classes, _unless_apart(pairs, classes, least), words, least)

    def across(held, near):
        """(shingle, fp, size, component) of the groups whose sets lie in several components of ``near``, without pairs of unlike size."""
        labels = cut(connected_components(near), "labels")
        of = F.coalesce(labels["component"], held["fp"]).alias("component")
        marked = cut(held.join(labels, held["fp"] == labels["node"], "left").select("shingle", "fp", "size", of), "labelled", read=[held])
        open_ = marked.groupBy("shingle").agg(
            F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"),
            F.min("size").alias("size"), F.max("size").alias("other")).where("x < y").where((F.col("n") > 2) | like("size", "other"))
        return cut(marked.join(open_.select("shingle"), "shingle", "left_semi"), "apart", read=[marked, labels])

    pairs, fingerprints = _by_fingerprint(classes, reach)
    near = near_of(pairs.select(*ordered("a", "b")).distinct())
    done(fingerprints)
    prefixes = _prefixes(texts, context.broadcast(_common(texts, classes.count(), words)), words, least)
    shared = cut(_shared(prefixes), "shared")
    # Shingles that the same sets hold, as those of a passage, are one group.
    alike = shared.groupBy("shingle").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"),
                                          F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y"))
    alike = alike.where("n > 1").groupBy("n", "x", "y").agg(F.min("shingle").alias("shingle"))
    held = shared.join(alike.select("shingle"), "shingle", "left_semi").join(classes.select("fp", "size"), "fp")
    held = cut(held.select("shingle", "fp", "size"), "groups", read=[shared])
    held = across(held, near)
    # The set that the others of a group are compared with first differs by group, so one odd set does little harm.
    mix = F.xxhash64(F.pmod("shingle", F.lit(16)))
    firsts = held.groupBy("shingle").agg(F.min_by(F.struct("fp", "size", "component"), F.col("fp").bitwiseXOR(mix)).alias("first"))
    pairs = held.join(firsts, "shingle").where("component != first.component").where(like("size", "first.size"))
    pairs = pairs.select(*ordered("fp", "first.fp")).distinct()
    near = near.union(near_of(pairs))
    held = across(held.drop("component"), near)
    rest = _linked_across(texts, classes, held, words, least)
    done(held, classes)
    return near.union(rest)


def components(docs, doc_id="doc_id", text="text", words=WORDS, least=LEAST):
    """(doc_id, fp, component_id) of every row of ``docs``, ``fp`` the name of its shingle set.

    Rows are linked where their sets have a Jaccard similarity of ``least`` or more. Null and wordless texts have the
    empty set and are one class; a text of fewer words than ``words`` is one shingle. The rest is as in ``simhash``.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))

    def compute(texts):
        found = [shingle_set(t, words) for t in texts]
        return [[set_name(x) for x in found], [len(x) for x in found], [sketch(x) for x in found],
                [simhash.majority(x) for x in found]]

    rows = with_columns(docs, ["text"], compute, "fp long, size int, sketch binary, bits long")
    rows = cut(rows.select("doc_id", "fp", "key", "size", "sketch", "bits"), "names")
    least_key = F.min(F.struct("key", "size", "sketch", "bits")).alias("of")
    sets = cut(rows.groupBy("fp").agg(least_key).select("fp", "of.key", "of.size", "of.sketch", "of.bits"), "sets")
    return labelled(rows.select("doc_id", "fp"), lambda classes: links(docs.select("text", "key"), sets, words, least))


def deduplicate(docs, doc_id="doc_id", text="text", words=WORDS, least=LEAST):
    """The rows of ``docs`` whose id is the smallest of their component, once each, as in ``simhash.deduplicate``."""
    found = components(docs, doc_id, text, words, least)
    return smallest_rows(docs, found, lambda rows, name: named(rows, text, words, name), doc_id, text)
