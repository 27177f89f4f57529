"""Boosted trees with a vector in every leaf: one model for all classes (softmax) or for several flags (logistic).

Feature values are binned once. A tree is grown level by level from histograms of the gradients of all outputs, so a
three-class model takes one chain of trees, not three. The fit reads every row. Values are binned in all tasks, in blocks of
rows. Below two times ENTRIES values the trees are one task's work, which holds six to eight bytes a value. Blocks of more
stay where they are: a job per level counts them, the counts of a share of the features meet in one task, and only the best
cut of every node comes to the driver. Sums are exact, so the trees are the same. Scoring and importances run over every row,
in all tasks.
"""

import os
import pickle
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.linalg import SparseVector
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 4                # of the values above zero of a feature, at its quantiles
LEAST_ROWS = 5          # on each side of a split
LEAST_CURVATURE = 0.5   # of all outputs together, on each side of a split
SHRINK = 1.0            # added to a leaf's curvature
ENTRIES = 1 << 25       # feature values worth a task of their own in a fit: a job per level costs a third of a second
_BLOCK = 1 << 21        # feature values binned at once
_MOST = 1 << 30         # feature values dealt to one task, however few cores are told
_PIVOTS = 15            # tried at once for a cut
_KEPT = 10              # trees whose margins are made anew by every job, before they are kept with the rows
_PARTS = 1 << 12
_THREADS = 4            # of a fit at most: more gain little
_STRETCH = 1 << 16      # entries counted at once
_CHUNK = 1 << 10        # rows scored at once


@dataclass
class Tree:
    """Nodes as lists; feature -1 is a leaf. A row goes right where its value is above the threshold."""

    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    right: list = field(default_factory=list)    # the left child is the node before it
    value: list = field(default_factory=list)

    def values(self, table, used):
        """Leaf values (rows x outputs) of the rows of ``table``, which has a line for each of the sorted features ``used``."""
        feature, right = np.array(self.feature), np.array(self.right)
        threshold, value = np.array(self.threshold), np.array(self.value)
        line = np.searchsorted(used, feature) * (feature >= 0)
        at, rows = np.zeros(table.shape[1], np.int64), np.arange(table.shape[1])
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            node = at[rows]
            at[rows] = right[node] - (table[line[node], rows] <= threshold[node])
        return value[at]


@dataclass
class Model:
    """Trees, the margins they start from, and the gain of every used feature."""

    loss: str
    base: np.ndarray
    trees: list
    gain: dict

    @property
    def featureImportances(self):  # the name that pyspark.ml has for it
        total = sum(self.gain.values())
        shares = {int(f): v / total for f, v in self.gain.items()}
        return SparseVector(max(shares, default=-1) + 1, shares)

    def add(self, tree, gains):
        """False, and nothing added, of a tree that doesn't split."""
        if len(tree.feature) == 1:
            return False
        self.trees.append(tree)
        for f, v in gains.items():
            self.gain[f] = self.gain.get(f, 0.0) + v
        return True

    def used(self):
        return sorted({f for t in self.trees for f in t.feature if f >= 0})

    def margins(self, columns, n, trees=None):
        """Margins (rows x outputs); ``columns`` gives the n values of a feature."""
        used = self.used()
        table = np.array([columns(f) for f in used], float).reshape(len(used), n)
        total = np.tile(self.base, (n, 1))
        for tree in self.trees if trees is None else trees:
            total += tree.values(table, used)
        return total

    def probabilities(self, margins):
        return _probabilities(self.loss, margins)


def _probabilities(loss, margins):
    if loss == "softmax":
        grown = np.exp(margins - margins.max(axis=1, keepdims=True))
        return grown / grown.sum(axis=1, keepdims=True)
    return 1 / (1 + np.exp(-np.clip(margins, -500, 500)))


def _order(numbers):
    """The stable order of numbers from zero up, by 16 bits at a time: these are put in order without comparisons."""
    order, most = np.argsort((numbers & 0xFFFF).astype(np.uint16), kind="stable"), int(numbers.max()) if len(numbers) else 0
    for shift in range(16, most.bit_length(), 16):
        order = order[np.argsort((numbers[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def bin_values(rows, features, values, n, least=LEAST_ROWS, bins=BINS):
    """(rows, feature numbers, bins from 1, kept features, edges) of the values above zero of a sparse matrix, by feature, bin and row.

    ``edges`` are a feature's cuts; a value above k of them has bin k + 1. Features with fewer than ``least`` rows on
    one side of zero that have no cut either can't split and are left out.
    """
    if len(values) and values.min() < 0:
        raise ValueError("features must not be negative")
    keep = values > 0
    rows, features, values = rows[keep].astype(np.int32), features[keep], values[keep]
    order = _order(rows)
    order = order[_order(features[order])]
    rows, features, values = rows[order], features[order], values[order]
    kept, starts = np.unique(features, return_index=True)
    ends, out, edges, names = [*starts[1:].tolist(), len(features)], [], [], []
    for f, a, b in zip(kept.tolist(), starts.tolist(), ends):
        if b - a < least:
            continue
        part, ranks = values[a:b], [(b - a) * k // bins for k in range(1, bins)]
        cuts = np.unique(np.partition(part, ranks)[ranks])
        cuts = cuts[cuts < part.max()]
        if n - (b - a) < least and not len(cuts):
            continue
        bin_ = np.ones(b - a, np.uint8)
        for cut in cuts:
            bin_ += part > cut
        order = np.argsort(bin_, kind="stable")
        out.append((rows[a:b][order], np.full(b - a, len(names), np.int32), bin_[order]))
        names.append(f)
        edges.append([0.0, *cuts.tolist()])
    if not out:
        return (np.empty(0, np.int64),) * 3 + ([], [])
    return (*(np.concatenate(x) for x in zip(*out)), names, edges)


class Histograms:
    """Sums by cell (a feature's bin) of the rows of a node, cumulated from the last bin down: the number of rows and the sum of
    each weight. ``rows`` are those of the entries in the order of cells, ``counts`` the entries of each cell, ``cells`` those of the
    entries in the order of rows, and ``starts`` where a row's begin. Features are dealt to ``threads`` in stretches of like numbers of
    entries: what one counts, no other does. Entries are counted _STRETCH at a time, which a processor holds close by."""

    def __init__(self, rows, counts, cells, starts, bins=BINS, threads=1):
        self.rows, self.cell_starts = rows, np.append(0, np.cumsum(counts))
        features = len(counts) // bins
        self.shape = (features, bins)
        cuts = np.searchsorted(self.cell_starts[::bins], len(rows) * np.arange(1, threads) // threads).tolist()
        self.pool = ThreadPoolExecutor(threads)
        stretches = [(a * bins, b * bins) for a, b in zip([0, *cuts], [*cuts, features]) if a < b]
        self.parts = [(slice(0, len(counts)), cells, starts)] if len(stretches) == 1 else list(
            self.pool.map(lambda ab: self._part(*ab, cells, starts), stretches))

    def _part(self, a, b, cells, starts):
        """Cells a to b: their place among all, and of their entries in the order of rows the cells, from a on, and where a row's begin."""
        mine = (cells >= a) & (cells < b)
        return slice(a, b), cells[mine] - cells.dtype.type(a), np.append(0, np.cumsum(mine))[starts]

    def _counted(self, nodes, weights, run):
        """(nodes, 1 + weights, features, bins), of which ``run`` fills the cells of a part."""
        found = np.zeros((nodes, 1 + weights, self.shape[0] * self.shape[1]))

        def fill(part):
            mine = found[:, :, part[0]]
            run(mine, *part)
            each = mine.reshape(nodes, 1 + weights, -1, self.shape[1])
            mine[:] = each[..., ::-1].cumsum(axis=-1)[..., ::-1].reshape(mine.shape)

        list(self.pool.map(fill, self.parts))
        return found.reshape(nodes, 1 + weights, *self.shape)

    def whole(self, weights):
        """(1, 1 + weights, features, bins) over all rows."""
        pairs = [np.array(weights[k:k + 2]).T.copy().view(complex).ravel() for k in range(0, len(weights) - 1, 2)]  # two at a time
        pairs += [weights[-1]] * (len(weights) % 2)

        def run(found, span, *_):
            upto = self.cell_starts[span.start:span.stop + 1]
            found[0, 0] = np.diff(upto)
            filled = np.flatnonzero(found[0, 0])
            rows, first = self.rows[upto[0]:upto[-1]], upto[filled] - upto[0]
            for a in range(0, len(rows), _STRETCH):
                at = rows[a:a + _STRETCH].astype(np.intp)
                i, j = np.searchsorted(first, (a, a + len(at)), "left")
                i -= i == len(first) or first[i] > a  # the cell that goes on from the stretch before
                begin = np.maximum(first[i:j] - a, 0)
                for k, x in enumerate(pairs):
                    sums = np.add.reduceat(x[at], begin)
                    found[0, 1 + 2 * k, filled[i:j]] += sums.real
                    if x.dtype == complex:
                        found[0, 2 + 2 * k, filled[i:j]] += sums.imag
        return self._counted(1, len(weights), run)

    def of_nodes(self, rows, node, nodes, weights):
        """(nodes, 1 + weights, features, bins) over ``rows``, each in its ``node``."""
        order = np.argsort(node, kind="stable")
        held, of = rows[order], np.searchsorted(node[order], np.arange(nodes + 1))
        values = [x[held] for x in weights]

        def run(found, span, of_row, starts):
            begin, lengths = starts[held], starts[held + 1] - starts[held]
            upto = np.r_[0, np.cumsum(lengths)]
            for i in range(nodes):
                a = of[i]
                while a < of[i + 1]:
                    b = min(of[i + 1], max(a + 1, int(np.searchsorted(upto, upto[a] + _STRETCH))))
                    at = np.repeat(begin[a:b] - (upto[a:b] - upto[a]), lengths[a:b])
                    at += np.arange(len(at))
                    cell = of_row[at].astype(np.intp)
                    found[i, 0] += np.bincount(cell, None, found.shape[2])
                    for k, x in enumerate(values):
                        found[i, 1 + k] += np.bincount(cell, np.repeat(x[a:b], lengths[a:b]), found.shape[2])
                    a = b
        return self._counted(nodes, len(weights), run)


def _exact(x, n=None):
    """``x``, of numbers up to 1, rounded to a step at which sums over the ``n`` rows are exact in doubles. So a sum doesn't depend
    on the order of its rows, and what a node holds less one child is the other child to the last digit."""
    step = 2.0 ** (max(1, len(x) if n is None else n).bit_length() - 52)
    return np.round(x / step) * step


def _weights(loss, margins, target, n):
    """The gradients of every output and their curvatures, of ``n`` rows in all."""
    p = _probabilities(loss, margins)
    return [np.ascontiguousarray(x[:, k]) for x in (_exact(p - target, n), _exact(p * (1 - p), n)) for k in range(target.shape[1])]


def _score(g, h):
    return (g * g / (h + SHRINK)).sum(axis=-1)


def _best_cut(flat, total, least):
    """(gain, cell) of the best cut of a node with the ``total`` (gradients, curvatures, rows), the first of equals; ``flat`` has
    rows, gradients and curvatures (1 + 2 x outputs) of what lies above each cell's cut. No cut is (-inf, -1)."""
    total_g, total_h, total_n = total
    outputs = len(total_g)
    cuts = np.flatnonzero((flat[0] >= least) & (total_n - flat[0] >= least))
    if not len(cuts):
        return -np.inf, -1
    g, h = (flat[k:k + outputs, cuts].T for k in (1, 1 + outputs))
    gain = _score(g, h) + _score(total_g - g, total_h - h) - _score(total_g, total_h)
    heavy, whole = h.sum(axis=-1), total_h.sum()
    gain[(heavy < LEAST_CURVATURE) | (whole - heavy < LEAST_CURVATURE)] = -np.inf
    return float(gain.max()), int(cuts[gain.argmax()])


class _Growth:
    """A tree, its gains by feature, and its level: the nodes that may be split next with their (gradients, curvatures, rows)."""

    def __init__(self, total, rate, least):
        self.tree, self.gains, self.rate, self.least = Tree(), {}, rate, least
        self.level, self.totals = [self._add(total)], [total]

    def _add(self, side):
        self.tree.feature.append(-1)
        self.tree.threshold.append(0.0)
        self.tree.right.append(-1)
        self.tree.value.append((-self.rate * side[0] / (side[1] + SHRINK)).tolist())
        return len(self.tree.feature) - 1

    def split(self, splits):
        """Of nodes by their place in the level, (gain, feature, threshold, rows, gradients and curvatures of the right side); gives
        the (place in the level before, right or not, fewer rows or not, its sibling's number) of every node of the new level."""
        coming, origin = [], []
        for i, (gain, name, threshold, k, right_g, right_h) in sorted(splits.items()):
            node, (total_g, total_h, total_n) = self.level[i], self.totals[i]
            sides = [(total_g - right_g, total_h - right_h, total_n - k), (right_g, right_h, k)]
            self.gains[name] = self.gains.get(name, 0.0) + gain
            children = [self._add(side) for side in sides]
            self.tree.feature[node], self.tree.threshold[node], self.tree.right[node] = name, threshold, children[1]
            small = int(sides[1][2] < sides[0][2])
            for x in (0, 1):
                if sides[x][2] >= 2 * self.least and sides[x][1].sum() >= 2 * LEAST_CURVATURE:
                    coming.append((children[x], sides[x]))
                    origin.append((i, x == small, children[small]))
        self.level, self.totals = [c[0] for c in coming], [c[1] for c in coming]
        return origin


def grow(histograms, edges, names, weights, outputs, depth, rate, least=LEAST_ROWS, bins=BINS):
    """(Tree, node of each row, gains by feature) by the largest gain; on ties the first feature and the lowest cut.

    Of two children only the one of fewer rows is counted; the other is what it leaves of their parent.
    """
    rows, starts, n = histograms.rows, histograms.cell_starts, len(weights[0])
    sums = np.array([w.sum() for w in weights])
    growth = _Growth((sums[:outputs], sums[outputs:], n), rate, least)
    place = np.zeros(n, np.int64)
    held = histograms.whole(weights) if names else None
    for step in range(depth):
        if not growth.level or not names:
            break
        number = np.full(len(growth.tree.feature), -1)
        number[growth.level] = np.arange(len(growth.level))
        of, moved, splits = number[place], np.zeros(n, np.int64), {}
        flat = held.reshape(len(growth.level), 1 + 2 * outputs, -1)
        for i, total in enumerate(growth.totals):
            gain, cell = _best_cut(flat[i], total, least)
            if gain > 1e-9:
                f, b = divmod(cell, bins)
                goes = rows[starts[cell]:starts[(f + 1) * bins]]
                moved[goes[of[goes] == i]] = 1
                splits[i] = (gain, names[f], edges[f][b], int(flat[i, 0, cell]),
                             *(flat[i, x:x + outputs, cell].copy() for x in (1, 1 + outputs)))
        before = len(growth.tree.feature)
        origin = growth.split(splits)
        left_of = np.array(growth.tree.right[:before]) - 1
        place = np.where(left_of[place] >= 0, left_of[place] + moved, place)
        if origin and step + 1 < depth:
            small = sorted({node for _, _, node in origin})
            counted = np.full(len(growth.tree.feature), -1)
            counted[small] = np.arange(len(small))
            mine = np.flatnonzero(counted[place] >= 0)
            found = histograms.of_nodes(mine, counted[place[mine]], len(small), weights)
            held = np.stack([found[counted[node]] if fewer else held[i] - found[counted[node]] for i, fewer, node in origin])
    return growth.tree, place, growth.gains


def learn(rows, features, values, target, loss="softmax", trees=150, depth=6, rate=0.1, least=LEAST_ROWS, threads=1):
    """A Model of ``target`` (rows x outputs: one-hot classes for softmax, flags for logistic) on a sparse matrix."""
    rows, features, value_bin, names, edges = bin_values(rows, features, values, len(target), least)
    cell = features * BINS + (value_bin - 1)
    starts = np.append(0, np.cumsum(np.bincount(rows, minlength=len(target))))
    histograms = Histograms(rows, np.bincount(cell, minlength=len(names) * BINS), cell.astype(np.int32)[_order(rows)], starts,
                            threads=threads)
    return _learn_binned(histograms, names, edges, target, loss, trees, depth, rate, least)


def _learn_binned(histograms, names, edges, target, loss, trees, depth, rate, least):
    n, outputs = target.shape
    base = np.zeros(outputs)  # every class or flag is as likely as not at first
    margins, model = np.tile(base, (n, 1)), Model(loss, base, [], {})
    for _ in range(trees):
        tree, place, gains = grow(histograms, edges, names, _weights(loss, margins, target, n), outputs, depth, rate, least)
        if not model.add(tree, gains):
            break  # nothing splits any more
        margins += np.array(tree.value)[place]
    return model


def _joined(blocks, cells, threads):
    """(Histograms, target) of the binned blocks of all rows."""
    blocks = list(blocks)
    each = [np.bincount(block[1], minlength=cells) for block in blocks]
    counts = sum(each)
    entries, n = int(counts.sum()), sum(len(block[2]) for block in blocks)
    rows, place = np.empty(entries, np.int32), np.append(0, np.cumsum(counts))[:-1]
    of_row, starts = np.empty(entries, blocks[0][1].dtype), np.zeros(n + 1, np.int64)
    target = np.concatenate([block[2] for block in blocks])
    a = upto = 0
    for k, mine in enumerate(each):  # a block's entries of a cell come behind those of the blocks before
        begin, cell, own, _ = blocks[k]
        blocks[k] = None
        order = _order(cell)
        to = np.repeat(place - (np.cumsum(mine) - mine), mine) + np.arange(len(cell))
        rows[to] = (np.repeat(np.arange(len(own), dtype=np.int32), np.diff(begin)) + a)[order]
        place += mine
        of_row[upto:upto + len(cell)] = cell
        starts[a + 1:a + 1 + len(own)] = begin[1:].astype(np.int64) + upto
        a, upto = a + len(own), upto + len(cell)
    return Histograms(rows, counts, of_row, starts, threads=threads), target


def _sparse(column):
    """(rows, features, values) of an Arrow column of unwrapped vectors, sparse or dense."""
    values, indices = column.field("values"), column.field("indices")
    counts = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(column)), counts)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)  # of a dense vector
    told = np.repeat(indices.is_valid().to_numpy(zero_copy_only=False), counts)
    at[told] = indices.flatten().to_numpy(zero_copy_only=False)
    return rows, at, values.flatten().to_numpy(zero_copy_only=False).astype(float)


def _tasks(spark, entries):
    """How many tasks the rows of a fit of so many feature values are dealt to: as many as there are cores, where they are worth it."""
    return max(1, min(entries // ENTRIES, spark.sparkContext.defaultParallelism), entries // _MOST)


def _threads(spark):
    """Threads of a fit that is one task: the cores of its executor, where nothing else runs meanwhile."""
    conf = spark.sparkContext.getConf()
    if spark.conf.get("spark.master", "").startswith("local"):
        return spark.sparkContext.defaultParallelism
    return int(conf.get("spark.executor.cores", conf.get("spark.task.cpus", "1")))


def fit(table, target, loss="softmax", trees=150, depth=6, rate=0.1, least=LEAST_ROWS, column="features", tasks=None):
    """A Model of all rows of ``table``, which have a feature vector and ``target``, an array of one double per output.

    The model depends neither on how rows lie nor on ``tasks``, the number of tasks that share them. Nothing to learn from gives
    a model without trees. ``table`` is read twice.
    """
    rows = table.select(F.unwrap_udt(column).alias("x"), F.col(target).alias("y"))
    n, outputs, entries, width = rows.agg(
        F.count("*"), F.max(F.size("y")), F.coalesce(F.sum(F.size("x.values")), F.lit(0)),
        F.max(F.coalesce("x.size", F.size("x.values")))).first()
    if not n:
        return Model(loss, np.zeros(1), [], {})
    tasks = tasks or _tasks(table.sparkSession, entries)
    parts = max(tasks, min(-(-entries // _BLOCK), table.sparkSession.sparkContext.defaultParallelism))
    base, where, threads = np.zeros(outputs), StorageLevel.MEMORY_AND_DISK, _threads(table.sparkSession)

    def alone(batches):
        found, targets, upto = [], [], 0
        for batch in batches:
            row, *rest = _sparse(batch.column(0))
            found.append((row + upto, *rest))
            targets.append(_targets(batch.column(1), outputs))
            upto += len(batch)
        model = learn(*(np.concatenate(x) for x in zip(*found)), np.concatenate(targets), loss, trees, depth, rate, least,
                      min(threads, os.cpu_count() or 1, _THREADS))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    if parts == 1:
        return pickle.loads(rows.repartition(1).mapInArrow(alone, "model binary").first()[0])

    def pack(batches):
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(0).field("values")), 0).to_numpy(zero_copy_only=False)
            upto, a = np.append(0, np.cumsum(lengths, dtype=np.int64)), 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + _BLOCK, "right")) - 1)
                part = batch.slice(a, b - a)
                raw = pickle.dumps(_Raw(part.column(0), _targets(part.column(1), outputs)))
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["block"])
                a = b

    raw = rows.repartition(parts).mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(where)
    names, edges = _cuts(raw, n, width, least)
    if not names:
        raw.unpersist()
        return Model(loss, base, [], {})
    cells = len(names) * BINS
    state = raw.map(lambda block: block.binned(names, edges, base)).persist(where)
    state.count()
    raw.unpersist()
    if tasks > 1:
        return _learn_dealt(state, names, edges, n, base, loss, trees, depth, rate, least, tasks)

    def run(blocks):
        histograms, target = _joined(blocks, cells, min(threads, os.cpu_count() or 1, _THREADS))
        yield pickle.dumps(_learn_binned(histograms, names, edges, target, loss, trees, depth, rate, least))

    model = pickle.loads(state.coalesce(1).mapPartitions(run).collect()[0])
    state.unpersist()
    return model


def _targets(column, outputs):
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), outputs)


class _Raw:
    """Rows of a fit with their values above zero, by feature and value: ``names`` are the features, ``starts`` where theirs begin."""

    def __init__(self, x, target):
        rows, features, self.values = _sparse(x)
        if len(self.values) and self.values.min() < 0:
            raise ValueError("features must not be negative")
        keep = self.values > 0
        rows, features, self.values = rows[keep].astype(np.int32), features[keep].astype(np.int32), self.values[keep]
        order = np.lexsort((self.values, features))
        self.rows, self.values, self.target = rows[order], self.values[order], target
        self.names, starts = np.unique(features[order], return_index=True)
        self.starts = np.append(starts, len(rows))

    def extent(self, width):
        """By feature the number of values, the least as an integer of the same order, and the largest."""
        counts, least, most = np.zeros(width, np.int64), np.full(width, np.iinfo(np.int64).max), np.zeros(width, np.int64)
        counts[self.names] = np.diff(self.starts)
        whole = self.values.view(np.int64)
        least[self.names], most[self.names] = whole[self.starts[:-1]], whole[self.starts[1:] - 1]
        return counts, least, most

    def upto(self, names, pivots):
        """How many values of the features ``names`` are not above their ``pivots`` (features x any number, each in order)."""
        found = np.zeros(pivots.shape, np.int64)
        at = np.searchsorted(self.names, names)
        for i, j in enumerate(at.tolist()):
            if j < len(self.names) and self.names[j] == names[i]:
                found[i] = np.searchsorted(self.values[self.starts[j]:self.starts[j + 1]], pivots[i].view(np.float64), "right")
        return found

    def binned(self, names, edges, base):
        """(where a row's cells begin, cells by row, target, margins); a cell is a bin of one of the features ``names``."""
        cells = len(names) * BINS
        kind = np.uint16 if cells <= 1 << 16 else np.int32
        cell, keep = np.zeros(len(self.rows), kind), np.zeros(len(self.rows), bool)
        where = {f: k for k, f in enumerate(names)}
        for f, a, b in zip(self.names.tolist(), self.starts.tolist(), self.starts[1:].tolist()):
            if f in where:
                at = np.searchsorted(self.values[a:b], edges[where[f]][1:], "right").tolist()
                for k, (i, j) in enumerate(zip([0, *at], [*at, b - a])):
                    cell[a + i:a + j] = where[f] * BINS + k
                keep[a:b] = True
        rows, cell = self.rows[keep], cell[keep]
        starts = np.append(0, np.cumsum(np.bincount(rows, minlength=len(self.target)))).astype(np.int32)
        return starts, cell[_order(rows)], self.target, np.tile(base, (len(self.target), 1))


def _summed(rdd, one, both):
    """``both`` of what ``one`` says of each element; a task says one thing."""
    def run(blocks):
        found = None
        for block in blocks:
            found = one(block) if found is None else both(found, one(block))
        return [] if found is None else [found]

    return rdd.mapPartitions(run).treeReduce(both, depth=1 if rdd.getNumPartitions() <= 64 else 2)


def _add(a, b):
    return a + b


def _cuts(raw, n, width, least, bins=BINS):
    """(kept features, edges) as of ``bin_values``, of rows dealt to blocks: a cut is closed in on by counts of what isn't above pivots."""
    counts, lo, most = _summed(raw, lambda block: block.extent(width),
                               lambda a, b: (a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])))
    names = np.flatnonzero(counts >= least)
    if not len(names):
        return [], []
    rank = counts[names, None] * np.arange(1, bins) // bins
    lo, hi = (np.repeat(x[names, None], bins - 1, axis=1) for x in (lo, most))
    while (lo < hi).any():
        open_ = np.flatnonzero((lo < hi).any(axis=1))
        low, high, parts = lo[open_, :, None], hi[open_, :, None], np.arange(1, _PIVOTS + 1)
        whole, rest = np.divmod(high - low, _PIVOTS + 1)
        pivots = low + whole * parts + rest * parts // (_PIVOTS + 1)
        asked, of = pivots.reshape(len(open_), -1), names[open_]
        enough = _summed(raw, lambda block: block.upto(of, asked), _add).reshape(pivots.shape) > rank[open_, :, None]
        first = np.where(enough.any(axis=2), enough.argmax(axis=2), _PIVOTS)[:, :, None]  # pivots go up, so do counts
        ends = np.concatenate([low - 1, pivots, high], axis=2)
        lo[open_] = np.take_along_axis(ends, first, 2)[:, :, 0] + 1
        hi[open_] = np.take_along_axis(ends, first + 1, 2)[:, :, 0]
    kept, edges = [], []
    for f, found in zip(names.tolist(), hi.view(np.float64)):
        cuts = np.unique(found)
        cuts = cuts[cuts.view(np.int64) < most[f]]
        if n - counts[f] >= least or len(cuts):
            kept.append(f)
            edges.append([0.0, *cuts.tolist()])
    return kept, edges


def _places(block, trees, cells):
    """The node of every row of a block in each of ``trees``, of which each is (first cell that goes right, or -1 of a leaf; right child)."""
    starts, cell, target, _ = block
    n = len(target)
    if not any(len(first) > 1 for first, _ in trees):
        return [np.zeros(n, np.int64) for _ in trees]
    used = np.unique(np.concatenate([first[first >= 0] // BINS for first, _ in trees]))
    line = np.full(cells // BINS, -1, np.int32)
    line[used] = np.arange(len(used))
    of = np.repeat(line, BINS)[cell]
    at = np.flatnonzero(of >= 0)
    table = np.zeros((len(used), n), np.uint8)
    table[of[at], np.searchsorted(starts, at, "right") - 1] = cell[at] % BINS + 1
    found = []
    for first, right in trees:
        place, rows = np.zeros(n, np.int64), np.arange(n)
        own, cut = line[first // BINS], first % BINS
        while len(rows):
            rows = rows[first[place[rows]] >= 0]
            node = place[rows]
            place[rows] = right[node] - (table[own[node], rows] <= cut[node])
        found.append(place)
    return found


def _moved(block, trees, values, cells):
    """A block with the margins after ``trees``, whose leaves have ``values``."""
    margins = block[3].copy()
    for place, value in zip(_places(block, trees, cells), values):
        margins += value[place]
    return (*block[:3], margins)


def _count(blocks, kept, values, tree, level, loss, n, cells, spans):
    """(number of a span, (totals of the nodes of ``level``, filled cells, their sums)) of the blocks of a task, for each of the
    ``spans`` of cells; sums are of rows and weights. ``kept`` trees are those whose margins the blocks don't hold yet."""
    found = totals = None
    number = np.full(len(tree[0]), -1)
    number[level] = np.arange(len(level))
    for block in blocks:
        starts, cell, target, margins = block
        *places, place = _places(block, [*kept, tree], cells)
        margins = margins.copy()
        for at, value in zip(places, values):
            margins += value[at]
        weights = _weights(loss, margins, target, n)
        of = number[place]
        held = np.flatnonzero(of >= 0)
        held = held[np.argsort(of[held], kind="stable")]
        first = np.searchsorted(of[held], np.arange(len(level) + 1))
        begin, lengths = starts[held], np.diff(starts)[held]
        if found is None:
            found = np.zeros((1 + len(weights), len(level), cells))
            totals = np.zeros((1 + len(weights), len(level)))
        for node, (a, b) in enumerate(zip(first, first[1:])):
            upto = np.cumsum(lengths[a:b])
            at = np.repeat(begin[a:b] - (upto - lengths[a:b]), lengths[a:b])
            at += np.arange(len(at), dtype=at.dtype)
            at = cell[at].astype(np.intp)
            found[0, node] += np.bincount(at, None, cells)
            totals[0, node] += b - a
            for k, x in enumerate(weights, 1):
                found[k, node] += np.bincount(at, np.repeat(x[held[a:b]], lengths[a:b]), cells)
                totals[k, node] += x[held[a:b]].sum()
    if found is not None:
        for i, (a, b) in enumerate(spans):
            part = found[:, :, a:b].reshape(len(found), -1)
            filled = np.flatnonzero(part[0])
            yield i, (totals, filled.astype(np.int32), part[:, filled])


def _offer(pieces, spans, least):
    """(totals of nodes, best cuts of nodes) of each span whose counts come to a task; a cut is (gain, cell, rows, gradients and
    curvatures above it)."""
    found, totals = {}, {}
    for i, (total, filled, sums) in pieces:
        a, b = spans[i]
        if i not in found:
            found[i], totals[i] = np.zeros((len(total), total.shape[1] * (b - a))), np.zeros(total.shape)
        totals[i] += total
        found[i][:, filled] += sums
    for i, held in found.items():
        total, outputs, offers = totals[i], len(held) // 2, []
        held = held.reshape(len(held), total.shape[1], -1, BINS)[..., ::-1].cumsum(axis=-1)[..., ::-1].reshape(*total.shape, -1)
        for node in range(total.shape[1]):
            sides = total[1:1 + outputs, node], total[1 + outputs:, node], int(total[0, node])
            gain, cell = _best_cut(held[:, node], sides, least)
            at = held[:, node, cell]
            offers.append((gain, spans[i][0] + cell, int(at[0]), at[1:1 + outputs].copy(), at[1 + outputs:].copy()))
        yield total, offers


def _itself(x):
    return x


def _learn_dealt(state, names, edges, n, base, loss, trees, depth, rate, least, tasks):
    """A Model of binned blocks that stay dealt to tasks, and are kept with their margins. A level of a tree is a job: tasks count the
    cells of their rows, and the counts of a span of cells are added and searched in one task."""
    model, outputs, cells, where = Model(loss, base, [], {}), len(base), len(names) * BINS, StorageLevel.MEMORY_AND_DISK
    share = np.linspace(0, len(names), min(tasks, len(names)) + 1).astype(int) * BINS
    spans = list(zip(share.tolist(), share[1:].tolist()))
    kept, values, old = [], [], None  # of trees whose margins the state doesn't hold

    def search(tree, level):
        def count(blocks, kept=tuple(kept), values=tuple(values)):
            return _count(blocks, kept, values, tree, level, loss, n, cells, spans)

        found = state.mapPartitions(count).partitionBy(len(spans), _itself).mapPartitions(lambda pieces: _offer(pieces, spans, least))
        got = found.collect()
        found._jrdd.rdd().cleanShuffleDependencies(False)  # a level's counts are used once
        return got

    for _ in range(trees):
        first, growth = np.full(1, -1), None
        for _ in range(depth):
            level = growth.level if growth else [0]
            if not level:
                break
            right = np.array(growth.tree.right if growth else [-1])
            got = search((first, right), level)
            if old is not None:
                old.unpersist()
                old = None
            if growth is None:
                total = got[0][0][:, 0]
                growth = _Growth((total[1:1 + outputs], total[1 + outputs:], int(total[0])), rate, least)
            splits, cut = {}, {}
            for i, offers in enumerate(zip(*(offers for _, offers in got))):
                gain, cell, *sides = max(offers, key=lambda o: (o[0], -o[1]))
                if gain > 1e-9:
                    f, b = divmod(cell, BINS)
                    splits[i], cut[level[i]] = (gain, names[f], edges[f][b], *sides), cell
            growth.split(splits)
            first = np.append(first, np.full(len(growth.tree.feature) - len(first), -1))
            first[list(cut)] = list(cut.values())
        if growth is None or not model.add(growth.tree, growth.gains):
            break  # nothing splits any more
        kept.append((first, np.array(growth.tree.right)))
        values.append(np.array(growth.tree.value))
        if len(kept) == _KEPT:
            def move(block, kept=tuple(kept), values=tuple(values)):
                return _moved(block, kept, values, cells)

            old, state = state, state.map(move).persist(where)
            kept, values = [], []
    for rdd in (state, old):
        if rdd is not None:
            rdd.unpersist()
    return model


def _columns(rows, features, values, n, used):
    """A function from a used feature to its n values."""
    held = {}
    keep = np.isin(features, used)
    rows, features, values = rows[keep], features[keep], values[keep]
    order = np.argsort(features, kind="stable")
    cuts = np.searchsorted(features[order], [*used, np.inf])
    for f, a, b in zip(used, cuts, cuts[1:]):
        held[f] = np.zeros(n)
        held[f][rows[order[a:b]]] = values[order[a:b]]
    return held.__getitem__


def transform(df, model, column="features", name="probabilities"):
    """``df`` with ``name``, an array of one probability per output. Every row is scored, in all tasks."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # as many trees as asked for, of bounded depth

    @F.arrow_udf("array<double>")
    def score(x):
        model, used, out = shared.value, shared.value.used(), [np.empty((0, len(shared.value.base)))]
        for i in range(0, len(x), _CHUNK):
            part = x.slice(i, _CHUNK)
            out.append(model.probabilities(model.margins(_columns(*_sparse(part), len(part), used), len(part))))
        return pa.array(np.concatenate(out).tolist(), pa.list_(pa.float64()))

    return df.withColumn(name, score(F.unwrap_udt(column)))


def permutation_importance(df, model, gold, key, column="features", seed=42):
    """(feature, importance) of every feature that the model uses: the share of hits it loses when a feature's
    values are dealt anew among the rows of ``df``.

    ``gold`` is the number of the right class (softmax) or the flag (logistic with one output). Each row takes the value of
    the next row in the order of a hash of ``key``, in parts of bounded size, the last one that of the first; that is one permutation for all
    features, each tried alone, and all in one pass of the model. Rows without gold don't count.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.where(F.col(gold).isNotNull()).select(
        F.xxhash64(F.lit(seed), key).alias("_o"), F.unwrap_udt(column).alias("x"), F.col(gold).cast("int").alias("y"))
    parts = max(1, -(-rows.count() // _PARTS))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_o"), F.lit(parts))).repartition(parts, "_part")  # few bytes, much work
    order = W.partitionBy("_part").orderBy("_o")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    paired = rows.select("x", "y", F.coalesce(F.lead("x").over(order), F.first("x").over(whole)).alias("other"))

    def run(batches):
        model, used = shared.value, shared.value.used()
        trees = [[k for k, t in enumerate(model.trees) if f in t.feature] for f in used]
        lost, seen = np.zeros(len(used)), 0
        for batch in batches:
            for i in range(0, len(batch), _CHUNK):
                part = batch.slice(i, _CHUNK)
                n, y = len(part), part.column(1).to_numpy()
                seen += n
                own, other = (np.array([columns(f) for f in used]).reshape(len(used), n) for columns in (
                    _columns(*_sparse(part.column(c)), n, used) for c in (0, 2)))
                each = np.array([t.values(own, used) for t in model.trees]).reshape(len(model.trees), n, len(model.base))
                margins = model.base + each.sum(axis=0)
                hit = _guess(model, margins) == y
                for at, found in enumerate(trees):
                    rows = np.flatnonzero(own[at] != other[at])  # the others keep their guess
                    if len(rows):
                        dealt = own[:, rows]
                        dealt[at] = other[at, rows]
                        moved = margins[rows] + sum(model.trees[k].values(dealt, used) - each[k, rows] for k in found)
                        lost[at] += hit[rows].sum() - (_guess(model, moved) == y[rows]).sum()
        yield pd.DataFrame({"feature": used, "lost": lost, "n": seen}) if used else pd.DataFrame(
            {"feature": np.empty(0, int), "lost": np.empty(0), "n": np.empty(0, int)})

    def arrow(batches):
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, pa.schema(
                [("feature", pa.int32()), ("lost", pa.float64()), ("n", pa.int64())]), preserve_index=False)

    found = paired.select("x", "y", "other").mapInArrow(arrow, "feature int, lost double, n long")
    return found.groupBy("feature").agg(F.try_divide(F.sum("lost"), F.sum("n")).alias("importance"))


def _guess(model, margins):
    return margins.argmax(axis=1) if model.loss == "softmax" else (margins[:, 0] > 0).astype(int)
