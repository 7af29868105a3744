"""Gradient-boosted regression trees on binned features, with calibrated grades."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.common import map_batches
from corpusmill.session import materialize

#: Residuals are multiples of this, so that their sums are exact and the same in whatever order rows come.
UNIT = 2.0**-18
#: Rows that are counted at once; a count weighs more than the residuals of so many rows of less than 8 each.
_BLOCK, _COUNT = 4096, 2.0**34
#: Predictions are graded in steps of 1 / STEPS, between LOWEST and LOWEST + SPAN.
STEPS, LOWEST, SPAN = 1024, -4, 14


def in_units(value: np.ndarray | float) -> np.ndarray | float:
    return np.rint(value / UNIT) * UNIT


def stepped(predicted: np.ndarray) -> np.ndarray:
    """Predictions to the nearest step."""
    return np.rint(predicted * STEPS) / STEPS


@dataclass
class Trees:
    """Least-squares boosting: trees of one depth, stored level by level as (feature, bin) of each node and leaf values."""

    n_trees: int = 90
    rate: float = 0.11
    depth: int = 4
    bins: int = 20
    least: int = 6
    damping: float = 2.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def coded(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        codes = self.coded(x)
        grow([self], codes.shape[1], [(float(y.sum()), len(y))], _Residuals(codes, y).histograms)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.of_codes(self.coded(x))

    def of_codes(self, codes: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(codes)), np.full(len(codes), self.base)
        for features, cuts, leaves in self.nodes:
            out += leaves[_descend(codes, rows, features, cuts, self.depth)]
        return out


def _descend(codes: np.ndarray, rows: np.ndarray, features: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after so many levels of a tree."""
    where = np.zeros(len(codes), np.int64)
    for level in range(levels):
        at = where + 2**level
        where = where * 2 + (codes[rows, features[at]] > cuts[at])
    return where


class _Tree:
    """A tree while it grows. Of two siblings the one with fewer rows is counted, the other is what is left of their parent."""

    def __init__(self, forest: Trees):
        self.forest, self.level, self.small, self.parent = forest, 0, np.ones(1, bool), None
        self.features, self.cuts = np.zeros(2**forest.depth, np.int64), np.full(2**forest.depth, forest.bins, np.int64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parent": None}

    def counts(self, codes: np.ndarray, where: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """(2, nodes, features, bins): the sums of residuals and the numbers of rows in nodes of this level that are counted."""
        few, (bins, wide) = np.flatnonzero(self.small[where]), (self.forest.bins, codes.shape[1])
        size, offset = 2**self.level * wide * bins, np.arange(wide) * bins
        out = np.zeros((2, size))
        for a in range(0, len(few), _BLOCK):
            block = few[a : a + _BLOCK]
            key, own = ((where[block] * (wide * bins))[:, None] + offset + codes[block]).ravel(), rest[block]
            if np.abs(own).max() < 8:
                both = np.bincount(key, np.repeat(own / UNIT + _COUNT, wide), size)
                number = np.rint(both / _COUNT)
                out += (both - number * _COUNT) * UNIT, number
            else:
                out += np.bincount(key, np.repeat(own, wide), size), np.bincount(key, minlength=size)
        return out.reshape(2, -1, wide, bins)

    def split(self, counts: np.ndarray) -> None:
        """Choose this level's splits by its counts; the last level completes the forest's next tree."""
        forest, nodes = self.forest, np.arange(2**self.level)
        if self.level:
            counts = np.where(self.small[:, None, None], counts, np.repeat(self.parent, 2, axis=1) - counts[:, nodes ^ 1])
        self.parent = counts
        sums, number = counts.cumsum(axis=3)
        all_sums, all_number = sums[:, :, -1:], number[:, :, -1:]
        right_sums, right_number = all_sums - sums, all_number - number
        gain = sums**2 / (number + forest.damping) + right_sums**2 / (right_number + forest.damping)
        gain = np.where((number >= forest.least) & (right_number >= forest.least), gain, -1.0).reshape(len(nodes), -1)
        best = gain.argmax(axis=1)
        feature, cut = best // forest.bins, np.where(gain[nodes, best] > 0, best % forest.bins, forest.bins)
        self.features[nodes + len(nodes)], self.cuts[nodes + len(nodes)] = feature, cut
        at = (nodes, feature, np.minimum(cut, forest.bins - 1))
        left, right = np.stack([sums[at], number[at]]), np.stack([right_sums[at], right_number[at]])
        self.level += 1
        self.small = np.stack([left[1] <= right[1], left[1] > right[1]], axis=1).ravel()
        if self.level == forest.depth:
            leaf_sums, leaf_number = np.stack([left, right], axis=2).reshape(2, -1)
            forest.nodes.append((self.features, self.cuts, in_units(forest.rate * leaf_sums / (leaf_number + forest.damping))))


class _Residuals:
    """One forest's rows in memory, with what is left of their targets and their nodes in the tree that grows."""

    def __init__(self, codes: np.ndarray, y: np.ndarray):
        self.codes, self.y, self.rows, self.rest, self.trees = codes, in_units(y), np.arange(len(codes)), None, 0

    def histograms(self, trees: list[_Tree]) -> list[np.ndarray]:
        tree = trees[0]
        if self.rest is None:
            self.rest = self.y - tree.forest.base
        if len(tree.forest.nodes) > self.trees:
            features, cuts, leaves = tree.forest.nodes[-1]
            self.rest = self.rest - leaves[_descend(self.codes, self.rows, features, cuts, tree.forest.depth)]
            self.trees += 1
        if tree.level == 0:
            self.where = np.zeros(len(self.codes), np.int64)
        else:
            at = self.where + 2 ** (tree.level - 1)
            self.where = self.where * 2 + (self.codes[self.rows, tree.features[at]] > tree.cuts[at])
        return [tree.counts(self.codes, self.where, self.rest)]


def grow(forests: list[Trees], wide: int, totals: list[tuple[float, float]], histograms: Callable[[list[_Tree]], list[np.ndarray]]) -> list[Trees]:
    """``forests`` grown side by side; totals are the sum and the number of each one's targets, ``histograms`` gives the
    counts of the level that each tree has come to."""
    for forest, (total, n) in zip(forests, totals, strict=True):
        forest.base = float(in_units(total / max(n, 1)))
    for _ in range(max((f.n_trees for f in forests), default=0)):
        trees = [_Tree(forest) for forest in forests]
        for _ in range(trees[0].forest.depth):
            for tree, counts in zip(trees, histograms(trees), strict=True):
                tree.split(counts)
    return forests


class Graded:
    """Coded rows with their grade and fold, and whether the grade is good: (codes, grade, fold, good). Up to ``most`` rows are
    fitted in the driver; beyond, each level of the trees is one job over all rows, whose counts alone come to the driver.
    Both ways give the same trees."""

    def __init__(self, table: DataFrame, n: int, wide: int, most: int, **trees: int):
        self.table, self.n, self.wide, self.trees = table, n, wide, trees
        self.arrays = next(self._arrays(table.toArrow().combine_chunks().to_batches())) if 0 < n <= most else None

    def _arrays(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for rows in batches:
            codes = np.frombuffer(b"".join(rows.column(0).to_pylist()), np.uint8).reshape(-1, self.wide)
            yield (codes, *(rows.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)))

    def sum(self, function: Callable[..., np.ndarray]) -> np.ndarray:
        """The sum of ``function(codes, grade, fold, good)`` over blocks of all rows."""
        if self.arrays is not None:
            return function(*self.arrays)
        arrays = self._arrays

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for block in arrays(batches):
                own = function(*block)
                total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], names=["total", "shape"])

        parts = map_batches(self.table.coalesce(self.table.sparkSession.sparkContext.defaultParallelism), run, "total binary, shape array<int>").toArrow()
        return sum(np.frombuffer(total.as_py()).reshape(shape.as_py()) for total, shape in zip(parts["total"], parts["shape"], strict=True))

    def __getstate__(self) -> dict:
        return {"wide": self.wide}

    def forests(self, without: list[int]) -> list[Trees]:
        """A forest for each fold of ``without``, fitted on the good rows of other folds; -1 is no fold. One that would have
        less than ten rows is the mean of all good rows."""
        totals = self.sum(lambda codes, grade, fold, good: np.array([[grade[k].sum(), k.sum()] for k in [good] + [good & (fold != w) for w in without]], float))
        forests, enough = [Trees(**self.trees) for _ in without], [n >= 10 for _, n in totals[1:]]
        for forest in forests:
            forest.base = float(in_units(totals[0, 0] / max(totals[0, 1], 1)))
        own = [(f, w, t) for f, w, t, e in zip(forests, without, totals[1:], enough, strict=True) if e]
        if self.arrays is not None:
            codes, grade, fold, good = self.arrays
            for forest, w, t in own:
                keep = good & (fold != w)
                grow([forest], self.wide, [t], _Residuals(codes[keep], grade[keep].astype(float)).histograms)
            return forests
        kept = [w for _, w, _ in own]

        def histograms(trees: list[_Tree]) -> list[np.ndarray]:
            bare = [(t.forest, t) for t in trees]

            def counts(codes: np.ndarray, grade: np.ndarray, fold: np.ndarray, good: np.ndarray) -> np.ndarray:
                out = []
                for (forest, tree), w in zip(bare, kept, strict=True):
                    at = good & (fold != w)
                    own = codes[at]
                    where = _descend(own, np.arange(len(own)), tree.features, tree.cuts, tree.level)
                    out.append(tree.counts(own, where, grade[at] - forest.of_codes(own)))
                return np.stack(out)

            return list(self.sum(counts))

        if own:
            grow([f for f, _, _ in own], self.wide, [t for _, _, t in own], histograms)
        return forests

    def judged(self, forests: list[Trees], slip: float) -> Graded:
        """The same rows, good if the forest that was fitted without their fold predicts their grade nearly; all of them, if
        these would be less than half."""
        wide = self.wide
        clean = lambda codes, grade, fold: np.abs(out_of_fold(forests, codes, fold) - grade) < slip
        n = self.sum(lambda codes, grade, fold, good: np.array([clean(codes, grade, fold).sum()], float))[0]
        if n < max(10, self.n // 2):
            return self
        new = object.__new__(Graded)
        new.__dict__ |= self.__dict__
        if self.arrays is not None:
            codes, grade, fold, _ = self.arrays
            new.arrays = (codes, grade, fold, clean(codes, grade, fold))
            return new

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                codes = np.frombuffer(b"".join(rows.column(0).to_pylist()), np.uint8).reshape(-1, wide)
                good = clean(codes, rows.column(1).to_numpy(), rows.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(good)], names=["codes", "grade", "fold", "good"])

        new.table = materialize(map_batches(self.table, run, "codes binary, grade int, fold int, good boolean"), "judged")
        return new

    def graded(self, forests: list[Trees], grades: int = 5) -> np.ndarray:
        """(2, steps, grades): how many rows, and how many good ones, have each prediction without their fold and each grade."""

        def counts(codes: np.ndarray, grade: np.ndarray, fold: np.ndarray, good: np.ndarray) -> np.ndarray:
            step = np.clip(np.rint(out_of_fold(forests, codes, fold) * STEPS).astype(np.int64) - LOWEST * STEPS, 0, SPAN * STEPS - 1)
            key, size = step * grades + grade - 1, SPAN * STEPS * grades
            return np.stack([np.bincount(key, minlength=size), np.bincount(key[good], minlength=size)]).reshape(2, -1, grades).astype(float)

        return self.sum(counts)


def out_of_fold(forests: list[Trees], codes: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each row's prediction by the forest of its fold."""
    out = np.zeros(len(codes))
    for k, forest in enumerate(forests):
        out[fold == k] = forest.of_codes(codes[fold == k])
    return out


def quantile_edges(values: DataFrame, wide: int, bins: int) -> list[np.ndarray]:
    """The values of ``values`` (feature, value, n: distinct values with their numbers) at the quantiles between ``bins`` bins."""
    counted = values.orderBy("feature", "value").toArrow()
    feature, value, n = (counted[c].to_numpy() for c in ("feature", "value", "n"))
    edges = []
    for f in range(wide):
        own, upto = value[feature == f], n[feature == f].cumsum()
        edges.append(np.unique(own[np.searchsorted(upto, np.arange(1, bins) / bins * upto[-1])]) if len(own) else np.zeros(0))
    return edges


def best_cuts(predicted: np.ndarray, grade: np.ndarray, grades: int = 5, weights: np.ndarray | None = None) -> np.ndarray:
    """The ascending cut points between grades 1 ... ``grades`` that agree with most of the grades, each of which counts as
    often as its weight says."""
    cuts = np.arange(1, grades) + 0.5
    for _ in range(3):
        for k in range(grades - 1):
            low = cuts[k - 1] if k else predicted.min() - 1
            high = cuts[k + 1] if k + 1 < len(cuts) else predicted.max() + 1
            options = np.unique(np.concatenate([np.linspace(max(low, cuts[k] - 0.5), min(high, cuts[k] + 0.5), 41), cuts[k : k + 1]]))
            right = [np.average(np.searchsorted(np.where(np.arange(len(cuts)) == k, o, cuts), predicted) + 1 == grade, weights=weights) for o in options]
            top = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
            cuts[k] = options[top[len(top) // 2]]
    return cuts
