"""Second-order boosted trees (the learner behind ML2).

Each round fits one tree to the gradients g = w (p - y) and hessians
h = w p (1 - p) of the logistic loss, level by level:

1. every task walks its rows down the part of the tree that exists and sums g
   and h by (node, feature, quantile bin); features with few bins share one sum
   over their combinations.  The tasks' sums, at most nodes x features x bins
   numbers whatever the table's size, are added by an executor, and the driver
   gets one total of the bins that exist (few, of a small table),
2. for each node the cut with the largest gain
   GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l) is taken; rows whose value is missing
   have a bin of their own and are tried on either side, and the better side
   becomes the cut's default; both children need a hessian sum of
   ``min_child_weight``,
3. leaves get -G/(H+l) times the step size.

Only the smaller child of each node is aggregated, its sibling is the parent
less that.  Gradients are rounded to multiples of a power of two, so sums are
exact integers: the model depends neither on the partitioning nor on a lost
executor's rerun.  Rows live as blocks (bins, label, weight, margin) in the
shared folder.

Where all cores can run one barrier stage and the shared folder is a mounted
one, that stage grows all trees (:func:`fit_together`): each task reads its
blocks once, follows its rows' nodes, and writes its sums to the shared folder;
each feature's sums are added by one of the tasks, which tells the others its
best cuts in the same way, so that the driver gets the trees and nothing else.  Elsewhere (a folder that only Spark's readers can open, dynamic
allocation) each level is a job; margins are then written anew every
``rewrite_every`` rounds, which bounds both the lineage and the trees a task has
to walk.  Both ways give the same trees.

Defined results: a null or NaN value is missing; rows with a null label take no
part; one label only, or an empty table, gives trees of one leaf.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import order_statistics
from ..session import checkpoint_dir

#: Rows of a block; sums of rounded gradients over one stay exact in a float64.
BLOCK_ROWS = 65_536
#: Tasks whose sums the driver adds itself; those of more are added by an executor.
FEW = 3
#: Gains up to here are rounding noise.
NO_GAIN = 1e-6
NODES = "tree int, node int, feature int, threshold double, missing_left boolean, left int, right int, value double"


@dataclass
class Tree:
    """Nodes as arrays; ``feature`` is -1 at a leaf.  ``cut`` is the bin (fitting), ``threshold`` the value (scoring)."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, x in zip((self.feature, self.cut, self.threshold, self.missing_left, self.left, self.right, self.value),
                             (-1, 0, 0.0, False, -1, -1, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def packed(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.cut, self.threshold, self.missing_left, self.left, self.right, self.value))


#: Rows that are walked down all trees before the next ones, so that a step's arrays stay in the processor's cache.
WALK_ROWS = 8192


def walk(tree: tuple[np.ndarray, ...], columns: np.ndarray) -> np.ndarray:
    """The node each row ends in, by its values (features x rows; NaN is missing)."""
    feature, _, threshold, missing_left, left, right, _ = tree
    n, inner = columns.shape[1], feature >= 0
    if not inner[0]:
        return np.zeros(n, np.int64)
    own = np.arange(len(feature))
    # a node's next one when its value is not below the threshold, below it, or missing; a leaf stays
    step = np.where(inner, np.stack([right, left, np.where(missing_left, left, right)]), own).T.astype(np.int64).ravel()
    flat, rows, start = np.ascontiguousarray(columns).ravel(), np.arange(n), np.where(inner, feature, 0) * n
    node = np.zeros(n, np.int64)
    for _ in range(height(tree)):
        x = flat[start[node] + rows]
        node = step[node * 3 + (x < threshold[node]) + 2 * np.isnan(x)]
    return node


def height(tree: tuple[np.ndarray, ...]) -> int:
    """Steps from the root to the deepest node."""
    feature, left, right = tree[0], tree[4], tree[5]
    depth = np.zeros(len(feature), np.int64)
    for i in np.flatnonzero(feature >= 0):  # children follow their parent
        depth[left[i]] = depth[right[i]] = depth[i] + 1
    return int(depth.max())


def steps_by_bin(tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """Each node's next one for every bin (nodes x 256, flat); a leaf stays."""
    feature, cut, _, missing_left, left, right, _ = tree
    step = np.where(np.arange(256)[None, :] <= cut[:, None], left[:, None], right[:, None])
    step[:, MISSING_BIN] = np.where(missing_left, left, right)
    return np.where((feature >= 0)[:, None], step, np.arange(len(feature))[:, None]).astype(np.int64).ravel()


def walk_bins(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The same by the rows' bins (rows x features)."""
    feature = tree[0]
    nodes, n = len(feature), len(bins)
    if nodes == 1:
        return np.zeros(n, np.int64)
    inner, step = feature >= 0, steps_by_bin(tree)
    columns = np.ascontiguousarray(bins.T)  # blocks keep their bins by feature
    flat, rows, start = columns.ravel(), np.arange(n), np.where(inner, feature, 0) * n
    node = step[columns[feature[0]]]
    for _ in range(height(tree) - 1):
        node = step[(node << 8) + flat[start[node] + rows]]
    return node


#: Bins are bytes, and the last one is for missing values, so a feature has at most 255 bins (254 cuts).
MISSING_BIN = 255


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """For each feature the distinct values at ``bins`` evenly spaced ranks: exact quantiles, found by a
    distributed rank search.  A row's bin is the number of cut points not above its value."""
    def ranks(n: int) -> list[int]:
        return sorted({(i * n) // bins for i in range(bins)}) if n else []

    clean = rows.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features])
    _, found = order_statistics(clean, features, ranks)
    return [np.unique([v for (name, _), v in found.items() if name == c]) for c in features]


def shared_columns(n_cuts: list[int]) -> list[list[int]]:
    """Features that are summed together: as many as have at most 256 combinations of bins (and missing)."""
    groups, room = [], 0
    for f in sorted(range(len(n_cuts)), key=lambda f: (n_cuts[f], f)):
        codes = n_cuts[f] + 2
        if groups and codes <= room:
            groups[-1].append(f)
            room //= codes
        else:
            groups.append([f])
            room = 256 // codes
    return groups


def as_blocks(rows: DataFrame, features: list[str], label: str, weight: str, cuts: list[np.ndarray], base_margin: float) -> DataFrame:
    """Rows with a label, packed: n, bins (features x n bytes, then a row for each group of :func:`shared_columns`
    with several features), labels, weights and margins (float64)."""
    n_cuts = [len(c) for c in cuts]
    joint = [g for g in shared_columns(n_cuts) if len(g) > 1]

    def pack(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        bins = np.empty((len(features) + len(joint), n), np.uint8)
        for i, c in enumerate(features):
            x = table.column(c).to_numpy().astype(np.float64)
            bins[i] = np.where(np.isnan(x), MISSING_BIN, np.searchsorted(cuts[i], x, side="right"))
        for i, group in enumerate(joint, len(features)):
            code = np.zeros(n, np.int64)
            for f in group:
                code = code * (n_cuts[f] + 2) + np.where(bins[f] == MISSING_BIN, n_cuts[f] + 1, bins[f])
            bins[i] = code
        y, w = (table.column(c).to_numpy().astype(np.float64) for c in ("label", "weight"))
        return pa.RecordBatch.from_pydict({"n": [n], "bins": [bins.tobytes()], "y": [y.tobytes()], "w": [w.tobytes()],
                                           "margin": [np.full(n, base_margin).tobytes()]})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                yield pack(table.slice(0, BLOCK_ROWS))
                held, n = table.slice(BLOCK_ROWS).to_batches(), n - BLOCK_ROWS
        if n:
            yield pack(pa.Table.from_batches(held))

    plain = rows.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in features],
                                                        F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"))
    return plain.mapInArrow(run, "n long, bins binary, y binary, w binary, margin binary")


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # bins (features and groups x rows), labels, weights, margins


def unpacked(blocks: DataFrame) -> RDD:
    """The stored blocks as arrays, one element each."""
    def arrays(r) -> Block:
        y, w, margin = (np.frombuffer(x, np.float64) for x in (r.y, r.w, r.margin))
        return np.frombuffer(r.bins, np.uint8).reshape(-1, len(y)), y, w, margin

    return blocks.select("bins", "y", "w", "margin").rdd.map(arrays)


def with_tree(rows: RDD, tree: tuple[np.ndarray, ...]) -> RDD:
    """The blocks with their margins moved by ``tree``."""
    return rows.map(lambda b: (b[0], b[1], b[2], b[3] + tree[-1][walk_bins(tree, b[0].T)]))


def added(parts):
    """The sum of (0, array) pairs, as one."""
    total = None
    for _, v in parts:
        total = v if total is None else total + v
    if total is not None:
        yield 0, total


def sum_rows(groups: list[list[int]], k: int) -> list[int]:
    """The row of a block's bins that each group of features is summed by."""
    joint = [g for g in groups if len(g) > 1]
    return [g[0] if len(g) == 1 else k + joint.index(g) for g in groups]


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """g and h as whole numbers."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint(w * (p - y) * scale), np.rint(w * p * (1.0 - p) * scale)


def tally(out: np.ndarray, at_row: list[int], bins: np.ndarray, use: np.ndarray | None, first: np.ndarray | int, g: np.ndarray, h: np.ndarray) -> None:
    """Adds g and h of a block's rows ``use`` (None: all) to ``out`` (2 x groups x cells); ``first``: their nodes' first cells."""
    for i, r in enumerate(at_row):
        cell = first + (bins[r].astype(np.int64) if use is None else np.take(bins[r], use))
        # whole numbers below 2^53 add up exactly
        out[0, i] += np.bincount(cell, g, out.shape[2]).astype(np.int64)
        out[1, i] += np.bincount(cell, h, out.shape[2]).astype(np.int64)


def per_feature(sums: np.ndarray, groups: list[list[int]], n_cuts: list[int]) -> list[np.ndarray]:
    """(2, groups, nodes, 256) as (2, nodes, bins) of each feature: its bins 0 to its number of cuts, then missing."""
    nodes, parts = sums.shape[2], {}
    for i, group in enumerate(groups):
        codes = [n_cuts[f] + 2 for f in group]
        if len(group) == 1:
            f = group[0]
            parts[f] = np.concatenate([sums[:, i, :, :n_cuts[f] + 1], sums[:, i, :, MISSING_BIN:]], axis=2)
            continue
        cube = sums[:, i, :, :int(np.prod(codes))].reshape(2, nodes, *codes)
        for j, f in enumerate(group):
            parts[f] = cube.sum(axis=tuple(2 + other for other in range(len(group)) if other != j))
    return [parts[f] for f in range(len(n_cuts))]


def histograms(rows: RDD, growing: tuple[np.ndarray, ...], wanted: list[int], n_cuts: list[int], scale: float) -> np.ndarray:
    """(2, features, nodes, 256) sums of g and h as whole numbers.

    A task adds up its blocks and keeps the bins that exist; one task adds those
    few numbers of all tasks, so that the driver gets one total, or FEW at most."""
    nodes, k = len(wanted), len(n_cuts)
    lookup = np.full(len(growing[0]), -1, np.int64)
    lookup[wanted] = np.arange(nodes)
    groups = shared_columns(n_cuts)
    at_row = sum_rows(groups, k)

    def summed(blocks):
        out = np.zeros((2, len(groups), nodes * 256), np.int64)
        for bins, y, w, margin in blocks:
            if len(growing[0]) == 1:  # the root holds all rows
                use, first = None, 0
            else:
                place = lookup[walk_bins(growing, bins[:k].T)]
                use = np.flatnonzero(place >= 0)
                y, w, margin, first = y[use], w[use], margin[use], place[use] * 256
            tally(out, at_row, bins, use, first, *gradients(y, w, margin, scale))
        yield 0, np.concatenate(per_feature(out.reshape(2, len(groups), nodes, 256), groups, n_cuts), axis=2)

    out = np.zeros((2, k, nodes, 256), np.int64)
    parts = rows.mapPartitions(summed)
    if rows.getNumPartitions() > FEW:
        parts = parts.partitionBy(1).mapPartitions(added)
    total = [sum(v for _, v in found)] if (found := parts.collect()) else []  # none of an empty table
    at = 0
    for f, cuts in enumerate(n_cuts if total else ()):
        out[:, f, :, :cuts + 1] = total[0][:, :, at:at + cuts + 1]
        out[:, f, :, MISSING_BIN] = total[0][:, :, at + cuts + 1]
        at += cuts + 2
    return out


def best_cuts(g: np.ndarray, h: np.ndarray, n_cuts: list[int], reg_lambda: float, min_child_weight: float):
    """The best cut of each node from (nodes, features, 256) sums: (gain, feature, bin, missing_left), or None.

    Rows of bins up to ``bin`` go left.  Ties go to the first feature, then the lowest bin, then missing right."""
    total_g, total_h = (np.array([x[0].sum() for x in sums])[:, None, None, None] for sums in (g, h))
    score = lambda a, b: a * a / (b + reg_lambda)
    most = max(n_cuts, default=0)  # the last bin is never the left part's end
    if not most:
        return [None] * len(g)
    # nodes x features x missing right or left x bins
    left_g, left_h = (np.stack([x, x + sums[:, :, MISSING_BIN:]], axis=2) for sums in (g, h) for x in [np.cumsum(sums[:, :, :most], axis=2)])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left_g, left_h) + score(total_g - left_g, total_h - left_h) - score(total_g, total_h)
    gain[~((left_h >= min_child_weight) & (total_h - left_h >= min_child_weight))] = -np.inf
    for f, cuts in enumerate(n_cuts):
        gain[:, f, :, cuts:] = -np.inf
    at = gain.argmax(axis=3)
    high = np.take_along_axis(gain, at[..., None], axis=3)[..., 0]
    high = np.where(high > NO_GAIN, high, -np.inf).reshape(len(g), -1)  # features, then missing right and left
    first = high.argmax(axis=1)
    return [(float(high[i, j]), int(j) // 2, int(at[i].flat[j]), bool(j % 2)) if high[i, j] > NO_GAIN else None for i, j in enumerate(first)]


@dataclass
class Growth:
    """What a tree's growth is ruled by."""

    cuts: list[np.ndarray]
    scale: float
    max_depth: int
    step_size: float
    reg_lambda: float
    min_child_weight: float

    def leaf(self, g: int, h: int) -> float:
        total = h / self.scale + self.reg_lambda
        return -self.step_size * (g / self.scale) / total if total > 0 else 0.0


Cut = tuple[float, int, int, bool, int, int]  # gain, feature, bin, missing left, whole sums of g and h on the left


class LevelSums:
    """Whole sums of g and h, (2, features, 256), of each node of a level, for the features ``mine``."""

    def __init__(self, rules: Growth, mine: list[int]):
        self.rules, self.mine, self.n_cuts = rules, mine, [len(c) for c in rules.cuts]
        self.level: dict[int, np.ndarray] = {}

    def summed(self, tree: Tree, wanted: list[int]) -> np.ndarray:
        """Those of the nodes ``wanted``."""
        raise NotImplementedError

    def begin(self, tree: Tree) -> tuple[int, int]:
        """The root's level; sums of g and h of all rows."""
        self.level = {0: self.summed(tree, [0])[0]}
        g, h = self.level[0][:, 0].sum(axis=1)
        return int(g), int(h)

    def deepen(self, tree: Tree, split: list[tuple[int, int, int]]) -> None:
        """The next level, of the smaller and larger children of the nodes ``split``."""
        children = {}
        for (node, small, large), sums in zip(split, self.summed(tree, [small for _, small, _ in split])):
            children[small], children[large] = sums, self.level[node] - sums
        self.level = children

    def best(self) -> list[Cut | None]:
        """The level's best cuts by these features."""
        if not self.mine:
            return [None] * len(self.level)
        g, h = np.stack(list(self.level.values()), axis=1) / self.rules.scale
        found = best_cuts(g, h, [self.n_cuts[f] for f in self.mine], self.rules.reg_lambda, self.rules.min_child_weight)
        out: list[Cut | None] = []
        for sums, cut in zip(self.level.values(), found):
            if cut is None:
                out.append(None)
                continue
            gain, i, at, missing_left = cut
            left = sums[:, i, :at + 1].sum(axis=1) + (sums[:, i, MISSING_BIN] if missing_left else 0)
            out.append((gain, self.mine[i], at, missing_left, int(left[0]), int(left[1])))
        return out


def grow(sums: LevelSums, rules: Growth) -> Tree:
    """One tree, level by level."""
    tree = Tree()
    root = tree.add()
    totals = {root: sums.begin(tree)}
    tree.value[root] = rules.leaf(*totals[root])
    for depth in range(rules.max_depth):
        split: list[tuple[int, int, int]] = []
        below: dict[int, tuple[int, int]] = {}
        for (node, (g, h)), cut in zip(totals.items(), sums.best()):
            if cut is None:
                continue
            _, f, at, missing_left, left_g, left_h = cut
            left, right = tree.add(), tree.add()
            tree.feature[node], tree.cut[node], tree.threshold[node] = f, at, float(rules.cuts[f][at])
            tree.missing_left[node], tree.left[node], tree.right[node] = missing_left, left, right
            right_g, right_h = g - left_g, h - left_h
            tree.value[left], tree.value[right] = rules.leaf(left_g, left_h), rules.leaf(right_g, right_h)
            sides = [(left, (left_g, left_h)), (right, (right_g, right_h))]
            below.update(sides if left_h <= right_h else sides[::-1])
            split.append((node, *((left, right) if left_h <= right_h else (right, left))))
        if not split or depth + 1 == rules.max_depth:
            break
        sums.deepen(tree, split)
        totals = below
    return tree


class JobSums(LevelSums):
    """Sums by one Spark job a level."""

    def __init__(self, rules: Growth, blocks: RDD):
        super().__init__(rules, list(range(len(rules.cuts))))
        self.blocks = blocks

    def summed(self, tree: Tree, wanted: list[int]) -> np.ndarray:
        return np.moveaxis(histograms(self.blocks, tree.packed(), wanted, self.n_cuts, self.rules.scale), 2, 0)


class TaskSums(LevelSums):
    """Sums within one of several tasks that run together.  A task's bins, labels and weights lie in a file of its
    own that is mapped into memory; margins, gradients and nodes, 26 bytes a row, are in memory."""

    def __init__(self, rules: Growth, blocks, context: BarrierTaskContext, folder: str):
        self.context, self.folder = context, folder
        self.rank, self.tasks = context.partitionId(), len(context.getTaskInfos())
        super().__init__(rules, list(range(self.rank, len(rules.cuts), self.tasks)))
        self.groups = shared_columns(self.n_cuts)
        self.at_row = sum_rows(self.groups, len(self.n_cuts))
        # a stage that is run again doesn't meet the files of its last attempt
        self.run, self.steps, self.files = context.allGather(str(context.taskAttemptId()))[0], 0, {}
        self.blocks, self.margins = [], []
        with tempfile.TemporaryFile() as f:
            for bins, y, w, margin in blocks:
                self.margins.append(margin.copy())
                self.blocks.append((f.tell(), bins.shape))
                for x in (y, w, bins):
                    f.write(x.tobytes())
                f.write(bytes(-f.tell() % 8))
            f.flush()
            held = np.memmap(f, np.uint8, "r") if self.blocks else np.empty(0, np.uint8)
        for i, (at, (rows, n)) in enumerate(self.blocks):
            y, w = (held[at + 8 * n * j:at + 8 * n * (j + 1)].view(np.float64) for j in range(2))
            self.blocks[i] = (held[at + 16 * n:at + 16 * n + rows * n].reshape(rows, n), y, w)
        self.small = np.min_scalar_type(2 ** (rules.max_depth + 1))
        self.nodes = [np.zeros(len(m), self.small) for m in self.margins]
        # a block's places and bins while its rows move, in the same memory for all blocks
        most = max(map(len, self.margins), default=0)
        self.rows, self.room, self.byte = np.arange(most), np.empty((2, most), np.int64), np.empty(most, np.uint8)
        self.gh = [gradients(y, w, m, rules.scale) for (_, y, w), m in zip(self.blocks, self.margins)]

    def follow(self, tree: tuple[np.ndarray, ...]) -> None:
        """Move all rows one node down, those at leaves stay."""
        if len(tree[0]) == 1:
            return
        step, asked = steps_by_bin(tree).astype(self.small), np.where(tree[0] >= 0, tree[0], 0)
        for (bins, _, _), node in zip(self.blocks, self.nodes):
            n = len(node)
            (key, at), byte = self.room[:, :n], self.byte[:n]
            key[:] = node
            # "clip" writes into ``out`` without a copy; all places are within bounds
            np.take(asked * n, key, out=at, mode="clip")
            at += self.rows[:n]
            np.take(bins.reshape(-1), at, out=byte, mode="clip")
            key <<= 8
            key += byte
            np.take(step, key, out=node, mode="clip")

    def take(self, tree: tuple[np.ndarray, ...]) -> None:
        """Add a grown tree to the margins."""
        self.follow(tree)
        for i, ((_, y, w), node, margin) in enumerate(zip(self.blocks, self.nodes, self.margins)):
            margin += tree[-1][node]
            node[:] = 0
            self.gh[i] = gradients(y, w, margin, self.rules.scale)

    def begin(self, tree: Tree) -> tuple[int, int]:
        self.level = {0: self.summed(tree, [0])[0]}
        return self.total

    def summed(self, tree: Tree, wanted: list[int]) -> np.ndarray:
        nodes, packed = len(wanted), tree.packed()
        self.follow(packed)
        first, asked = np.zeros(len(packed[0]), np.int64), np.zeros(len(packed[0]), bool)
        first[wanted], asked[wanted] = np.arange(nodes) * 256, True
        out = np.zeros((2, len(self.groups), nodes * 256), np.int64)
        for (bins, _, _), node, (g, h) in zip(self.blocks, self.nodes, self.gh):
            if len(packed[0]) == 1:  # the root holds all rows
                tally(out, self.at_row, bins, None, 0, g, h)
                continue
            use = np.flatnonzero(np.take(asked, node))
            tally(out, self.at_row, bins, use, np.take(first, np.take(node, use)), np.take(g, use), np.take(h, use))
        parts = per_feature(out.reshape(2, len(self.groups), nodes, 256), self.groups, self.n_cuts)
        return self.exchanged(parts, nodes)

    def put(self, kind: str, data: bytes) -> list[str]:
        """Write this task's file of the step, whole or not at all; the names of all tasks' ones."""
        names = [os.path.join(self.folder, f"{self.run}-{self.steps}-{kind}-{rank}") for rank in range(self.tasks)]
        self.files[kind] = names[self.rank]
        with open(f"{names[self.rank]}.part", "wb") as f:
            f.write(data)
        os.replace(f"{names[self.rank]}.part", names[self.rank])
        return names

    def drop(self, kind: str) -> None:
        if kind in self.files:
            os.remove(self.files.pop(kind))

    def exchanged(self, parts: list[np.ndarray], nodes: int) -> np.ndarray:
        """All tasks' sums of the features ``mine``, from the files of this step."""
        self.drop("sums")  # all have read the last ones, as they have told their cuts since
        self.steps += 1
        own = np.array([int(x) for x in parts[0].sum(axis=(1, 2))], np.int64)
        names = self.put("sums", b"".join(x.tobytes() for x in (own, *parts)))
        self.total, wanted = (0, 0), [0] * len(self.mine)
        start = 16 + 8 * np.cumsum([0, *(x.size for x in parts)])
        for name in names:
            with when_there(name) as f:
                self.total = tuple(a + int(b) for a, b in zip(self.total, np.frombuffer(f.read(16), np.int64)))
                for i, feature in enumerate(self.mine):
                    f.seek(start[feature])
                    wanted[i] = wanted[i] + np.frombuffer(f.read(8 * parts[feature].size), np.int64).reshape(parts[feature].shape)
        self.drop("cuts")  # all have read the last ones, as they are a step further
        out = np.zeros((nodes, 2, len(self.mine), 256), np.int64)
        for i, (feature, total) in enumerate(zip(self.mine, wanted)):
            out[:, :, i, :self.n_cuts[feature] + 1] = total[:, :, :-1].swapaxes(0, 1)
            out[:, :, i, MISSING_BIN] = total[:, :, -1].T
        return out

    def best(self) -> list[Cut | None]:
        """The best of all tasks' cuts; ties go to the first feature."""
        told = []
        for name in self.put("cuts", json.dumps(super().best()).encode()):
            with when_there(name) as f:
                told.append(json.loads(f.read()))
        return [min((tuple(c) for c in cuts if c), key=lambda c: (-c[0], c[1]), default=None) for cuts in zip(*told)]


def when_there(name: str):
    """The opened file, once another task has put it there.  A task that fails ends its whole barrier stage, the waiting ones too."""
    pause = 0.0005
    while True:
        try:
            return open(name, "rb")
        except FileNotFoundError:
            time.sleep(pause)
            pause = min(0.02, pause * 1.5)


def tasks_together(spark: SparkSession) -> int:
    """Tasks that the session can run at the same time in one barrier stage and that share a mounted folder, or 0."""
    sc = spark.sparkContext
    conf = sc.getConf()
    folder = checkpoint_dir(spark)
    if "://" in folder and not folder.startswith("file://") or conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    cores, executors = sc.defaultParallelism, max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1)
    if conf.get("spark.default.parallelism"):  # not the cores, then
        cores = min(cores, executors * int(conf.get("spark.executor.cores", "1")))
    if cores == 2:  # what a cluster of one core says as well
        cores = min(cores, executors)
    return cores // int(conf.get("spark.task.cpus", "1"))


def fit_together(packed: DataFrame, rules: Growth, rounds: int, tasks: int, folder: str) -> list[tuple[np.ndarray, ...]]:
    """All trees by one barrier stage of ``tasks`` tasks that exchange their sums in ``folder``."""
    os.makedirs(folder)

    def run(blocks):
        context = BarrierTaskContext.get()
        sums = TaskSums(rules, blocks, context, folder)
        for r in range(rounds):
            tree = grow(sums, rules).packed()
            if context.partitionId() == 0:
                yield tree
            if r + 1 < rounds:
                sums.take(tree)

    trees = unpacked(packed.repartition(tasks)).barrier().mapPartitions(run).collect()
    shutil.rmtree(folder, ignore_errors=True)
    return trees


@dataclass
class BoostedTrees:
    """A fitted model: at most rounds x 2^(depth+1) nodes, whatever it was fitted on."""

    features: list[str]
    base_margin: float
    trees: list[tuple[np.ndarray, ...]]

    def margins(self, columns: np.ndarray) -> np.ndarray:
        """Log-odds of rows given as features x rows values, NaN for missing."""
        out = np.full(columns.shape[1], self.base_margin)
        for start in range(0, columns.shape[1], WALK_ROWS):
            part = np.ascontiguousarray(columns[:, start:start + WALK_ROWS])
            for tree in self.trees:
                out[start:start + WALK_ROWS] += tree[-1][walk(tree, part)]
        return out

    def probability(self, spark: SparkSession) -> Column:
        """P(label = 1) of a frame's rows, from its feature columns."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns]) if len(columns[0]) else np.zeros((len(columns), 0))
            return pd.Series(1.0 / (1.0 + np.exp(-shared.value.margins(x))))

        return score(*[F.col(c).cast("double") for c in self.features])

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, int(f), float(th), bool(ml), int(lo), int(hi), float(v))
                for t, tree in enumerate(self.trees) for i, (f, _, th, ml, lo, hi, v) in enumerate(zip(*tree))]
        return spark.createDataFrame(rows, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "nodes"))
        meta = [(self.base_margin, self.features, len(self.trees))]
        spark.createDataFrame(meta, "base_margin double, features array<string>, trees int").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedTrees":
        meta = spark.read.parquet(os.path.join(path, "meta")).first()
        table = spark.read.parquet(os.path.join(path, "nodes")).toPandas().sort_values(["tree", "node"])  # a bounded model
        trees = []
        for _, t in table.groupby("tree"):
            trees.append((t["feature"].to_numpy(), np.zeros(len(t), np.int64), t["threshold"].to_numpy(), t["missing_left"].to_numpy(),
                          t["left"].to_numpy(), t["right"].to_numpy(), t["value"].to_numpy()))
        return BoostedTrees(list(meta.features), float(meta.base_margin), trees)


def fit(rows: DataFrame, features: list[str], label: str, weight: str, rounds: int = 150, max_depth: int = 6, step_size: float = 0.1,
        reg_lambda: float = 1.0, min_child_weight: float = 1.0, bins: int = 255, base_score: float = 0.5, rewrite_every: int = 10) -> BoostedTrees:
    """Fit ``rounds`` trees to the 0/1 column ``label`` with row weights ``weight``."""
    if not 2 <= bins <= MISSING_BIN:
        raise ValueError(f"bins must be between 2 and {MISSING_BIN}")
    cuts = cut_points(rows, features, bins - 1)
    base_margin = float(np.log(base_score / (1.0 - base_score)))
    spark = rows.sparkSession
    folder = os.path.join(checkpoint_dir(spark), "boosting", uuid.uuid4().hex)  # sets the context's checkpoint folder as well
    packed = as_blocks(rows, features, label, weight, cuts, base_margin)
    packed.write.parquet(folder)
    packed = spark.read.schema(packed.schema).parquet(folder)
    n = packed.agg(F.sum("n").alias("n")).first()["n"] or 0
    most = rows.agg(F.max(F.col(weight).cast("double")).alias("w")).first()["w"] or 1.0
    # the finest power of two at which neither a block's sums (float64) nor the table's (long) can overflow
    room = min(52 - int(np.ceil(np.log2(BLOCK_ROWS))), 61 - int(np.ceil(np.log2(n + 2))))
    scale = 2.0 ** (room - int(np.ceil(np.log2(max(most, 1.0)))))

    rules = Growth(cuts, scale, max_depth, step_size, reg_lambda, min_child_weight)
    tasks = tasks_together(spark) if n and features and max_depth else 0
    if tasks:
        exchange = os.path.join(checkpoint_dir(spark).removeprefix("file://"), "boosting", uuid.uuid4().hex)
        return BoostedTrees(list(features), base_margin, fit_together(packed, rules, rounds, tasks, exchange))
    return BoostedTrees(list(features), base_margin, fit_by_jobs(packed, rules, rounds, rewrite_every))


def fit_by_jobs(packed: DataFrame, rules: Growth, rounds: int, rewrite_every: int) -> list[tuple[np.ndarray, ...]]:
    """All trees by one job a level."""
    done: list[tuple[np.ndarray, ...]] = []
    blocks = unpacked(packed).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [blocks]
    for r in range(rounds):
        done.append(grow(JobSums(rules, blocks), rules).packed())
        if r + 1 < rounds:
            # computed by the next round's first job; an executor that is lost recomputes a few rounds at most
            blocks = with_tree(blocks, done[-1]).persist(StorageLevel.MEMORY_AND_DISK)
            if (r + 1) % rewrite_every == 0:
                blocks.checkpoint()
            kept.append(blocks)
            if len(kept) > 2:
                kept.pop(0).unpersist()
    for b in kept:
        b.unpersist()
    return done
