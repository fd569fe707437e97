"""Operator 6: exact cosine threshold links by dual traversal of cover trees.

Vectors are scaled to unit length, where cosine >= c is a chord of at most
sqrt(2 - 2c).  A cover tree has nested levels of centres with halving radii: every centre
of a level is one of the next, and every point lies within the level's radius of a
centre.  Each node knows its exact covering radius.  Two nodes whose distance less both
radii is over the chord are pruned; two whose distance plus both radii is under it are
linked whole, without looking at pairs; the rest are opened, and single points are
compared by cosine in double precision.

Only rows of one label meet.  A label with more than ``BLOCK_ROWS`` vectors starts its
traversal on the cluster: the top of a cover tree over a bounded sample gives cells, every
vector goes to the nearest centre, and two cells meet only if their exact covering radii
let them.  Cells of a quarter block or more that lie within the chord are linked whole there
and then, and smaller ones that together lie within half of it count as one, so many copies
and near copies of one vector never meet in pairs.  Other cells are put together, near ones first, into units of a block at most, so a label has no more
than some four units a block of its rows, and a vector is dealt to the blocks of the units
that its cell meets, not to every cell.  A cell with more than ``BLOCK_ROWS`` vectors is cut
by a hash of vec_id; one task holds two blocks at most.  Tasks return counts and a forest,
never pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and
rows with a null label, link with nothing and are components of their own; vectors of
different lengths never link; a null vec_id takes no part and has a null component; rows
that share a vec_id are one node whose links add up; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.components import connected_components, forest
from quarrylens.llm.store import hashed_sample, save, shuffle_width

BLOCK_ROWS = 32_768  # of up to 64 components, fewer of longer vectors: 16 MB in double precision
BATCH = 256
DEAL_ROWS = 8192  # rows that leave the dealing at once
SLACK = 1e-7  # distances this close to a bound are not decided by it; a chord of near-equal vectors is off by up to 3e-8
LEVELS = 12
CELL_SAMPLE = 16_384  # vectors of large labels that cells are taken from
LABEL_CELLS = 512  # cells of a label at most, so 512 x 512 flags say which of them meet
PAIR_CHUNK = 1 << 20
FEW_POINTS = 64
PENDING_LINKS = 1 << 20  # links that wait for a forest
RADIUS_STEPS = (SLACK, 0.0625, 0.125, 0.25, 0.5)  # nodes of about one radius are pruned together
LINK_SCHEMA = "vec_id long, n long, root long"


@dataclass
class Node:
    centre: int
    radius: float
    members: np.ndarray
    children: list["Node"] = field(default_factory=list)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords between rows of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def nearest_of(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and chord of the nearest centre of every point, PAIR_CHUNK pairs at once."""
    nearest, cosine = np.empty(len(points), np.int64), np.empty(len(points))
    step = max(1, PAIR_CHUNK // len(centres))
    for s in range(0, len(points), step):
        dots = points[s : s + step] @ centres.T
        nearest[s : s + step] = dots.argmax(axis=1)
        cosine[s : s + step] = dots.max(axis=1)
    return nearest, np.sqrt(np.maximum(2 - 2 * cosine, 0))


def cover_tree(points: np.ndarray) -> Node:
    """The root over all points; a level's centres are kept in the next and points not covered are added to them."""
    everything = np.arange(len(points))
    root = Node(0, float(distances(points[:1], points).max(initial=0)), everything)
    level, radius = [root], 2.0
    for _ in range(LEVELS):
        radius /= 2
        below: list[Node] = []
        for node in level:
            if node.radius <= SLACK or len(node.members) == 1:
                continue
            node.children = split(points, node, radius)
            below += node.children
        level = below
        if not level:
            break
    return root


def split(points: np.ndarray, node: Node, radius: float) -> list[Node]:
    """Children whose centres are over ``radius`` apart, the node's own centre first.

    Points not covered yet become centres in their order, ``BATCH`` looked at together:
    within a batch by its own distances, then against all that is left at once.
    """
    left = np.concatenate([[node.centre], node.members[node.members != node.centre]])
    found: list[Node] = []
    while len(left):
        batch = left[:BATCH]
        inner = distances(points[batch], points[batch]) <= radius
        centres: list[int] = []
        covered = np.zeros(len(batch), bool)
        for k in range(len(batch)):
            if not covered[k]:
                centres.append(k)
                covered |= inner[k]
        nearest, near = nearest_of(points[left], points[batch[centres]])
        nearest[centres], near[centres] = np.arange(len(centres)), 0
        inside = near <= radius
        order = np.flatnonzero(inside)[np.argsort(nearest[inside], kind="stable")]
        cuts = np.cumsum(np.bincount(nearest[inside], minlength=len(centres)))[:-1]
        for k, own in enumerate(np.split(order, cuts)):
            found.append(Node(int(batch[centres[k]]), float(near[own].max(initial=0)), left[own]))
        left = left[~inside]
    return found


class Flat:
    """A tree's nodes in arrays, the children of each one behind the other.

    A node of few points that a radius over half the chord holds together bounds nothing:
    its children stand in its place, so vectors without structure are compared as points.
    """

    def __init__(self, root: Node, chord: float):
        nodes, first = [root], []
        for node in nodes:  # grows as it goes
            first.append(len(nodes))
            todo = node.children[::-1]
            while todo:
                child = todo.pop()
                if child.children and len(child.members) <= FEW_POINTS and child.radius > chord / 2:
                    todo += child.children[::-1]
                else:
                    nodes.append(child)
        self.members = [n.members for n in nodes]
        self.centre, self.radius = np.array([n.centre for n in nodes]), np.array([n.radius for n in nodes])
        self.size, self.first = np.array([len(m) for m in self.members]), np.array(first)
        self.inner = np.array([bool(n.children) for n in nodes])
        self.last = np.append(self.first[1:], len(nodes))
        self.counts = np.zeros(len(nodes), np.int64)  # links of every member of a node
        self.tied = np.zeros(len(nodes), bool)  # nodes whose members are in one component

    def below(self, node: int) -> np.ndarray:
        return np.arange(self.first[node], self.last[node])


class Traversal:
    """Links between the points under two trees, or under one against itself."""

    def __init__(self, left: np.ndarray, right: np.ndarray, cosine: float, same: bool):
        self.left, self.right, self.cosine, self.same = left, right, cosine, same
        self.chord = float(np.sqrt(2 - 2 * cosine))
        self.left_counts, self.right_counts = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        self.coarse_left = left.astype(np.float32)
        self.coarse_right = self.coarse_left if same else right.astype(np.float32)
        self.coarse_error = (left.shape[1] + 8) * 1.2e-7  # of a product of two unit vectors in single precision
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []
        self.pending = 0

    def run(self, a: Node, b: Node) -> None:
        self.a = Flat(a, self.chord)
        self.b = self.a if a is b else Flat(b, self.chord)
        stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64), a is b)]
        while stack:
            self.level(*stack.pop(), stack)
        for tree, counts, shift in ((self.a, self.left_counts, 0), (self.b, self.right_counts, 0 if self.same else len(self.left)))[: 1 if a is b else 2]:
            for k in np.flatnonzero((tree.counts > 0) | tree.tied).tolist():
                counts[tree.members[k]] += tree.counts[k]
                self.add(np.full(tree.size[k] - 1, tree.members[k][0] + shift), tree.members[k][1:] + shift)

    def level(self, left: np.ndarray, right: np.ndarray, mirrored: bool, stack: list) -> None:
        """All pairs of two lists of nodes; mirrored: the lists are one, and each pair counts once.

        Products in single precision prune first, less their error; what is left is decided
        in double precision.
        """
        a, b = self.a, self.b
        left = left[np.argsort(a.radius[left], kind="stable")]
        right = left if mirrored else right[np.argsort(b.radius[right], kind="stable")]
        cuts = sorted({0, len(right), *np.searchsorted(b.radius[right], RADIUS_STEPS, side="right").tolist()})
        open_: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(0, len(left), 1024):
            rows = left[s : s + 1024]
            coarse, wide = self.coarse_left[a.centre[rows]], max(1, PAIR_CHUNK // len(rows))
            for low, high in zip(cuts, cuts[1:]):
                for t in range(max(low, s) if mirrored else low, high, wide):  # mirrored: from the first row on
                    columns = right[t : min(t + wide, high)]
                    reach = self.chord + SLACK + a.radius[rows] + b.radius[columns].max()
                    least = np.where(reach < 2, 1 - reach * reach / 2, -1) - self.coarse_error
                    i, j = np.nonzero(coarse @ self.coarse_right[b.centre[columns]].T >= least.astype(np.float32)[:, None])
                    if mirrored:
                        keep = i + s <= j + t
                        i, j = i[keep], j[keep]
                    if len(i):
                        open_.append(self.near(rows[i], columns[j], mirrored, stack))
            if sum(len(x) for x, _ in open_) > PENDING_LINKS:
                self.open(open_, stack)
                open_ = []
        self.open(open_, stack)

    def near(self, x: np.ndarray, y: np.ndarray, mirrored: bool, stack: list) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes x, y are pruned, linked whole or compared as points; those are returned that stay open."""
        a, b = self.a, self.b
        apart = np.sqrt(np.maximum(2 - 2 * products(self.left, a.centre[x], self.right, b.centre[y]), 0))
        reach = a.radius[x] + b.radius[y]
        keep = apart - reach <= self.chord + SLACK
        x, y, whole = x[keep], y[keep], (apart + reach <= self.chord - SLACK)[keep]
        points = (a.size[x] == 1) & (b.size[y] == 1)
        self.points(a.centre[x[points]], b.centre[y[points]], whole[points])
        own = (x == y) & ~points if mirrored else np.zeros(len(x), bool)
        for k, w in zip(x[own].tolist(), whole[own].tolist()):
            if w:
                a.counts[k] += a.size[k] - 1
                a.tied[k] = True
            elif a.inner[k]:
                stack.append((a.below(k), a.below(k), True))
            else:
                self.exact(a.members[k], a.members[k], True)
        linked = whole & ~points & ~own
        self.link_all(x[linked], y[linked])
        rest = ~whole & ~points & ~own
        return x[rest], y[rest]

    def open(self, pairs: list[tuple[np.ndarray, np.ndarray]], stack: list) -> None:
        """The wider node of each pair is opened, once for all nodes that it is open to; leaves are compared point by point."""
        if not pairs:
            return
        a, b = self.a, self.b
        x, y = (np.concatenate(side) for side in zip(*pairs))
        wider = a.inner[x] & (~b.inner[y] | (a.radius[x] >= b.radius[y]))
        for k, others in groups(x[wider], y[wider]):
            stack.append((a.below(k), others, False))
        narrower = b.inner[y] & ~wider
        for k, others in groups(y[narrower], x[narrower]):
            stack.append((others, b.below(k), False))
        leaves = ~wider & ~narrower
        for k, others in groups(x[leaves], y[leaves]):
            self.exact(a.members[k], np.concatenate([b.members[q] for q in others.tolist()]), False)

    def link_all(self, x: np.ndarray, y: np.ndarray) -> None:
        """Every point under x with every point under y, pair by pair of nodes."""
        a, b = self.a, self.b
        np.add.at(a.counts, x, b.size[y])
        np.add.at(b.counts, y, a.size[x])
        a.tied[x] = b.tied[y] = True
        self.add(np.array([m[0] for m in map(a.members.__getitem__, x.tolist())], np.int64), self.shift(np.array([m[0] for m in map(b.members.__getitem__, y.tolist())], np.int64)))

    def points(self, x: np.ndarray, y: np.ndarray, whole: np.ndarray) -> None:
        """Pairs of single points, of which ``whole`` ones are linked for certain; a point does not meet itself."""
        linked = whole.copy()
        open_ = np.flatnonzero(~whole)
        linked[open_] = products(self.left, x[open_], self.right, y[open_]) >= self.cosine
        if self.same:
            linked &= x != y
        x, y = x[linked], y[linked]
        self.left_counts += np.bincount(x, minlength=len(self.left))
        self.right_counts += np.bincount(y, minlength=len(self.right))
        self.add(x, self.shift(y))

    def exact(self, x: np.ndarray, y: np.ndarray, self_pair: bool) -> None:
        """Points of leaves: one each, or nearer to each other than the smallest radius."""
        wide = min(len(y), 4096)
        step = max(1, PAIR_CHUNK // wide)
        for s in range(0, len(x), step):
            for t in range(0, len(y), wide):
                i, j = np.nonzero(cosines(self.left[x[s : s + step]], self.right[y[t : t + wide]]) >= self.cosine)
                i, j = i + s, j + t
                if self_pair:
                    i, j = i[i < j], j[i < j]
                np.add.at(self.left_counts, x[i], 1)
                np.add.at(self.right_counts, y[j], 1)
                self.add(x[i], self.shift(y[j]))

    def shift(self, members):
        return members if self.same else members + len(self.left)

    def add(self, u, v) -> None:
        self.u.append(np.asarray(u, np.int64))
        self.v.append(np.asarray(v, np.int64))
        self.pending += len(self.u[-1])
        if self.pending > PENDING_LINKS:  # a forest has fewer links than points
            nodes, roots = forest(np.concatenate(self.u), np.concatenate(self.v))
            self.u, self.v, self.pending = [nodes], [roots], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of links over left and then right points, and a forest (node, root)."""
        counts = self.left_counts + self.right_counts if self.same else np.concatenate([self.left_counts, self.right_counts])
        if not self.u:
            return counts, np.empty(0, np.int64), np.empty(0, np.int64)
        return counts, *forest(np.concatenate(self.u), np.concatenate(self.v))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each value from its two rows alone, whatever stands beside them."""
    step = max(1, PAIR_CHUNK // max(a.size, 1))
    return np.concatenate([(a[:, None, :] * b[None, s : s + step, :]).sum(axis=2) for s in range(0, len(b), step)], axis=1)


def products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same for rows i of a with rows j of b, one by one."""
    step = max(1, PAIR_CHUNK // a.shape[1])
    return np.concatenate([np.empty(0), *((a[i[s : s + step]] * b[j[s : s + step]]).sum(axis=1) for s in range(0, len(i), step))])


def groups(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each key with its values."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    names, first = np.unique(keys[order], return_index=True)
    return list(zip(names.tolist(), np.split(values[order], first[1:])))


def links(left: np.ndarray, right: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    same = right is None
    walk = Traversal(left, left if same else right, cosine, same)
    a = cover_tree(left)
    walk.run(a, a if same else cover_tree(right))
    return walk.result()


# ---------------------------------------------------------------- on Spark


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy().astype(np.float64, copy=False).reshape(len(vectors), -1)
    scaled = flat / np.abs(flat).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def top_centres(points: np.ndarray, wanted: int) -> np.ndarray:
    """Centres of the first level of a cover tree with that many nodes, or of its last; LABEL_CELLS at most."""
    level, radius = [Node(0, 2.0, np.arange(len(points)))], 2.0
    for _ in range(LEVELS):
        if len(level) >= wanted:
            break
        radius /= 2
        level = [c for node in level for c in split(points, node, radius)]
    return points[[n.centre for n in level][:LABEL_CELLS]]


def block_limit(dim, block_rows: int):
    """Rows of a block: ``block_rows``, fewer of vectors with more than 64 components."""
    return max(1, block_rows * 64 // max(dim, 64))


def merged_cells(sizes: np.ndarray, radius: np.ndarray, apart: np.ndarray, chord: float, block_rows: int) -> np.ndarray:
    """The cell that every cell becomes part of: those within half a chord of a centre, if they hold a quarter block or more."""
    near = apart + radius[None, :] <= chord / 2 - SLACK
    into, open_ = np.arange(len(sizes)), np.ones(len(sizes), bool)
    for centre in np.argsort(-(near @ sizes), kind="stable").tolist():
        own = near[centre] & open_
        if own[centre] and 4 * sizes[own].sum() >= block_rows:
            into[own], open_[own] = centre, False
    return into


def units_of(sizes: np.ndarray, apart: np.ndarray, block_rows: int) -> np.ndarray:
    """The unit of every cell: a cell of a quarter block or more alone, others with their nearest up to a block."""
    unit = np.full(len(sizes), -1)
    alone = np.flatnonzero(4 * sizes >= block_rows)
    unit[alone] = np.arange(len(alone))
    count = len(alone)
    for first in range(len(sizes)):
        if unit[first] >= 0:
            continue
        rest = np.flatnonzero(unit < 0)
        rest = rest[np.argsort(apart[first, rest], kind="stable")]
        unit[rest[: max(1, int(np.searchsorted(np.cumsum(sizes[rest]), block_rows, side="right")))]] = count
        unit[first] = count
        count += 1
    return unit


def dealt_in_cells(rows: DataFrame, cosine: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """rows (label, dim, rows, vec_id, embedding) -> one row per pair of blocks that a vector takes part in, and links found already."""
    spark = rows.sparkSession
    label_type, vector_type = (rows.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    schema = f"label {label_type}, dim int, first long, second long, block long, vec_id long, embedding {vector_type}"
    sample = hashed_sample(rows, rows.count(), CELL_SAMPLE, CELL_SAMPLE, "vec_id").select("label", "dim", "rows", "embedding").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema), spark.createDataFrame([], LINK_SCHEMA)
    own: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(sample["label"].to_pylist(), sample["dim"].to_pylist())):
        own.setdefault(key, []).append(k)
    centres = {key: top_centres(unit_rows(sample["embedding"].combine_chunks().take(pa.array(at))), 4 * -(-sample["rows"][at[0]].as_py() // block_limit(key[1], block_rows))) for key, at in own.items()}
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            cell, apart = np.zeros(len(keys), np.int64), np.full(len(keys), 2.0)
            places: dict[tuple, list[int]] = {}
            for k, key in enumerate(keys):
                places.setdefault(key, []).append(k)
            for key, at in places.items():
                if key in shared.value:  # a label that the sample has missed is one cell
                    cell[at], apart[at] = nearest_of(unit_rows(batch.column(3).take(pa.array(at))), shared.value[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(apart)], [*batch.schema.names, "cell", "apart"])

    celled = save(rows.select("label", "dim", "vec_id", "embedding").mapInArrow(assign, f"label {label_type}, dim int, vec_id long, embedding {vector_type}, cell long, apart double"), "cells")
    sizes: dict[tuple, np.ndarray] = {}
    radii: dict[tuple, np.ndarray] = {}
    least: dict[tuple, np.ndarray] = {}
    for r in celled.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius"), F.min("vec_id").alias("least")).collect():  # LABEL_CELLS rows a large label
        key = (r["label"], r["dim"])
        count = len(centres[key]) if key in centres else 1
        for table, value in ((sizes, r["n"]), (radii, r["radius"]), (least, r["least"])):
            table.setdefault(key, np.zeros(count, np.float64 if table is radii else np.int64))[r["cell"]] = value
    chord = np.sqrt(2 - 2 * cosine)
    merged: dict[tuple, np.ndarray] = {}  # the cell that every cell becomes part of
    units: dict[tuple, np.ndarray] = {}  # the unit of every cell
    salts: dict[tuple, np.ndarray] = {}  # the blocks of every unit
    meets: dict[tuple, np.ndarray] = {}  # cells by units
    added: dict[tuple, np.ndarray] = {}
    joined: dict[tuple, np.ndarray] = {}
    bridges: list[tuple[int, int, int]] = []
    for key, radius in radii.items():
        limit = block_limit(key[1], block_rows)
        apart = distances(centres[key], centres[key]) if key in centres else np.zeros((1, 1))
        np.fill_diagonal(apart, 0)
        into = merged[key] = merged_cells(sizes[key], radius, apart, chord, limit)
        radius = np.array([(apart[c, into == c] + radius[into == c]).max(initial=0) for c in range(len(radius))])
        least[key] = np.array([least[key][(into == c) & (sizes[key] > 0)].min(initial=np.iinfo(np.int64).max) for c in range(len(radius))])
        sizes[key] = np.bincount(into, sizes[key], len(radius)).astype(np.int64)
        reach = radius[:, None] + radius[None, :]
        there, alone = sizes[key] > 0, 4 * sizes[key] >= limit
        linked = (apart + reach <= chord - SLACK) & (there & alone)[:, None] & (there & alone)[None, :]
        met = (apart - reach <= chord + SLACK) & ~linked & there[:, None] & there[None, :]
        unit = units[key] = units_of(sizes[key], apart, limit)
        members = unit[:, None] == np.arange(unit.max() + 1)[None, :]
        salts[key] = -(-(sizes[key] @ members) // limit)
        meets[key] = met.astype(np.float32) @ members.astype(np.float32) > 0
        added[key] = linked @ sizes[key] - linked.diagonal()
        joined[key] = np.where(linked.any(axis=1), least[key][linked.argmax(axis=1)], -1)
        nodes, roots = forest(*np.nonzero(linked))
        bridges += [(a, 0, b) for a, b in zip(least[key][nodes].tolist(), least[key][roots].tolist())]
    layout = spark.sparkContext.broadcast((merged, units, salts, meets))

    def deal(batches):
        merged, units, salts, meets = layout.value
        for batch in batches:
            rows, first, second, block = [], [], [], []

            def dealt():
                taken = batch.take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *(pa.array(x, pa.int64()) for x in (first, second, block)), taken.column(2), taken.column(3)], ["label", "dim", "first", "second", "block", "vec_id", "embedding"])

            for k, (label, dim, vec_id, cell) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)))):
                cell = merged[label, dim][cell]
                unit, n = units[label, dim][cell], salts[label, dim]
                mine = (int(unit) << 24) + ((vec_id * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33) % int(n[unit])
                for other_unit in np.flatnonzero(meets[label, dim][cell]).tolist():
                    for salt in range(n[other_unit]):
                        other = (other_unit << 24) + salt
                        rows.append(k)
                        first.append(min(mine, other))
                        second.append(max(mine, other))
                        block.append(mine)
                        if len(rows) == DEAL_ROWS:
                            yield dealt()
                            rows, first, second, block = [], [], [], []
            yield dealt()

    whole = spark.sparkContext.broadcast({key: (added[key][into], joined[key][into]) for key, into in merged.items()})

    def link(batches):
        for batch in batches:
            at = []
            for k, (label, dim, cell) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)))):
                added, joined = whole.value[label, dim]
                if added[cell]:
                    at.append((k, added[cell], joined[cell]))
            names = batch.column(3).take(pa.array([k for k, _, _ in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([names, pa.array([n for _, n, _ in at], pa.int64()), pa.array([r for _, _, r in at], pa.int64())], ["vec_id", "n", "root"])

    found = celled.select("label", "dim", "cell", "vec_id").mapInArrow(link, LINK_SCHEMA)
    return celled.mapInArrow(deal, schema), found.unionByName(spark.createDataFrame(sorted(set(bridges)), LINK_SCHEMA))


def threshold_links(vectors: DataFrame, cosine: float = 0.93, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors (vec_id, embedding, label) -> (vec_id, n_links, component_id, kept)."""
    vector_type = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"  # floats travel as they are
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(vector_type).alias("embedding"), F.col("label"))
    able = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))
    sized = able.join(able.groupBy("label", "dim").agg(F.count("*").alias("rows")), ["label", "dim"])
    whole = F.lit(0).cast("long")
    limit = F.greatest(F.lit(1), F.floor(F.lit(64 * block_rows) / F.greatest("dim", F.lit(64))))
    small = sized.where(F.col("rows") <= limit).select("label", "dim", whole.alias("first"), whole.alias("second"), whole.alias("block"), "vec_id", "embedding")
    large, found_whole = dealt_in_cells(sized.where(F.col("rows") > limit), cosine, block_rows)
    dealt = small.unionByName(large)

    def compare(key, batch):
        batch = batch.sort_by("vec_id")
        ids, block = batch.column("vec_id").to_numpy(), batch.column("block").to_numpy()
        points = unit_rows(batch.column("embedding").combine_chunks())
        first, second = (k.as_py() for k in key[2:4])
        if first == second:
            counts, nodes, roots = links(points, None, cosine)
            names = ids
        else:
            a, b = block == first, block == second
            names = np.concatenate([ids[a], ids[b]])
            if a.any() and b.any():
                counts, nodes, roots = links(points[a], points[b], cosine)
            else:
                counts, nodes, roots = np.zeros(len(ids), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        root = np.arange(len(names))
        root[nodes] = roots
        hit = counts > 0
        return pa.table({"vec_id": pa.array(names[hit]), "n": pa.array(counts[hit]), "root": pa.array(names[root[hit]])})

    pair = ["label", "dim", "first", "second"]
    compared = dealt.repartition(shuffle_width(vectors.sparkSession), *pair).groupBy(*pair).applyInArrow(compare, LINK_SCHEMA)  # few bytes, much work: tasks are not put together
    found = save(compared.unionByName(found_whole), "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    return (
        rows.select("vec_id").join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, l.w FROM reach r JOIN links l ON l.u = r.other),
component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component USING (vec_id) LEFT JOIN counted ON counted.u = e.vec_id
"""
