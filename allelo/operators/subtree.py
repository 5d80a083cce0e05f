"""Small subtrees of a forest, grown and walked whole by one task each.

Deep in a tree a node holds few samples, and a scan of all cells for each of the
many last levels would cost far more than the work.  Nodes whose samples hold at
most a bounded number of cells are therefore finished here: a grouped operation
brings the cells of one such node together, and its whole subtree is grown by
the same rules as the levels above, in arrays, all open nodes of a level at once.
A group is bounded by that number of cells.

Variants that few samples carry make trees as deep as a chain: each split takes a few
samples off a large node.  A large node therefore keeps the class counts of its (variable,
value) pairs; where it splits, the smaller child's are counted from its cells and taken off
the larger one's.  Many pairs split off the same class counts, so candidates are scored once
for each distinct right side (``Counts``).  A level thus costs the cells that move and the
distinct right sides, not the cells that stay.  Pure nodes are leaves and are not searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from allelo.functions.hashing import below, mixed_array

#: what a grown node says of itself; ``parent`` and ``side`` link it to the level above
NODE_FIELDS = ("depth", "node", "parent", "side", "variable", "threshold", "majority", "gain", "impurity", "size")


#: cells from which on a node keeps its counts
LARGE = 20_000


@dataclass(frozen=True)
class Rules:
    """What the levels above and the subtrees share."""

    n_labels: int
    fraction: float
    seed: int
    kind: str
    min_gain: float
    max_depth: int | None

    def level_seed(self, depth: int) -> int:
        return self.seed + 7919 * (depth + 1)


def impurity(counts: np.ndarray, kind: str) -> np.ndarray:
    """Impurity of each row of class counts; 0 for an empty one."""
    n = across(counts).astype(float)
    safe = np.maximum(n, 1.0)
    total = np.zeros(len(counts))
    for c in counts.astype(float).T:
        total = total + (c * c if kind == "gini" else c * np.log2(np.where(c > 0, c, 1.0)))
    value = 1.0 - total / (safe * safe) if kind == "gini" else np.log2(safe) - total / safe
    return np.where(n > 0, value, 0.0)


def sums(group: np.ndarray, label: np.ndarray, weight: np.ndarray, n: int, n_labels: int) -> np.ndarray:
    """Weight of each label in each of ``n`` groups."""
    flat = np.bincount(group * n_labels + label, weights=weight, minlength=n * n_labels)  # exact below 2**53
    return flat.astype(np.int64).reshape(n, n_labels)


def first_of(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted sequence starts a new combination of keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def best_splits(node: np.ndarray, pair: np.ndarray, label: np.ndarray, weight: np.ndarray, pair_variable: np.ndarray,
                pair_allele: np.ndarray, totals: np.ndarray, kind: str) -> tuple[np.ndarray, ...]:
    """Per node with a candidate: node, variable, threshold, weighted impurity; cells sorted by node and pair.

    A pair's candidate sends its value and those above it to the right; the threshold is the
    next smaller value, or zero.  Ties go to the smallest variable, then threshold.
    """
    at = first_of(node, pair)
    counts = sums(np.cumsum(at) - 1, label, weight, int(at.sum()), totals.shape[1])
    node, pair = node[at], pair[at]
    variable = pair_variable[pair]
    run = first_of(node, variable)
    right = suffix_sums(counts, run)
    threshold = np.where(run, 0.0, np.r_[0.0, pair_allele[pair][:-1]])
    useful = np.flatnonzero((across(right) > 0) & (across(totals)[node] > across(right)))
    node, variable, threshold, right = node[useful], variable[useful], threshold[useful], right[useful]
    weighted = split_impurity(right, totals[node], kind)
    score = rounded(weighted)
    starts = np.flatnonzero(first_of(node)) if len(node) else np.zeros(0, dtype=np.int64)
    least = np.minimum.reduceat(score, starts) if len(node) else score
    tied = np.flatnonzero(score == np.repeat(least, np.diff(np.r_[starts, len(node)])))
    best = tied[first_of(node[tied])] if len(tied) else tied
    return node[best], variable[best], threshold[best], weighted[best]


def across(counts: np.ndarray) -> np.ndarray:
    """Row sums; numpy's own are slow on a few columns."""
    total = counts[:, 0].copy()
    for c in counts.T[1:]:
        total += c
    return total


def rounded(weighted: np.ndarray) -> np.ndarray:
    return np.rint(weighted * 1e12).astype(np.int64)


def suffix_sums(counts: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Each row plus those after it up to the next start of a run."""
    if run.all():
        return counts
    running = np.cumsum(counts, axis=0)
    ends = np.r_[np.flatnonzero(run)[1:], len(run)] - 1
    return running[ends][np.cumsum(run) - 1] - running + counts


def split_impurity(right: np.ndarray, totals: np.ndarray, kind: str) -> np.ndarray:
    """Weighted impurity of splits from the class counts of the right side and of the node."""
    left = totals - right
    n_left, n_right = across(left), across(right)
    return (impurity(left, kind) * n_left + impurity(right, kind) * n_right) / (n_left + n_right)


class Counts:
    """The class counts of a large node's (variable, value) pairs, and the distinct right sides of their candidates.

    A pair's candidate is as in ``best_splits``; pairs that no sample of the node carries drop out in
    time.  ``side`` is the row of a candidate's right side in ``right``; ``members`` counts a
    row's candidates.  Rows are shared by equal right sides whose counts fit one number (``keys``,
    sorted); larger ones have a row of their own.
    """

    def __init__(self, pair: np.ndarray, label: np.ndarray, weight: np.ndarray, n_labels: int,
                 pair_variable: np.ndarray | None = None):
        self.pair, group = np.unique(pair, return_inverse=True)
        self.counts = sums(group, label, weight, len(self.pair), n_labels)
        self.variable = pair_variable
        self.side = None  # right sides are made when the first split is searched
        self._drop_empty()

    def _drop_empty(self) -> None:
        left = across(self.counts) > 0
        self.pair, self.counts, self.empty = self.pair[left], self.counts[left], 0
        if self.side is not None:  # candidates of empty pairs equal their successors'
            self.members -= np.bincount(self.side[~left], minlength=len(self.members))
            self.side = self.side[left]
            self._runs()

    def _runs(self) -> None:
        variable = self.variable[self.pair]
        self.run = first_of(variable) if len(variable) else np.zeros(0, dtype=bool)
        self.starts = np.r_[np.flatnonzero(self.run), len(self.run)]
        self.lengths = np.diff(self.starts)
        self.run_of = np.cumsum(self.run) - 1

    def _make_sides(self) -> None:
        self._runs()
        n_labels = self.counts.shape[1]
        self.radix = int(2 ** (62 / n_labels))  # counts below it make one number
        self.powers = np.array([self.radix ** k for k in range(n_labels)], dtype=np.int64)
        self.keys, self.rows = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.right = np.zeros((0, n_labels))  # whole numbers
        self.members, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.squares = np.zeros((2, 0))
        self.side = self._sides_of(suffix_sums(self.counts, self.run)).astype(np.int32)
        self.members += np.bincount(self.side, minlength=len(self.members))

    def _sides_of(self, right: np.ndarray) -> np.ndarray:
        """Rows of ``right`` for class counts, new ones where there are none yet."""
        out = np.empty(len(right), dtype=np.int64)
        fits = (right < self.radix).all(axis=1)
        key = right[fits] @ self.powers
        new, first = np.unique(key, return_index=True)
        place = np.searchsorted(self.keys, new)
        known = np.zeros(len(new), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == new[inside]
        fresh, own = first[~known], np.flatnonzero(~fits)
        at = len(self.right)
        self.keys = np.insert(self.keys, place[~known], new[~known])
        self.rows = np.insert(self.rows, place[~known], at + np.arange(len(fresh)))
        out[own] = at + len(fresh) + np.arange(len(own))
        added = np.concatenate([right[fits][fresh], right[own]])
        size, square = across(added), across(added.astype(float) ** 2)
        self.right = np.concatenate([self.right, added])
        self.size = np.concatenate([self.size, size])
        self.squares = np.concatenate([self.squares, [square, square / np.maximum(size, 1)]], axis=1)
        self.members = np.concatenate([self.members, np.zeros(len(added), dtype=np.int64)])
        out[fits] = self.rows[np.searchsorted(self.keys, key)]
        return out

    def take_off(self, other: Counts) -> None:
        place = np.searchsorted(self.pair, other.pair)
        self.counts[place] -= other.counts
        self.empty += int((across(self.counts[place]) == 0).sum())
        if self.side is not None and len(place):
            self._renew(place)
        if self.empty > len(self.pair) / 8:  # empty pairs split nothing off: they may stay for a while
            self._drop_empty()

    def _renew(self, place: np.ndarray) -> None:
        """New right sides for the variables of some pairs."""
        runs = self.run_of[place]
        runs = runs[first_of(runs)]
        begin, n = self.starts[runs], self.lengths[runs]
        ends = np.cumsum(n)
        at = np.repeat(begin - ends + n, n) + np.arange(ends[-1])
        right = suffix_sums(self.counts[at], self.run[at])
        changed = (right != self.right[self.side[at]]).any(axis=1)
        at, right = at[changed], right[changed]
        old, self.side[at] = self.side[at], self._sides_of(right)
        self.members += np.bincount(self.side[at], minlength=len(self.members)) - np.bincount(old, minlength=len(self.members))
        alive = np.flatnonzero(self.members)
        if len(self.members) > 2 * len(alive) + 10_000:
            number = np.full(len(self.members), -1, dtype=np.int64)
            number[alive] = np.arange(len(alive))
            self.side, self.rows = number.astype(np.int32)[self.side], number[self.rows]
            self.keys, self.rows = self.keys[self.rows >= 0], self.rows[self.rows >= 0]
            self.right, self.members, self.size = self.right[alive], self.members[alive], self.size[alive]
            self.squares = self.squares[:, alive]

    def best(self, pair_allele: np.ndarray, totals: np.ndarray, impure: float, rules: Rules, depth: int, tree: int,
             name: int) -> tuple[int, float, float] | None:
        """Variable, threshold and weighted impurity of the best split, None if none gains."""
        if self.side is None:
            self._make_sides()
        n = int(totals.sum())
        useful = (self.members > 0) & (self.size > 0) & (self.size < n)
        n_useful = int(useful.sum())
        if rules.kind == "gini":  # n times the weighted impurity, up to rounding
            t = totals.astype(float)
            apart = t @ t - 2.0 * (self.right @ t) + self.squares[0]
            rough = n - self.squares[1] - apart / np.where(useful, n - self.size, 1)
            rough[~useful] = np.inf
        else:
            rough = np.full(len(useful), np.inf)
            rough[useful] = n * split_impurity(self.right[useful], totals[None], rules.kind)
        most = 1 if rules.fraction >= 1 else 64
        while n_useful:
            # the best rows and all that may tie with them
            every = most >= n_useful
            bound = np.inf if every else np.partition(rough, most - 1)[most - 1]
            here = np.flatnonzero(useful & (rough <= bound + 1e-11 * n))
            weighted = split_impurity(self.right[here], totals[None], rules.kind)
            score = rounded(weighted)
            if not every:
                whole = score <= score[rough[here] <= bound].max()
                here, weighted, score = here[whole], weighted[whole], score[whole]
            gains = impure - weighted > rules.min_gain
            asked = np.zeros(len(useful), dtype=bool)
            asked[here] = True
            found = np.flatnonzero(asked[self.side])
            if rules.fraction < 1:
                found = found[mixed_array(rules.level_seed(depth), tree, name, self.variable[self.pair[found]]) < below(rules.fraction)]
            if len(found):
                of = np.searchsorted(here, self.side[found])
                k = int(np.argmin(score[of]))  # the first of the least: pairs are sorted by variable and value
                at, of = int(found[k]), int(of[k])
                cut = 0.0 if self.run[at] else float(pair_allele[self.pair[at - 1]])
                return int(self.variable[self.pair[at]]), cut, float(weighted[of])
            if every or not gains.any():
                return None
            most *= 8
        return None


def grow(rules: Rules, tree: int, depth: int, parent: int, side: int, samples: np.ndarray, weights: np.ndarray,
         labels: np.ndarray, cell_sample: np.ndarray, variable: np.ndarray, allele: np.ndarray) -> Iterator[dict]:
    """Columns of the nodes of one subtree, level by level.

    ``samples`` are distinct and ascending; ``cell_sample`` holds positions in them.
    """
    every = _Cells(cell_sample, variable, allele, len(samples))
    del cell_sample, variable, allele
    kept: dict[int, Counts] = {}   # of the large open nodes; the cells of the others are at ``loose``
    loose = np.arange(len(every.pair))
    if len(loose) >= LARGE:
        kept[0] = Counts(every.pair, labels[every.sample], weights[every.sample], rules.n_labels, every.pair_variable)
        loose = loose[:0]
    at = np.zeros(len(samples), dtype=np.int64)      # the open node of every sample, -1 once it is in a leaf
    names, parents, sides = samples[:1], np.array([parent]), np.array([side])
    while len(names):
        here = at >= 0
        totals = sums(at[here], labels[here], weights[here], len(names), rules.n_labels)
        impure = impurity(totals, rules.kind)
        majority = rules.n_labels - 1 - totals[:, ::-1].argmax(axis=1)  # ties go to the largest label
        chosen, cut = np.full(len(names), -1, dtype=np.int64), np.zeros(len(names))
        gain = np.zeros(len(names))
        open_ = impure > 0 if depth != rules.max_depth else np.zeros(len(names), dtype=bool)
        loose = loose[np.append(open_, False)[at[every.sample[loose]]]]  # what no split can take apart needs no search
        if len(loose):
            node, pair = at[every.sample[loose]], every.pair[loose]
            tried = np.arange(len(loose)) if rules.fraction >= 1 else np.flatnonzero(
                mixed_array(rules.level_seed(depth), tree, names[node], every.pair_variable[pair]) < below(rules.fraction))
            key = node[tried].astype(np.uint16) if len(names) < 1 << 16 else node[tried]
            by_node = tried[np.argsort(key, kind="stable")]
            if len(by_node):
                s = every.sample[loose[by_node]]
                n, v, t, weighted = best_splits(node[by_node], pair[by_node], labels[s], weights[s], every.pair_variable,
                                                every.pair_allele, totals, rules.kind)
                won = impure[n] - weighted
                n, v, t, won = (a[won > rules.min_gain] for a in (n, v, t, won))
                chosen[n], cut[n], gain[n] = v, t, won
        for j, counts in kept.items():
            best = counts.best(every.pair_allele, totals[j], impure[j], rules, depth, tree, int(names[j])) if open_[j] else None
            if best is not None and impure[j] - best[2] > rules.min_gain:
                chosen[j], cut[j], gain[j] = best[0], best[1], impure[j] - best[2]
        yield dict(zip(NODE_FIELDS, (np.full(len(names), depth), names, parents, sides, chosen, cut, majority, gain,
                                     impure, totals.sum(axis=1)), strict=True))
        split = np.flatnonzero(np.append(chosen >= 0, False)[at])
        right = np.zeros(len(samples), dtype=np.int64)
        if len(loose):
            variable = every.pair_variable[pair]
            mine = variable == chosen[node]
            right[every.sample[loose[mine]][every.pair_allele[pair[mine]] > cut[node[mine]]]] = 1
        for j in kept:
            if chosen[j] >= 0:
                above = every.carriers(chosen[j], cut[j])
                right[above[at[above] == j]] = 1
        code = 2 * at[split] + right[split]
        first = np.full(2 * len(names), -1, dtype=np.int64)
        first[code[::-1]] = split[::-1]                  # the smallest sample of each child
        child = np.flatnonzero(first >= 0)
        parents, sides = names[child // 2], child % 2
        names = samples[first[child]]
        at = np.full(len(samples), -1, dtype=np.int64)
        at[split] = (np.cumsum(first >= 0) - 1)[code]
        kept, fresh = _children(kept, child, at, every, labels, weights, rules.n_labels)
        if len(fresh):
            loose = np.sort(np.concatenate([loose, fresh]))
        depth += 1


class _Cells:
    """The cells of a subtree, sorted by variable and value, with their place by sample; numbers take 32 bits."""

    def __init__(self, sample: np.ndarray, variable: np.ndarray, allele: np.ndarray, n_samples: int):
        order = np.lexsort((allele, variable))
        variable, allele = variable[order], allele[order]
        new = first_of(variable, allele) if len(variable) else np.zeros(0, dtype=bool)
        small = np.int32 if len(order) < 1 << 31 else np.int64
        self.sample = sample[order].astype(small)
        self.pair = (np.cumsum(new) - 1).astype(small)
        self.pair_variable, self.pair_allele = variable[new], allele[new]
        self.pair_first = np.append(np.flatnonzero(new), len(order))
        del order, variable, allele, new
        self.by_sample = np.argsort(self.sample, kind="stable").astype(small)
        self.sizes = np.bincount(self.sample, minlength=n_samples)
        self.first = np.r_[0, np.cumsum(self.sizes)]

    def of(self, samples: np.ndarray) -> np.ndarray:
        """Positions of the cells of some samples."""
        n = self.sizes[samples]
        ends = np.cumsum(n)
        return self.by_sample[np.repeat(self.first[samples] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def carriers(self, variable: int, cut: float) -> np.ndarray:
        """Samples above a threshold."""
        low, high = np.searchsorted(self.pair_variable, (variable, variable + 1))
        low += np.searchsorted(self.pair_allele[low:high], cut, side="right")
        return self.sample[self.pair_first[low]:self.pair_first[high]]


def _children(kept: dict[int, Counts], child: np.ndarray, at: np.ndarray, cells: _Cells, labels: np.ndarray,
              weights: np.ndarray, n_labels: int) -> tuple[dict[int, Counts], np.ndarray]:
    """What large nodes leave to their children: the counts of large ones, the positions of the others' cells.

    ``child`` is twice the number of the node above plus the side, by new node.
    """
    def counted(positions: np.ndarray) -> Counts:
        s = cells.sample[positions]
        return Counts(cells.pair[positions], labels[s], weights[s], n_labels, cells.pair_variable)

    large: dict[int, Counts] = {}
    loose = [np.empty(0, dtype=np.int64)]
    for j, counts in kept.items():
        parts = [(k, np.flatnonzero(at == k)) for k in np.flatnonzero(child // 2 == j)]
        if not parts:
            continue  # a leaf
        sized = sorted(((int(cells.sizes[s].sum()), k, s) for k, s in parts), key=lambda x: x[0])
        few, first, samples = sized[0]
        positions = cells.of(samples)
        taken = counted(positions)
        most, second, rest = sized[-1]
        if most >= LARGE:
            counts.take_off(taken)
            large[second] = counts
        else:
            loose.append(cells.of(rest))
        if few >= LARGE:
            large[first] = taken
        else:
            loose.append(positions)
    return large, np.concatenate(loose)


def walk(nodes: dict[str, np.ndarray], n_samples: int, cell_sample: np.ndarray, variable: np.ndarray, allele: np.ndarray,
         cuts: tuple[int | None, ...] = (None,)) -> dict[int | None, np.ndarray]:
    """The predictions of ``n_samples`` samples that start at the root of one subtree, for every cut not above the root.

    ``nodes`` has the columns depth, node, parent, side, variable, threshold and majority;
    ``cell_sample`` numbers the samples.  With a cut the predictions are those of the tree cut at this depth.
    A node looks at the carriers of its variable or, where these are fewer, at its own samples.
    """
    order = np.argsort(nodes["depth"], kind="stable")
    depth, node, parent, side, split, cut_at, majority = (nodes[c][order] for c in (
        "depth", "node", "parent", "side", "variable", "threshold", "majority"))
    child = {k: i for i, k in enumerate(zip(depth.tolist(), parent.tolist(), side.tolist(), strict=True))}
    order = np.lexsort((cell_sample, variable))
    cell_sample, variable, allele = cell_sample[order], variable[order], allele[order]
    low, high = np.searchsorted(variable, split), np.searchsorted(variable, split, side="right")
    at = np.zeros(n_samples, dtype=np.int64)   # the group of a sample; its samples stand at the node ``where``
    where, members, group = [0], [np.arange(n_samples)], {0: 0}
    out, levels = {}, set(cuts)
    for i, (d, name, v, t) in enumerate(zip(depth.tolist(), node.tolist(), split.tolist(), cut_at.tolist(), strict=True)):
        if d in levels:
            out[d] = majority[np.array(where)[at]]
            levels.discard(d)
        g = group.pop(i)
        if v < 0:
            continue
        s, a = cell_sample[low[i]:high[i]], allele[low[i]:high[i]]
        if len(members[g]) < len(s):
            m = members[g] = members[g][at[members[g]] == g]
            k = np.minimum(np.searchsorted(s, m), len(s) - 1)
            moved = m[(s[k] == m) & (a[k] > t)]
        else:
            moved = s[a > t]
            moved = moved[at[moved] == g]
        where[g] = child[d + 1, name, 0]
        group[where[g]] = g
        at[moved] = len(where)
        group[child[d + 1, name, 1]] = len(where)
        where.append(child[d + 1, name, 1])
        members.append(moved)
    found = majority[np.array(where)[at]]
    return out | {c: found for c in levels if c is None or c >= depth[0]}
