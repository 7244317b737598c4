"""Nearest objects inside one block, by bounds: the objects in the order of a kd-tree, cut into leaves, and groups of near targets that look only through leaves that can hold a neighbour. Exact.

No object of a leaf comes nearer to a target of a group than the gap between their bounds, of which each band counts by the greatest errors on either side. A group looks
through the leaves around it first, which bounds its k-th neighbours, and then through all leaves whose gap is no wider.
"""

from __future__ import annotations

import numpy as np

#: Objects in a leaf, and the most targets in a group.
LEAF, GROUP = 64, 64
#: Leaves in a run, whose bounds are looked at first.
RUN = 32


def distances(t: np.ndarray, r: np.ndarray, metric: str, scale: np.ndarray | None = None) -> np.ndarray:
    """t[targets, bands, 2], r[objects, bands, 2]: [targets, objects], bands added one by one."""
    out = np.zeros((len(t), len(r)))
    d, v = np.empty_like(out), np.empty_like(out)
    for b in range(t.shape[1]):
        f, e = r[None, :, b, 0], r[None, :, b, 1]
        if scale is not None:
            f, e = scale * f, scale * e
        np.subtract(f, t[:, None, b, 0], out=d)
        np.multiply(d, d, out=d)
        if metric == "chi2":
            np.add(e * e, t[:, None, b, 1] ** 2, out=v)
            if v.min(initial=1.0) > 0:
                np.divide(d, v, out=d)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.where(v == 0, np.where(d == 0, 0.0, np.inf), d / v)
        out += d
    return np.sqrt(out) if metric == "euclidean" else out


def best(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """[targets, min(k, objects)]: places of the k least, ties by id, in order."""
    k = min(k, d.shape[1])
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(d, near, axis=1)
    out = np.take_along_axis(near, np.lexsort((ids[near], value), axis=1), axis=1)
    last = value.max(axis=1, keepdims=True)
    for i in np.flatnonzero((d <= last).sum(axis=1) > k):  # more than k are as near as the last: the smaller ids go first
        at = np.flatnonzero(d[i] <= last[i])
        out[i] = at[np.lexsort((ids[at], d[i, at]))[:k]]
    return out


def cut(x: np.ndarray, e: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of x[objects, bands] and where its parts begin (with the end): halves by the band that spreads most in units of its errors e, down to at most `most` objects. Without errors the order is taken as it is."""
    order, todo, ends = np.arange(len(x)), [(0, len(x))], []
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            ends.append(b)
            continue
        half = (b - a) // 2
        if e is not None:
            part = order[a:b]
            own = x[part]
            spread = (own.max(axis=0) - own.min(axis=0)) / e[part].mean(axis=0)
            order[a:b] = part[np.argpartition(own[:, int(np.argmax(spread))], half)]
        todo += [(a + half, b), (a, a + half)]  # the left half is next
    return order, np.array([0, *ends])


def bounds(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part of values[objects, bands, 2]: least and greatest fluxes, greatest errors."""
    f, e = values[..., 0], np.abs(values[..., 1])
    return np.minimum.reduceat(f, starts[:-1]), np.maximum.reduceat(f, starts[:-1]), np.maximum.reduceat(e, starts[:-1])


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each first on."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Leaves:
    def __init__(self, values: np.ndarray, ids: np.ndarray, metric: str, leaf: int = LEAF, ordered: bool = False):
        """ordered: they stand as another's values and ids with this metric, so that nothing is sorted."""
        self.metric = metric
        if ordered:
            _, self.starts = cut(values[..., 0], None, leaf)
            self.order, self.values, self.ids = np.arange(len(ids)), values, ids
        else:
            self.order, self.starts = cut(values[..., 0], self.unit(values), leaf)
            self.values, self.ids = values[self.order], ids[self.order]
        self.low, self.high, self.error = bounds(self.values, self.starts)
        self.size = np.diff(self.starts)
        self.runs = np.append(np.arange(0, len(self.size), RUN), len(self.size))  # of leaves that follow each other, so that they lie near each other
        self.run_low, self.run_high, self.run_error = np.minimum.reduceat(self.low, self.runs[:-1]), np.maximum.reduceat(self.high, self.runs[:-1]), np.maximum.reduceat(self.error, self.runs[:-1])

    @staticmethod
    def fit_for(values: np.ndarray) -> bool:
        """Whether bounds say anything: fluxes must be finite, and errors be numbers."""
        return len(values) > 0 and bool(np.isfinite(values[..., 0]).all() and not np.isnan(values[..., 1]).any())

    def unit(self, values: np.ndarray) -> np.ndarray:
        if self.metric == "euclidean":
            return np.ones(values.shape[:2])
        return np.where(np.isfinite(values[..., 1]), np.abs(values[..., 1]), 1e300) + 1e-300

    def gap(self, low: np.ndarray, high: np.ndarray, error: np.ndarray, t_low: np.ndarray, t_high: np.ndarray, t_error: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance (squared, if Euclidean) between what lies within bounds."""
        d = np.maximum(np.maximum(low - t_high, t_low - high), 0)
        d *= d
        if self.metric == "chi2":
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(d > 0, d / (error * error + t_error * t_error), 0.0)
        return d.sum(axis=-1)

    def near(self, reach: float, group: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Leaves no farther than that from a group's bounds."""
        runs = np.flatnonzero(self.gap(self.run_low, self.run_high, self.run_error, *group) <= reach)
        leaves = spans(self.runs[runs], np.diff(self.runs)[runs])
        return leaves[self.gap(self.low[leaves], self.high[leaves], self.error[leaves], *group) <= reach]

    def around(self, k: int, group: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Some near leaves with k objects or more in all, of the run whose middle is nearest, or of several."""
        middle = (self.run_low + self.run_high) / 2
        runs = np.argsort(self.gap(middle, middle, self.run_error, *group), kind="stable")
        held = np.cumsum(np.add.reduceat(self.size, self.runs[:-1])[runs])
        runs = runs[: max(2, 1 + int(np.searchsorted(held, k)))]
        leaves = spans(self.runs[runs], np.diff(self.runs)[runs])
        middle = (self.low[leaves] + self.high[leaves]) / 2
        leaves = leaves[np.argsort(self.gap(middle, middle, self.error[leaves], *group), kind="stable")]
        return leaves[: max(2 + 2 * k // LEAF, 1 + int(np.searchsorted(np.cumsum(self.size[leaves]), k)))]

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        """Places of the objects of leaves."""
        return spans(self.starts[leaves], self.size[leaves])

    def look(self, t: np.ndarray, k: int, last: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """A group's targets t[targets, bands, 2]: places and distances [targets, k] of their nearest, in order. last: no places, and the k-th distances alone, so that ties cost nothing."""
        group = t[..., 0].min(axis=0), t[..., 0].max(axis=0), np.abs(t[..., 1]).max(axis=0)
        d = distances(t, self.values[self.rows(self.around(k, group))], self.metric)
        reach = np.partition(d, k - 1, axis=1)[:, k - 1].max()
        reach = (reach * reach if self.metric == "euclidean" else reach) * (1 + 1e-9) + 1e-300  # roundings lose no tie
        if last and reach <= 1e-300:
            return None, np.zeros((len(t), 1))
        if np.isnan(reach):
            reach = np.inf
        at = self.rows(self.near(reach, group))
        own = self.values[at]
        at = at[self.gap(own[..., 0], own[..., 0], own[..., 1], *group) <= reach]
        d = distances(t, self.values[at], self.metric)
        if last:
            return None, np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        found = best(d, self.ids[at], k)
        return at[found], np.take_along_axis(d, found, axis=1)

    def kth(self, t: np.ndarray, k: int) -> np.ndarray:
        """The distance of the k-th nearest of t[targets, bands, 2]."""
        out = np.empty(len(t))
        for at in self.groups(t):
            out[at] = self.look(t[at], k, True)[1][:, 0]
        return out

    def groups(self, t: np.ndarray) -> list[np.ndarray]:
        """Places of targets that lie near each other."""
        inside = ((self.low <= t[..., 0].max(axis=0)) & (self.high >= t[..., 0].min(axis=0))).all(axis=1) @ self.size if len(t) else 0
        order, starts = cut(t[..., 0], self.unit(t), int(np.clip(LEAF * len(t) // max(1, inside), 4, GROUP)))  # a group about as wide as a leaf
        return [order[a:b] for a, b in zip(starts, starts[1:]) if b > a]

    def nearest(self, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """t[targets, bands, 2]: places in the block (as given) and distances [targets, min(k, objects)]."""
        k = min(k, len(self.ids))
        at, d = np.empty((len(t), k), np.int64), np.empty((len(t), k))
        for of in self.groups(t):
            at[of], d[of] = self.look(t[of], k)
        return self.order[at], d
