"""Nearest neighbours on a pixel lattice, without comparing all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FAR = 1 << 30
#: Pairs of open and known cells up to which all are compared at once.
FEW_PAIRS = 1 << 17
#: Pairs that are held at a time.
BLOCK_PAIRS = 1 << 14


def fill_grid(x: np.ndarray, y: np.ndarray, value: np.ndarray) -> np.ndarray:
    """value with each NaN replaced by that of the nearest cell which has one; ties go to the smaller y, then x.

    Exact. Where few pairs are to be compared, all are; else in two passes: along rows each place learns the nearest known cell of its row; then the
    open cells look up and down their columns, step by step, until no row further away can be nearer.
    """
    known = ~np.isnan(value)
    if known.all() or not known.any():
        return value
    if int(known.sum()) * int((~known).sum()) <= FEW_PAIRS:
        at, open_ = np.flatnonzero(known), np.flatnonzero(~known)
        at = at[np.lexsort((x[at], y[at]))]
        dx, dy = (np.subtract.outer(c[open_].astype(np.int64), c[at].astype(np.int64)) for c in (x, y))
        out = value.copy()
        out[open_] = value[at[(dx * dx + dy * dy).argmin(1)]]
        return out
    x, y = x - x.min(), y - y.min()
    grid = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
    grid[y[known], x[known]] = value[known]
    height, width = grid.shape
    places = np.arange(width)
    has = ~np.isnan(grid)
    left = np.maximum.accumulate(np.where(has, places, -FAR), axis=1)
    right = np.minimum.accumulate(np.where(has, places, FAR)[:, ::-1], axis=1)[:, ::-1]
    near = np.where(places - left <= right - places, left, right).astype(np.int64)
    open_ = np.flatnonzero(~known)
    oy, ox = y[open_].astype(np.int64), x[open_].astype(np.int64)
    best, by, bx = (np.full(len(open_), FAR * FAR, np.int64) for _ in range(3))
    live = np.arange(len(open_))
    for step in range(height):
        live = live[best[live] >= step * step]
        if not len(live):
            break
        for row in {oy_step for oy_step in (-step, step)}:
            at = oy[live] + row
            inside = (at >= 0) & (at < height)
            k, at = live[inside], at[inside]
            column = near[at, ox[k]]
            d2 = step * step + (ox[k] - column) ** 2
            better = (np.abs(column) < FAR) & ((d2 < best[k]) | (d2 == best[k]) & ((at < by[k]) | (at == by[k]) & (column < bx[k])))
            k = k[better]
            best[k], by[k], bx[k] = d2[better], at[better], column[better]
    out = value.copy()
    out[open_] = grid[by, bx]
    return out


def fill_groups(group: np.ndarray, x: np.ndarray, y: np.ndarray, value: np.ndarray) -> np.ndarray:
    """fill_grid within each group of cells (numbered from 0). Where few pairs are to be compared, those of all groups are at once."""
    known = ~np.isnan(value)
    at, open_ = np.flatnonzero(known), np.flatnonzero(~known)
    n = int(group.max()) + 1 if len(group) else 0
    have = np.bincount(group[at], minlength=n)
    each = have[group[open_]]
    out = value.copy()
    if each.sum() > 8 * FEW_PAIRS:
        order = np.argsort(group, kind="stable")
        for cells in np.split(order, np.cumsum(np.bincount(group, minlength=n))[:-1]):
            out[cells] = fill_grid(x[cells], y[cells], value[cells])
        return out
    at, open_, each = at[np.lexsort((x[at], y[at], group[at]))], open_[each > 0], each[each > 0]
    if not len(open_):
        return out
    x, y = x - x.min(), y - y.min()
    kind = np.int32 if (int(x.max()) ** 2 + int(y.max()) ** 2 + 1) * len(at) < 1 << 31 else np.int64
    x, y = x.astype(kind), y.astype(kind)
    start, tx, ty = (np.cumsum(have) - have)[group[open_]], x[at], y[at]
    # Pairs are compared in blocks of open cells that stay in the processor's cache.
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(each) // BLOCK_PAIRS)) + 1).tolist(), len(open_)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = each[a:b]
        first = np.cumsum(n) - n
        other = (np.arange(n.sum()) - np.repeat(first - start[a:b], n)).astype(kind)
        dx, dy = np.repeat(x[open_[a:b]], n) - tx[other], np.repeat(y[open_[a:b]], n) - ty[other]
        # Known cells stand in the order of ties, so the least distance with the least place is the one.
        out[open_[a:b]] = value[at[np.minimum.reduceat((dx * dx + dy * dy) * kind(len(at)) + other, first) % len(at)]]
    return out


def nearest_targets(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, distance) of the target nearest to each point; ties go to the smaller y, then x.

    Exact: a point looks at the targets left and right of it in the rows of targets above and below, row by row, until no row
    further away can be as near. Memory is that of the points and the targets.
    """
    order = np.lexsort((x, y))
    tx, ty = x[order].astype(float), y[order].astype(float)
    rows, first = np.unique(ty, return_index=True)
    last = np.append(first[1:], len(ty))
    least, span = tx.min(), float(np.ptp(tx)) + 3
    filed = np.repeat(np.arange(len(rows)), last - first) * span + (tx - least)
    across = np.clip(px - least, -1, span - 2)
    near, distance = np.full(len(px), len(tx)), np.full(len(px), np.inf)
    below = np.searchsorted(rows, py)
    live = {-1: np.arange(len(px)), 1: np.arange(len(px))}
    step = 0
    while any(map(len, live.values())):
        for sign, begin in ((-1, below - 1), (1, below)):
            k = live[sign]
            row = begin[k] + sign * step
            inside = (row >= 0) & (row < len(rows))
            k, row = k[inside], row[inside]
            close = np.abs(rows[row] - py[k]) <= distance[k]
            live[sign] = k = k[close]
            row = row[close]
            right = np.searchsorted(filed, row * span + across[k], "right")
            for at in (right - 1, right):
                some = (at >= first[row]) & (at < last[row])
                q, c = k[some], at[some]
                d = np.sqrt((tx[c] - px[q]) ** 2 + (ty[c] - py[q]) ** 2)
                better = (d < distance[q]) | (d == distance[q]) & (c < near[q])
                near[q[better]], distance[q[better]] = c[better], d[better]
        step += 1
    return x[order][near], y[order][near], distance


def nearest_point(points: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """For each point (keys, px, py) the nearest target (keys, x, y) of its group, as tx, ty, distance.

    Points and targets of equal keys, those of a picture, are one group; each side is shuffled once and nothing is broadcast.
    """
    some, there = points.select(*keys, "px", "py").dropna(), targets.select(*keys, "x", "y").dropna()
    schema = T.StructType([*some.schema.fields, T.StructField("tx", there.schema["x"].dataType), T.StructField("ty", there.schema["y"].dataType), T.StructField("distance", T.DoubleType())])

    def find(at: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        at = at.drop_duplicates() if len(to) else at.iloc[:0]
        if not len(at):
            return at.assign(tx=0, ty=0, distance=0.0)
        x, y, distance = nearest_targets(at["px"].to_numpy(float), at["py"].to_numpy(float), to["x"].to_numpy(), to["y"].to_numpy())
        return at.assign(tx=x, ty=y, distance=distance)

    return some.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(find, schema)
