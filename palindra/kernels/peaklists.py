"""Sequential peak-list kernels on numpy arrays; no Spark imports.

Isotope clusters are built greedily around the strongest unused peak. Two slips of common
implementations are not repeated: no peak at (0, 0) for short lists and no second copy of a merged
last peak.
"""

from __future__ import annotations

import numpy as np

from palindra.chemistry import AMMONIA, NEUTRON, PROTON, WATER


def width(mz: float, tolerance: float, ppm: bool) -> float:
    return mz * tolerance * 1e-6 if ppm else tolerance


def isotope_clusters(mz: np.ndarray, inten: np.ndarray, most_charge: int, tolerance: float = 20.0, ppm: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, charge) of every peak of an ascending list: clusters in order of their strongest peak, charge 0 if alone.

    To the right a member has at most 1.2 times the intensity of the one before (the first of a cluster
    is free); to the left at least 0.3 times the leftmost for the peak that fixes the charge, 0.4 after.
    """
    gaps = [NEUTRON / c for c in range(1, most_charge + 1)]
    order = np.lexsort((np.arange(len(mz)), -inten)).tolist()
    # plain numbers: a step looks at single peaks
    mz, inten = mz.tolist(), inten.tolist()
    free = [True] * len(mz)
    cluster, charge = np.full(len(mz), -1), np.zeros(len(mz), int)
    number = 0
    for top in order:
        if not free[top]:
            continue
        members, z = [top], 0
        for side in (1, -1):
            edge, at = mz[top], top + side
            while 0 <= at < len(mz):
                if not free[at]:
                    at += side
                    continue
                gap = (mz[at] - edge) * side
                tol = width(mz[at] if side > 0 else edge, tolerance, ppm)
                last = members[-1] if side > 0 else members[0]
                if gap > gaps[0] + tol or z and gap > gaps[z - 1] + tol:
                    break
                fits = [c for c in range(1, most_charge + 1) if abs(gap - gaps[c - 1]) <= tol and (not z or c == z)]
                if fits:
                    if side > 0:
                        good = not z or inten[at] <= 1.2 * inten[last]
                    else:
                        good = inten[at] >= (0.4 if z else 0.3) * inten[last]
                    if good:
                        z, edge = z or fits[0], mz[at]
                        members = [*members, at] if side > 0 else [at, *members]
                at += side
        for m in members:
            free[m] = False
        cluster[members], charge[members] = number, z
        number += 1
    return cluster, charge


def deconvolve(mz: np.ndarray, inten: np.ndarray, cluster: np.ndarray, charge: np.ndarray, add: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Clusters as singly charged peaks at their first member, with its intensity or the cluster's sum."""
    own = own_peaks(cluster)
    first = np.array([o[0] for o in own], int)
    z = np.maximum(charge[first], 1)
    masses = mz[first] * z - (z - 1) * PROTON
    heights = np.array([inten[o].sum() for o in own], float) if add else inten[first]
    order = np.argsort(masses, kind="stable")
    return masses[order], heights[order]


def own_peaks(cluster: np.ndarray) -> list[np.ndarray]:
    """The ascending places of the peaks of every cluster."""
    order = np.argsort(cluster, kind="stable")
    ends = np.searchsorted(cluster[order], np.arange(cluster.max() + 2 if len(cluster) else 0)).tolist()
    return [order[low:high] for low, high in zip(ends[:-1], ends[1:])]


def merge_close(mz: np.ndarray, inten: np.ndarray, tolerance: float = 20.0, ppm: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Chains of peaks closer than the tolerance become one, at the intensity-weighted mass."""
    if not len(mz):
        return mz, inten
    near = np.diff(mz) < width(mz[1:], tolerance, ppm)
    group = np.concatenate([[0], np.cumsum(~near)])
    total = np.bincount(group, inten)
    safe = np.where(total > 0, total, 1)
    return np.where(total > 0, np.bincount(group, inten * mz) / safe, mz[np.searchsorted(group, np.arange(len(total)))]), total


def strongest(mz: np.ndarray, inten: np.ndarray, *more: np.ndarray, most: int | None) -> tuple[np.ndarray, ...]:
    """The ``most`` strongest peaks in their order, all if None; of equally intense ones that of the smaller m/z goes first."""
    if most is None or len(mz) <= most:
        return mz, inten, *more
    kept = np.sort(np.lexsort((mz, inten))[-most:])
    return tuple(x[kept] for x in (mz, inten, *more))


def collapse_losses(mz: np.ndarray, inten: np.ndarray, tolerance: float = 20.0, ppm: bool = True, share: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """From high m/z down, peaks at a loss of ammonia or water join their parent if stronger than ``share`` of it."""
    kept, height = np.ones(len(mz), bool), inten.astype(float).copy()
    order = np.argsort(mz, kind="stable")
    near = []
    for loss in (AMMONIA, WATER):
        # a wider range by sorted m/z, of which those within the tolerance are taken
        reach = width(mz, tolerance, ppm) + 1e-6
        near.append([np.searchsorted(mz[order], at, side).tolist() for at, side in ((mz - loss - reach, "left"), (mz - loss + reach, "right"))])
    for i in range(len(mz) - 1, -1, -1):
        if not kept[i]:
            continue
        for loss, (lows, highs) in zip((AMMONIA, WATER), near):
            if lows[i] == highs[i]:
                continue
            tol = width(mz[i], tolerance, ppm)
            for j in sorted(order[lows[i] : highs[i]].tolist()):
                if kept[j] and abs(mz[i] - mz[j] - loss) <= tol and inten[j] > share * inten[i]:
                    height[i] += inten[j]
                    kept[j] = False
    return mz[kept], height[kept]


def cluster_labels(mz: np.ndarray, inten: np.ndarray, most_charge: int, tolerance: float = 20.0, ppm: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(cluster from 1, charge) of peaks in any order, in that order; 0 for single peaks and those below the proton's mass."""
    number, charge = np.zeros(len(mz), int), np.zeros(len(mz), int)
    order = np.lexsort((inten, mz))
    order = order[mz[order] >= PROTON]
    cluster, z = isotope_clusters(mz[order], inten[order], most_charge, tolerance, ppm)
    real = np.unique(cluster[z > 0])
    number[order] = np.where(z > 0, np.searchsorted(real, cluster) + 1, 0)
    charge[order] = z
    return number, charge


def labelled_singles(mz: np.ndarray, inten: np.ndarray, label: np.ndarray, most_charge: int, tolerance: float = 20.0, ppm: bool = True, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(m/z, intensity, label) of charge one of doublets' light peaks: see ``operators.doublets.deisotoped``."""
    order = np.lexsort((inten, mz))
    mz, inten, label = mz[order], inten[order], label[order]
    cluster, charge = isotope_clusters(mz, inten, most_charge, tolerance, ppm)
    rows: list[tuple[float, float, int]] = []
    for own in own_peaks(cluster):
        first, seen = own[0], int(label[own].max() > 0)
        charges = range(1, int(label[first]) + 1) if seen and not charge[first] else [max(int(charge[first]), 1)]
        rows += [(mz[first] * z - (z - 1) * PROTON, inten[first] * (1 + seen), seen) for z in charges]
    rows.sort()
    groups: list[list[float]] = []
    for m, h, lab in rows:
        # closeness is chained to the last peak of the group
        if groups and m - groups[-1][3] < width(m, tolerance, ppm):
            g = groups[-1]
            total = g[1] + h
            g[0] = (g[0] * g[1] + m * h) / total if total > 0 else g[0]
            g[1], g[2], g[3] = total, max(g[2], lab), m
        else:
            groups.append([m, h, lab, m])
    mz, inten, label = strongest(*(np.array([g[k] for g in groups], float) for k in range(3)), most=most)
    kept = np.zeros(len(mz), bool)
    for lab in (0, 1):
        # a loss joins a parent of the same label
        own = np.flatnonzero(label == lab)
        left, high = collapse_losses(mz[own], inten[own], tolerance, ppm)
        at = own[np.isin(mz[own], left)] if len(left) < len(own) else own
        kept[at], inten[at] = True, high
    return mz[kept], inten[kept], label[kept].astype(int)
