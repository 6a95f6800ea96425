"""The one subset of some amounts that makes up a target, exactly: dense by bit sets, sparse by meeting in the middle."""

from __future__ import annotations

import numpy as np

#: Payments that one bank row is searched among, and the largest target searched (paise).
TOP, CAP = 60, 50_000_000
#: Targets up to this many paise are searched by bit sets (a bit a paisa), larger ones by sums of halves.
DENSE = 200_000_000


def counted(nets: list[int], most: int, target: int):
    """Bit sets of the sums up to most: those with one way or more, and with several. None once target has several."""
    keep, one, several = (1 << (most + 1)) - 1, 1, 0
    for n in nets:
        if n > most:
            continue
        moved = (one << n) & keep
        several |= ((several << n) & keep) | (one & moved)
        one |= moved
        if several >> target & 1:
            return None
    return one, several


def trace(nets: list[int], total: int, every: int = 8) -> list[int]:
    """Places of the one subset that makes up total: without the last amount, if the others reach it. Bit sets are kept at each eighth."""
    keep, one, marks = (1 << (total + 1)) - 1, 1, []
    for i, n in enumerate(nets):
        if i % every == 0:
            marks.append(one)
        one |= (one << n) & keep
    out = []
    for block in reversed(range(len(marks))):
        own, before = nets[block * every : (block + 1) * every], [marks[block]]
        for n in own[:-1]:
            before.append(before[-1] | (before[-1] << n) & keep)
        for i in reversed(range(len(own))):
            if not before[i] >> total & 1:
                total -= own[i]
                out.append(block * every + i)
    return out[::-1]


def dense(target: int, nets: list[int], tolerance: int) -> list[int] | None:
    found = counted(nets, target + tolerance, target)
    if found is None:
        return None
    one, several = found
    hits = [target] if one >> target & 1 else [s for s in range(max(1, target - tolerance), target + tolerance + 1) if one >> s & 1]
    return trace(nets, hits[0]) if len(hits) == 1 and not several >> hits[0] & 1 else None


def sums(nets: list[int], least: int, most: int):
    """Sorted sums between the bounds of subsets of nets, how many ways each has (2: several), and one subset of each as bits."""
    value, ways, bits = np.zeros(1, np.int64), np.ones(1, np.int8), np.zeros(1, np.int64)
    rest = sum(nets)
    for i, n in enumerate(nets):
        rest -= n
        value, ways, bits = np.concatenate([value, value + n]), np.concatenate([ways, ways]), np.concatenate([bits, bits | 1 << i])
        fits = (value <= most) & (value + rest >= least)
        order = np.argsort(value[fits], kind="stable")
        value, ways, bits = (x[fits][order] for x in (value, ways, bits))
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        ways = np.minimum(np.add.reduceat(ways.astype(np.int64), first), 2).astype(np.int8) if len(value) else ways
        value, bits = value[first], bits[first]
    return value, ways, bits


def middle(total: int, left, right) -> tuple[int, int, int]:
    """Ways (2: several) to make up total from a sum of each half, and the bits of one of them."""
    (a, n, x), (b, m, y) = left, right
    at = np.searchsorted(b, total - a)
    hit = np.flatnonzero((at < len(b)) & (b[np.minimum(at, len(b) - 1)] == total - a)) if len(b) else np.zeros(0, np.int64)
    if not len(hit):
        return 0, 0, 0
    j = at[hit]
    return min(2, int((n[hit].astype(np.int64) * m[j]).sum())), int(x[hit[0]]), int(y[j[0]])


def sparse(target: int, nets: list[int], tolerance: int) -> list[int] | None:
    """Meeting in the middle. Some amounts first: several ways among them are several ways among all, which ends dense cases early."""
    for part in sorted({min(len(nets), k) for k in (24, 32, 40, len(nets))}):
        own, half = nets[:part], part // 2
        low, high = target - tolerance, target + tolerance
        left = sums(own[:half], low - sum(own[half:]), high)
        right = sums(own[half:], low - sum(own[:half]), high)
        if middle(target, left, right)[0] > 1:
            return None
    found = [(s, *middle(s, left, right)) for s in [target, *range(max(1, low), target), *range(target + 1, high + 1)]]
    found = [found[0]] if found[0][1] else [f for f in found if f[1]]
    if len(found) != 1 or found[0][1] > 1:
        return None
    _, _, x, y = found[0]
    return [i for i in range(len(nets)) if (x >> i if i < half else y >> (i - half)) & 1]


def subset_of(target: int, nets: list[int], tolerance: int = 5, cap: int | None = CAP) -> list[int] | None:
    """Indices of the one subset whose sum is target (else within tolerance); None if there is none or several.

    Zero or negative amounts make every answer ambiguous. Targets above cap are not searched; None
    searches any. Memory grows with the target up to DENSE, beyond with the sums that each half has.
    """
    if target <= 0 or cap is not None and target > cap or any(n <= 0 for n in nets):
        return None
    return (dense if target <= DENSE else sparse)(target, nets, tolerance)

