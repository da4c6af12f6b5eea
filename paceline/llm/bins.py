"""Bin completion over a histogram of sizes.

Equal sizes are interchangeable, so a packing is a list of fillings, each with the
number of bins that hold it. Its length depends on the capacity, not on how many items
there are: one filling is used until a size in it runs out.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter

import numpy as np

Filling = tuple[int, ...]  # sizes in falling order
Packing = list[tuple[Filling, int]]
FEW = 5


def bins_of(packing: Packing) -> int:
    return sum(n for _, n in packing)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The largest of the bounds that leave out sizes below a threshold k: of the larger
    sizes, those over half a bin need one each, and what is left of their bins beside
    those over capacity - k is all that the sizes between k and half a bin can fill."""
    if not counts:
        return 0
    n = np.zeros(capacity + 2, np.int64)
    n[list(counts)] = list(counts.values())
    size = np.arange(capacity + 2)
    number, total = np.cumsum(n), np.cumsum(n * size)
    half = capacity // 2
    k = np.arange(half + 1)
    below = np.maximum(k - 1, 0)
    large = number[capacity] - number[half]
    room = (number[capacity - k] - number[half]) * capacity - (total[capacity - k] - total[half])
    small = total[half] - total[below] * (k > 0)
    return int((large + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Largest first, each item into the fullest bin that holds it."""
    bins: dict[int, list[list]] = {}  # room left: [filling, bins]
    rooms: list[int] = []

    def put(filling: Filling, room: int, n: int) -> None:
        if not n:
            return
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append([filling, n])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                filling, room, n = (), capacity, -(-left // (capacity // size))
            else:
                room = rooms[at]
                filling, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            each = room // size
            full = min(n, left // each)
            put(filling + (size,) * each, room - size * each, full)
            left, n = left - full * each, n - full
            if n and left:  # one bin takes the rest
                put(filling + (size,) * left, room - size * left, 1)
                left, n = 0, n - 1
            put(filling, room, n)
    merged = Counter()
    for entries in bins.values():
        for filling, n in entries:
            merged[filling] += n
    return list(merged.items())


def dominates(better: Filling, worse: Filling) -> bool:
    """Whether the sizes of `worse` fit into those of `better` as into small bins."""
    rooms = list(better)

    def place(i: int) -> bool:
        if i == len(worse):
            return True
        tried = set()
        for k, room in enumerate(rooms):
            if room >= worse[i] and room not in tried:
                tried.add(room)
                rooms[k] -= worse[i]
                if place(i + 1):
                    return True
                rooms[k] += worse[i]
        return False

    return place(0)


def fillings(counts: dict[int, int], sizes: list[int], room: int, width: int, keep: int) -> list[Filling]:
    """Undominated sets of the sizes (rising) that fit the room, least waste first.

    Sets begin with one or two of the `width` largest sizes that fit; each is then
    filled up with the largest that fit. The best `keep` are returned. Dominance is
    tested among sets of few sizes, where one fits into another.
    """
    if counts.get(room):
        return [(room,)]  # an exact fit by one size dominates every other set

    def largest(limit: int, used: Filling = ()) -> int:
        at = bisect_right(sizes, limit) - 1
        while at >= 0 and used.count(sizes[at]) >= counts[sizes[at]]:
            at -= 1
        return sizes[at] if at >= 0 else 0

    def filled(chosen: Filling) -> Filling:
        left = room - sum(chosen)
        while size := largest(min(left, chosen[-1] if chosen else left), chosen):
            chosen, left = chosen + (size,), left - size
        return chosen

    found = {filled(())}
    top = sizes[max(0, bisect_right(sizes, room) - width) : bisect_right(sizes, room)][::-1]
    for a in top:
        found.add(filled((a,)))
        second = sizes[max(0, bisect_right(sizes, min(a, room - a)) - width) : bisect_right(sizes, min(a, room - a))]
        for b in second[::-1]:
            if a != b or counts[a] > 1:
                found.add(filled((a, b)))
                if room == sum(filled((a, b))):
                    break
    out: list[Filling] = []
    for filling in sorted(found - {()}, key=lambda x: (room - sum(x), [-s for s in x])):
        if len(filling) > FEW or not any(len(x) <= FEW and dominates(x, filling) for x in out):
            out.append(filling)
            if len(out) == keep:
                break
    return out or [()]


def complete(counts: dict[int, int], capacity: int, nodes: int = 4000, width: int = 24, keep: int = 4) -> Packing:
    """The best packing found: best fit first, then a search that completes the bin of
    the largest size left with each undominated filling in turn, for as many bins as the
    counts allow. A branch ends when its waste, or its bins and the bound on the rest,
    can no longer beat the best. `nodes` bounds the search, never the items packed.
    """
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    bound, total = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    left = nodes
    used: Packing = []
    depth_limit = 20_000

    def options(now: dict[int, int], sizes: list[int]) -> list[tuple[Filling, int]]:
        head = sizes[-1]
        now[head] -= 1
        tails = fillings(now, sizes if now[head] else sizes[:-1], capacity - head, width, keep)
        now[head] += 1
        out = []
        for tail in tails:
            need = Counter((head, *tail))
            out.append(((head, *tail), min(now[s] // k for s, k in need.items())))
        return out

    now, sizes = dict(counts), sorted(counts)
    stack: list[list] = []  # for each depth: options still to try, filling and bins in use, waste so far
    waste, bins = 0, 0

    def apply(filling: Filling, n: int, sign: int) -> None:
        nonlocal waste, bins
        waste += sign * n * (capacity - sum(filling))
        bins += sign * n
        for s, k in Counter(filling).items():
            before = now[s]
            now[s] -= sign * k * n
            if sign > 0 and not now[s]:
                sizes.remove(s)
            elif sign < 0 and not before:
                insort(sizes, s)

    fewest = bins_of(best)

    def hopeless() -> bool:
        allowed = (fewest - 1) * capacity - total
        return waste > allowed or bins + lower_bound({s: now[s] for s in sizes}, capacity) >= fewest

    while left > 0 and fewest > bound and len(stack) < depth_limit:
        left -= 1
        if not sizes and bins < fewest:
            best, fewest = list(used), bins
        if not sizes or hopeless():
            while stack and not stack[-1]:
                stack.pop()
                apply(*used.pop(), -1)
            if not stack:
                break
            apply(*used.pop(), -1)
            choice = stack[-1].pop(0)
        else:
            stack.append(options(now, sizes))
            choice = stack[-1].pop(0)
        used.append(choice)
        apply(*choice, 1)
    return list(used) if not sizes and bins < fewest else best
