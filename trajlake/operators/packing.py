"""Length-balanced packing: sequential algorithms, one group a task by ``applyInPandas``.

A group is one training step, whose size the batch size bounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each item, in input order; an item over the capacity is alone."""
    room, out = [], []
    for n in lengths:
        at = next((i for i, r in enumerate(room) if n <= r), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= n
        out.append(at)
    return out


def in_order_greedy(lengths: list[int], bins: int) -> list[int]:
    """Each item, in input order, to the bin of least sum (lowest number on ties)."""
    heap = [(0, b) for b in range(bins)]
    out = []
    for n in lengths:
        total, b = heapq.heappop(heap)
        out.append(b)
        heapq.heappush(heap, (total + n, b))
    return out


def largest_differencing(lengths: list[int], bins: int, equal_size: bool = False) -> list[int]:
    """Karmarkar-Karp: the two partitions of widest spread merge, largest parts with smallest.

    Parts go by sum, then number of items, then items; of equally wide
    partitions the one with the greater largest part is first. With
    ``equal_size`` each bin gets as many items: partitions begin as ``bins``
    neighbours of the sorted lengths, which must come out even.
    """
    if not lengths:
        return []
    ranked = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    width = bins if equal_size else 1
    if len(ranked) % width:
        raise ValueError(f"{len(ranked)} items don't fill {bins} bins evenly")

    def entry(parts: list[tuple]) -> tuple:
        parts = sorted(parts, reverse=True)
        total, count, items = parts[0]
        return (parts[-1][0] - total, -total, -count, tuple(-i for i in items)), parts

    queue = []
    for at in range(0, len(ranked), width):
        own = [(lengths[i], 1, (i,)) for i in ranked[at : at + width]]
        queue.append(entry(own + [(0, 0, ())] * (bins - width)))
    heapq.heapify(queue)
    while len(queue) > 1:
        (_, a), (_, b) = heapq.heappop(queue), heapq.heappop(queue)
        heapq.heappush(queue, entry([(x + y, m + n, p + q) for (x, m, p), (y, n, q) in zip(a, reversed(b), strict=True)]))
    out = [0] * len(lengths)
    for b, (_, _, items) in enumerate(queue[0][1]):
        for i in items:
            out[i] = b
    return out


def greedy_chunks(sizes: list[int], limit: int) -> list[int]:
    """Contiguous chunks: a new one begins before an item that would bring the sum to the limit."""
    out, chunk, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k and out[-1] == chunk and total + n >= limit:
            chunk, total = chunk + 1, 0
        total += n
        out.append(chunk)
    return out


def pack(df: DataFrame, group: str, order: str, length: str, method: Callable[[list[int]], list[int]]) -> DataFrame:
    """(group, order, length, bin) by ``method`` over each group's lengths in order."""
    slim = df.select(group, order, length)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(bin=pd.Series(method(pdf[length].tolist()), index=pdf.index, dtype="int32"))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    return slim.groupBy(group).applyInPandas(run, f"{schema}, bin int")


def split_bin(items: list[int], sizes: list[int]) -> tuple[list[int], list[int]]:
    """The bin's items in two halves: largest first, each to the lighter half (the left one on ties)."""
    halves, weight = ([], []), [0, 0]
    for i in sorted(items, key=lambda i: -sizes[i]):
        side = int(weight[1] < weight[0])
        halves[side].append(i)
        weight[side] += sizes[i]
    return halves


def split_heaviest(rows: list[list[int]], sizes: list[int], count: int) -> list[list[int]]:
    """The heaviest bin of several items (the later one on ties) is split until there are ``count`` bins or only single items."""
    rows = list(rows)
    queue = [(-sum(sizes[i] for i in row), -k) for k, row in enumerate(rows) if len(row) > 1]
    heapq.heapify(queue)
    while len(rows) < count and queue:
        k = -heapq.heappop(queue)[1]
        rows[k], more = split_bin(rows[k], sizes)
        rows.append(more)
        for at in (k, len(rows) - 1):
            if len(rows[at]) > 1:
                heapq.heappush(queue, (-sum(sizes[i] for i in rows[at]), -at))
    return rows


def grow_bins(sizes: list[int], capacity: int, count: int) -> list[int]:
    """First fit, then splits of the heaviest bins until there are ``count`` of them."""
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(first_fit(sizes, capacity)):
        bins.setdefault(b, []).append(i)
    out = [0] * len(sizes)
    for b, row in enumerate(split_heaviest([bins[b] for b in sorted(bins)], sizes, count)):
        for i in row:
            out[i] = b
    return out


def least_loaded(loads: list[int], n: int) -> list[int]:
    """Indices picked one by one, each the least loaded so far, the first on ties."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for _ in range(max(1, n)):
        load, k = heapq.heappop(heap)
        out.append(k)
        heapq.heappush(heap, (load + 1, k))
    return out
