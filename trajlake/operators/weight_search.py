"""Search for robust rubric weights: a balanced panel of drawn scores, then coordinate moves and swaps on the grid of tenths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .weights import LEAST_TENTHS, MOST_ACTIVE, MOST_TENTHS

_GRID = np.array((0, *range(LEAST_TENTHS, MOST_TENTHS + 1)))
#: Tenths that a swapped-in rubric is tried with, beside those of the one it replaces.
SWAPPED = [5, 10, 20, 30, 40, 50]
#: Margins that are looked at at once.
BLOCK = 1 << 15


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without pattern: two rounds of multiply and shift."""
    with np.errstate(over="ignore"):
        for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            x = x * np.uint64(factor)
            x = x ^ (x >> np.uint64(32))
    return x


def _moves(key: np.ndarray, draws: int) -> np.ndarray:
    """By key, which draws are lower (-1) and higher (1): a tenth each, by the order of the draws' hashes."""
    order = np.argsort(_scrambled(_scrambled(key)[:, None] + np.arange(draws, dtype=np.uint64)), axis=1, kind="stable")
    out, rows = np.zeros((len(key), draws), np.int64), np.arange(len(key))[:, None]
    out[rows, order[:, : draws // 10]] = -1
    out[rows, order[:, draws - draws // 10 :]] = 1
    return out


def _values(cell: np.ndarray, sign: np.ndarray, sides: list[tuple], draws: int, worth: np.ndarray) -> np.ndarray:
    """Cells x draws, the first the scores as they are; of each side the numbers of scores and all scores."""
    value = np.zeros((len(cell), draws + 1))
    for side, (sizes, scores) in enumerate(sides):
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            key = cell.view(np.uint64)[row] + (place * 2 + side).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        moved = scores[:, None] + np.concatenate((np.zeros((len(row), 1), np.int64), _moves(key, draws)), axis=1)
        np.add.at(value, row, (-1 if side else 1) * worth[np.clip(moved, 1, 5) - 1] / sizes[row][:, None])
    return value * sign.astype(float)[:, None]


def _cells(raw: DataFrame, draws: int, seed: int) -> DataFrame:
    """Raw scores whose sides have some, and the hash that their draws follow from."""
    if draws < 10 or draws % 10:
        raise ValueError("draws must be a positive multiple of ten")
    cell = F.xxhash64(F.lit(seed), "instance", "pair", "rubric").alias("cell")
    return raw.where("size(left) > 0 and size(right) > 0").select("instance", "pair", "rubric", "sign", cell, *(F.col(c).cast("array<int>").alias(c) for c in ("left", "right")))


def panel(raw: DataFrame, draws: int, seed: int, mapping: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """(instance, draw, pair, rubric, value) of raw scores (instance, pair, rubric, sign, left, right), draw -1 the scores as they are.

    ``left`` and ``right`` are arrays of scores 1 to 5. In a tenth of the draws
    each of them is one lower, in a tenth one higher, within 1 to 5; which ones
    follows from a hash of seed, cell, side, place and draw. The value is the
    sign times the difference of both sides' mean mapped scores. ``draws`` is a
    multiple of ten. A cell with an empty or null side is left out.
    """
    worth, rows = np.array(mapping, float), _cells(raw, draws, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(np.diff(x.offsets.to_numpy()), x.flatten().to_numpy()) for x in batch.columns[5:7]]
            value = _values(batch.column(4).to_numpy(), batch.column(3).to_numpy(), sides, draws, worth)
            each = pa.array(np.repeat(np.arange(batch.num_rows), draws + 1))
            draw = np.tile(np.arange(-1, draws, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(draw), batch.column(1).take(each), batch.column(2).take(each), pa.array(value.ravel())], ["instance", "draw", "pair", "rubric", "value"]
            )

    kind = {c: raw.schema[c].dataType.simpleString() for c in ("instance", "pair", "rubric")}
    return rows.mapInArrow(run, f"instance {kind['instance']}, draw int, pair {kind['pair']}, rubric {kind['rubric']}, value double")


class _Problem:
    """Score differences draws x pairs x rubrics of one instance; the nominal ones are a draw of their own."""

    def __init__(self, drawn: np.ndarray, nominal: np.ndarray, base: np.ndarray):
        self.drawn, self.nominal = np.ascontiguousarray(np.moveaxis(drawn, 2, 0)), np.ascontiguousarray(nominal.T)
        self.base = base / max(base.sum(), 1)
        self.worst = max(1, -(-drawn.shape[0] // 10))

    def margins(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.tensordot(w, self.drawn, 1), w @ self.nominal

    def _key(self, w: np.ndarray, right: np.ndarray, margin: np.ndarray) -> tuple:
        active, total = int((w > 0).sum()), max(int(w.sum()), 1)
        even = w[w > 0].min() / w.max() if active else 0.0
        far = np.abs(w / total - self.base).sum()
        worst = np.partition(right, self.worst - 1)[: self.worst].sum()
        return (int(right.sum()), int(worst), int((margin > 0).sum()), round(float(margin.sum()) / total, 12), -active, float(even), -round(float(far), 12))

    def key(self, w: np.ndarray) -> tuple:
        """Greater is better: correct over all draws, over the worst tenth, nominally; margin, fewer and evener weights, nearness to the base."""
        drawn, nominal = self.margins(w)
        return self._key(w, (drawn > 0).sum(axis=1), nominal)

    def score(self, w: np.ndarray) -> tuple:
        return (*self.key(w), *(-w))

    def best_of(self, w: np.ndarray, held: tuple[np.ndarray, np.ndarray], moves: list[dict[int, int]]) -> tuple[tuple, np.ndarray] | None:
        """The best of the vectors that moves {rubric: tenths} make of ``w``, with its score; margins change by the moved columns alone."""
        drawn, nominal = held
        best = None
        for move in moves:
            v, d, n = w.copy(), drawn, nominal
            for r, tenths in move.items():
                step = tenths - w[r]
                v[r] = tenths
                if step:
                    d, n = d + step * self.drawn[r], n + step * self.nominal[r]
            found = (*self._key(v, (d > 0).sum(axis=1), n), *(-v))
            if best is None or found > best[0]:
                best = (found, v)
        return best

    def column(self, w: np.ndarray, held: tuple[np.ndarray, np.ndarray], r: int, values: np.ndarray) -> tuple[tuple, np.ndarray]:
        """The best vector with another weight of one rubric: a margin changes its sign once along the weights, which are ascending."""
        drawn, nominal = held
        steps, last = values - w[r], len(values)
        # How many of the weights are at most a whole number, from -1 on.
        upto = np.searchsorted(values, np.arange(-1, values[-1] + 1), "right")
        begin = np.arange(drawn.shape[0])[:, None] * (last + 1)
        cells = np.zeros(2 * drawn.shape[0] * (last + 1), np.int64)
        span = max(1, BLOCK // drawn.shape[0])
        for at in range(0, drawn.shape[1], span):
            d, x = drawn[:, at : at + span], self.drawn[r][:, at : at + span]
            falls = x < 0
            turn = self._turns(d, x, falls, steps, upto[np.clip(np.floor(w[r] - d / np.where(x == 0, 1, x)), -1, values[-1]).astype(np.int64) + 1])
            cells += np.bincount((begin + turn + falls * (len(cells) // 2)).ravel(), minlength=len(cells))
        turned = cells.reshape(2, drawn.shape[0], last + 1).cumsum(axis=2)
        right = (turned[0, :, :last] + turned[1, :, last:] - turned[1, :, :last]).T
        worst = np.partition(right, self.worst - 1, axis=1)[:, : self.worst].sum(axis=1)
        first = np.stack((right.sum(axis=1), worst), axis=1)
        top = max(map(tuple, first.tolist()))
        best = None
        for k in np.flatnonzero((first == top).all(axis=1)):
            v = w.copy()
            v[r] = values[k]
            found = (*self._key(v, right[k], nominal + steps[k] * self.nominal[r]), *(-v))
            if best is None or found > best[0]:
                best = (found, v)
        return best

    @staticmethod
    def _turns(d: np.ndarray, x: np.ndarray, falls: np.ndarray, steps: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The first step at which a margin is positive, or if it falls isn't, from a guess: margins are compared as they are rounded."""
        last = len(steps)
        turn = np.where(x == 0, np.where(d > 0, 0, last), turn)
        turned = lambda k, d, x, falls: (d + steps[k] * x > 0) != falls
        early = (turn > 0) & turned(np.maximum(turn - 1, 0), d, x, falls)
        late = (turn < last) & ~turned(np.minimum(turn, last - 1), d, x, falls)
        for wrong, by, edge in ((early, -1, 0), (late, 1, last)):
            at = np.nonzero(wrong)
            while len(at[0]):
                turn[at] += by
                now, own = turn[at], (d[at], x[at], falls[at])
                more = turned(np.maximum(now - 1, 0), *own) if by < 0 else ~turned(np.minimum(now, last - 1), *own)
                more &= now != edge
                at = tuple(i[more] for i in at)
        return turn


def improve(problem: _Problem, start: np.ndarray, sweeps: int, active: int = MOST_ACTIVE, swaps: int = 2) -> np.ndarray:
    """Sweeps over the rubrics, each set to its best weight, until one changes nothing; then rounds of the best swap of an active for an idle one."""
    w = np.array(start, np.int64)
    held, value = problem.margins(w), problem.key(w)
    size = len(value)

    def take(found: tuple[tuple, np.ndarray] | None) -> bool:
        nonlocal w, held, value
        if found is None or found[0][:size] <= value:
            return False
        for r in np.flatnonzero(found[1] != w):
            step = found[1][r] - w[r]
            held = (held[0] + step * problem.drawn[r], held[1] + step * problem.nominal[r])
        w, value = found[1], found[0][:size]
        return True

    for _ in range(sweeps):
        changed = False
        for r in range(len(w)):
            others = int((np.delete(w, r) > 0).sum())
            values = _GRID if 0 < others < active else _GRID[1:] if others < active else _GRID[:1]
            changed |= take(problem.column(w, held, r, values))
        if not changed:
            break
    for _ in range(swaps):
        moves = [{on: 0, off: t} for on in np.flatnonzero(w > 0) for off in np.flatnonzero(w == 0) for t in dict.fromkeys([*SWAPPED, int(w[on])])]
        if not take(problem.best_of(w, held, moves)):
            break
    return w


def starts(problem: _Problem, base: np.ndarray, count: int, seed: int, active: int = MOST_ACTIVE) -> Iterator[np.ndarray]:
    """The base, the four best rubrics alone, the best ones together, and ``count`` random vectors: without repeats."""
    n = len(base)
    single = np.eye(n, dtype=np.int64) * MOST_TENTHS
    order = sorted(range(n), key=lambda r: problem.key(single[r]), reverse=True)
    rows = [base, *(single[r] for r in order[:4])]
    rows += [single[order[:k]].sum(axis=0) for k in range(2, min(active, n) + 1)]
    rng = np.random.default_rng(seed)
    for _ in range(count):
        w = np.zeros(n, dtype=np.int64)
        chosen = rng.choice(n, size=int(rng.integers(1, min(active, n) + 1)), replace=False)
        w[chosen] = rng.integers(LEAST_TENTHS, MOST_TENTHS + 1, size=len(chosen))
        rows.append(w)
    for w in dict.fromkeys(map(tuple, rows)):
        if 0 < np.count_nonzero(w) <= active:
            yield np.array(w)


def search_weights(
    rows: DataFrame, base: DataFrame, *counts: int, seed: int = 20260814, active: int = MOST_ACTIVE, tried: int = 4, mapping: tuple[int, ...] = (1, 2, 3, 4, 5)
) -> DataFrame:
    """(instance, rubric, tenths): the best weights found for each instance over the ``panel`` of its raw scores.

    rows: raw scores as ``panel`` takes them, with the counts draws, draw seed,
    sweeps (3) and random starts (10); or cells as it returns them, with the
    last two; base: (instance, rubric, tenths), all rubrics. The panel of raw
    scores is drawn in the instance's task, so these are shuffled rather than
    its cells, and not even these if they lie by instance. Starts
    follow from the seed; the ``tried`` best ones are improved, and of equal
    results the lighter one wins. A move recomputes the margins of the columns
    it changes. One instance is held in memory.
    """
    worth, ready = np.array(mapping, float), "value" in rows.columns
    draws, draw_seed = (0, 0) if ready else counts[:2]
    given = counts if ready else counts[2:]
    sweeps, random_starts = (*given, *(3, 10)[len(given) :])
    # Expressions give both sides columns of their own, also where they come from one table; the instance keeps its type and so its place.
    named = ["instance", "pair", "cast(rubric as string) AS rubric"]
    both = rows.selectExpr(*named, "draw", "cast(value as double) AS value") if ready else _cells(rows, draws, draw_seed).selectExpr(*named, "sign", "cell", "left", "right")
    own = base.selectExpr("instance AS _instance", "cast(instance as string) AS name", "cast(rubric as string) AS rubric", "cast(tenths as long) AS tenths")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("rubric")
        rubrics = right["rubric"].to_pylist()
        kinds = left["rubric"].combine_chunks().dictionary_encode()
        at = np.array([rubrics.index(r) for r in kinds.dictionary.to_pylist()], np.int64)[kinds.indices.to_numpy()]
        pairs, pair = np.unique(left["pair"].to_numpy(), return_inverse=True)
        # The nominal draw comes first.
        order, draw = np.unique(left["draw"].to_numpy(), return_inverse=True) if ready else (range(draws + 1 if len(left) else 1), None)
        cube = np.zeros((max(len(order), 1), max(len(pairs), 1), len(rubrics)))
        if len(left) and ready:
            cube[draw, pair, at] = left["value"].to_numpy()
        elif len(left):
            sides = [(pc.list_value_length(left[c]).to_numpy(), pc.list_flatten(left[c]).to_numpy().astype(np.int64)) for c in ("left", "right")]
            value = _values(left["cell"].to_numpy(), left["sign"].to_numpy(), sides, draws, worth)
            cube[:, pair, at] = value.T
        drawn = cube[1:] if len(cube) > 1 and (not ready or order[0] == -1) else cube
        problem = _Problem(drawn, cube[0], first := right["tenths"].to_numpy().astype(np.int64))
        begins = sorted(starts(problem, first, random_starts, seed, active), key=problem.key, reverse=True)[:tried]
        best = max((improve(problem, w, sweeps, active) for w in begins), key=problem.score)
        return pa.table({"instance": right["name"], "rubric": right["rubric"], "tenths": best.astype("int32")})

    found = both.groupBy("instance").cogroup(own.groupBy("_instance")).applyInArrow(run, "instance string, rubric string, tenths int")
    return found.withColumn("rubric", F.col("rubric").cast(base.schema["rubric"].dataType))
