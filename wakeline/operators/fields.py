"""Sums over all pairs of two sets of points without meeting every pair: what is smooth is expanded in powers of coordinates, whose
dropped terms are bounded, and only what is left is worked out pair by pair.

Every function answers for all its points or gives None, where an expansion would need too many terms; then pairs are met singly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np

#: Points of a group, where there are not too many groups, terms of an expansion, points whose terms and groups whose bounds are held at
#: once, and points that a group meets at once.
LEAF, GROUPS, TERMS, HELD, BLOCK = 64, 1 << 11, 1 << 13, 32, 512
#: The least score whose sigmoid is over a half in double precision.
POSITIVE = 1.5 * 2.0**-53
#: How often what is too wide for an expansion is cut in halves, and pairs that meet singly instead.
CUTS, PAIRS = 3, 1 << 22
#: Grid points between which a place is interpolated (by a side), the radius of what is not smooth in steps of the grid, cells of the
#: grid for each point and in all, and what the inverse root of 1 - x is in powers of x, of which the smooth part keeps these.
STENCIL, RADIUS, CELLS, MOST_CELLS = 18, 28, 32, 1 << 21
SMOOTH = np.cumprod([1.0, *[(i - 0.5) / i for i in range(1, 18)]])
#: Chebyshev nodes at which a function of a score is taken.
NODES = 40


def leaves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points, and where in it groups of neighbours begin (and the last ends): a group is halved across its widest side
    until it is small."""
    most, groups, found = max(LEAF, len(points) // GROUPS), [np.arange(len(points))], []
    while groups:
        group = groups.pop()
        if len(group) <= most:
            found.append(group)
            continue
        x = points[group]
        half = len(group) // 2
        at = np.argpartition(x[:, (x.max(0) - x.min(0)).argmax()], half)
        groups += [group[at[half:]], group[at[:half]]]
    return np.concatenate(found), np.cumsum([0, *map(len, found)])


def boxes(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles and half sides of groups."""
    low, high = (f.reduceat(points, starts[:-1]) for f in (np.minimum, np.maximum))
    return (low + high) / 2, (high - low) / 2


def _rows(starts: np.ndarray) -> np.ndarray:
    """The points of each group, as many in every row: the last of a smaller group again."""
    return np.minimum(starts[:-1, None] + np.arange(np.diff(starts).max()), starts[1:, None] - 1)


def score_bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of points in boxes of a with points in boxes of b, with room for rounding."""
    (am, ar), (bm, br) = a, b
    room = np.abs(am) @ br.T + ar @ np.abs(bm).T + ar @ br.T
    middle = am @ bm.T
    room += 1e-12 * (room + np.abs(am) @ np.abs(bm).T)
    return middle - room, middle + room


@dataclass
class Terms:
    """Products of powers of coordinates, `weight` of each in a power of their scaled sum, and that power's degree, ascending."""

    powers: np.ndarray
    weight: np.ndarray
    degree: np.ndarray

    def __post_init__(self) -> None:
        self.steps, self.room, count = [], {}, self.powers.shape[1]
        for k in range(count):
            prefix, at = np.unique(self.powers[:, : k + 1], axis=0, return_inverse=True)
            before = np.unique(prefix[:, :k], axis=0, return_inverse=True)[1].reshape(-1) if k else np.zeros(len(prefix), int)
            at = at.reshape(-1) if k == count - 1 else np.arange(len(prefix))
            self.steps.append((before[at], prefix[at, k]))

    def of(self, points: np.ndarray, count: int | None = None) -> np.ndarray:
        """A row for each product (of the first `count`), a column for each point; it holds until the next call."""
        size, out = len(points), np.ones((1, len(points)))
        if size not in self.room:
            self.room[size] = [tuple(np.empty((len(power), size)) for _ in range(2)) for _, power in self.steps]
        for x, (before, power), (left, right) in zip(points.T, self.steps, self.room[size], strict=True):
            many = len(power) if power is not self.steps[-1][1] else count
            table = np.ones((power.max() + 1, size))
            np.cumprod(np.broadcast_to(x, (len(table) - 1, size)), 0, out=table[1:])
            np.take(out, before[:many], 0, left[:many], "clip")
            np.take(table, power[:many], 0, right[:many], "clip")
            out = np.multiply(left[:many], right[:many], left[:many])
        return out

    def up_to(self, degree: np.ndarray) -> np.ndarray:
        """How many products have no higher degree."""
        return np.searchsorted(self.degree, degree, "right")


def terms(share: np.ndarray, size: np.ndarray, drop: float) -> Terms | None:
    """The terms of sum(size[n] * (sum of share * x)**n) for x between -1 and 1, but for some that come to at most `drop` together."""
    powers, weight = np.zeros((1, 0), int), np.ones(1)
    for w in share:
        each = np.array([w**i / factorial(i) for i in range(len(size))])
        at, power = np.nonzero((powers.sum(1)[:, None] + np.arange(len(size)) < len(size)) & (each > 0))
        powers, weight = np.concatenate([powers[at], power[:, None]], 1), weight[at] * each[power]
        if len(weight) > 8 * TERMS:
            return None
    degree = powers.sum(1)
    weight = weight * np.array([float(factorial(n)) for n in range(len(size))])[degree]
    bound = weight * size[degree]
    order = np.argsort(bound)
    kept = order[np.searchsorted(np.cumsum(bound[order]), drop, "right") :]
    if len(kept) > TERMS:
        return None
    kept = kept[np.argsort(degree[kept], kind="stable")]
    return Terms(powers[kept], weight[kept], degree[kept])


def _scaled(x: np.ndarray, middle: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    moved = x - middle
    reach = np.abs(moved).max(0)
    return moved / np.where(reach > 0, reach, 1), reach


def _sides(x: np.ndarray, column: int) -> list[np.ndarray]:
    """The rows on either side of the middle of a column's range."""
    over = x[:, column] > (x[:, column].min() + x[:, column].max()) / 2
    return [rows for rows in (np.flatnonzero(~over), np.flatnonzero(over)) if len(rows)]


def exponential_sums(a: np.ndarray, b: np.ndarray, weight: np.ndarray, cuts: int = CUTS) -> np.ndarray | None:
    """For every row of a the sum over the rows of b of weight * exp(a . b), each part to 1e-14 of itself before rounding. What is too
    wide is cut in halves at most `cuts` times; a few far rows meet singly."""
    found = _exponential_sums(a, b, weight)
    if found is not None or not cuts:
        return found
    if len(a) * len(b) <= PAIRS:
        found = np.exp(a @ b.T) @ weight
        return found if np.isfinite(found).all() and (found > 1e-250).all() else None
    found, wide = np.zeros(len(a)), (np.ptp(a, 0) * np.ptp(b, 0)).argmax()
    for rows in _sides(a, wide):
        for some in _sides(b, wide):
            part = exponential_sums(a[rows], b[some], weight[some], cuts - 1)
            if part is None:
                return None
            found[rows] += part
    return found


def _exponential_sums(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray | None:
    a0, b0 = ((x.max(0) + x.min(0)) / 2 for x in (a, b))
    (u, reach), (v, far) = _scaled(a, a0), _scaled(b, b0)
    wide = float(reach @ far)
    if not wide <= 3:
        return None
    size = [1.0]
    while size[-1] > 1e-17 * np.exp(-wide):
        size.append(size[-1] * wide / len(size))
    used = terms(reach * far / (wide or 1), np.array(size), 1e-14 * np.exp(-wide))
    if used is None:
        return None
    raised, back = weight * np.exp((b - b0) @ a0), np.exp(a @ b0)
    if not all(len(x) and 1e-250 < x.min() <= x.max() < 1e250 for x in (raised, back)):
        return None
    moments = sum(used.of(v[i : i + HELD]) @ raised[i : i + HELD] for i in range(0, len(v), HELD))
    moments *= used.weight * np.array(size)[used.degree]
    return np.concatenate([moments @ used.of(u[i : i + HELD]) for i in range(0, len(u), HELD)]) * back


Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def positive_sums(a: np.ndarray, b: np.ndarray, weight: np.ndarray, value: Callable[[np.ndarray, np.ndarray], np.ndarray], least: np.ndarray, drop: float = 1e-11, cuts: int = CUTS) -> Sums | None:
    """Over the rows of b whose product with a row of a is positive: the sums of weight, of weight * value and of weight * value * b.

    value(scores, rows): a smooth function of the scores of some rows of a, a row of scores for each, that is `least` or more where they are
    positive; errors are at most `drop` of that. Groups of b that are positive to a group of a are summed by their moments, those
    with both signs pair by pair. What is too wide is cut in halves at most `cuts` times; a few far rows meet singly.
    """
    found = _positive_sums(a, b, weight, value, least, drop)
    if found is not None or not cuts:
        return found
    if len(a) * len(b) <= PAIRS:
        scores = a @ b.T
        ahead = scores > POSITIVE
        each = np.where(ahead, value(scores, np.arange(len(a))), 0.0) * weight
        return (ahead @ weight, each.sum(1), each @ b) if np.isfinite(each).all() else None
    found, wide = (np.zeros(len(a)), np.zeros(len(a)), np.zeros(a.shape)), (np.abs(a).max(0) * np.ptp(b, 0)).argmax()
    for rows in _sides(a, wide):
        for some in _sides(b, wide):
            part = positive_sums(a[rows], b[some], weight[some], lambda scores, at, rows=rows: value(scores, rows[at]), least[rows], drop, cuts - 1)
            if part is None:
                return None
            for whole, x in zip(found, part, strict=True):
                whole[rows] += x
    return found


def _positive_sums(a: np.ndarray, b: np.ndarray, weight: np.ndarray, value: Callable[[np.ndarray, np.ndarray], np.ndarray], least: np.ndarray, drop: float) -> Sums | None:
    (order, starts), (b_order, b_starts) = leaves(a), leaves(b)
    a, b, weight, least = a[order], b[b_order], weight[b_order], least[order]
    b0 = (b.max(0) + b.min(0)) / 2
    (u, reach), (v, far) = _scaled(a, 0.0), _scaled(b, b0)
    wide = float(reach @ far)
    # value as a polynomial in the score's distance from that with the middle of b, of degree up to which its Chebyshev terms count
    angle = (np.arange(NODES) + 0.5) * np.pi / NODES
    to_terms = np.cos(np.outer(angle, np.arange(NODES))) * np.where(np.arange(NODES), 2, 1) / NODES
    middle = a @ b0
    taken = np.concatenate([value(middle[i : i + LEAF, None] + wide * np.cos(angle), order[i : i + LEAF]) for i in range(0, len(a), LEAF)])
    series = taken @ to_terms
    tail = np.cumsum((np.abs(series) / least[:, None]).max(0)[::-1])[::-1]
    short = np.flatnonzero(tail <= drop / 4)
    if not len(short) or short[0] > NODES - 8 or not np.isfinite(tail[0]):
        return None
    to_powers = np.zeros((short[0], short[0]))
    for i in range(short[0]):
        whole = np.polynomial.chebyshev.cheb2poly(np.eye(short[0])[i])
        to_powers[i, : len(whole)] = whole
    series = series[:, : short[0]] @ to_powers
    size = (np.abs(series) / least[:, None]).max(0)
    share = reach * far / (wide or 1)
    used = terms(share, size, drop / 4) if size.sum() < 1e4 else None
    if used is None:
        return None

    def degrees(scaled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Up to which degree terms count for each group: where all are well within the reach, not up to the highest."""
        part = np.maximum.reduceat(np.abs(scaled) @ share, starts[:-1])[:, None] ** np.arange(len(size)) * size
        return len(size) - 1 - (np.cumsum(part[:, ::-1], 1) <= drop / 4).sum(1)

    # With the products that are one power of a coordinate higher, moments give the sums of weight * value * b too.
    more, at = np.unique(np.concatenate([used.powers, *[used.powers + e for e in np.eye(len(far), dtype=int)]]), axis=0, return_inverse=True)
    by_degree = np.argsort(more.sum(1), kind="stable")
    at, more = np.argsort(by_degree)[at.reshape(1 + len(far), -1)], more[by_degree]
    wider = Terms(more, np.ones(len(more)), more.sum(1))
    moments = np.zeros((len(b_starts) - 1, len(more)))
    for k, (i, j, count) in enumerate(zip(b_starts, b_starts[1:], wider.up_to(degrees(v, b_starts) + 1), strict=False)):
        moments[k, :count] = wider.of(v[i:j], count) @ weight[i:j]
    members = np.add.reduceat(weight, b_starts[:-1])
    (middles, sides), (b_middles, b_sides) = boxes(a, starts), boxes(b, b_starts)
    weights, sizes = np.concatenate([weight[:, None], weight[:, None] * b], 1), np.diff(b_starts)
    known, sums = np.zeros(len(a)), np.zeros((len(a), 1 + len(far)))
    ends, highest = used.up_to(np.arange(-1, len(size))), degrees(u, starts)
    rows, b_rows = _rows(starts), _rows(b_starts)
    off, sided = (b - np.repeat(b_middles, sizes, 0)), np.abs(b)
    held = max(1, min(HELD, (1 << 21) // len(b)))
    for first in range(0, len(middles), held):
        some_rows, middle, side = rows[first : first + held], middles[first : first + held], sides[first : first + held]
        # a . b is a . (middle of b) and (middle of a) . (b off its middle), both over all points, and the product of what is off
        at_middle, offs = a[some_rows] @ b_middles.T, (off @ middle.T)[b_rows]
        room = side @ b_sides.T
        room += 1e-12 * (room + np.abs(middle) @ np.abs(b_middles).T + 1)
        within = at_middle.min(1) + offs.min(1).T - room > POSITIVE
        both = ~within & (at_middle.max(1) + offs.max(1).T + room > POSITIVE)
        upper = (b @ middle.T + sided @ side.T).T > -1e-12
        mixed = within.any(0) & ~within.all(0)
        gathered = within[:, mixed].astype(float) @ moments[mixed] + moments[within.all(0)].sum(0)
        for k, (i, j) in enumerate(zip(starts[first:], starts[first + 1 : first + 1 + held], strict=False)):
            top = max(0, highest[first + k])
            own, met = used.of(u[i:j], ends[top + 1]), (gathered[k][at[:, : ends[top + 1]]] * used.weight[: ends[top + 1]]).T
            some = sum(series[i:j, n, None] * (own[ends[n] : ends[n + 1]].T @ met[ends[n] : ends[n + 1]]) for n in range(top + 1))
            some[:, 1:] = some[:, 1:] * far + some[:, :1] * b0
            known[i:j] = members[within[k]].sum()
            near = np.flatnonzero(np.repeat(both[k], sizes) & upper[k])
            for n in range(0, len(near), BLOCK):
                some_b = near[n : n + BLOCK]
                scores = a[i:j] @ b[some_b].T
                ahead = (scores > POSITIVE).astype(float)
                found = value(scores, order[i:j])
                found *= ahead
                some += found @ weights[some_b]
                known[i:j] += ahead @ weight[some_b]
            sums[i:j] = some
    back = np.argsort(order)
    return known[back], sums[back, 0], sums[back, 1:]


def contenders(a: np.ndarray, b: np.ndarray, margin: Callable[[np.ndarray, float], float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some rows of a with all rows of b whose product with one of them may be the largest or within margin(rows, least) of it, until
    every row of a was told. least: what the largest product of each of these rows reaches at least."""
    (order, starts), (b_order, b_starts) = leaves(a), leaves(b)
    (middles, sides), b_boxes = boxes(a[order], starts), boxes(b[b_order], b_starts)
    for k, (i, j) in enumerate(zip(starts, starts[1:], strict=False)):
        low, high = score_bounds((middles[k : k + 1], sides[k : k + 1]), b_boxes)
        rows, least = order[i:j], low.max()
        some = b_order[np.repeat(high[0] >= least - margin(rows, least), np.diff(b_starts))]
        for part in np.array_split(rows, max(1, len(rows) * len(some) >> 20)):
            score = a[part] @ b[some].T
            yield part, some[(score >= score.max(1, keepdims=True) - margin(part, least)).any(0)]


def _stencil(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places in units of a grid, the first of the STENCIL grid points around each and the weights with which these interpolate."""
    first = np.floor(x).astype(int) - (STENCIL // 2 - 1)
    from_points = (x - first)[:, None] - np.arange(STENCIL)
    weights = np.ones((len(x), STENCIL))
    for j in range(STENCIL):
        for i in range(STENCIL):
            if i != j:
                weights[:, j] *= from_points[:, i] / (j - i)
    return first, weights


def _stencils(points: np.ndarray, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some points, the grid points that each meets, numbered in rows of `width`, and their weights."""
    for i in range(0, len(points), 1 << 13):
        (x, wx), (y, wy) = (_stencil(c) for c in points[i : i + (1 << 13)].T)
        at = ((x[:, None] + np.arange(STENCIL)) * width)[:, :, None] + (y[:, None] + np.arange(STENCIL))[:, None]
        yield slice(i, i + (1 << 13)), at.reshape(len(x), -1), (wx[:, :, None] * wy[:, None]).reshape(len(x), -1)


def inverse_distance_sums(a: np.ndarray, b: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray | None:
    """For every row of a, a place in the plane, the sum over the rows of b of weight times the inverse distance, at most `most`, and 0
    where two coincide.

    The inverse distance is taken as a smooth function, which beyond a radius is the inverse distance itself and within it a polynomial of
    the squared distance with the same derivatives at the radius, and the rest, which is 0 beyond the radius. The smooth part is a
    convolution on a grid (places are interpolated between its points), the rest is worked out pair by pair.
    """
    low = np.minimum(a.min(0), b.min(0))
    sides = np.maximum(a.max(0), b.max(0)) - low
    if not (np.isfinite(sides).all() and sides.max() > 0):
        return None
    step = float(np.sqrt(np.prod(np.maximum(sides, sides.max() / 1000)) / min(CELLS * len(b), MOST_CELLS)))
    radius = max(RADIUS * step, 2 / most)
    (order, starts), (b_order, b_starts) = leaves(a), leaves(b)
    a, b, weight = a[order], b[b_order], weight[b_order].astype(float)
    (am, ar), (bm, br), sizes = boxes(a, starts), boxes(b, b_starts), np.diff(b_starts)
    within = lambda k: (np.maximum(np.abs(am[k] - bm) - ar[k] - br, 0) ** 2).sum(1) < (radius * (1 + 1e-9)) ** 2
    if sum((j - i) * (within(k) @ sizes) for k, (i, j) in enumerate(zip(starts, starts[1:], strict=False))) > 0.25 * len(a) * len(b):
        return None
    # the smooth part
    origin = low - STENCIL * step
    shape = tuple(int(n) for n in np.ceil(sides / step) + 2 * STENCIL)
    grid = np.zeros(shape[0] * shape[1])
    for some, at, by in _stencils((b - origin) / step, shape[1]):
        grid += np.bincount(at.reshape(-1), (by * weight[some, None]).reshape(-1), len(grid))
    whole = tuple(_fast(2 * n) for n in shape)
    x, y = (np.arange(n // 2 + 1) * step for n in whole)
    squares = x[:, None] ** 2 + y**2
    smooth = np.polynomial.polynomial.polyval(1 - np.minimum(squares / radius**2, 1), SMOOTH) / radius
    quarter = np.where(squares < radius**2, smooth, 1 / np.sqrt(np.maximum(squares, radius**2)))
    mirrored = np.ix_(*[np.minimum(np.arange(n), n - np.arange(n)) for n in whole])
    field = np.fft.rfft2(quarter[mirrored])
    field *= np.fft.rfft2(grid.reshape(shape), whole)
    field = np.fft.irfft2(field, whole)[: shape[0], : shape[1]].reshape(-1)
    sums = np.empty(len(a))
    for some, at, by in _stencils((a - origin) / step, shape[1]):
        sums[some] = np.einsum("ij,ij->i", field[at], by)
    # the rest
    for k, (i, j) in enumerate(zip(starts, starts[1:], strict=False)):
        close = np.flatnonzero(np.repeat(within(k), sizes))
        for n in range(0, len(close), BLOCK):
            met = close[n : n + BLOCK]
            square, other = (np.subtract.outer(a[i:j, c], b[met, c]) for c in (0, 1))
            square *= square
            other *= other
            square += other
            np.minimum(square, radius**2, square)
            rest = np.sqrt(square, other)
            np.divide(1, np.maximum(rest, 1 / most, rest), rest)
            rest[square == 0] = 0
            square *= -1 / radius**2
            square += 1
            smooth = np.full_like(square, SMOOTH[-1])
            for c in SMOOTH[-2::-1]:
                smooth *= square
                smooth += c
            smooth *= 1 / radius
            rest -= smooth
            sums[i:j] += rest @ weight[met]
    return sums[np.argsort(order)]


def _fast(least: int) -> int:
    """The next length of few small factors, which transforms like."""
    return min(n for p in (1, 3, 5, 9, 15) for n in [p << max(0, int(np.ceil(np.log2(least / p))))] if n >= least)
