"""Rank-sum tests over each entity's earlier rows, a batch of whole careers at a time.

A career is the rows of one entity in order. What a row adds to a U statistic and to its ties follows from the earlier rows of
the career, each compared with it once; running sums then give the test of every row's past. So a career of n rows costs
n * (n - 1) / 2 comparisons of numbers, made in blocks of bounded size, and no row carries its history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

EXACT_BELOW = 50  # rows of either side from which the normal distribution is near enough
_BLOCK = 1 << 20  # comparisons made at once

Arrays = dict[str, np.ndarray]


def chances_at_least(below: int) -> dict[tuple[int, int], np.ndarray]:
    """Per pair of sizes (2 to ``below`` - 1) the chance that U is at least 0, 1, ..., n1 * n2, without ties.

    The largest of n1 + n2 rows lies in the first side with odds n1 : n2 and then beats all n2 of the other, so the
    chances of one pair of sizes follow from those of the two pairs that are one row smaller.  Only sums of positive
    numbers, so there is no loss of digits.
    """
    chance = {}
    for n1 in range(below):
        for n2 in range(below):
            p = np.zeros(n1 * n2 + 1)
            if n1 == 0 or n2 == 0:
                p[0] = 1.0
            else:
                p[n2:] += chance[n1 - 1, n2] * (n1 / (n1 + n2))
                p[: n1 * (n2 - 1) + 1] += chance[n1, n2 - 1] * (n2 / (n1 + n2))
            chance[n1, n2] = p
    return {k: np.cumsum(p[::-1])[::-1] for k, p in chance.items() if min(k) > 1}


@cache
def _tails() -> tuple[np.ndarray, np.ndarray]:
    """All tails one behind the other, and where those of each pair of sizes begin."""
    tails = chances_at_least(EXACT_BELOW)
    begin = np.zeros((EXACT_BELOW, EXACT_BELOW), np.int64)
    at = 0
    for k, t in tails.items():
        begin[k] = at
        at += len(t)
    return np.concatenate(list(tails.values())), begin


def z_and_p(u: np.ndarray, n1: np.ndarray, n2: np.ndarray, ties: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal score and one-sided p-value, NaN where all values tie; sides have two rows or more.

    Exact for small sides without ties, else the normal tail in the approximation of ``scalars.normal_upper_tail``.
    """
    n, product = (n1 + n2).astype(float), (n1 * n2).astype(float)
    variance = product / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(variance == 0, np.nan, (u - product / 2.0 + np.where(less, 0.5, -0.5)) / np.sqrt(variance))
    a = np.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-a * a / 2.0) / 2.5066282746310002 * poly
    tail = np.where(z >= 0, tail, 1.0 - tail)
    p = np.where(less, 1.0 - tail, tail)
    exact = np.flatnonzero((ties == 0) & (n1 < EXACT_BELOW) & (n2 < EXACT_BELOW))
    tails, begin = _tails()
    # U at most u is as likely as U at least n1 * n2 - u
    extreme = np.where(less, product - u, u)[exact].astype(np.int64)
    p[exact] = tails[begin[n1[exact], n2[exact]] + extreme]
    return z, p


def _blocks(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose counts add up to _BLOCK at most, or of one row."""
    ends, i = np.cumsum(count), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _BLOCK, side="right")))
        yield i, j
        i = j


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ..., count - 1 for each count."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _earlier_pairs(at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, later, earlier): each of the rows i to j - 1 with every earlier row of its career; ``at``: place in the career."""
    for i, j in _blocks(at):
        later = np.repeat(np.arange(i, j), at[i:j])
        yield i, j, later, later - at[later] + _within(at[i:j])


def _before(add: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum over the earlier rows of the career; ``first``: each row's first row."""
    total = np.cumsum(add) - add
    return total - total[first]


def _places(career: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(np.append(True, career[1:] != career[:-1])[: len(career)])
    return _within(np.diff(np.append(starts, len(career))))


def played_or_not(career: np.ndarray, x: np.ndarray, played: np.ndarray, unknown: np.ndarray) -> Arrays:
    """u, n1, n2 and ties of every row's past, and whether it holds no row of which the side is unknown."""
    at = _places(career)
    code = np.unique(x, return_inverse=True)[1]
    wins, same = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for i, j, later, earlier in _earlier_pairs(at):
        above, equal = code[later] > code[earlier], code[later] == code[earlier]
        twice = np.where(played[later], 2 * above, 2 * (~above & ~equal)) + equal
        wins[i:j] = np.bincount(later - i, np.where(played[later] != played[earlier], twice, 0), j - i)
        same[i:j] = np.bincount(later - i, equal, j - i)
    first = np.arange(len(at)) - at
    n1 = _before(played.astype(np.int64), first)
    # the t-th equal value adds 3 t (t - 1) to the sum of t^3 - t
    return {"u": _before(wins, first) / 2.0, "n1": n1, "n2": at - n1, "ties": _before(3 * same * (same + 1), first), "known": _before(unknown.astype(np.int64), first) == 0}


def _in_order_of_meeting(career: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Number of each row's group among those of its career, in the order in which they were met; -1 for none (-1)."""
    some = np.flatnonzero(group >= 0)
    _, met, of = np.unique(career[some] * (group.max(initial=0) + 1) + group[some], return_index=True, return_inverse=True)
    place = np.empty(len(met), np.int64)
    place[np.argsort(met)] = _places(np.sort(career[some][met]))
    out = np.full(len(group), -1)
    out[some] = place[of]
    return out


def former_groups(career: np.ndarray, x: np.ndarray, group: np.ndarray, less: bool) -> Arrays:
    """Smallest p, largest z and number of tests over all pairs of groups in every row's past (inf, -inf, 0 without any).

    A slot is a row and a group of its career; it holds what the earlier rows of that group are to the row. A pair's test
    changes only at a row of either group, so it is made there, and later rows look it up where the newer group was last seen.
    """
    at, n = _places(career), len(career)
    code, group = np.unique(x, return_inverse=True)[1], _in_order_of_meeting(career, group)
    number = np.cumsum(at == 0) - 1
    met = np.zeros(number.max(initial=-1) + 1, np.int64)
    np.maximum.at(met, number, group + 1)
    wide = met[number]
    begin = np.cumsum(wide) - wide
    row, label = np.repeat(np.arange(n), wide), _within(wide)
    count, above, equal = (np.zeros(len(row), np.int64) for _ in range(3))
    last = np.full(len(row), -1)
    for i, j, later, earlier in _earlier_pairs(at):
        some = group[earlier] >= 0
        later, earlier = later[some], earlier[some]
        slot, part = begin[later] + group[earlier], slice(begin[i], begin[j - 1] + wide[j - 1])
        size = part.stop - part.start
        count[part] = np.bincount(slot - part.start, minlength=size)
        above[part] = np.bincount(slot - part.start, code[earlier] > code[later], size)
        equal[part] = np.bincount(slot - part.start, code[earlier] == code[later], size)
        np.maximum.at(last, slot, earlier)

    # rows that change a pair's test: a row's own group and any other of its career
    event = np.flatnonzero((group[row] >= 0) & (label != group[row]))
    j, other, own = row[event], label[event], group[row[event]]
    own_slot, older = begin[j] + own, other < own  # older: the other group was met first and is the first side
    below = count[event] - above[event] - equal[event]
    same = equal[event] + equal[own_slot]
    pair = (number[j] * (met.max(initial=0) + 1) + np.minimum(own, other)) * (met.max(initial=0) + 1) + np.maximum(own, other)
    order = np.argsort(pair, kind="stable")
    place = _places(pair[order])
    wins, ties = np.empty(len(event), np.int64), np.empty(len(event), np.int64)
    for out, add in ((wins, 2 * np.where(older, above[event], below) + equal[event]), (ties, 3 * same * (same + 1))):
        out[order] = _before(add[order], np.arange(len(order)) - place) + add[order]
    n_own, n_other = count[own_slot] + 1, count[event]
    test = np.flatnonzero((n_own > 1) & (n_other > 1))
    z, p = np.full(len(row), np.nan), np.full(len(row), np.nan)
    n1, n2 = np.where(older, n_other, n_own)[test], np.where(older, n_own, n_other)[test]
    z[event[test]], p[event[test]] = z_and_p(wins[test] / 2.0, n1, n2, ties[test], np.full(len(test), less))

    least, largest, tests = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
    usable = np.flatnonzero(count > 1)
    later_ones = np.bincount(row[usable], minlength=n)[row[usable]] - 1 - _places(row[usable])
    for i, j in _blocks(later_ones):
        a = np.repeat(np.arange(i, j), later_ones[i:j])
        b = usable[a + 1 + _within(later_ones[i:j])]
        a = usable[a]
        newer = last[a] > last[b]
        slot = np.where(newer, begin[last[a]] + label[b], begin[last[b]] + label[a])
        known = ~np.isnan(z[slot])
        slot, of = slot[known], row[a[known]]
        if len(of):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            rows = of[starts]
            least[rows] = np.minimum(least[rows], np.minimum.reduceat(p[slot], starts))
            largest[rows] = np.maximum(largest[rows], np.maximum.reduceat(z[slot], starts))
            tests[rows] += np.diff(np.append(starts, len(of)))
    return {"p": least, "z": largest, "tests": tests}


def over_careers(compute: Callable[[pa.Table], pa.Table]):
    """mapInArrow step over rows in order of entity and period, ``__n`` being 1 at an entity's first row: whole careers are handed on."""

    def run(source):
        held = []

        def solved():
            return compute(pa.Table.from_batches(held).combine_chunks()).to_batches()

        for batch in source:
            starts = np.flatnonzero(batch.column("__n").to_numpy() == 1)
            cut = int(starts[-1]) if len(starts) else 0
            if cut or (len(starts) and held):
                held.append(batch.slice(0, cut))
                yield from solved()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from solved()

    return run


def careers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a value ``__x``, their career's number and their values."""
    x = table.column("__x").combine_chunks()
    rows = np.flatnonzero(pc.is_valid(x).to_numpy(zero_copy_only=False))
    return rows, np.cumsum(table.column("__n").to_numpy() == 1)[rows], x.drop_null().to_numpy()


def column(values: np.ndarray, missing: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A column of n rows that has the values at ``rows``, but for those that are missing, and is NULL elsewhere."""
    out, empty = np.zeros(n, values.dtype), np.ones(n, bool)
    out[rows], empty[rows] = values, missing
    return pa.array(out, kind, mask=empty)
