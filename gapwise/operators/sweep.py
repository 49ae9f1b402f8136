"""Sweeps within tasks: whole keys from sorted batches, their points in order of one axis, and the pairs near each other on it.

The work of a key grows with its pairs that are near on that axis, so callers give these functions keys of bounded size.
Many keys are worked on at once, none alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of whole keys, pairs compared and pairs passed on that are held at once.
ROWS, COMPARED, PASSED = 1 << 16, 1 << 19, 1 << 16


def codes(column: pa.Array) -> np.ndarray:
    """A number for each value, the same for equal ones: null, NaN and both zeros are values like others."""
    if pa.types.is_floating(column.type):
        column = pa.array(column.to_numpy(zero_copy_only=False) + 0.0, mask=column.is_null().to_numpy(zero_copy_only=False))
    if pa.types.is_nested(column.type):
        seen: dict[str, int] = {}
        return np.array([seen.setdefault(repr(v), len(seen)) for v in column.to_pylist()], dtype=np.int64)
    return column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def whole_keys(batches, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, starts): rows of whole keys, at least about `rows` of them, and the row at which each key begins. The
    batches are sorted by the column "key"."""
    held: list[pa.RecordBatch] = []

    def joined():
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        number = codes(batch.column("key"))
        return batch, np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            whole, starts = joined()
            held = [whole.slice(starts[-1])]
            if len(starts) > 1:
                yield whole.slice(0, starts[-1]), starts[:-1]
    if held:
        yield joined()


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def nearest(starts: np.ndarray, second: np.ndarray, places: list[np.ndarray], slack: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, dist): the rows of a key whose distance is up to `slack` times the key's least, i of the first table and j of
    the second. Each key goes along the axis of its greatest extent: its points meet those a step further, two steps and so
    on, while the gap on that axis leaves room for a pair in question."""
    n = len(second)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    with np.errstate(over="ignore"):
        extents = [np.maximum.reduceat(p, starts) - np.minimum.reduceat(p, starts) for p in places]
    along = np.choose(np.argmax(extents, axis=0)[group], places)
    order = np.lexsort((along, group))
    along, second, (x, y, z) = along[order], second[order], (p[order] for p in places)
    end = np.append(starts, n)[1:][group]

    def met(reach: np.ndarray, below):
        at, step = np.arange(n), 0
        with np.errstate(over="ignore"):
            while len(at):
                step += 1
                at = at[at + step < end[at]]
                at = at[below(along[at + step] - along[at], reach[group[at]])]
                a = at[second[at] != second[at + step]]
                b = a + step
                dx, dy, dz = x[a] - x[b], y[a] - y[b], z[a] - z[b]
                yield a, b, np.sqrt(dx * dx + dy * dy + dz * dz)

    least = np.full(len(starts), np.inf)
    for a, _, dist in met(least, np.less):  # least falls on the way
        np.minimum.at(least, group[a], dist)
    held, size = [], 0
    reach = least * slack
    for a, b, dist in met(reach, np.less_equal):
        hit = dist <= reach[group[a]]
        a, b, dist = a[hit], b[hit], dist[hit]
        held.append((order[np.where(second[a], b, a)], order[np.where(second[a], a, b)], dist))
        size += len(a)
        if size >= PASSED:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def neighbour_moments(starts: np.ndarray, places: list[np.ndarray], box: tuple[float, float, float], cutoff: float) -> tuple[np.ndarray, ...]:
    """(count, mean, m2, least) of each row's distances up to `cutoff` to its key's points, which repeat with the periods
    `box`. A pair is met once and counts at both ends.

    Where a period is more than twice the cutoff, one image alone can be near, and its distance is that of the places as
    given less whole periods. Else each image that can be near is met, by places within the box.
    """
    n, main = len(places[0]), int(np.argmax(box))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    inside = [p - np.floor(p / length) * length for p, length in zip(places, box, strict=True)]
    order = np.lexsort((inside[main], group))
    places, inside = [p[order] for p in places], [p[order] for p in inside]
    single = [2.000001 * cutoff < length for length in box]  # by more than the hair below
    # keys lie so far apart that no window reaches from one into another
    line = group * (4 * (box[main] + cutoff)) + inside[main]
    hair = 4 * np.spacing(line[-1]) + 1e-9 * cutoff
    count, mean, m2, least = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.full(n, np.inf)

    def add(at: np.ndarray, dist: np.ndarray) -> None:
        """Moments of one more part, merged about the common mean."""
        more = np.bincount(at, minlength=n)
        own = np.bincount(at, dist, minlength=n) / np.maximum(more, 1)
        off = dist - own[at]
        both = np.maximum(count + more, 1)
        apart = own - mean
        m2[:] += np.bincount(at, off * off, minlength=n) + apart * apart * (count * (more / both))
        mean[:] += apart * (more / both)
        count[:] += more
        np.minimum.at(least, at, dist)

    far = [1 if alone else int(cutoff // length) + 1 for alone, length in zip(single, box, strict=True)]
    images = [range(-m, m + 1) if k == main or not single[k] else (0,) for k, m in enumerate(far)]
    for image in itertools.product(*images):
        if image < (0, 0, 0):
            continue  # met from the other end
        shift = image[main] * box[main]
        low = np.searchsorted(line, line - shift - cutoff - hair, "left") if any(image) else np.arange(1, n + 1)
        high = np.searchsorted(line, line - shift + cutoff + hair, "right")
        before = np.concatenate([[0], np.cumsum(np.maximum(high - low, 0))])
        first = 0
        while before[first] < before[-1]:
            last = max(first + 1, int(np.searchsorted(before, before[first] + COMPARED, "right")) - 1)
            sizes = np.diff(before[first : last + 1])
            a = np.repeat(np.arange(first, last), sizes)
            b = np.arange(before[last] - before[first]) + np.repeat(low[first:last] - (before[first:last] - before[first]), sizes)
            squares = 0.0
            for k, length in enumerate(box):
                if single[k]:
                    d = places[k][a] - places[k][b]
                    d = d - length * np.rint(d / length)
                else:
                    d = inside[k][b] + image[k] * length - inside[k][a]
                squares = squares + d * d
            dist = np.sqrt(squares)
            hit = dist <= cutoff
            if hit.any():
                add(np.concatenate([a[hit], b[hit]]), np.tile(dist[hit], 2))
            first = last
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return count[back], mean[back], m2[back], least[back]


def key_states(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each key of the batch: points, the number of their neighbours, mean and m2 of all their distances, the
    most neighbours of a point and the least distance."""
    number = codes(batch.column("key"))
    keys, first = np.unique(number, return_index=True)
    n = len(keys)
    number = np.searchsorted(keys, number)
    weight = column(batch, "neighbours")
    some = weight > 0
    mean, m2, least = (np.where(some, column(batch, c), 0.0) for c in ("mean", "m2", "least"))
    bonds, most, nearest_of = np.bincount(number, weight, minlength=n), np.zeros(n, np.int64), np.full(n, np.inf)
    np.maximum.at(most, number, weight)
    np.minimum.at(nearest_of, number[some], least[some])
    centre = np.bincount(number, weight * mean, minlength=n) / np.maximum(bonds, 1)
    off = mean - centre[number]
    squares = np.bincount(number, np.where(some, m2 + weight * off * off, 0.0), minlength=n)
    none = bonds == 0
    states = [np.bincount(number, minlength=n), bonds.astype(np.int64), most]
    columns = [batch.column("key").take(pa.array(first)), *map(pa.array, states), *(pa.array(c, mask=none) for c in (centre, squares, nearest_of))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "points", "neighbours", "most", "mean", "m2", "least"])
