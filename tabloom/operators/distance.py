"""Exact edit distances of pairs of texts, many pairs at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

FIRST_BAND, WIDER = 8, 4  # edits looked for at first, and by how much the band widens for the pairs that need more
CELLS = 1 << 20  # code points of one side held side by side


def within(a: Sequence[np.ndarray], b: Sequence[np.ndarray], band: int) -> np.ndarray:
    """Edit distance of each pair where it is ``band`` (even) or less, else -1; pairs come longest sum first.

    The table is filled by antidiagonals, for all pairs at once, and only for
    the diagonals no further than ``band`` from the main one: a path that
    leaves them costs more. Step t needs the two steps before; even steps
    hold the even diagonals and odd steps the odd ones.
    """
    half, total = band // 2, np.array([len(x) + len(y) for x, y in zip(a, b)])
    height = (int(total[0]) + band) // 2 + band + 2
    down, up = np.zeros((2, len(a), height), np.uint32)
    for r, (x, y) in enumerate(zip(a, b)):  # both sides begin after ``band`` blanks; the second one is laid upside down
        down[r, band : band + len(x)] = x[: height - band]
        up[r, height - band - len(y) : height - band] = y[::-1]
    down, up = np.ascontiguousarray(down.T), np.ascontiguousarray(up.T)
    kind, never = (np.int16, 1 << 14) if total[0] + band < 1 << 14 else (np.int32, 1 << 30)
    even, odd = np.full((band + 1, len(a)), never, kind), np.full((band + 2, len(a)), never, kind)
    even[half] = 0
    out, live = np.full(len(a), -1), len(a)
    ends = half + (np.array([len(x) for x in a]) * 2 - total) // 2  # slot of the last cell, of an odd sum one further
    for t in range(int(total[0]) + 1):
        # Slot s of an even step is the diagonal 2 s - band, of an odd one 2 s - band - 1; diagonals beyond t do not exist yet.
        table, other, shift = (odd, even, 1) if t % 2 else (even, odd, 0)
        reach = min(t, band - t % 2)
        reach -= (reach - t) % 2
        lo, hi = (band + shift - reach) // 2, (band + shift + reach) // 2 + 1
        if t:
            x = (t + 2 * lo - band - shift) // 2 - 1 + band
            y = height - band - (t - 2 * lo + band + shift) // 2
            n, cells = hi - lo, table[lo:hi, :live]
            cells += down[x : x + n, :live] != up[y : y + n, :live]
            near = np.minimum(other[lo - shift : hi - shift, :live], other[lo - shift + 1 : hi - shift + 1, :live])
            near += 1
            np.minimum(cells, near, out=cells)
        while live and total[live - 1] == t:
            live -= 1
            found = int(table[ends[live] + shift, live])
            out[live] = found if found <= band else -1
    return out


def distances(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    """Edit distance of each pair: in a band that widens until it holds the answer, so the work is length times distance."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)]).reshape(-1, 2)
    out, total, band = np.full(len(a), -1), sizes.sum(axis=1), FIRST_BAND
    while (open_ := np.flatnonzero(out < 0)).size:
        fit = open_[np.abs(sizes[open_, 0] - sizes[open_, 1]) <= band]
        fit = fit[np.argsort(-total[fit], kind="stable")]
        while fit.size:
            rows = max(1, CELLS // (int(total[fit[0]]) // 2 + 2 * band + 1))
            part, fit = fit[:rows], fit[rows:]
            out[part] = within([a[i] for i in part], [b[i] for i in part], band)
        band *= WIDER
    return out


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def edit_distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Over Arrow batches of two text columns: their edit distance in code points, null if one is null."""
    for left, right in batches:
        a, b = left.cast(pa.binary()).to_pylist(), right.cast(pa.binary()).to_pylist()
        out = [None if x is None or y is None else 0 for x, y in zip(a, b)]
        apart = [i for i, n in enumerate(out) if n == 0 and a[i] != b[i]]
        found = distances([code_points(a[i]) for i in apart], [code_points(b[i]) for i in apart])
        for i, n in zip(apart, found.tolist()):
            out[i] = n
        yield pa.array(out, pa.int32())
