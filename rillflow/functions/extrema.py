"""Local extrema of a sequence."""

from __future__ import annotations

import numpy as np


def local_extrema(values) -> tuple[list[float], list[int], list[float], list[int]]:
    """Maxima in descending and minima in ascending order, with their places. NaN is left out.

    A plateau counts once, at its middle. End points are extrema such that kinds alternate. Of a constant
    sequence the first place is both; of an empty one there are none.
    """
    v = np.asarray(values, float)
    at = np.flatnonzero(~np.isnan(v))
    if not len(at):
        return [], [], [], []
    x = v[at]
    if (x == x[0]).all():
        return [float(x[0])], [int(at[0])], [float(x[0])], [int(at[0])]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    last = np.append(first[1:], len(x)) - 1
    y, place = x[first], at[(first + last) // 2]
    rise = np.sign(np.diff(y))
    turn = np.flatnonzero(rise[1:] != rise[:-1]) + 1
    top = [int(k) for k in turn if rise[k - 1] > 0]
    low = [int(k) for k in turn if rise[k - 1] < 0]
    (low if rise[0] > 0 else top).append(0)
    (top if rise[-1] > 0 else low).append(len(y) - 1)
    top.sort(key=lambda k: (-y[k], k))
    low.sort(key=lambda k: (y[k], k))
    return [float(y[k]) for k in top], [int(place[k]) for k in top], [float(y[k]) for k in low], [int(place[k]) for k in low]
