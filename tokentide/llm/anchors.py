"""Locally least keys: equal runs of keys choose the same places, wherever they stand."""

from __future__ import annotations

import numpy as np

_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """For each i with a whole window keys[i:i+width]: the place of its least key, the first of equals.

    Keys are compared by their upper 40 bits. Runs of more than 2**24 keys are worked through in parts.
    """
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    most = (1 << _PLACE_BITS) - width
    if n > most:
        parts = [least_places(keys[a : a + most + width - 1], width) + a for a in range(0, n, most)]
        return np.concatenate(parts)
    low = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:n], low[width - span : width - span + n])
    return (low[:n] & _PLACE).astype(np.int64)


def anchors(keys: np.ndarray, width: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows whose starts are flagged in `wanted`: place, first and last window start they stand for.

    Each wanted start belongs to exactly one row of the result, and the starts of a row are consecutive.
    """
    place = least_places(keys, width)
    starts = np.flatnonzero(wanted[: len(place)])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return at[first], starts[first], starts[last]
