"""Windows of bytes and the anchors by which equal windows meet."""

from __future__ import annotations

import numpy as np

#: Bytes of a window, and of the grams whose smallest hash is its anchor.
WINDOW, GRAM = 50, 24
#: Windows that are looked at together.
TILE = 1 << 15
_STEPS = (1, 2, 4, 8)
_TABLE = np.random.default_rng(50).integers(1 << 63, size=256, dtype=np.uint64)
_MIX = np.random.default_rng(24).integers(1 << 63, size=8, dtype=np.uint64) | np.uint64(1)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (24) bytes at each place that has as many."""
    h = _TABLE[data]
    sizes = {}
    for k, step in enumerate(_STEPS):
        h = h[:-step] * _MIX[k] + h[step:]
        sizes[2 * step] = h
    h = sizes[16][: len(data) - GRAM + 1] * _MIX[4] + sizes[8][16 : len(data) - GRAM + 17]
    h ^= h >> np.uint64(29)
    h *= _MIX[5]
    h ^= h >> np.uint64(32)
    return h


def _anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of the window at each place that has one."""
    least, wide, span = _grams(data), WINDOW - GRAM + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = wide - span
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, first, count, text)``: the windows of the texts that end at
    ``ends``, in runs of ``count`` neighbours that share their anchor.

    An anchor depends on the window's bytes alone. A run is of one text and has at
    most WINDOW - GRAM + 1 windows, also where a text repeats itself."""
    none = np.empty(0, np.int64)
    if len(data) < WINDOW:
        return none.astype(np.uint64), none, none, none
    wide = WINDOW - GRAM + 1
    # in tiles that stay in the processor's cache
    least = np.concatenate([_anchors(data[at : at + TILE + WINDOW - 1]) for at in range(0, len(data) - WINDOW + 1, TILE)])
    sizes = np.diff(ends, prepend=0)
    counts = np.maximum(sizes - WINDOW + 1, 0)
    begins = ends - sizes
    edge = np.zeros(len(data) + 1, bool)
    edge[1 : len(least)] = least[1:] != least[:-1]
    edge[0] = edge[begins] = edge[begins + counts] = True
    first = np.flatnonzero(edge[: len(least)])
    size = np.diff(first, append=len(least))
    text = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(first, ends), prepend=0))
    real = first < (begins + counts)[text]
    first, size = first[real], size[real]
    parts = -(-size // wide)
    which = np.repeat(np.arange(len(first)), parts)
    skip = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * wide
    first, size, text = first[which] + skip, np.minimum(size[which] - skip, wide), text[real][which]
    return least[first], first, size, text
