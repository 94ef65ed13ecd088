"""Arrow batches taken in parts, so that what a function holds follows a part and not the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words that a function over texts works on at a time.
WORDS = 1 << 18


def parts(size: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` (WORDS) in all: less than that beside the first row of each."""
    cut = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // (most or WORDS))) + 1
    bounds = [0, *cut.tolist(), len(size)]
    return ((a, b) for a, b in zip(bounds, bounds[1:]) if a < b)
