"""A perceptual key for text, the counterpart of an image difference hash."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID_ROWS, GRID_COLS = 8, 9
#: Tokens whose cell a task remembers.
MAX_CELLS = 50_000
_SPLIT = re.compile("[^a-z0-9]+")


def grid_key(text: str, cells: dict[str, int]) -> str:
    """16 hex digits from the whole text.

    Every token falls into one of 8 x 9 cells by hash; a bit says whether a cell holds more
    tokens than its left neighbour. Small edits leave most comparisons as they were.
    """
    tokens = Counter(_SPLIT.split(text.lower()))
    del tokens[""]
    for token in tokens:
        if token not in cells:
            cells[token] = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % (GRID_ROWS * GRID_COLS)
    places = np.fromiter((cells[t] for t in tokens), dtype=np.int64, count=len(tokens))
    times = np.fromiter(tokens.values(), dtype=np.int64, count=len(tokens))
    counts = np.bincount(places, weights=times, minlength=GRID_ROWS * GRID_COLS)
    grid = counts.reshape(GRID_ROWS, GRID_COLS)
    return np.packbits((grid[:, 1:] > grid[:, :-1]).ravel()).tobytes().hex()


@F.arrow_udf(T.StringType())
def text_grid_key(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts are taken from the Arrow batch one at a time; nothing but their keys and a bounded cache is held."""
    cells: dict[str, int] = {}  # token cells repeat between texts
    for batch in texts:
        keys = []
        for text in batch:
            keys.append(None if not text.is_valid else grid_key(text.as_py(), cells))
            if len(cells) > MAX_CELLS:
                cells.clear()
        yield pa.array(keys, pa.string())
