"""Feature extraction over image rows, as Arrow jobs.

Input rows carry ``height, width, nChannels, data`` as Spark's image source yields them.
Pixels go in and a few numbers come out before anything is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineguard import params
from lineguard.functions import pixels

IMAGE_COLUMNS = ("height", "width", "nChannels", "data")
#: Images whose results are held at a time, whatever the size of an Arrow batch.
SLICE = 256


def map_images(
    df: DataFrame, keep: Sequence[str], fields: Sequence[T.StructField], fn: Callable[[np.ndarray], tuple]
) -> DataFrame:
    """Apply *fn* to the gray image of every row; an undecoded row gets nulls.

    Results leave the task in slices: a descriptor can be many times the size of its image.
    """
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    empty = (None,) * len(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                pdf = batch.iloc[start : start + SLICE]
                rows = [
                    fn(pixels.decode_row(h, w, c, d)) if h > 0 and w > 0 else empty
                    for h, w, c, d in zip(*(pdf[c] for c in IMAGE_COLUMNS))
                ]
                made = pd.DataFrame(rows, columns=[f.name for f in fields], index=pdf.index)
                yield pd.concat([pdf[list(keep)], made], axis=1)

    return df.select(*keep, *[c for c in IMAGE_COLUMNS if c not in keep]).mapInPandas(run, schema)


def _doubles(names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def image_statistics(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The seven statistics per image."""
    return map_images(df, keep, _doubles(params.FEATURE_NAMES), pixels.statistics)


def image_profile(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Statistics and difference hash from one decode."""
    fields = [*_doubles(params.FEATURE_NAMES), T.StructField("dhash", T.StringType())]
    return map_images(df, keep, fields, lambda g: (*pixels.statistics(g), pixels.difference_hash(g)))


def image_dhash(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    field = T.StructField("dhash", T.StringType())
    return map_images(df, keep, [field], lambda g: (pixels.difference_hash(g),))


def gray_pixels(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Row-major gray values in [0, 1]."""
    field = T.StructField("px", T.ArrayType(T.DoubleType()))
    return map_images(df, keep, [field], lambda g: (g.ravel(),))


def hog_features(
    df: DataFrame, keep: Sequence[str], *, resize: int | None = None, cell: int = 16, bins: int = 9, block: int = 2
) -> DataFrame:
    """HOG descriptor per image, optionally after a square resize."""
    field = T.StructField("hog", T.ArrayType(T.DoubleType()))

    def describe(g: np.ndarray) -> tuple:
        if resize:
            g = pixels.area_resize(g, resize, resize)
        return (pixels.hog(g, cell, bins, block),)

    return map_images(df, keep, [field], describe)


def preprocess(
    df: DataFrame,
    keep: Sequence[str],
    *,
    resize: int = params.PREPROCESS["resize"],
    mean: float = params.PREPROCESS["mean"],
    std: float = params.PREPROCESS["std"],
) -> DataFrame:
    """Gray, square resize, then ``(x - mean) / std``, row-major."""
    field = T.StructField("tensor", T.ArrayType(T.FloatType()))

    def prepare(g: np.ndarray) -> tuple:
        out = (pixels.area_resize(g, resize, resize) - mean) / std
        return (out.astype(np.float32).ravel(),)

    return map_images(df, keep, [field], prepare)


def gradient_key(df: DataFrame, px: str, height: int, width: int, name: str = "dhash") -> DataFrame:
    """Gradient key of a gray pixel array without resizing, in column expressions only."""
    places = [r * width + c for r in range(height) for c in range(width - 1)]
    spots = F.array(*[F.lit(p) for p in places])
    bits = F.transform(spots, lambda i: F.when(F.get(px, i + 1) > F.get(px, i), "1").otherwise("0"))
    digits = -(-len(places) // 4)
    text = F.lower(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), digits, "0"))
    return df.withColumn(name, text)


def feature_vector(df: DataFrame, names: Sequence[str] = params.FEATURE_NAMES, out: str = "features") -> DataFrame:
    """Statistics as one array in canonical order."""
    return df.withColumn(out, F.array(*[F.col(n).cast("double") for n in names]))
