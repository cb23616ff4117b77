"""Images as structs of height, width, channels and pixel bytes, row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = T.StructType([T.StructField("origin", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("nChannels", T.IntegerType()), T.StructField("mode", T.IntegerType()), T.StructField("data", T.BinaryType())])
#: Spark's modes of images by channels.
MODES = {1: 0, 3: 16, 4: 24}


def to_vector(image: Column) -> Column:
    """The pixels of an image as numbers, row by row and channel by channel."""

    @F.pandas_udf("array<double>")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else np.frombuffer(b, np.uint8).astype(float), na_action="ignore")

    return run(image["data"])


def from_vector(cells: Column, width: int, height: int, channels: int) -> Column:
    """An image of pixels held as numbers, cut off at 0 and 255; null for another number of them."""
    n = width * height * channels

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or len(v) != n else np.clip(np.nan_to_num(np.asarray(v, float)), 0, 255).astype(np.uint8).tobytes(), na_action="ignore")

    data = run(cells)
    return F.when(data.isNotNull(), F.struct(F.lit("").alias("origin"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("nChannels"), F.lit(MODES[channels]).alias("mode"), data.alias("data")))


def resized(image: Column, width: int, height: int, channels: int | None = None) -> Column:
    """The image at another size by nearest pixels; grey from the mean of channels, colours from repeated grey."""

    def one(row) -> tuple | None:
        if row is None or row["data"] is None:
            return None
        x = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
        x = x[np.arange(height) * row["height"] // height][:, np.arange(width) * row["width"] // width]
        n = channels or row["nChannels"]
        if n != x.shape[2]:
            grey = x[:, :, :3].mean(axis=2, keepdims=True) if x.shape[2] >= 3 else x
            x = x[:, :, :3] if n == 3 and x.shape[2] == 4 else np.concatenate([x, np.full((height, width, 1), 255)], 2) if n == 4 and x.shape[2] == 3 else np.repeat(grey, n, 2)
        return row["origin"], height, width, n, MODES[n], np.ascontiguousarray(x.astype(np.uint8)).tobytes()

    return F.udf(one, IMAGE)(image)


def mean_image(images: DataFrame, column: str = "image") -> tuple[int, int, int, bytes] | None:
    """(height, width, channels, pixels) of the mean of images of one size; tasks add up their own first."""
    kinds = images.select(f"{column}.height", f"{column}.width", f"{column}.nChannels").where("height is not null").distinct().limit(2).collect()
    if not kinds:
        return None
    if len(kinds) > 1:
        raise ValueError("images have different sizes")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for batch in batches:
            for b in batch["data"].dropna():
                x = np.frombuffer(b, np.uint8).astype(np.int64)
                total, n = (x if total is None else total + x), n + 1
        if n:
            yield pd.DataFrame({"total": [total.astype("<i8").tobytes()], "n": [n]})

    parts = images.select(F.col(f"{column}.data").alias("data")).mapInPandas(sums, "total binary, n long")
    total, n = 0, 0
    for r in parts.toLocalIterator():  # one row for each task
        total, n = total + np.frombuffer(r.total, "<i8"), n + r.n
    h, w, c = kinds[0]
    return h, w, c, (total / n).round().astype(np.uint8).tobytes()
