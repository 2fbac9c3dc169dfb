"""Decoded images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels that go back to Spark at once; small images share a batch.
FLUSH_BYTES = 32 << 20


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decode image files to raw RGB rows; gray is repeated, a fourth band dropped.

    Returns ``(images, rejects)``; files that cannot be decoded are rejects.

    The JVM decodes the files (bands come as BGR), Python only reorders bands.
    """
    names = ["path", "width", "height", "rgb"]

    def to_rgb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for im in pdf.itertuples(index=False):
                px = np.frombuffer(im.data, np.uint8).reshape(im.height, im.width, im.bands)
                rgb = np.repeat(px, 3, axis=2) if im.bands == 1 else px[:, :, 2::-1]
                out.append((im.path, im.width, im.height, rgb.tobytes()))
                held += rgb.size
                if held > FLUSH_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    decoded = spark.read.format("image").option("dropInvalid", "false").load(path)
    bad = F.col("image.height") <= 0
    rejects = decoded.filter(bad).select(
        F.col("image.origin").alias("path"), F.lit("not a readable image").alias("reason")
    )
    images = decoded.filter(~bad).select(
        F.col("image.origin").alias("path"), "image.width", "image.height",
        F.col("image.nChannels").alias("bands"), "image.data",
    ).mapInPandas(to_rgb, "path string, width int, height int, rgb binary")
    return images, rejects
