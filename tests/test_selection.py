"""Medians by counting against the engine's own."""

import math
import random

from pyspark.sql import functions as F

from slidelake.operators.selection import exact_medians

NAN, INF = math.nan, math.inf


def test_medians_equal_the_builtin(spark):
    draw = random.Random(6)
    data = {
        None: [3.0, 1.0, 2.0], "one": [5.0], "two": [1.0, 2.0], "none": [None, None], "some": [None, 4.0, None, 8.0],
        "same": [7.5] * 40, "heap": [0.0] * 30 + [draw.gauss(0, 1) for _ in range(25)],
        "wide": [10.0 ** draw.uniform(-300, 300) * draw.choice((-1, 1)) for _ in range(301)],
        "ends": [-1.7e308, 1.7e308, 1.6e308, -1.6e308], "tiny": [5e-324, 0.0, 1e-323], "tiny pair": [5e-324, 0.0, 1e-323, 1.5e-323],
        "infinite": [-INF, -INF, 1.0, INF], "high": [1.0, INF, INF, INF], "nan": [1.0, NAN, 2.0], "half nan": [1.0, NAN], "mostly nan": [NAN, NAN, NAN, 1.0],
        "whole": [float(draw.randrange(50)) for _ in range(1000)],
    }
    rows = [(k, v) for k, values in data.items() for v in values]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r.m for r in exact_medians(df, ["k"], "v", "m").collect()}
    expected = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in expected.items()}


def test_no_rows(spark):
    assert exact_medians(spark.createDataFrame([], "a int, b string, v int"), ["a", "b"], "v").count() == 0
