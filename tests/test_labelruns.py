"""Run tiles against the pixel tables they stand for."""

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from slidelake.operators import cells as C
from slidelake.operators import labelruns as R
from slidelake.operators.components import label_components
from slidelake.session import cut_lineage
from slidelake.sources.tilestore import payload_moves, write_tile_store

MASKS = "slide_id string, col int, row int, width int, height int, mask binary"
CLASSES = MASKS.replace("mask", "classes")
TILE = 8


def cut(slide, image):
    h, w = image.shape
    for y in range(0, h, TILE):
        for x in range(0, w, TILE):
            part = image[y:y + TILE, x:x + TILE]
            yield slide, x // TILE, y // TILE, part.shape[1], part.shape[0], bytearray(part.astype(np.uint8).tobytes())


@pytest.fixture(scope="module")
def images(spark):
    draw = np.random.default_rng(11)
    masks = {"noise": draw.random((29, 37)) < 0.55, "empty": np.zeros((5, 9), bool), "full": np.ones((17, 16), bool), "sparse": draw.random((40, 33)) < 0.15}
    kinds = {k: draw.integers(0, 5, m.shape) for k, m in masks.items()}
    mask_tiles = spark.createDataFrame([t for k, m in masks.items() for t in cut(k, m)], MASKS).repartition(3)
    class_tiles = spark.createDataFrame([t for k, m in kinds.items() for t in cut(k, m)], CLASSES).repartition(5)
    return mask_tiles, class_tiles


@pytest.fixture(scope="module")
def pixels(images):
    """The pixel tables of the same images."""
    labels = cut_lineage(label_components(images[0], TILE))
    kinds = R.run_pixels(R.tile_runs(images[1], TILE, "classes", "u1", None), "type")
    return labels, kinds


@pytest.fixture(scope="module")
def runs(images):
    return cut_lineage(R.label_runs(images[0], TILE))


def test_runs_hold_the_labelled_pixels(runs, pixels):
    assert rows(R.run_pixels(runs), "slide_id", "y", "x", "label") == rows(pixels[0], "slide_id", "y", "x", "label")
    assert runs.filter("exists(transform(starts, (s, i) -> i > 0 AND s <= starts[i - 1]), late -> late)").count() == 0
    assert pixels[1].count() == 29 * 37 + 5 * 9 + 17 * 16 + 40 * 33


def test_instances_from_runs(runs, pixels):
    rounded = lambda df: df.withColumns({c: F.round(c, 9) for c in ("cx", "cy")})
    names = ("slide_id", "label", "row_min", "row_max", "col_min", "col_max", "area", "cx", "cy")
    assert rows(rounded(R.run_instances(runs, TILE)), *names) == rows(rounded(C.instance_table(pixels[0])), *names)


@pytest.mark.parametrize("least", [0, 1, 2, 3, 10, 300, 10**6])
def test_small_components_go(runs, pixels, least):
    kept = R.run_pixels(R.remove_small_runs(runs, TILE, least))
    assert rows(kept, "slide_id", "x", "y", "label") == rows(C.remove_small(pixels[0], least), "slide_id", "x", "y", "label")


def test_types_of_stored_runs_move_counts_only(images, runs, pixels):
    labels = write_tile_store(runs, buckets=4, keys=R.PLACE)
    kinds = write_tile_store(R.tile_runs(images[1], TILE, "classes", "u1", None), buckets=4, keys=R.PLACE)
    types = R.run_types(labels, kinds)
    assert payload_moves(types, "starts") == [] and payload_moves(types, "other_starts") == []
    expect = rows(C.instance_types(*pixels), "slide_id", "label", "type", "type_prob")
    assert rows(types, "slide_id", "label", "type", "type_prob") == expect and len(expect) > 50


def test_tiles_without_payload_and_without_partner(spark):
    labels = spark.createDataFrame([("a", 0, 0, 2, 1, bytearray(np.array([5, 5], "<i8").tobytes())), ("a", 1, 0, 2, 1, None), ("b", 0, 0, 2, 1, bytearray(np.array([-1, 7], "<i8").tobytes()))],
                                   "slide_id string, col int, row int, width int, height int, labels binary")
    kinds = spark.createDataFrame([("a", 0, 0, 2, 1, bytearray([3, 4])), ("c", 0, 0, 1, 1, bytearray([1]))], CLASSES)
    runs, classes = R.tile_runs(labels, 2), R.tile_runs(kinds, 2, "classes", "u1", None)
    assert rows(R.run_pixels(runs), "slide_id", "x", "label") == [("a", 0, 5), ("a", 1, 5), ("b", 1, 7)]
    assert rows(R.overlap_counts(runs, classes), "slide_id", "label", "type", "n") == [("a", 5, 3, 1), ("a", 5, 4, 1)]
    assert R.run_types(runs.limit(0), classes).count() == 0 and R.remove_small_runs(runs.limit(0), 2).count() == 0


def test_runs_are_made_once_before_small_ones_go(images, runs):
    thinned = R.remove_small_runs(runs, 8, 5)
    assert thinned._jdf.queryExecution().sparkPlan().toString().count("MapInPandas") == 1
