import math

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from slidelake.operators import pixels as X
from slidelake.operators.pyramid import plan_levels

TILES = "slide_id bigint, level int, col int, row int, width int, height int, rgb binary"


def image(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def cut(spark, pixels, tile, level):
    h, w = pixels.shape[:2]
    df = spark.createDataFrame([(1, level, w, h, pixels.tobytes())], "slide_id bigint, level int, width int, height int, rgb binary")
    return X.cut_tiles(df, tile)


def join(found, h, w, tile):
    canvas = np.full((h, w, 3), 255, np.uint8)
    for t in found:
        part = np.frombuffer(t.rgb, np.uint8).reshape(t.height, t.width, 3)
        canvas[t.row * tile:t.row * tile + t.height, t.col * tile:t.col * tile + t.width] = part
    return canvas


def slide(spark, h, w, tile):
    return spark.createDataFrame([(1, w, h, tile)], "slide_id bigint, width int, height int, tile_size int")


def test_cutting_keeps_edges_and_strips_agree(spark):
    px = image(37, 50)
    tiles = cut(spark, px, 16, 0)
    assert sorted((r.col, r.row, r.width, r.height) for r in tiles.collect())[-1] == (3, 2, 2, 5)
    assert np.array_equal(join(tiles.collect(), 37, 50, 16), px)
    strips = spark.createDataFrame([(1, 0, 50, 32, 0, px[:32].tobytes()), (1, 0, 50, 5, 32, px[32:].tobytes())],
                                   "slide_id bigint, level int, width int, height int, y_offset int, rgb binary")
    assert rows(X.cut_tiles(strips, 16), "col", "row", "rgb") == rows(tiles, "col", "row", "rgb")


def halve(px):
    h, w = px.shape[:2]
    out = np.zeros(((h + 1) // 2, (w + 1) // 2, 3), np.uint8)
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            block = px[2 * y:2 * y + 2, 2 * x:2 * x + 2].reshape(-1, 3).astype(float)
            out[y, x] = np.floor(block.mean(axis=0) + 0.5)
    return out


def test_pyramid_against_whole_image_halving(spark):
    h, w, tile = 37, 51, 8
    px = image(h, w, 1)
    levels = plan_levels(slide(spark, h, w, tile))
    top = levels.agg(F.max("level")).first()[0]
    done = X.build_pyramid_tiles(cut(spark, px, tile, top), slide(spark, h, w, tile), levels).collect()
    for level in range(top, -1, -1):
        mine = join([t for t in done if t.level == level], px.shape[0], px.shape[1], tile)
        assert np.array_equal(mine, px), level
        px = halve(px)
    assert len([t for t in done if t.level == 0]) == 1


def test_missing_children_are_background(spark):
    px = np.zeros((16, 16, 3), np.uint8)
    levels = plan_levels(slide(spark, 16, 16, 8))
    base = cut(spark, px, 8, 1).filter("NOT (col = 1 AND row = 0)")
    parent = [t for t in X.build_pyramid_tiles(base, slide(spark, 16, 16, 8), levels).collect() if t.level == 0][0]
    got = np.frombuffer(parent.rgb, np.uint8).reshape(8, 8, 3)
    assert (got[:4, 4:] == 255).all() and (got[4:] == 0).all() and (got[:4, :4] == 0).all()


def lanczos_line(values, factor, count):
    """One-dimensional filter written out tap by tap."""
    out = []
    stretch = max(1 / factor, 1)
    kernel = lambda x: 1.0 if x == 0 else (3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2 if abs(x) < 3 else 0.0)
    for t in range(count):
        center = (t + 0.5) / factor - 0.5
        weights = [kernel((s - center) / stretch) for s in range(len(values))]
        out.append(sum(w * v for w, v in zip(weights, values)) / sum(weights))
    return np.array(out)


@pytest.mark.parametrize("factor", [0.5, 0.37, 1.0, 1.6])
def test_lanczos_over_tiles_equals_the_whole_image(spark, factor):
    h, w, tile = 29, 41, 8
    px = image(h, w, 2)
    done = X.resample_to(cut(spark, px, tile, 0), slide(spark, h, w, tile), F.lit(factor), out_tile_size=16).collect()
    oh, ow = int(h * factor + 0.5), int(w * factor + 0.5)
    middle = np.array([[lanczos_line(px[y, :, c].astype(float), factor, ow) for c in range(3)] for y in range(h)])  # h, 3, ow
    full = np.array([[lanczos_line(middle[:, c, x], factor, oh) for x in range(ow)] for c in range(3)])  # 3, ow, oh
    expected = np.clip(np.floor(full.transpose(2, 1, 0) + 0.5 + 1e-9), 0, 255).astype(np.uint8)
    assert np.array_equal(join(done, oh, ow, 16), expected)


def test_thumbnail_picks_the_cheapest_adequate_level(spark):
    h, w, tile = 48, 64, 8
    px = image(h, w, 3)
    s = slide(spark, h, w, tile)
    levels = plan_levels(s)
    sizes = X.thumbnail_sizes(s, levels, 20).first()
    assert (sizes.level, sizes.width, sizes.height, sizes.out_width, sizes.out_height) == (2, 32, 24, 20, 15)
    base = cut(spark, px, tile, 3)
    thumb = X.thumbnails(X.build_pyramid_tiles(base, s, levels), s, levels, 20, block=8).first()
    half = halve(px).astype(float)
    expected = np.zeros((15, 20, 3))
    for y in range(15):
        for x in range(20):
            y0, y1, x0, x1 = y * 1.6, (y + 1) * 1.6, x * 1.6, (x + 1) * 1.6
            wy = np.clip(np.minimum(np.arange(24) + 1, y1) - np.maximum(np.arange(24), y0), 0, None)
            wx = np.clip(np.minimum(np.arange(32) + 1, x1) - np.maximum(np.arange(32), x0), 0, None)
            expected[y, x] = np.einsum("i,ijc,j->c", wy, half, wx) / (wy.sum() * wx.sum())
    got = np.frombuffer(thumb.rgb, np.uint8).reshape(15, 20, 3)
    assert np.abs(got - expected).max() <= 0.5 + 1e-6
    # A slide smaller than the limit keeps its size.
    assert X.thumbnail_sizes(s, levels, 1024).select("level", "out_width", "out_height").first() == (3, 64, 48)


def test_zeros_of_the_kernel_feed_nothing():
    first, weights = X.axis_weights(5, 20, 1.0, "lanczos3")
    assert first + np.flatnonzero(weights) == [5] and weights.max() == 1.0


def test_frames_of_many_small_images_and_of_parts_of_big_ones(spark, monkeypatch):
    small = [(i, 0, 3, 2, bytes(range(i, i + 18))) for i in range(50)]
    images = spark.createDataFrame(small, "slide_id bigint, level int, width int, height int, rgb binary").coalesce(1)
    whole = rows(X.cut_tiles(images, 2), "slide_id", "col", "row", "width", "rgb")
    assert len(whole) == 100 and whole[1] == (0, 1, 0, 1, bytes([6, 7, 8, 15, 16, 17]))
    monkeypatch.setattr(X, "_FRAME_BYTES", 20)
    assert rows(X.cut_tiles(images, 2), "slide_id", "col", "row", "width", "rgb") == whole
