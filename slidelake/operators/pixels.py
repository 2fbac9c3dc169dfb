"""Cutting, shrinking and resampling tiles.

Shrinking and resampling are sums over source pixels, so each tile is reduced
where it lies and only its small contribution is shuffled; the tasks that meet
at a target tile just add.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake import schema as S
from slidelake.operators.grouping import map_sorted_groups
from slidelake.session import cut_lineage
from slidelake.sources.tilestore import wanted_tiles, with_slide_columns

TILE = ["slide_id", "level", "col", "row"]
_FRAME_BYTES = 16 << 20


def _sid(df: DataFrame) -> str:
    return df.schema["slide_id"].dataType.simpleString()


def _tile_schema(df: DataFrame) -> str:
    return f"slide_id {_sid(df)}, level int, col int, row int, width int, height int, rgb binary"


def cut_tiles(images: DataFrame, tile_size: int = S.TILE_SIZE) -> DataFrame:
    """Cut ``(slide_id, level, width, height, rgb[, y_offset])`` images into grid tiles.

    Edge tiles stay smaller.  Big images arrive as strips whose ``y_offset`` is a
    multiple of the tile size; every strip is cut on its own.
    """
    names = [*TILE, "width", "height", "rgb"]
    strips = images if "y_offset" in images.columns else images.withColumn("y_offset", F.lit(0))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0  # a frame may hold many small images, or part of a big one
            for im in pdf.itertuples(index=False):
                if im.y_offset % tile_size:
                    raise ValueError("strip offsets must be multiples of the tile size")
                pixels = np.frombuffer(im.rgb, np.uint8).reshape(im.height, im.width, 3)
                first_row = im.y_offset // tile_size
                for y in range(0, im.height, tile_size):
                    for x in range(0, im.width, tile_size):
                        part = pixels[y:y + tile_size, x:x + tile_size]
                        out.append((im.slide_id, im.level, x // tile_size, first_row + y // tile_size,
                                    part.shape[1], part.shape[0], part.tobytes()))
                    held += 3 * im.width * min(tile_size, im.height - y)
                    if held > _FRAME_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    return strips.select("slide_id", "level", "width", "height", "y_offset", "rgb").mapInPandas(
        cut, _tile_schema(images)
    )


def _halve(image: np.ndarray) -> np.ndarray:
    """2 x 2 mean, rounded half up; an odd last row or column averages what is there."""
    h, w = image.shape[:2]
    rows = np.add.reduceat(image.astype(np.int64), np.arange(0, h, 2), axis=0)
    sums = np.add.reduceat(rows, np.arange(0, w, 2), axis=1)
    ny = np.minimum(2, h - np.arange(0, h, 2))[:, None, None]
    nx = np.minimum(2, w - np.arange(0, w, 2))[None, :, None]
    n = ny * nx
    return ((2 * sums + n) // (2 * n)).astype(np.uint8)


#: What a tile needs to know of its slide to be shrunk: full size, tile size, finest level.
_FRAME = ["slide_width", "slide_height", "tile_size", "top"]


def _framed(tiles: DataFrame, slides: DataFrame, levels: DataFrame, only_top: bool) -> DataFrame:
    """Tiles with their slide's frame; one narrow join by tile key (see ``with_slide_columns``)."""
    tops = levels.groupBy("slide_id").agg(F.max("level").alias("top"), F.max("tile_size").alias("tile_size")).join(
        slides.select("slide_id", F.col("width").alias("slide_width"), F.col("height").alias("slide_height")), "slide_id"
    )
    tiles = tiles.select(*TILE, "width", "height", "rgb")
    if only_top:
        return with_slide_columns(tiles, tops.withColumn("level", F.col("top")), ["slide_id", "level"])
    return with_slide_columns(tiles, tops, ["slide_id"])


def _shrink_level(framed: DataFrame) -> DataFrame:
    """Tiles of the next coarser level with their frames; halves meet at their parent, nothing is joined."""
    sid = _sid(framed)
    frame = ", ".join(f"{c} int" for c in _FRAME)
    names = [*TILE, "dx", "dy", "width", "height", "rgb", *_FRAME]

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                small = _halve(np.frombuffer(t.rgb, np.uint8).reshape(t.height, t.width, 3))
                out.append((t.slide_id, t.level - 1, t.col // 2, t.row // 2, t.col % 2, t.row % 2, small.shape[1], small.shape[0],
                            small.tobytes(), *(getattr(t, c) for c in _FRAME)))
            yield pd.DataFrame(out, columns=names)

    halves = framed.filter(F.col("level") > 0).select(*TILE, "width", "height", "rgb", *_FRAME).mapInPandas(
        shrink, f"slide_id {sid}, level int, col int, row int, dx int, dy int, width int, height int, rgb binary, {frame}",
    )

    def compose(key: tuple, rows: Iterable) -> Iterable[tuple]:
        canvas = None
        for t in rows:
            if canvas is None:
                size, shrunk = int(t.tile_size), 1 << int(t.top - key[1])
                if size % 2:
                    raise ValueError("2 x 2 shrinking needs an even tile size")
                width = min(size, -(-int(t.slide_width) // shrunk) - key[2] * size)
                height = min(size, -(-int(t.slide_height) // shrunk) - key[3] * size)
                canvas = np.full((height, width, 3), S.BACKGROUND, np.uint8)
                told = tuple(int(getattr(t, c)) for c in _FRAME)
            x, y = t.dx * size // 2, t.dy * size // 2
            canvas[y:y + t.height, x:x + t.width] = np.frombuffer(t.rgb, np.uint8).reshape(t.height, t.width, 3)
        yield (*key, width, height, canvas.tobytes(), *told)

    return map_sorted_groups(
        halves, TILE, [], compose, f"{_tile_schema(framed)}, {frame}", [*TILE, "width", "height", "rgb", *_FRAME],
    )


def downsample_level(tiles: DataFrame, slides: DataFrame, levels: DataFrame) -> DataFrame:
    """Tiles of the next coarser level from the tiles of one level.

    Each tile is halved before the shuffle, so a quarter of the pixels moves; a
    parent has at most four children.  Missing children leave background; a
    parent without any stored child stays missing.
    """
    return _shrink_level(_framed(tiles, slides, levels, False)).drop(*_FRAME)


def build_pyramid_tiles(base: DataFrame, slides: DataFrame, levels: DataFrame, written: bool = False) -> DataFrame:
    """All levels from the finest tiles of each slide.

    The loop runs from the deepest slide's finest level down; slides of less
    depth join in when their own finest level is reached.  Each level is
    checkpointed: it is a quarter of the one before and feeds the next step.
    ``base`` is read once per level, so it is written first unless it is a
    ``written`` table already (see ``write_tile_store``).
    """
    base = base.select(*TILE, "width", "height", "rgb")
    base = _framed(base if written else cut_lineage(base), slides, levels, True)
    tops = [r.level for r in levels.groupBy("slide_id").agg(F.max("level").alias("level")).select("level").distinct().collect()]  # some ten numbers
    result = base
    current = base.filter(F.col("level") == max(tops, default=0))
    for level in range(max(tops, default=0) - 1, -1, -1):
        current = cut_lineage(_shrink_level(current))
        result = result.unionByName(current)
        if level in tops:
            current = current.unionByName(base.filter(F.col("level") == level))
    return result.drop(*_FRAME)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def axis_weights(target: int, source: int, factor: float, kernel: str) -> tuple[int, np.ndarray]:
    """First source index and normalised weights that feed one target pixel.

    Taps outside the image are left out and the rest is rescaled to sum 1.
    """
    step = 1.0 / factor
    if kernel == "box":
        low, high = target * step, min((target + 1) * step, source)
        first, last = int(np.floor(low)), int(np.ceil(high))
        at = np.arange(first, max(last, first + 1))
        weights = np.minimum(at + 1, high) - np.maximum(at, low)
    elif kernel == "lanczos3":
        stretch = max(step, 1.0)
        center = (target + 0.5) * step - 0.5
        first = max(0, int(np.ceil(center - 3 * stretch)))
        last = min(source - 1, int(np.floor(center + 3 * stretch)))
        at = np.arange(first, last + 1)
        weights = _lanczos((at - center) / stretch)
        weights[np.abs(weights) < 1e-12] = 0.0  # zeros of the kernel but for float noise: such taps feed nothing
    else:
        raise ValueError("kernel is 'lanczos3' or 'box'")
    return first, weights / weights.sum()


def _reach(kernel: str, factor: Column) -> Column:
    """Farthest source distance, in source px, that still feeds a target pixel."""
    step = F.lit(1.0) / factor
    return step + 1 if kernel == "box" else F.greatest(step, F.lit(1.0)) * 3 + 1


def _axis_matrix(start: int, count: int, origin: int, length: int, source: int, factor: float, kernel: str):
    """Weights of the source px ``origin..`` for the target px ``start..``, one row per target px."""
    rows = np.zeros((count, length))
    for i in range(count):
        first, weights = axis_weights(start + i, source, factor, kernel)
        a, b = max(first, origin), min(first + len(weights), origin + length)
        if a < b:
            rows[i, a - origin:b - origin] = weights[a - first:b - first]
    return rows


def _contribution(tile: np.ndarray, x0: int, y0: int, target: tuple, dims: tuple, factors: tuple, matrix):
    """Weighted sums of one source tile for the px of one target tile it reaches.

    Values are taken relative to the white background, so absent tiles add 0.
    """
    h, w = tile.shape[:2]
    tx, ty, tw, th = target
    mx = matrix(tx, tw, x0, w, dims[0], factors[0])
    my = matrix(ty, th, y0, h, dims[1], factors[1])
    used_x, used_y = np.flatnonzero(mx.any(axis=1)), np.flatnonzero(my.any(axis=1))
    if not len(used_x) or not len(used_y):
        return None
    xa, xb, ya, yb = used_x[0], used_x[-1] + 1, used_y[0], used_y[-1] + 1
    sums = np.einsum("ij,jkc,lk->ilc", my[ya:yb], tile.astype(float) - 255.0, mx[xa:xb], optimize=True)
    return int(xa), int(ya), sums


def resample(
    tiles: DataFrame, sizes: DataFrame, kernel: str = "lanczos3", out_tile_size: int = S.TILE_SIZE
) -> DataFrame:
    """Resample the given tiles of each slide to a new grid.

    ``sizes(slide_id, tile_size, width, height, factor_x, factor_y, out_width,
    out_height)`` describes the image the tiles belong to and the result.  A
    source tile is multiplied with the kernel once per target tile it reaches;
    the partial sums of a target tile are added in a fixed order.
    """
    joined = with_slide_columns(
        tiles.select(*TILE, "width", "height", "rgb"), sizes.withColumnsRenamed({"width": "src_width", "height": "src_height"}), ["slide_id"]
    )

    def target(edge: Column, factor: Column, out: Column) -> Column:
        last = F.floor((out - 1) / F.lit(out_tile_size))
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.floor(edge * factor / F.lit(out_tile_size)), last))

    x0, y0 = F.col("col") * F.col("tile_size"), F.col("row") * F.col("tile_size")
    rx, ry = _reach(kernel, F.col("factor_x")), _reach(kernel, F.col("factor_y"))
    keyed = joined.withColumns(
        {
            "tc": F.sequence(
                target(x0 - rx, F.col("factor_x"), F.col("out_width")),
                target(x0 + F.col("width") + rx, F.col("factor_x"), F.col("out_width")),
            ),
            "tr": F.sequence(
                target(y0 - ry, F.col("factor_y"), F.col("out_height")),
                target(y0 + F.col("height") + ry, F.col("factor_y"), F.col("out_height")),
            ),
        }
    )
    names = ["slide_id", "tc", "tr", "col", "row", "tw", "th", "dx", "dy", "pw", "ph", "sums"]

    def contribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Tiles of one grid column or row share their weights.
        matrix = functools.lru_cache(maxsize=256)(
            lambda *args: _axis_matrix(*args, kernel)
        )
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                image = np.frombuffer(t.rgb, np.uint8).reshape(t.height, t.width, 3)
                for tr in t.tr:
                    for tc in t.tc:
                        tx, ty = int(tc) * out_tile_size, int(tr) * out_tile_size
                        tw, th = min(out_tile_size, t.out_width - tx), min(out_tile_size, t.out_height - ty)
                        part = _contribution(
                            image, t.col * t.tile_size, t.row * t.tile_size, (tx, ty, tw, th),
                            (t.src_width, t.src_height), (t.factor_x, t.factor_y), matrix,
                        )
                        if part is not None:
                            dx, dy, sums = part
                            out.append((t.slide_id, tc, tr, t.col, t.row, tw, th, dx, dy,
                                        sums.shape[1], sums.shape[0], sums.tobytes()))
            yield pd.DataFrame(out, columns=names)

    sid = _sid(tiles)
    parts = keyed.select(
        "slide_id", "col", "row", "width", "height", "rgb", "tile_size", "src_width", "src_height",
        "factor_x", "factor_y", "out_width", "out_height", "tc", "tr",
    ).mapInPandas(
        contribute,
        f"slide_id {sid}, tc int, tr int, col int, row int, tw int, th int, dx int, dy int, pw int, ph int, sums binary",
    )

    def add(key: tuple, rows: Iterable) -> Iterable[tuple]:
        canvas = None
        for p in rows:  # sorted by source tile, so sums are the same in every run
            if canvas is None:
                canvas = np.full((int(p.th), int(p.tw), 3), 255.0)
            canvas[p.dy:p.dy + p.ph, p.dx:p.dx + p.pw] += np.frombuffer(p.sums).reshape(p.ph, p.pw, 3)
        # The guard keeps values that are exact halves but for float noise on one side.
        image = np.clip(np.floor(canvas + 0.5 + 1e-9), 0, 255).astype(np.uint8)
        yield (*key, image.shape[1], image.shape[0], image.tobytes())

    return map_sorted_groups(
        parts, ["slide_id", "tc", "tr"], ["row", "col"], add,
        f"slide_id {sid}, col int, row int, width int, height int, rgb binary",
        ["slide_id", "col", "row", "width", "height", "rgb"],
    )


def resample_to(tiles: DataFrame, slides: DataFrame, factor: Column, kernel: str = "lanczos3",
                out_tile_size: int = S.TILE_SIZE) -> DataFrame:
    """Resample each slide's full-resolution tiles by a factor, e.g. that of ``plan_resize``."""
    sizes = slides.select(
        "slide_id", "tile_size", "width", "height",
        factor.cast("double").alias("factor_x"), factor.cast("double").alias("factor_y"),
        F.greatest(F.lit(1), F.round(F.col("width") * factor)).cast("int").alias("out_width"),
        F.greatest(F.lit(1), F.round(F.col("height") * factor)).cast("int").alias("out_height"),
    )
    return resample(tiles, sizes, kernel, out_tile_size)


def thumbnail_sizes(slides: DataFrame, levels: DataFrame, max_size: int = S.THUMBNAIL_MAX_SIZE) -> DataFrame:
    """Cheapest adequate level per slide, its size and the thumbnail's size."""
    w = F.ceil(F.col("_w") / F.col("downsample")).cast("int")
    h = F.ceil(F.col("_h") / F.col("downsample")).cast("int")
    sized = levels.join(
        slides.select("slide_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "slide_id"
    ).select("slide_id", "level", "downsample", "tile_size", w.alias("width"), h.alias("height"))
    adequate = F.greatest("width", "height") >= max_size
    pick = F.struct("level", "tile_size", "width", "height")
    chosen = sized.groupBy("slide_id").agg(
        F.coalesce(
            F.max_by(F.when(adequate, pick), F.when(adequate, F.col("downsample"))),
            F.min_by(pick, "downsample"),
        ).alias("c")
    ).select("slide_id", "c.*")
    scale = F.least(F.lit(1.0), F.lit(float(max_size)) / F.greatest("width", "height"))
    out = lambda side: F.greatest(F.lit(1), F.round(F.col(side) * scale)).cast("int")
    return chosen.withColumn("out_width", out("width")).withColumn("out_height", out("height")).withColumn(
        "factor_x", F.col("out_width") / F.col("width")
    ).withColumn("factor_y", F.col("out_height") / F.col("height"))


def thumbnails(tiles: DataFrame, slides: DataFrame, levels: DataFrame,
               max_size: int = S.THUMBNAIL_MAX_SIZE, block: int = 256) -> DataFrame:
    """One small image per slide, area-averaged from the cheapest adequate level.

    The level's tiles shrink where they lie; what meets per slide is at most
    ``max_size`` x ``max_size`` px, whatever the slide's size.
    """
    sizes = thumbnail_sizes(slides, levels, max_size)
    used = wanted_tiles(tiles, sizes, ["slide_id", "level"])
    parts = resample(used, sizes.drop("level"), "box", block)
    # What is left of the pixels meets one frame row per slide; nothing is joined.
    frames = sizes.select("slide_id", "out_width", "out_height").withColumn("part", F.lit(0))
    shrunk = parts.withColumnRenamed("rgb", "shrunk").withColumn("part", F.lit(1))

    def assemble(key: tuple, rows: Iterable) -> Iterable[tuple]:
        canvas = None
        for p in rows:
            if p.part == 0:
                canvas = np.full((int(p.out_height), int(p.out_width), 3), S.BACKGROUND, np.uint8)
            else:
                w, h = int(p.width), int(p.height)
                x, y = int(p.col) * block, int(p.row) * block
                canvas[y:y + h, x:x + w] = np.frombuffer(p.shrunk, np.uint8).reshape(h, w, 3)
        yield (*key, canvas.shape[1], canvas.shape[0], canvas.tobytes())

    return map_sorted_groups(
        frames.unionByName(shrunk, allowMissingColumns=True), ["slide_id"], ["part"], assemble,
        f"slide_id {_sid(tiles)}, width int, height int, rgb binary", ["slide_id", "width", "height", "rgb"],
    )
