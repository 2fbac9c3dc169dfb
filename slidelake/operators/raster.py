"""Drawing annotations onto transparent tiles."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.functions import parse_hex_color
from slidelake.operators.annotations import annotations_by_tile
from slidelake.operators.grouping import map_sorted_groups

# Fixed values of the drawing style.
FILL_ALPHA = 102
OUTLINE_ALPHA = 255
OUTLINE_WIDTH = 2
POINT_RADIUS = 6

TILE = ["slide_id", "level", "col", "row"]


def _window(low: np.ndarray, high: np.ndarray, size: int) -> tuple[int, int, int, int] | None:
    """Integer part of the canvas a shape can touch: x0, y0, x1, y1 (ends exclusive)."""
    x0, y0 = np.maximum(np.floor(low) - 1, 0).astype(int)
    x1, y1 = np.minimum(np.ceil(high) + 2, size).astype(int)
    return (x0, y0, x1, y1) if x0 < x1 and y0 < y1 else None


def _disc(box: tuple, x: float, y: float) -> tuple[np.ndarray, np.ndarray]:
    yy, xx = np.ogrid[box[1]:box[3], box[0]:box[2]]
    dist = (xx - x) ** 2 + (yy - y) ** 2
    inside = dist <= POINT_RADIUS**2
    return inside, inside & (dist > (POINT_RADIUS - OUTLINE_WIDTH) ** 2)


def _rectangle(box: tuple, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    yy, xx = np.ogrid[box[1]:box[3], box[0]:box[2]]
    inside = (xx >= low[0]) & (xx <= high[0]) & (yy >= low[1]) & (yy <= high[1])
    core = (
        (xx >= low[0] + OUTLINE_WIDTH) & (xx <= high[0] - OUTLINE_WIDTH)
        & (yy >= low[1] + OUTLINE_WIDTH) & (yy <= high[1] - OUTLINE_WIDTH)
    )
    return inside, inside & ~core


def _polygon(box: tuple, pts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Even-odd fill by scanline crossings, and a one-pixel outline."""
    x0, y0, x1, y1 = box
    inside = np.zeros((y1 - y0, x1 - x0), bool)
    edge = np.zeros_like(inside)
    nxt = np.roll(pts, -1, axis=0)
    xs = np.arange(x0, x1)
    for y in range(y0, y1):
        crosses = (pts[:, 1] <= y) != (nxt[:, 1] <= y)
        if crosses.any():
            p, q = pts[crosses], nxt[crosses]
            at = np.sort(p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]))
            inside[y - y0] = np.searchsorted(at, xs, side="right") % 2 == 1
    for p, q in zip(pts, nxt):
        part = _clip(p, q, size, size)
        if part is None:
            continue
        p, q = part
        n = int(np.ceil(np.abs(q - p).max())) + 1
        cx = np.rint(np.linspace(p[0], q[0], n)).astype(int)
        cy = np.rint(np.linspace(p[1], q[1], n)).astype(int)
        ok = (cx >= x0) & (cx < x1) & (cy >= y0) & (cy < y1)
        edge[cy[ok] - y0, cx[ok] - x0] = True
    return inside | edge, edge


def _clip(p: np.ndarray, q: np.ndarray, width: int, height: int):
    """Part of a segment near the canvas, or None: keeps long edges cheap."""
    t0, t1 = 0.0, 1.0
    d = q - p
    for axis, side in ((0, width), (1, height)):
        if d[axis] == 0:
            if not -1 <= p[axis] <= side:
                return None
            continue
        a, b = sorted(((-1 - p[axis]) / d[axis], (side - p[axis]) / d[axis]))
        t0, t1 = max(t0, a), min(t1, b)
    return (p + t0 * d, p + t1 * d) if t0 <= t1 else None


class _Layer:
    """One canvas with, per pixel, the order of the annotation on top."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.image = np.zeros((size, size, 4), np.uint8)
        self.top = np.full((size, size), np.iinfo(np.int64).min, np.int64)

    def paint(self, kind: str, pts: np.ndarray, rgb: tuple[int, int, int], seq: int) -> None:
        needed = {"point": 1, "rectangle": 2}.get(kind, 3)
        if len(pts) < needed:
            return
        used = pts[:needed] if kind in ("point", "rectangle") else pts
        low, high = used.min(axis=0), used.max(axis=0)
        pad = POINT_RADIUS if kind == "point" else 0
        box = _window(low - pad, high + pad, self.size)
        if box is None:
            return
        if kind == "point":
            area, edge = _disc(box, *pts[0])
        elif kind == "rectangle":
            area, edge = _rectangle(box, low, high)
        else:
            area, edge = _polygon(box, pts, self.size)
        x0, y0, x1, y1 = box
        image = self.image[y0:y1, x0:x1]
        image[area] = (*rgb, FILL_ALPHA)
        image[edge] = (*rgb, OUTLINE_ALPHA)
        self.top[y0:y1, x0:x1][area] = seq

    def merge(self, rgba: bytes, top: bytes) -> None:
        seq = np.frombuffer(top, np.int64).reshape(self.size, self.size)
        above = seq > self.top
        self.image[above] = np.frombuffer(rgba, np.uint8).reshape(self.size, self.size, 4)[above]
        self.top[above] = seq[above]


def rasterize_tiles(
    annotations: DataFrame, levels: DataFrame, tiles_wanted: DataFrame, order: str = "draw_order",
    chunk_rows: int = 5000, max_chunks: int = 64,
) -> DataFrame:
    """RGBA image of each wanted tile; a later annotation paints over an earlier one.

    A crowded tile is split into up to ``max_chunks`` chunks that different
    tasks draw, each streaming its annotations in drawing order onto a single
    canvas.  A chunk keeps the order of the annotation on top per pixel, so
    merging the few chunk layers gives the same picture as one pass.
    """
    wanted = tiles_wanted.select(*TILE).distinct()
    colored = annotations.withColumn("_rgb", parse_hex_color(F.col("color"))).withColumn(
        "draw_seq", F.col(order).cast("bigint")
    )
    wanted_levels = levels.join(
        wanted.select("slide_id", "level").distinct(), ["slide_id", "level"], "left_semi"
    )
    hits = annotations_by_tile(colored, wanted_levels).join(wanted, TILE, "left_semi")
    sizes = hits.groupBy(*TILE).agg(
        F.least(F.ceil(F.count(F.lit(1)) / F.lit(chunk_rows)), F.lit(max_chunks)).alias("_chunks")
    )
    shapes = hits.join(sizes, TILE).select(
        *TILE,
        F.pmod(F.xxhash64("draw_seq"), F.col("_chunks")).cast("int").alias("chunk"),
        "_chunks",
        "draw_seq", "type", "downsample", "tile_size",
        F.transform("coordinates", lambda p: p["x"]).alias("xs"),
        F.transform("coordinates", lambda p: p["y"]).alias("ys"),
        "_rgb.r", "_rgb.g", "_rgb.b",
    )
    def canvas_of(key: tuple, rows: Iterable) -> _Layer:
        layer = None
        for s in rows:
            if layer is None:
                layer = _Layer(int(s.tile_size))
                side = s.tile_size * s.downsample
            pts = np.column_stack([s.xs, s.ys]).astype(float).reshape(-1, 2)
            pts = (pts - (key[2] * side, key[3] * side)) / s.downsample
            layer.paint(s.type, pts, (s.r, s.g, s.b), s.draw_seq)
        return layer

    def draw(key: tuple, rows: Iterable) -> Iterable[tuple]:
        yield (*key, canvas_of(key, rows).image.tobytes())

    def draw_chunk(key: tuple, rows: Iterable) -> Iterable[tuple]:
        layer = canvas_of(key, rows)
        yield (*key, layer.size, layer.image.tobytes(), layer.top.tobytes())

    def merge(key: tuple, rows: Iterable) -> Iterable[tuple]:
        merged = None
        for layer in rows:
            merged = merged or _Layer(int(layer.size))
            merged.merge(layer.rgba, layer.top)
        yield (*key, merged.image.tobytes())

    sid = annotations.schema["slide_id"].dataType.simpleString()
    tile_schema = f"slide_id {sid}, level int, col int, row int"
    # Most tiles are one chunk and are drawn directly.
    single = map_sorted_groups(
        shapes.filter("_chunks = 1"), TILE, ["draw_seq"], draw, f"{tile_schema}, rgba binary", [*TILE, "rgba"]
    )
    layers = map_sorted_groups(
        shapes.filter("_chunks > 1"), [*TILE, "chunk"], ["draw_seq"], draw_chunk,
        f"{tile_schema}, chunk int, size int, rgba binary, top binary", [*TILE, "chunk", "size", "rgba", "top"],
    )
    merged = map_sorted_groups(layers, TILE, ["chunk"], merge, f"{tile_schema}, rgba binary", [*TILE, "rgba"])
    drawn = single.unionByName(merged)
    side = levels.select("slide_id", "level", "tile_size").distinct()
    blank = F.unhex(F.repeat(F.lit("00000000"), (F.col("tile_size") * F.col("tile_size")).cast("int")))
    return wanted.join(side, ["slide_id", "level"]).join(drawn, TILE, "left").select(
        *TILE, "tile_size", F.coalesce("rgba", blank).alias("rgba"),
        F.col("rgba").isNotNull().alias("has_annotations"),
    )
