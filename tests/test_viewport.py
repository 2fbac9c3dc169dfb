import random

import pytest
from compare import rows
from pyspark.sql import functions as F

from slidelake.operators import levels as L
from slidelake.operators import regions as R
from slidelake.operators import viewport as V
from slidelake.operators.ordering import number_rows, previous_row, running_sums
from slidelake.operators.skew import salted_join

VIEW = ("viewport_id bigint, slide_id bigint, x double, y double, width double, height double, scale double, "
        "velocity_x double, velocity_y double")


def views(spark, *items):
    return spark.createDataFrame([(i, 1, *map(float, v), *([0.0] * (7 - len(v)))) for i, v in enumerate(items)], VIEW)


@pytest.mark.parametrize("scale, level", [(1.0, 2), (0.5, 1), (0.25, 0), (0.6, 2), (0.3, 1), (0.75, 2), (0.1, 0), (2.0, 2)])
def test_level_for_scale(spark, three_levels, scale, level):
    df = views(spark, (0, 0, 10, 10, scale))
    assert L.level_for_scale(df, three_levels).first().level_info.level == level


def test_scale_zero_or_less_has_no_tiles(spark, three_levels):
    assert V.visible_tiles(views(spark, (0, 0, 10, 10, 0), (0, 0, 10, 10, -1)), three_levels).count() == 0


@pytest.mark.parametrize("mpp, level", [(8.0, 0), (2.0, 0), (1.5, 1), (0.5, 2), (0.1, 2)])
def test_level_for_mpp(spark, three_levels, mpp, level):
    df = spark.createDataFrame([(1, mpp)], "slide_id bigint, target_mpp double")
    assert L.level_for_mpp(df, three_levels).first().level_info.level == level


def test_level_lookup(spark, three_levels):
    df = spark.createDataFrame([(1, 1), (1, 9)], "slide_id bigint, level int")
    assert rows(L.level_info(df, three_levels, "default"), "level", "downsample", "cols", "rows") == [(1, 2, 2, 2), (9, 1, 0, 0)]
    with pytest.raises(Exception, match="Unknown level: 9"):
        L.level_info(df, three_levels).collect()


def test_both_edge_rules(spark, three_levels):
    df = views(spark, (0, 0, 512, 512, 1.0))
    assert V.visible_tiles(df, three_levels, "trunc").count() == 4
    assert V.visible_tiles(df, three_levels, "ceil").count() == 1
    # Truncation lets a right edge just left of the slide reach column 0.
    left = views(spark, (-600, 0, 500, 100, 1.0))
    assert V.visible_tiles(left, three_levels, "trunc").count() == 1
    assert V.visible_tiles(left, three_levels, "ceil").count() == 0


def test_viewports_beyond_the_slide_see_nothing(spark, three_levels):
    df = views(spark, (15000, 15000, 1024, 1024, 1.0), (-5000, -5000, 1024, 1024, 1.0))
    for edge in ("trunc", "ceil"):
        assert V.visible_tiles(df, three_levels, edge).count() == 0


@pytest.mark.parametrize("tile, place", [((0, 0, 0), (0, 0, 2048, 2048)), ((2, 0, 0), (0, 0, 512, 512)), ((2, 1, 0), (512, 0, 512, 512)), ((1, 0, 0), (0, 0, 1024, 1024))])
def test_tile_position(spark, three_levels, square_slide, tile, place):
    tiles = spark.createDataFrame([(1, *tile)], "slide_id bigint, level int, col int, row int")
    assert rows(V.tile_position(tiles, square_slide, three_levels), "x", "y", "width", "height") == [place]


def test_tile_position_is_cut_at_the_border_and_bounds_are_not(spark, three_levels, square_slide):
    small = square_slide.withColumn("width", F.lit(700)).withColumn("height", F.lit(100))
    tiles = spark.createDataFrame([(1, 2, 1, 2)], "slide_id bigint, level int, col int, row int")
    assert rows(V.tile_position(tiles, small, three_levels), "x", "y", "width", "height") == [(512, 1024, 188, 0)]
    assert rows(V.tile_bounds(tiles, three_levels), "x", "y", "width", "height") == [(512.0, 1024.0, 512.0, 512.0)]


def test_roi_tiles_exclude_touching_edges(spark, three_levels):
    tiles = spark.createDataFrame([(1, 2, c, r) for c in range(4) for r in range(4)], "slide_id bigint, level int, col int, row int")
    rois = spark.createDataFrame([(7, 1, 2, 0.0, 0.0, 1024.0, 1024.0)], "roi_id int, slide_id bigint, level int, x double, y double, w double, h double")
    assert rows(R.tiles_in_roi(tiles, rois, three_levels), "col", "row") == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_region_blocks_give_the_same_pixels(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    image = rng.integers(0, 255, (40, 56, 3), dtype=np.uint8)
    stored = []
    for r in range(3):
        for c in range(4):
            part = image[r * 16:(r + 1) * 16, c * 16:(c + 1) * 16]
            if (c, r) != (1, 1):
                stored.append((1, 0, c, r, part.shape[1], part.shape[0], part.tobytes()))
    image[16:32, 16:32] = 255
    tiles = spark.createDataFrame(stored, "slide_id bigint, level int, col int, row int, width int, height int, rgb binary")
    requests = spark.createDataFrame(
        [(1, 1, 0, -5, -3, 70, 50), (2, 1, 0, 10, 9, 30, 25), (3, 1, -1, 0, 0, 4, 4), (4, 9, 0, 0, 0, 3, 2)],
        "request_id int, slide_id bigint, level int, x int, y int, w int, h int",
    )
    canvas = np.full((100, 120, 3), 255, np.uint8)
    canvas[20:60, 20:76] = image
    expected = {1: canvas[17:67, 15:85], 2: canvas[29:54, 30:60], 3: np.full((4, 4, 3), 255), 4: np.full((2, 3, 3), 255)}
    for block_pixels in (1 << 20, 200):
        got = {}
        for r in sorted(R.assemble_regions(requests, tiles, 16, block_pixels).collect(), key=lambda r: r.block):
            part = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
            got[r.request_id] = np.concatenate([got[r.request_id], part]) if r.request_id in got else part
        assert all(np.array_equal(got[k], expected[k]) for k in expected)
    with pytest.raises(Exception, match="must be positive"):
        R.assemble_regions(requests.withColumn("w", F.lit(0)), tiles, 16).collect()


def brute_prefetch(level_rows, view, cached, config=V.PrefetchConfig()):
    """Plain-Python reading of the ranking rules for one viewport."""
    x, y, w, h, scale, vx, vy = view
    levels = {l[1]: l for l in level_rows}
    fit = [l for l in level_rows if l[2] <= 1 / scale]
    level = max(fit, key=lambda l: l[2])[1] if fit else min(level_rows, key=lambda l: l[2])[1]

    def rect(info, x, y, w, h):
        side = 512 * info[2]
        cs = range(max(0, int(x // side)), max(0, min(info[3], int(-(-(x + w) // side)))))
        rs = range(max(0, int(y // side)), max(0, min(info[4], int(-(-(y + h) // side)))))
        return [(info[1], c, r) for r in rs for c in cs]

    ring = 512 * config.tiles_around
    ax = (1 if vx > 0 else -1) * 512 * config.tiles_ahead if abs(vx) > config.min_velocity else 0
    ay = (1 if vy > 0 else -1) * 512 * config.tiles_ahead if abs(vy) > config.min_velocity else 0
    order = [rect(levels[level], x, y, w, h),
             rect(levels[level], x - ring + min(ax, 0), y - ring + min(ay, 0), w + 2 * ring + abs(ax), h + 2 * ring + abs(ay))]
    order.append(rect(levels[level + 1], x, y, w, h) if level + 1 in levels else [])
    order.append(rect(levels[level - 1], x + w / 2 - w / 8, y + h / 2 - h / 8, w / 4, h / 4) if level - 1 in levels else [])
    out = []
    for tiles in order:
        out += [t for t in tiles if t not in out and t not in cached]
    visible = min(256, len([t for t in order[0] if t not in cached]))
    return out, out[:visible + max(0, 32 - visible)]


def test_prefetch_against_brute_force(spark):
    level_rows = [(1, i, 2 ** (4 - i), -(-20 // 2 ** (4 - i)), -(-18 // 2 ** (4 - i))) for i in range(5)]
    levels = spark.createDataFrame([(*l, 512) for l in level_rows], "slide_id bigint, level int, downsample int, cols int, rows int, tile_size int")
    rng = random.Random(1)
    items = [(rng.uniform(-900, 10000), rng.uniform(-900, 9000), rng.choice([300, 1024, 9000]), rng.choice([200, 768, 9000]),
              rng.choice([1.0, 0.6, 0.3, 0.1, 0.03]), rng.uniform(-120, 120), rng.uniform(-120, 120)) for _ in range(40)]
    cached = {(l, c, r) for _, l, _, cols, rs in level_rows for c in range(cols) for r in range(rs) if rng.random() < 0.3}
    cached_df = spark.createDataFrame([(1, *t) for t in cached], "slide_id bigint, level int, col int, row int")
    ranked = V.rank_prefetch(views(spark, *items), levels, cached_df)
    budget = V.budget_prefetch(ranked)
    all_tiles, kept = {}, {}
    for r in ranked.collect():
        all_tiles.setdefault(r.viewport_id, []).append((r.priority, r.row, r.col, r.level))
    for r in budget.collect():
        kept.setdefault(r.viewport_id, []).append((r["rank"], (r.level, r.col, r.row)))
    for i, item in enumerate(items):
        whole, cut = brute_prefetch(level_rows, item, cached)
        assert [(l, c, r) for _, r, c, l in sorted(all_tiles.get(i, []))] == whole
        assert [t for _, t in sorted(kept.get(i, []))] == cut


def test_cache_filter_threshold(spark):
    tiles = spark.createDataFrame([(v, 1, 0, c, 0) for v in (1, 2) for c in range(10)], "viewport_id int, slide_id bigint, level int, col int, row int")
    cached = spark.createDataFrame([(1, 0, c, 0) for c in range(3)], "slide_id bigint, level int, col int, row int")
    assert V.filter_cached(tiles, cached).count() == 6
    assert V.filter_cached(tiles, cached.filter("col < 2")).count() == 20


def test_cache_statistics(spark):
    log = spark.createDataFrame([("L1", 1, 2, 0, 0, False, 10), ("L1", 1, 2, 0, 0, True, 10), ("L1", 1, 2, 1, 0, False, 20)],
                                "tier string, slide_id bigint, level int, col int, row int, hit boolean, bytes bigint")
    s = V.cache_stats(log).first()
    assert (s.hits, s.misses, s.tiles, s.bytes) == (1, 2, 2, 30) and abs(s.hit_ratio - 1 / 3) < 1e-12


def test_tile_set_changes(spark):
    data = [("a", 0, 1, 0, 0), ("a", 0, 1, 1, 0), ("a", 1, 1, 1, 0), ("a", 1, 1, 0, 0), ("a", 2, 2, 0, 0), ("a", 4000, 2, 0, 0), ("a", 9000, 2, 5, 0)]
    df = spark.createDataFrame([(v, s, l, c, r) for v, s, l, c, r in data], "viewer_id string, seq bigint, level int, col int, row int")
    df = df.withColumn("ts", F.timestamp_seconds("seq"))
    assert rows(V.tileset_changes(df), "seq", "level", "n_tiles", "fallback_seq") == [(0, 1, 2, None), (2, 2, 1, 1), (9000, 2, 1, None)]


def test_preload_order_alternates_outward(spark):
    df = spark.createDataFrame([(i, c, 6) for c in (0, 2, 5) for i in range(6)], "idx bigint, current_idx bigint, n bigint")
    got = {}
    for r in V.preload_order(df).collect():
        got.setdefault(r.current_idx, []).append((r.preload_rank, r.idx))
    assert [i for _, i in sorted(got[0])] == [0, 1, 2, 3, 4, 5]
    assert [i for _, i in sorted(got[2])] == [2, 3, 1, 4, 0, 5]
    assert [i for _, i in sorted(got[5])] == [5, 4, 3, 2, 1, 0]


def test_duplicate_and_stale_requests(spark):
    df = spark.createDataFrame(
        [("v", 1, 1, 1, 0, 0, 0), ("v", 2, 2, 1, 0, 0, 0), ("v", 3, 2, 1, 0, 0, 0), ("v", 4, 2, 1, 0, 1, 0)],
        "viewer_id string, seq bigint, generation bigint, slide_id bigint, level int, col int, row int",
    )
    assert rows(V.dedupe_requests(df), "seq") == [(2,), (4,)]


def test_split_windows_equal_plain_windows(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "k string, seq bigint, v bigint")
    sums, last, expected = {}, {}, []
    for k, seq, v in data:
        sums[k] = sums.get(k, 0) + v
        expected.append((seq, sums[k], last.get(k)))
        last[k] = v
    bucket = F.floor(F.col("seq") / 37)
    got = running_sums(df, ["k"], bucket, ["seq"], {"s": "v"})
    got = previous_row(got, ["k"], bucket, ["seq"], ["v"])
    assert rows(got.select("seq", "s", F.coalesce("prev.v", F.lit(-1)).alias("p")), "seq", "s", "p") == [
        (a, b, -1 if c is None else c) for a, b, c in expected]


def test_numbering_without_gaps(spark):
    df = spark.createDataFrame([("hot" if i % 3 else str(i % 7), (i * 7919) % 3001) for i in range(3000)], "k string, o bigint").dropDuplicates()
    by_key = {}
    for r in number_rows(df.repartition(5), ["k"], ["o"]).collect():
        by_key.setdefault(r.k, []).append((r.o, r.row_num))
    for values in by_key.values():
        assert [n for _, n in sorted(values)] == list(range(1, len(values) + 1))


def test_balanced_joins_equal_plain_joins(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(600)], "k bigint, v bigint")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 600, 2)] + [(1, 7)], "k bigint, w bigint")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert sorted(map(tuple, salted_join(left, right, ["k"], how, salts=5).collect()), key=str) == plain
