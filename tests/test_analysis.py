import random

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from slidelake.operators import analysis as G
from slidelake.operators import cells as C
from slidelake.operators.components import label_components, merge_labels
from slidelake.operators.status import batch_overview, recent, running_timing, stage_progress


def region(spark, *arrays):
    data = [(i, a.shape[1], a.shape[0], a.astype(np.uint8).tobytes()) for i, a in enumerate(arrays)]
    return spark.createDataFrame(data, "request_id int, width int, height int, rgb binary")


def filled(color, side=64):
    return np.full((side, side, 3), color, np.uint8)


def noisy(spread):
    base = np.full((40, 40, 3), (200, 120, 100), int)
    base[::2] += np.array([1, 1, 1]) * spread
    base[1::2] -= np.array([1, 1, 1]) * spread
    return np.clip(base, 0, 255)


def test_tissue_rules(spark):
    got = {r.request_id: (r.label, round(r.confidence, 6)) for r in G.classify_regions(
        region(spark, filled((220, 180, 200)), filled(255), filled((10, 10, 10)), noisy(30), noisy(50), filled((100, 150, 200)))).collect()}
    assert got == {0: ("Tissue", 0.6), 1: ("Background", 0.95), 2: ("Artifact", 0.7), 3: ("Tissue", 0.75), 4: ("Dense Tissue", 0.8), 5: ("Tissue", 0.6)}


def test_colour_statistics_with_blocks(spark):
    px = np.random.default_rng(7).integers(0, 256, (31, 17, 3), dtype=np.uint8)
    blocks = spark.createDataFrame([(1, 17, 20, px[:20].tobytes()), (1, 17, 11, px[20:].tobytes())], "request_id int, width int, height int, rgb binary")
    s = G.color_stats(blocks).first().asDict()
    for i, c in enumerate(("red", "green", "blue")):
        ch = px[:, :, i].astype(float)
        assert (s[f"{c}_min"], s[f"{c}_max"], s[f"{c}_median"]) == (ch.min(), ch.max(), np.median(ch))
        assert np.allclose([s[f"{c}_mean"], s[f"{c}_std"]], [ch.mean(), ch.std()])
    gray = px.mean(axis=2)
    assert np.allclose([s["gray_mean"], s["gray_std"]], [gray.mean(), gray.std()]) and (s["pixels"], s["width"], s["height"]) == (31 * 17, 17, 31)


def test_tissue_detection_counts_missing_tiles(spark, three_levels):
    tile = lambda level, c, r, v: (1, level, c, r, 4, 4, bytes([v]) * 48)
    tiles = spark.createDataFrame([tile(1, 0, 0, 100), tile(1, 1, 0, 250), tile(1, 0, 1, 10), tile(2, 0, 0, 0)],
                                  "slide_id bigint, level int, col int, row int, width int, height int, rgb binary")
    scores = G.tissue_scores(tiles, three_levels, mpp=1.0)
    assert scores.count() == 3
    s = G.tissue_summary(scores, three_levels, mpp=1.0).first()
    assert (s.level, s.tissue_tiles, s.total_tiles, s.tissue_fraction) == (1, 2, 4, 0.5)
    grid = [r.scores for r in G.score_grid(scores, three_levels, mpp=1.0).orderBy("row").collect()]
    assert np.allclose(grid, [[1 - 100 / 255, 1 - 250 / 255], [1 - 10 / 255, 0]])


def test_failing_rows_do_not_fail_the_job(spark):
    def halves(rows):
        return {"half": 6 // int(rows.v.iloc[0])}

    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "request_id int, v int")
    done = {r.request_id: r for r in G.run_analysis(G.AnalysisSpec("h", "half int", process=halves), df).collect()}
    assert [done[i].success for i in range(3)] == [False, True, True] and done[1].half == 6 and "zero" in done[0].message
    grouped = G.AnalysisSpec("n", "n int", process=lambda rows: {"n": sum(1 for _ in rows)}, input_kind="annotations", keys=("v",))
    assert rows(G.run_analysis(grouped, df), "v", "n") == [(0, 3), (1, 3), (2, 3)]


def test_groups_can_be_split_over_tasks(spark):
    def count(rows):
        values = [r.v for r in rows]
        if 6666 in values:
            raise ValueError("bad value")
        return len(values), sum(values)

    spec = G.AnalysisSpec("mean", "n int, mean double, parts int", process=count, input_kind="whole_slide", keys=("slide_id",),
                          merge=lambda states: {"n": sum(s[0] for s in states), "mean": sum(s[1] for s in states) / sum(s[0] for s in states), "parts": len(states)})
    df = spark.range(1000).selectExpr("id % 2 AS slide_id", "CAST(id AS INT) AS v").union(spark.createDataFrame([(7, 6666), (7, 1)], "a bigint, b int"))
    done = {r.slide_id: r for r in G.run_analysis(spec, df).collect()}
    assert (done[0].n, done[0].mean) == (500, 499.0) and done[1].mean == 500.0 and done[0].parts > 1
    assert not done[7].success and done[7].message == "bad value"


def test_models_are_loaded_and_released(spark, folder):
    import os

    def load():
        path = f"{folder}/{os.getpid()}-{random.random()}"
        open(path, "w").close()
        return path

    model = G.ModelSpec(load=load, predict=lambda m, rows: {"y": int(rows.v.iloc[0]) + 1}, unload=os.unlink)
    df = spark.range(200).selectExpr("CAST(id AS INT) AS request_id", "CAST(id AS INT) AS v").repartition(2)
    done = G.run_analysis(G.AnalysisSpec("m", "y int", model=model), df)
    assert rows(done, "request_id", "y") == [(i, i + 1) for i in range(200)] and not os.listdir(folder)


def test_output_kinds_and_routing(spark):
    one = "array<struct<type:string,geometry:string,coordinates:array<struct<x:double,y:double>>,label:string,color:string>>"
    rec = lambda geometry=None, coords=None, label=None: (None, geometry, coords, label, None)
    at = [(1.0, 1.0)]
    data = [(1, 1, True, [rec(), rec(None, at, "A"), rec("g")], None), (1, 2, True, [rec("g"), rec(None, at)], None),
            (1, 3, False, [rec(None, at)], None), (1, 4, True, [rec()], {"z": 5}), (1, 5, True, [], None)]
    df = spark.createDataFrame(data, f"slide_id bigint, output_id int, success boolean, annotations {one}, m map<string,int>")
    df = df.withColumn("measurements", F.struct(F.lit(None).cast("map<string,int>").alias("counts_by_type"), F.col("m").alias("type_counts"), F.col("m").alias("counts")))
    assert {r.output_id for r in G.routable(df).collect()} == {1}
    none = spark.createDataFrame([], "slide_id bigint, annotation_id string, type string, coordinates array<struct<x:double,y:double>>, properties map<string,string>")
    routed = G.route_annotations(df, none, "finder").collect()
    assert [(r.annotation_id, r.type, r.properties["group"], r.properties["label"]) for r in routed] == [("ann_000001", "polygon", "finder", "A")]
    assert rows(G.breakdown(df), "output_id", "label", "n") == [(1, "A", 1), (1, "Unknown", 2), (2, "Unknown", 2), (3, "Unknown", 1), (4, "z", 5)]
    assert dict(rows(G.breakdown_totals(df), "output_id", "total"))[5] == 0


# --- cells ----------------------------------------------------------------


@pytest.mark.parametrize("length, count", [(512, 1), (1024, 1), (1025, 2), (1984, 2), (1985, 3)])
def test_patch_counts(spark, length, count):
    assert spark.createDataFrame([(length,)], "n bigint").select(C.patch_count(F.col("n"))).first()[0] == count


@pytest.mark.parametrize("center, patch, roi, kept", [
    ((100, 100), (0, 0), (1024, 1024), True), ((970, 970), (960, 960), (2048, 2048), False), ((10, 10), (0, 0), (2048, 2048), True),
    ((992, 100), (0, 0), (2048, 2048), False), ((992, 100), (960, 0), (2048, 2048), True), ((991.9, 100), (0, 0), (2048, 2048), True)])
def test_centroid_ownership(spark, center, patch, roi, kept):
    cells = spark.createDataFrame([(1, *map(float, center), *map(float, patch))], "roi_id int, cx double, cy double, px double, py double")
    rois = spark.createDataFrame([(1, 0, 0, *roi)], "roi_id int, roi_x int, roi_y int, roi_w int, roi_h int")
    assert C.dedupe_cells(cells, rois).count() == int(kept)


def test_rounding_half_to_even_and_scale(spark, square_slide):
    rois = spark.createDataFrame([(1, 1, 0.25, 0.75, 1000.25, 100.0)], "roi_id int, slide_id bigint, x double, y double, w double, h double")
    r = C.wsi_rois(rois, square_slide).first()
    assert (r.wsi_x, r.wsi_y, r.wsi_w, r.wsi_h, r.wsi_scale) == (0, 2, 2000, 200, 2.0)
    none = square_slide.withColumn("source_mpp", F.lit(0.0))
    assert C.wsi_rois(rois, none).first().wsi_scale == 1.0
    assert C.eligible(rois, square_slide).first().magnification == 40
    assert C.eligible(rois, square_slide.withColumn("source_mpp", F.lit(0.5))).first().magnification == 20
    assert C.eligible(rois, square_slide.withColumn("source_mpp", F.lit(0.6))).count() == 0


def test_instance_classes(spark):
    def case(label, *types):
        return [(1, label, i, label, t) for i, t in enumerate(types)]

    data = case(1, 0, 0, 3) + case(2, 0) + case(3, 2, 1, 2, 1) + case(4, 0, 0, 5, 4)
    df = spark.createDataFrame(data, "slide_id int, label int, x int, y int, type int")
    got = {r.label: (r.type, round(r.type_prob, 4)) for r in C.instance_types(df.drop("type"), df.drop("label")).collect()}
    assert got == {1: (3, 0.3333), 2: (0, 1.0), 3: (1, 0.5), 4: (4, 0.25)}


def flood(mask):
    """Smallest packed position of each 4-connected component, by flood fill."""
    labels = {}
    for y, x in zip(*np.nonzero(mask)):
        if (x, y) in labels:
            continue
        todo, members = [(x, y)], []
        labels[x, y] = None
        while todo:
            cx, cy = todo.pop()
            members.append((cx, cy))
            for n in ((cx + 1, cy), (cx - 1, cy), (cx, cy + 1), (cx, cy - 1)):
                if 0 <= n[0] < mask.shape[1] and 0 <= n[1] < mask.shape[0] and mask[n[1], n[0]] and n not in labels:
                    labels[n] = None
                    todo.append(n)
        low = min((int(my) << 32) | int(mx) for mx, my in members)
        labels.update(dict.fromkeys(members, low))
    return {(int(a), int(b)): v for (a, b), v in labels.items()}


@pytest.mark.parametrize("make", ["random", "snake", "full"])
def test_components_across_tiles(spark, make):
    h, w, tile = 21, 30, 5
    mask = np.random.default_rng(1).random((h, w)) < 0.6
    if make == "snake":  # one path through every tile
        mask[:] = False
        mask[::2] = True
        mask[1::4, -1] = mask[3::4, 0] = True
    elif make == "full":
        mask[:] = True
    data = []
    for s in (1, 2):
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                part = (mask if s == 1 else ~mask)[r:r + tile, c:c + tile].astype(np.uint8)
                data.append((s, c // tile, r // tile, part.shape[1], part.shape[0], part.tobytes()))
    tiles = spark.createDataFrame(data, "slide_id bigint, col int, row int, width int, height int, mask binary")
    got = {1: {}, 2: {}}
    for r in label_components(tiles, tile).collect():
        got[r.slide_id][r.x, r.y] = r.label
    assert got[1] == flood(mask) and got[2] == flood(~mask)
    sized = C.remove_small(label_components(tiles, tile), 10)
    sizes = {}
    for v in flood(mask).values():
        sizes[v] = sizes.get(v, 0) + 1
    assert sized.filter("slide_id = 1").count() == sum(n for n in sizes.values() if n >= 10)


def test_merging_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 200)] + [(1500 + i, 1000 + i) for i in range(1, 100)]
    done = dict(map(tuple, merge_labels(spark.createDataFrame(chain + hub, "a bigint, b bigint")).collect()))
    assert all(done[i] == 0 for i in range(1, 301)) and all(done[n] == 1000 for pair in hub for n in pair if n != 1000)


# --- status ---------------------------------------------------------------


def test_progress_and_overview(spark):
    df = spark.createDataFrame([("thumbnail", 0, 1), ("dzsave_progress", 50, 100), ("packing", 1, 0), ("x", 0, 0)], "stage string, current int, total int")
    assert [round(v[1], 4) for v in rows(stage_progress(df), "stage", "progress")] == [0.51, 1.0, 0.01, 0.5]
    events = spark.createDataFrame([("/a/x.svs", 1, "processing", 0.1, None), ("/a/x.svs", 4, "done", 1.0, None), ("/a/y.svs", 2, "error", 0.2, "bad"), ("/a/z.svs", 3, "pending", 0.0, None)],
                                   "file string, seq int, status string, progress double, error string")
    o = batch_overview(events).first()
    assert (o.files, o.completed, round(o.overall, 4), o.first_result) == (3, 2, 0.6667, "x.pyramid")


def test_running_average_and_recent(spark):
    log = spark.createDataFrame([("s", i, float(i)) for i in range(1, 401)], "source string, seq bigint, t double")
    assert rows(running_timing(log, ["t"], bucket_rows=30), "seq", "avg_t") == [(100, 50.5), (200, 100.5), (300, 150.5), (400, 200.5)]
    opens = spark.createDataFrame([(1, p, i, i) for i, p in enumerate(["a", "b", "", "a", None, *"cdefghijk"])], "user_id int, path string, ts int, seq int")
    assert [r.path for r in recent(opens).orderBy("position").collect()] == list("kjihgfedca")


def test_merging_with_hot_nodes(spark):
    from slidelake.operators import components

    hub = [(1000, 1000 + i) for i in range(1, 120)] + [(3 * i, 3 * i + 1) for i in range(40)]
    done = dict(map(tuple, components.merge_labels(spark.createDataFrame(hub, "a bigint, b bigint")).collect()))
    assert all(done[1000 + i] == 1000 for i in range(1, 120)) and all(done[3 * i + 1] == 3 * i for i in range(40))
