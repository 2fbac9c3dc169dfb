import random

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from slidelake.operators import annotations as A
from slidelake.operators.quadtree import NODE, PARTS, spread_crowded
from slidelake.operators.raster import rasterize_tiles
from slidelake.sources import geojson

SHAPES = "slide_id bigint, annotation_id string, type string, coordinates array<struct<x:double,y:double>>, properties map<string,string>"


def shapes(spark, *items):
    return spark.createDataFrame(
        [(1, i, t, [tuple(map(float, p)) for p in pts], props) for i, t, pts, props in items], SHAPES
    )


def test_defaults_and_bounds(spark):
    df = shapes(spark, ("a", "polygon", [(10, 20), (50, 20), (50, 80), (10, 80)], {"label": "x"}), ("b", "polygon", [], {}))
    n = A.with_bounds(A.normalize_annotations(df))
    assert rows(n, "annotation_id", "label", "color", "notes", "group", *A.BOX) == [
        ("a", "x", "#ff6b6b", "", "default", 10, 20, 50, 80), ("b", "", "#ff6b6b", "", "default", 0, 0, 0, 0)]


def windows(spark, *items):
    return spark.createDataFrame([(i, 1, *map(float, v)) for i, v in enumerate(items)],
                                 "viewport_id bigint, slide_id bigint, x double, y double, width double, height double")


def test_range_query_is_closed(spark):
    df = shapes(spark, ("in", "point", [(50, 50)], {}), ("out", "point", [(500, 500)], {}), ("touch", "point", [(100, 100)], {}), ("none", "polygon", [], {}))
    assert rows(A.query_viewports(df, windows(spark, (0, 0, 100, 100))), "annotation_id") == [("in",), ("none",), ("touch",)]


def test_range_query_against_all_pairs(spark):
    rng = random.Random(4)
    boxes, views = [], []
    for i in range(400):
        side = rng.choice([0, 3, 60, 64, 192, 193, 900, 5000, 30_000_000])
        x, y = rng.choice([rng.uniform(-3000, 9000), rng.randrange(-5, 40) * 64.0]), rng.uniform(-3000, 9000)
        boxes.append((1, str(i), x, y, x + side, y + side * rng.random()))
    for i in range(120):
        side = rng.choice([0, 64, 512, 1024, 8000, 300_000])
        views.append((rng.uniform(-3000, 9000), rng.randrange(-5, 40) * 64.0, side, side * rng.random()))
    df = spark.createDataFrame(boxes, "slide_id bigint, annotation_id string, min_x double, min_y double, max_x double, max_y double")
    expected = {(v, b[1]) for v, (x, y, w, h) in enumerate(views) for b in boxes
                if b[2] <= x + w and b[4] >= x and b[3] <= y + h and b[5] >= y}
    for cell_rows in (1 << 16, 40, 7):
        got = [(r.viewport_id, r.annotation_id) for r in A.query_viewports(df, windows(spark, *views), cell_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == expected, cell_rows


def test_crowded_cells_are_divided(spark):
    """Many small boxes under large viewports, a heap at one place, rows that repeat as a whole."""
    rng = random.Random(8)
    boxes = [(1, str(i), x, y, x + 3, y + 3) for i in range(3000) for x, y in [(rng.gauss(5000, 900), rng.gauss(4000, 900))]]
    boxes += [(1, "heap", 10.0, 10.0, 11.0, 11.0)] * 500 + [(None, "lost", 0.0, 0.0, 9000.0, 9000.0)] * 300
    views = [(rng.uniform(2000, 7000), rng.uniform(2000, 6000), 2500.0, 1800.0) for _ in range(20)] + [(9.0, 9.0, 4.0, 4.0)] * 150
    df = spark.createDataFrame(boxes, "slide_id bigint, annotation_id string, min_x double, min_y double, max_x double, max_y double")
    got = A.query_viewports(df, windows(spark, *views), cell_rows=100).groupBy("viewport_id").count()
    expected = [sum(b[0] == 1 and b[2] <= x + w and b[4] >= x and b[3] <= y + h and b[5] >= y for b in boxes) for x, y, w, h in views]
    assert rows(got, "viewport_id", "count") == [(v, n) for v, n in enumerate(expected) if n]


def test_no_node_of_the_quadtree_is_crowded(spark):
    rng = random.Random(2)
    place = lambda n, side: [(1, 0, 5, 0, 0, x, y, x + side, y + side) for x, y in [(rng.uniform(0, 2000), rng.uniform(0, 2000)) for _ in range(n)]]
    schema = "slide_id int, _kind int, _scale int, _cx bigint, _cy bigint, x0 double, y0 double, x1 double, y1 double"
    few, many = spark.createDataFrame(place(30, 40.0), schema), spark.createDataFrame(place(4000, 2.0) + [(1, 0, 5, 0, 0, 7.0, 7.0, 7.0, 7.0)] * 900, schema)
    box = ("x0", "y0", "x1", "y1")
    left, right = spread_crowded(many, few, box, box, cell_rows=200)
    sizes = left.join(right.select(*NODE, *PARTS).distinct(), [*NODE, *PARTS], "left_semi").groupBy(*NODE, *PARTS).count()
    assert sizes.agg(F.max("count")).first()[0] <= 300 and left.agg(F.max("_depth")).first()[0] >= 2
    same, also = spread_crowded(many, few, box, box)
    assert same.count() == 4900 and also.count() == 30


def test_batch_skips_empty_rows_and_continues_numbers(spark):
    existing = shapes(spark, ("ann_000041", "point", [(1, 1)], {}), ("ann_x", "point", [(1, 1)], {}))
    batch = spark.createDataFrame(
        [(1, 1, None, [(0.0, 0.0)], "L", None), (1, 2, "point", [], None, None), (1, 3, "point", [(2.0, 2.0)], None, "#010203")],
        "slide_id bigint, seq bigint, type string, coordinates array<struct<x:double,y:double>>, label string, color string",
    )
    done = A.normalize_annotations(A.append_batch(existing, batch, "g")).filter("group = 'g'")
    assert rows(done, "annotation_id", "type", "label", "color") == [("ann_000042", "polygon", "L", "#ff6b6b"), ("ann_000043", "point", "", "#010203")]


def test_groups(spark):
    df = A.normalize_annotations(shapes(spark, *[(f"a{i}", "point", [(i, i)], {"group": "alpha"}) for i in range(5)],
                                        *[(f"b{i}", "point", [(i, i)], {"group": "beta"}) for i in range(3)]))
    assert [tuple(r) for r in A.annotation_groups(df).collect()] == [(1, "alpha", 5), (1, "beta", 3)]
    assert A.remove_group(df, "alpha").count() == 3
    assert A.removed_group_count(df, "alpha").first().removed == 5
    ids = spark.createDataFrame([(1, "a0"), (1, "zzz")], "slide_id bigint, annotation_id string")
    assert A.remove(df, ids).count() == 7 and A.removed_count(df, ids).first().removed == 1


def replay(base, changes):
    """The edit log applied one change at a time."""
    state = {(s, i): dict(group=g, x=x, label=l) for s, i, g, x, l in base}
    used = set(state)
    for s, _, op, i, g, x, l in sorted(changes, key=lambda c: c[1]):
        if op == "add" and (s, i) not in used:
            state[s, i] = dict(group=g, x=x, label=l)
            used.add((s, i))
        elif op == "set_coordinates" and (s, i) in state:
            state[s, i]["x"] = x
        elif op == "set_style" and (s, i) in state:
            state[s, i]["label"] = l
        elif op == "delete":
            state.pop((s, i), None)
        elif op == "delete_group":
            state = {k: v for k, v in state.items() if not (k[0] == s and v["group"] == g)}
        elif op == "clear":
            state = {k: v for k, v in state.items() if k[0] != s}
    return sorted((s, i, v["group"], v["x"], v["label"]) for (s, i), v in state.items())


@pytest.mark.parametrize("seed", range(3))
def test_edit_log_against_replay(spark, seed):
    rng = random.Random(seed)
    base = [(s, f"b{i}", rng.choice("gh"), float(i), "") for s in (1, 2) for i in range(8)]
    ops = ["add"] * 6 + ["set_coordinates"] * 6 + ["set_style"] * 6 + ["delete"] * 2 + ["delete_group", "clear"][: 1 + (seed > 0)]
    changes = [(rng.choice((1, 2)), i, rng.choice(ops), rng.choice([f"b{rng.randrange(8)}", f"n{rng.randrange(30)}"]),
                rng.choice("gh"), float(100 + i), f"l{i}") for i in range(120)]
    # A new id is added once: ids are never handed out again.
    seen, kept = {b[1] for b in base}, []
    for c in changes:
        if c[2] == "add":
            if (c[0], c[3]) in seen or c[3].startswith("b"):
                continue
            seen.add((c[0], c[3]))
        kept.append(c)
    base_df = spark.createDataFrame([(s, i, g, "point", [(x, x)], l, "#000000") for s, i, g, x, l in base],
                                    "slide_id bigint, annotation_id string, group string, type string, coordinates array<struct<x:double,y:double>>, label string, color string")
    log = spark.createDataFrame([(s, q, op, i, g, "point", [(x, x)], l, "#111111") for s, q, op, i, g, x, l in kept],
                                "slide_id bigint, seq bigint, op string, annotation_id string, group string, type string, coordinates array<struct<x:double,y:double>>, label string, color string")
    done = A.apply_changes(base_df, log).withColumn("x", F.get("coordinates", 0)["x"])
    assert rows(done, "slide_id", "annotation_id", "group", "x", "label") == replay(base, kept)


def test_drawn_shapes(spark):
    df = spark.createDataFrame(
        [(1, "rectangle", 0.5, [(20.0, 30.0), (10.0, 10.0)]), (2, "rectangle", 2.0, [(20.0, 30.0), (10.0, 10.0)]),
         (3, "freehand", 1.0, [(1.0, 1.0)]), (4, "freehand", 1.0, [(1.0, 1.0), (5.0, 5.0)])],
        "i int, type string, scale double, coordinates array<struct<x:double,y:double>>",
    )
    got = {r.i: [tuple(p) for p in r.coordinates] for r in A.accept_shapes(df).collect()}
    assert got == {1: [(20.0, 20.0), (40.0, 60.0)], 4: [(1.0, 1.0), (5.0, 5.0)]}


def test_decimation_measures_from_the_last_kept_point(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.9, 0.0), (2.0, 0.0), (3.5, 0.0), (4.0, 0.0)],), ([],), ([(1.0, 2.0)],)],
                               "coordinates array<struct<x:double,y:double>>")
    assert [[p.x for p in r.coordinates] for r in A.decimate(df).collect()] == [[0.0, 2.0, 4.0], [], [1.0]]


def test_visibility_and_labels(spark):
    df = spark.createDataFrame([(1, "Dead"), (1, "Dead"), (1, "other"), (1, "Epithelial")], "slide_id int, label string")
    counts = {r.label: r.n for r in A.label_counts(df).collect()}
    assert counts == {"Neoplastic": 0, "Inflammatory": 0, "Connective": 0, "Dead": 2, "Epithelial": 1}
    switches = spark.createDataFrame([("Dead", False), ("Epithelial", None)], "label string, visible boolean")
    assert rows(A.filter_visible(df, switches), "label") == [("Epithelial",), ("other",)]


def test_last_of_equal_ids_wins(spark):
    df = spark.createDataFrame([(1, "a", 0, "old"), (1, "a", 1, "new"), (1, "b", 2, "x")], "slide_id int, annotation_id string, pos int, label string")
    assert rows(A.replace_all(df), "annotation_id", "label") == [("a", "new"), ("b", "x")]


# --- documents ------------------------------------------------------------


def documents(spark, *texts):
    return spark.createDataFrame([(f"p{i}", str(i), t) for i, t in enumerate(texts)], "path string, slide_id string, document string")


def test_reading_documents(spark):
    text = """{"type": "FeatureCollection", "features": [
      {"id": "p", "geometry": {"type": "Point", "coordinates": [150, 250]}, "properties": {"label": "L"}},
      {"id": "q", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}, "properties": {}},
      {"id": "r", "geometry": {"type": "Polygon", "coordinates": [[[10, 20], [50, 20], [50, 80], [10, 80], [10, 20]]]}, "properties": {"annotation_type": "rectangle"}},
      {"id": "f", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4]]]}, "properties": {"annotation_type": "freehand"}},
      {"id": "u", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
      {"geometry": {"type": "Point", "coordinates": [1, 2]}},
      {"id": "bad", "geometry": {"type": "Polygon", "coordinates": [["x"]]}}, 7]}"""
    good, rejects = geojson.parse_documents(documents(spark, text, "{oops", '{"type": "FeatureCollection"}'))
    got = {r.annotation_id: (r.type, [tuple(p) for p in r.coordinates]) for r in good.collect()}
    made = [i for i in got if len(i) == 36]
    assert len(made) == 1 and made[0] in {r.annotation_id for r in good.collect()}  # the same at every read
    got = {k: v for k, v in got.items() if len(k) < 36}
    assert got == {
        "p": ("point", [(150.0, 250.0)]), "q": ("polygon", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]),
        "r": ("rectangle", [(10.0, 20.0), (50.0, 80.0)]), "f": ("freehand", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]), "u": ("polygon", []),
    }
    assert rows(rejects.na.fill(-1), "slide_id", "pos", "reason") == [
        ("0", 6, "bad coordinates"), ("0", 7, "feature is no object"), ("1", -1, "malformed JSON"), ("2", -1, "missing features")]


def test_a_feature_is_parsed_once(spark):
    """Expressions and filters above the parsed fields refer to them and hold no copies of the parsing."""
    feature = spark.createDataFrame([("p", "1", 0, "{}")], "path string, slide_id string, pos int, feature string")
    good, rejects = geojson.parse_features(feature)
    for df in (good, rejects):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("get_json_object(") <= 8 and plan.count("from_json(") + plan.count("jsontostructs(") <= 4, plan


def test_written_documents(spark, folder):
    import json

    df = shapes(spark, ("pt", "point", [(1, 2)], {"label": 'quo"te'}), ("rc", "rectangle", [(10, 20), (50, 80)], {}),
                ("pg", "polygon", [(0, 0), (4, 0), (4, 4)], {}), ("e", "polygon", [], {}), ("r1", "rectangle", [(1, 1)], {})).withColumn("pos", F.monotonically_increasing_id())
    doc = json.loads(geojson.annotation_documents(df).first().document)
    geometry = {f["id"]: f["geometry"] for f in doc["features"]}
    assert doc["type"] == "FeatureCollection" and [f["id"] for f in doc["features"]] == ["pt", "rc", "pg", "e", "r1"]
    assert geometry["pt"] == {"type": "Point", "coordinates": [1, 2]}
    assert geometry["rc"]["coordinates"] == [[[10, 20], [50, 20], [50, 80], [10, 80], [10, 20]]]
    assert geometry["pg"]["coordinates"] == [[[0, 0], [4, 0], [4, 4], [0, 0]]]
    assert geometry["e"]["coordinates"] == [[]] and geometry["r1"]["coordinates"] == [[]]
    assert doc["features"][0]["properties"] == {"annotation_type": "point", "label": 'quo"te'}
    geojson.write_annotations(df, folder + "/out", max_features=2)
    again, rejects = geojson.read_annotations(spark, folder + "/out")
    assert rows(again, "slide_id", "annotation_id", "type")[0][0] == "1" and again.count() == 5 and rejects.count() == 0


# --- raster ---------------------------------------------------------------


def levels_of(spark, tile=512, ds=2, cols=4, rows_=4):
    return spark.createDataFrame([(1, 1, ds, cols, rows_, tile)], "slide_id bigint, level int, downsample int, cols int, rows int, tile_size int")


def raster(spark, df, wanted, chunk_rows=5000, **kw):
    tiles = spark.createDataFrame([(1, 1, *t) for t in wanted], "slide_id bigint, level int, col int, row int")
    done = rasterize_tiles(df, levels_of(spark, **kw), tiles, chunk_rows=chunk_rows)
    return {(r.col, r.row): np.frombuffer(r.rgba, np.uint8).reshape(r.tile_size, r.tile_size, 4) for r in done.collect()}


def test_rectangle_lands_in_its_tile(spark):
    df = A.normalize_annotations(shapes(spark, ("a", "rectangle", [(1124, 1124), (1424, 1424)], {"color": "#102030"}))).withColumn("draw_order", F.lit(1))
    got = raster(spark, df, [(0, 0), (1, 1)])
    assert not got[0, 0].any()
    tile = got[1, 1]
    assert tuple(tile[100, 100]) == (16, 32, 48, 102) and tuple(tile[50, 50]) == (16, 32, 48, 255)
    assert tuple(tile[200, 199]) == (16, 32, 48, 255) and not tile[49, 100].any() and not tile[100, 201].any()


def test_points_and_polygons(spark):
    df = A.normalize_annotations(shapes(spark, ("p", "point", [(100, 100)], {}), ("t", "polygon", [(200, 200), (400, 200), (200, 400)], {}), ("l", "polygon", [(0, 0), (50, 50)], {}))).withColumn("draw_order", F.lit(1))
    tile = raster(spark, df, [(0, 0)])[0, 0]
    assert tile[50, 50, 3] == 102 and tile[50, 56, 3] == 255 and tile[50, 57, 3] == 0
    assert tile[120, 120, 3] == 102 and tile[100, 150, 3] == 255 and tile[190, 190, 3] == 0
    assert not tile[:40, :40].any()


def test_drawing_order_holds_across_chunks(spark):
    rng = random.Random(9)
    items = []
    for i in range(60):
        x, y, w = rng.uniform(-20, 120), rng.uniform(-20, 120), rng.uniform(5, 60)
        kind = rng.choice(["rectangle", "polygon", "point"])
        pts = {"rectangle": [(x, y), (x + w, y + w / 2)], "point": [(x, y)], "polygon": [(x, y), (x + w, y), (x + w / 3, y + w), (x - w / 4, y + w / 2)]}[kind]
        items.append((f"a{i:03d}", kind, pts, {"color": f"#{i + 1:06x}"}))
    df = A.normalize_annotations(shapes(spark, *items)).withColumn("draw_order", F.substring("annotation_id", 2, 3).cast("int"))
    one = raster(spark, df, [(0, 0), (1, 0)], tile=64, ds=1)
    many = raster(spark, df, [(0, 0), (1, 0)], tile=64, ds=1, chunk_rows=4)
    assert all(np.array_equal(one[k], many[k]) for k in one) and one[0, 0].any()
