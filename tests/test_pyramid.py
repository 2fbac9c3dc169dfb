import json
import random

import pytest
from compare import rows
from pyspark.sql import functions as F

from slidelake.operators import pyramid as P

SIZED = "slide_id bigint, width int, height int, tile_size int"


def halving(width, height, tile):
    sizes = [(width, height)]
    while max(sizes[-1]) > tile:
        w, h = sizes[-1]
        sizes.append(((w + 1) // 2, (h + 1) // 2))
    depth = len(sizes) - 1
    return sorted((depth - k, 2**k, -(-w // tile), -(-h // tile)) for k, (w, h) in enumerate(sizes))


@pytest.mark.parametrize("size, expected", [
    ((2048, 2048), [(0, 4, 1, 1), (1, 2, 2, 2), (2, 1, 4, 4)]),
    ((512, 512), [(0, 1, 1, 1)]),
    ((100, 100), [(0, 1, 1, 1)]),
    ((1025, 768), [(0, 4, 1, 1), (1, 2, 2, 1), (2, 1, 3, 2)]),
])
def test_level_plans(spark, size, expected):
    slides = spark.createDataFrame([(1, *size, 512)], SIZED)
    assert rows(P.plan_levels(slides), "level", "downsample", "cols", "rows") == expected


def test_level_plans_equal_repeated_halving(spark):
    rng = random.Random(5)
    sizes = [(i, rng.randint(1, 400_000), rng.randint(1, 400_000), rng.choice([64, 256, 511, 512])) for i in range(400)]
    planned = {}
    for r in P.plan_levels(spark.createDataFrame(sizes, SIZED)).collect():
        planned.setdefault(r.slide_id, []).append((r.level, r.downsample, r.cols, r.rows))
    assert all(sorted(planned[i]) == halving(w, h, t) for i, w, h, t in sizes)


def test_resolution_comes_from_the_first_positive_property(spark):
    cases = [
        ({"openslide.mpp-x": "0.23", "aperio.MPP": "0.5"}, 0.23), ({"openslide.mpp-x": "0", "aperio.MPP": "0.5"}, 0.5),
        ({"openslide.mpp-x": "abc"}, 0.25), ({}, 0.25), ({"openslide.mpp-x": "nan", "aperio.MPP": "-3"}, 0.25),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "slide_id int, props map<string,string>")
    assert rows(P.resolve_mpp(df), "slide_id", "source_mpp") == [(i, v) for i, (_, v) in enumerate(cases)]


def test_resize_plan(spark):
    df = spark.createDataFrame([(1, 1000, 600, 0.25), (2, 1000, 600, 0.5), (3, 1000, 600, 1.0)],
                               "slide_id int, width int, height int, source_mpp double")
    got = rows(P.plan_resize(df), "slide_id", "resize_factor", "actual_mpp", "magnification", "out_width", "coarser_than_target")
    assert got == [(1, 0.5, 0.5, 20.0, 500, False), (2, 1.0, 0.5, 20.0, 1000, False), (3, 1.0, 1.0, 10.0, 1000, True)]
    native = rows(P.plan_resize(df, native=True), "slide_id", "resize_factor", "actual_mpp")
    assert native == [(1, 1.0, 0.25), (2, 1.0, 0.5), (3, 1.0, 1.0)]


def test_pyramid_name_suffixes_can_be_chosen(spark):
    df = spark.createDataFrame([("/a/b.c/case 1.tar.svs",), ("/a/.svs",), ("plain",)], "path string")
    assert [r[0] for r in df.select(P.pyramid_name(F.col("path"))).collect()] == ["case 1.tar.pyramid", ".svs.pyramid", "plain.pyramid"]
    assert df.select(P.pyramid_name(F.col("path"), True, ".a", ".b")).first()[0] == "case 1.tar.b"


def _folder_case(spark, files, document):
    expected = spark.createDataFrame([(1,)], "slide_id int")
    listing = spark.createDataFrame([(1, f) for f in files], "slide_id int, rel_path string")
    docs = spark.createDataFrame([(1, document)] if document is not None else [], "slide_id int, document string")
    return P.pyramid_status(expected, listing, docs).first().status


GOOD = json.dumps({"version": "1", "source_file": "a", "tile_size": 512, "dimensions": [1, 1], "levels": [{"level": 0}], "tile_format": "pack_v2"})
FULL = ["", "metadata.json", "tiles", "tiles/level_0.pack", "tiles/level_0.idx", "thumbnail.jpg"]


@pytest.mark.parametrize("files, document, status", [
    ([], None, "not_exists"),
    ([""], None, "incomplete"),
    (FULL, GOOD, "complete"),
    (FULL, "{broken", "corrupted"),
    (FULL, GOOD.replace("source_file", "other"), "corrupted"),
    (FULL, GOOD.replace("pack_v2", "v1"), "corrupted"),
    (FULL, GOOD.replace('{"level": 0}', '{"lvl": 0}'), "corrupted"),
    ([f for f in FULL if f != "thumbnail.jpg"], GOOD, "incomplete"),
    ([f for f in FULL if not f.startswith("tiles")], GOOD, "incomplete"),
    ([f for f in FULL if not f.endswith(".idx")], GOOD, "incomplete"),
    # The first bad level decides: here the missing file comes before the bad entry.
    (["", "metadata.json", "tiles", "thumbnail.jpg"], GOOD.replace('{"level": 0}', '{"level": 0}, {"x": 1}'), "incomplete"),
])
def test_pyramid_status(spark, files, document, status):
    assert _folder_case(spark, files, document) == status


def test_batch_plan_and_summary(spark):
    found = spark.createDataFrame([(1,), (2,), (3,)], "slide_id int")
    status = spark.createDataFrame([(1, "complete", True), (2, "incomplete", None)], "slide_id int, status string, native_mpp_mode boolean")
    assert rows(P.plan_batch(found, status), "slide_id", "action", "mode_mismatch") == [(1, "skip", True), (2, "build", False), (3, "build", False)]
    assert {r.action for r in P.plan_batch(found, status, force=True).collect()} == {"build"}
    done = spark.createDataFrame([(3,)], "slide_id int")
    assert rows(P.to_build(P.plan_batch(found, status), done), "slide_id") == [(2,)]
    results = spark.createDataFrame([("/a/x.svs", "done", None), ("/a/y.svs", "error", None), ("/a/z.svs", "error", "bad"), ("/a/q.svs", "skipped", None)],
                                    "file string, status string, error string")
    assert tuple(P.summarize_batch(results).first()) == (1, 1, 2)
    assert rows(P.batch_failures(results), "file", "error") == [("y.svs", "Unknown error"), ("z.svs", "bad")]


def test_metadata_rules(spark):
    slides = spark.createDataFrame([(1, 1000, 2000, 512), (2, 0, 5, 512), (3, 5, 5, 0), (4, 5, 5, 512)], SIZED)
    levels = spark.createDataFrame(
        [(1, 0, 8, 1, 1), (1, 1, 4, 2, 4), (2, 0, 0, 1, 1), (3, 0, 1, 0, 1), (3, 0, 1, 1, 0)],
        "slide_id bigint, level int, downsample int, cols int, rows int",
    )
    got = {(r.slide_id, r.rule) for r in P.validate_slides(slides, levels).collect()}
    assert got == {(2, "dimensions"), (2, "downsample"), (3, "tile_size"), (3, "cols"), (3, "rows"), (3, "duplicate_level"), (4, "levels_empty")}


def test_index_checks(spark):
    index = spark.createDataFrame(
        [(1, 0, 0, 0, 0, 10), (1, 0, 1, 0, 10, 5), (1, 0, 0, 1, 0, 0), (1, 0, 1, 1, 16, 4), (1, 0, 0, 2, 20, 100)],
        "slide_id int, level int, col int, row int, offset bigint, length bigint",
    )
    packs = spark.createDataFrame([(1, 0, 60)], "slide_id int, level int, pack_length bigint")
    got = rows(P.validate_index(index, packs), "col", "row", "out_of_pack", "not_contiguous")
    assert got == [(0, 2, True, False), (1, 1, False, True)]
