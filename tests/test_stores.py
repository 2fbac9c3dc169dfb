"""Packs without a mount, tile stores that keep their pixels in place, and the build job's failures."""

import os
import struct

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from slidelake.operators import pixels as X
from slidelake.operators.analysis import tissue_scores
from slidelake.operators.levels import with_level_mpp
from slidelake.operators.pyramid import plan_levels
from slidelake.operators.regions import assemble_regions, get_tiles
from slidelake.plans import pipelines
from slidelake.sources import packs, pieces
from slidelake.sources.tilestore import payload_moves, wanted_tiles, write_tile_store

TILES = "slide_id string, level int, col int, row int, data binary"


def all_files(folder):
    return sorted(os.path.relpath(os.path.join(r, f), folder) for r, _, fs in os.walk(folder) for f in fs)


def test_packs_by_uri_in_blocks_and_ranges(spark, folder):
    draw = np.random.default_rng(4)
    cols, height = 7, 90
    data = {(c, r): draw.bytes(int(draw.integers(1, 60))) for r in range(height) for c in range(cols) if (c + r) % 5}
    tiles = spark.createDataFrame([("s", 0, c, r, bytearray(v)) for (c, r), v in data.items()], TILES).repartition(5)
    levels = spark.createDataFrame([("s", 0, cols, height), ("t", 3, 2, 2)], "slide_id string, level int, cols int, rows int")
    uri = "file://" + folder
    packs.write_packs(tiles, levels, uri, block_bytes=500, block_cells=50)
    assert all_files(folder) == ["s/tiles/level_0.idx", "s/tiles/level_0.pack", "t/tiles/level_3.idx", "t/tiles/level_3.pack"]
    whole = b"".join(data.get((c, r), b"") for r in range(height) for c in range(cols))
    with open(f"{folder}/s/tiles/level_0.pack", "rb") as f:
        assert f.read() == whole
    with open(f"{folder}/s/tiles/level_0.idx", "rb") as f:
        assert f.read(16) == struct.pack("<8sIHH", b"FPLIDX1\0", 1, cols, height)
    ranged = packs.IndexReader({"path": uri, "rangeBytes": "600"}).partitions()
    assert len(ranged) > 10 and sum(r.last - r.first for p in ranged for r in p.ranges) == cols * height + 4
    index, rejects = packs.read_tile_index(spark, uri, range_bytes=600)
    assert index.rdd.getNumPartitions() == len(ranged) and rejects.count() == 0 and index.count() == cols * height + 4
    assert all(r.pack_path.startswith("file://") for r in index.collect())
    got = {(r.col, r.row): r.data for r in packs.read_tile_bytes(index, index.filter("slide_id = 's'").select("slide_id", "level", "col", "row")).collect()}
    assert {k: bytes(v) for k, v in got.items() if v is not None} == data and len(got) == cols * height
    assert packs.read_tile_index(spark, uri + "/none")[0].count() == 0


def test_failed_jobs_leave_nothing(spark, folder):
    good = spark.createDataFrame([("a.bin", 0, b"one"), ("a.bin", 1, b"two"), ("b.bin", 0, b"x")], "file string, block bigint, data binary").coalesce(1)
    files = good.select("file").union(spark.createDataFrame([("empty.bin",)], "file string"))

    def fail(frames):
        for frame in frames:
            yield frame
            raise ValueError("a lost task")

    with pytest.raises(Exception, match="a lost task"):
        pieces.write_pieces(good.mapInPandas(fail, good.schema), folder, files)
    assert all_files(folder) == []
    pieces.write_pieces(good, folder, files)
    pieces.write_pieces(good, folder, files)  # a second run puts the same files there
    assert all_files(folder) == ["a.bin", "b.bin", "empty.bin"]
    assert open(f"{folder}/a.bin", "rb").read() == b"onetwo" and os.path.getsize(f"{folder}/empty.bin") == 0


def test_a_repeated_task_is_not_joined_twice(folder):
    """Two attempts wrote the same block; only the reported one counts."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"file": ["f", "f"], "block": pa.array([0, 0], pa.int64()), "data": pa.array([b"ab", b"c"], pa.binary())})
    writer = pieces.PieceWriter({"path": folder + "/staging"})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.rows[0][2] != kept.rows[0][2] and kept.rows[0][3] == 3
    writer.commit([kept])
    import pyarrow.parquet as pq
    assert pq.read_table(folder + "/staging/parts.parquet").to_pylist() == [{"file": "f", "block": 0, "part": kept.rows[0][2], "bytes": 3}]
    writer.abort([kept])
    assert not os.path.exists(folder + "/staging")


@pytest.fixture()
def shuffled(spark):
    """No broadcast at all, as for keys beyond any threshold."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture()
def store(spark):
    draw = np.random.default_rng(1)
    tiles = [(s, 2, c, r, 8, 8, bytearray(draw.bytes(192))) for s in (1, 2) for c in range(4) for r in range(3)]
    df = spark.createDataFrame(tiles, "slide_id bigint, level int, col int, row int, width int, height int, rgb binary")
    slides = spark.createDataFrame([(1, 32, 24, 8, 0.5), (2, 32, 24, 8, 0.5)], "slide_id bigint, width int, height int, tile_size int, target_mpp double")
    return df, write_tile_store(df, buckets=6), slides


def test_stores_keep_their_pixels_in_place(spark, shuffled, store):
    plain, tiles, slides = store
    levels = with_level_mpp(plan_levels(slides), slides)
    assert rows(tiles, "slide_id", "col", "row", "rgb") == rows(plain, "slide_id", "col", "row", "rgb")
    wanted = spark.createDataFrame([(1, 2, 3, 1), (2, 2, 0, 0), (2, 2, 9, 9)], "slide_id bigint, level int, col int, row int")
    asked = spark.createDataFrame([(7, 1, 2, -3, 5, 20, 9)], "request_id int, slide_id bigint, level int, x int, y int, w int, h int")
    plans = {
        "keys": wanted_tiles(tiles, wanted), "slides": wanted_tiles(tiles, wanted.filter("slide_id = 1"), ["slide_id", "level"]),
        "lookup": get_tiles(wanted, tiles), "tissue": tissue_scores(tiles, levels, 0.5), "region": assemble_regions(asked, tiles, 8),
        "thumbnail": X.thumbnails(tiles, slides, levels, 16, 8),
    }
    for name, df in plans.items():
        assert payload_moves(df) == [], name
    assert payload_moves(wanted_tiles(plain, wanted)) != []  # a table without buckets has to move
    assert plans["keys"].count() == 2 and plans["slides"].count() == 12 and plans["lookup"].filter("rgb IS NULL").count() == 1
    assert rows(plans["tissue"], "slide_id", "col", "row", "score") == rows(tissue_scores(plain, levels, 0.5), "slide_id", "col", "row", "score")
    assert rows(plans["region"], "rgb") == rows(assemble_regions(asked, plain, 8), "rgb")
    assert rows(plans["thumbnail"], "slide_id", "rgb") == rows(X.thumbnails(plain, slides, levels, 16, 8), "slide_id", "rgb")


def test_strips_that_do_not_make_an_image(spark):
    strip = lambda s, y, h, w=4, cut=0: (s, w, h, y, bytearray(w * h * 3 - cut))
    images = spark.createDataFrame([
        strip("good", 0, 16), strip("good", 16, 8), strip("good", 24, 3), strip("short", 0, 8), strip("short", 8, 8, cut=1), strip("gap", 0, 8), strip("gap", 16, 8),
        strip("overlap", 0, 16), strip("overlap", 8, 8), strip("twice", 0, 8), strip("twice", 0, 8), strip("late", 8, 8), strip("odd", 0, 4), strip("odd", 4, 8),
        strip("width", 0, 8), strip("width", 8, 8, w=5), strip("tricky", 0, 8), strip("tricky", 16, 16), strip("tricky", 24, 8), ("null", 4, 4, 0, None),
    ], "slide_id string, width int, height int, y_offset int, rgb binary")
    told = {r.slide_id: (r.height, r.problem) for r in pipelines.image_problems(images, 8).collect()}
    assert told.pop("good") == (27, None)
    assert {k: v[1] for k, v in told.items()} == {
        "short": "image bytes do not fit its size", "null": "image bytes do not fit its size", "odd": "strip offsets must be multiples of the tile size",
        "width": "strips differ in width", **{k: "strips leave a gap or overlap" for k in ("gap", "overlap", "twice", "late", "tricky")},
    }


def test_build_job_keeps_failures_with_their_slides(spark, folder):
    draw = np.random.default_rng(9)
    px = {s: draw.integers(0, 200, (40, 30, 3), dtype=np.uint8) for s in (1, 2, 3)}
    px[2][10, 20] = 255  # a pixel that the encoder refuses
    images = spark.createDataFrame(
        [(s, 30, h, y, bytearray(px[s][y:y + h].tobytes())) for s in (1, 2) for y, h in ((0, 16), (16, 24))] + [(3, 30, 40, 0, bytearray(px[3].tobytes()))],
        "slide_id bigint, width int, height int, y_offset int, rgb binary",
    )
    slides = spark.createDataFrame([(s, f"/in/{s}.svs", {"aperio.MPP": "0.5"}) for s in (1, 2, 3, 4)], "slide_id bigint, path string, props map<string,string>")

    def encode(w, h, rgb):
        if 255 in rgb:
            raise ValueError("too bright")
        return rgb

    done = pipelines.build_job(images, slides, "file://" + folder, tile_size=8, encode=encode).cache()
    told = {r.slide_id: (r.status, r.stage, r.error) for r in done.collect()}
    assert told == {1: ("done", None, None), 3: ("done", None, None), 4: ("error", "input", "no image"), 2: ("error", "tiles", told[2][2])}
    assert told[2][2].endswith("ValueError: too bright") and told[2][2].startswith("level ")
    assert {f.split("/")[0] for f in all_files(folder)} == {"1", "3"}
    # The strips' pyramid holds the pixels of the whole image.
    index, _ = packs.read_tile_index(spark, folder)
    top = index.filter("slide_id = '1'").agg(F.max("level")).first()[0]
    stored = packs.read_tile_bytes(index, index.filter(f"slide_id = '1' AND level = {top}").select("slide_id", "level", "col", "row")).collect()
    assert len(stored) == 20
    for t in stored:
        part = px[1][t.row * 8:t.row * 8 + 8, t.col * 8:t.col * 8 + 8]
        assert bytes(t.data) == part.tobytes()
    # Retries are counted, and given up in the end.
    letters = pipelines.dead_letters(done)
    again = pipelines.dead_letters(done.filter("slide_id = 2"), pipelines.dead_letters(done))
    assert rows(letters, "slide_id", "stage", "attempts") == [(2, "tiles", 1), (4, "input", 1)]
    assert rows(again, "slide_id", "stage", "attempts") == [(2, "tiles", 2), (4, "input", 1)]
    last = pipelines.build_job(images, slides, folder + "/more", tile_size=8, retries=again, max_attempts=2)
    assert {r.slide_id: r.error for r in last.collect()} == {1: None, 2: "given up after 2 attempts", 3: None, 4: "no image"}
