import json
import os
import struct
import zlib

import numpy as np
from compare import rows
from pyspark.sql import functions as F

from slidelake.sources import packs, projects
from slidelake.sources import slides as sources
from slidelake.sources.files import pyramid_documents, pyramid_listing
from slidelake.sources.images import read_images


def touch(path, content=b""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content)


def test_discovery(spark, folder):
    for name in ("b.svs", "a.NDPI", "c.txt", "sub/d.svs", "e.tif", "plain"):
        touch(f"{folder}/{name}", b"123")
    found = sources.discover_slides(spark, folder).collect()
    assert [(r.stem, r.ext, r.length) for r in found] == [("a", ".ndpi", 3), ("b", ".svs", 3), ("e", ".tif", 3)]
    assert [r.stem for r in sources.discover_slides(spark, f"{folder}/b.svs").collect()] == ["b"]
    assert sources.discover_slides(spark, f"{folder}/c.txt").count() == 0
    assert sources.discover_slides(spark, f"{folder}/none").count() == 0


def test_discovery_of_hidden_and_empty_files(spark, folder):
    for name, content in (("_b.svs", b"1"), (".d.svs", b"1"), ("c.svs", b"")):
        touch(f"{folder}/{name}", content)
    found = sources.discover_slides(spark, folder).collect()
    assert [(r.stem, r.length) for r in found] == [(".d", 1), ("_b", 1), ("c", 0)]


def test_siblings(spark):
    catalog = spark.createDataFrame([("/d", n) for n in ("beta.pyramid", "Alpha.pyramid", "gamma.pyramid", "x.pyramid_native", "y.txt")], "parent string, name string")
    current = spark.createDataFrame([(1, "/d", "beta.pyramid"), (2, "/d", "gone.pyramid"), (3, "/empty", "q.pyramid")], "viewer_id int, parent string, name string")
    got = rows(sources.sibling_slides(catalog, current).na.fill("-").na.fill(-9), "viewer_id", "idx", "name", "current_idx", "n")
    assert got == [(1, 0, "Alpha.pyramid", 1, 3), (1, 1, "beta.pyramid", 1, 3), (1, 2, "gamma.pyramid", 1, 3),
                   (2, 0, "Alpha.pyramid", 0, 3), (2, 1, "beta.pyramid", 0, 3), (2, 2, "gamma.pyramid", 0, 3), (3, -9, "-", -1, 0)]


META = {"version": "1.0", "source_file": "a.svs", "source_mpp": 0.25, "target_mpp": 0.5, "target_magnification": 20, "tile_size": 512,
        "dimensions": [2048, 2048], "levels": [{"level": 0, "downsample": 4, "cols": 1, "rows": 1}, {"level": 1, "downsample": 2, "cols": 2, "rows": 2}],
        "background_color": [255, 255, 255], "preprocessed_at": "2024-01-02T03:04:05", "tile_format": "pack_v2"}


def test_metadata_documents(spark, folder):
    cases = {"good": META, "format": {**META, "tile_format": "old"}, "keys": {k: v for k, v in META.items() if k != "levels"},
             "entry": {**META, "levels": [{"level": 0}]}, "native": {**META, "native_mpp_mode": True}}
    for name, doc in cases.items():
        touch(f"{folder}/{name}.pyramid/metadata.json", json.dumps(doc, indent=1).encode())
    touch(f"{folder}/broken.pyramid/metadata.json", b'{"version": ')
    slides, levels, rejects = sources.read_slides(spark, f"{folder}/*.pyramid/metadata.json")
    assert rows(slides, "slide_id", "width", "native_mpp_mode") == [("good.pyramid", 2048, False), ("native.pyramid", 2048, True)]
    assert rows(levels.filter("slide_id = 'good.pyramid'"), "level", "downsample", "mpp") == [(0, 4, 2.0), (1, 2, 1.0)]
    assert {r.slide_id: r.reason for r in rejects.collect()} == {
        "format.pyramid": "unsupported tile_format: old", "keys.pyramid": "missing keys: levels",
        "entry.pyramid": "incomplete level entry", "broken.pyramid": "malformed JSON"}
    sources.write_slides(slides, levels, f"{folder}/again")
    slides2, levels2, rejects2 = sources.read_slides(spark, f"{folder}/again")
    same = ("slide_id", "width", "height", "source_mpp", "native_mpp_mode", "preprocessed_at")
    assert rows(slides2, *same) == rows(slides, *same) and rejects2.count() == 0
    assert rows(levels2, "slide_id", "level", "mpp") == rows(levels, "slide_id", "level", "mpp")


def test_metadata_folders_of_any_name(spark, folder):
    names = ["a b", "50%", "x/y", "1+1", "ü", "k=v", "plain"]
    row = spark.createDataFrame([(n, json.dumps(META)) for n in names], "slide_id string, document string")
    slides, levels, _ = sources.slides_from_documents(row.withColumn("path", F.col("slide_id")))
    sources.write_slides(slides, levels, f"{folder}/store")
    tops = os.listdir(f"{folder}/store")
    assert len(tops) > 1 and all(t.startswith("group=") for t in tops)  # no folder holds all slides
    found, found_levels, rejects = sources.read_slides(spark, f"file:{folder}/store")
    assert rows(found, "slide_id") == sorted((n,) for n in names) and found_levels.count() == 2 * len(names) and rejects.count() == 0
    sources.write_slides(slides.filter("slide_id = 'plain'"), levels, f"{folder}/store")
    assert rows(sources.read_slides(spark, f"{folder}/store")[0], "slide_id") == [("plain",)]


def test_metadata_of_flat_folders_and_files(spark, folder):
    for place in ("slide_id=s/part-0.txt", "own.json", "_part=1/slide_id=t/a.txt", "slide_id=u/_SUCCESS", "slide_id=v/.a.crc", "plain/metadata.json"):
        touch(f"{folder}/store/{place}", json.dumps(META).encode())
    touch(f"{folder}/store/slide_id=w/empty.txt")
    assert rows(sources.read_slides(spark, f"{folder}/store")[0], "slide_id") == [("s",), ("store",)]
    assert rows(sources.read_slides(spark, f"{folder}/store/own.json")[0], "slide_id") == [("store",)]


def test_listing_of_empty_files_and_folders(spark, folder):
    touch(f"{folder}/a/tiles/level_0.pack")
    touch(f"{folder}/a/metadata.json", b"{}")
    touch(f"{folder}/_staging-1/x", b"1")
    os.makedirs(f"{folder}/b")
    listing = pyramid_listing(spark, folder)
    assert rows(listing, "slide_id", "rel_path") == [("a", ""), ("a", "metadata.json"), ("a", "tiles"), ("a", "tiles/level_0.pack"), ("b", "")]
    assert rows(pyramid_documents(listing, folder), "slide_id", "document") == [("a", "{}")]
    assert pyramid_listing(spark, f"{folder}/none").count() == 0


def test_pack_store_round_trip(spark, folder):
    tiles = spark.createDataFrame([("s", 0, 0, 0, b"aaaa"), ("s", 1, 0, 0, b"level one")], "slide_id string, level int, col int, row int, data binary")
    levels = spark.createDataFrame([("s", 0, 2, 1), ("s", 1, 1, 1), ("t", 0, 1, 1)], "slide_id string, level int, cols int, rows int")
    packs.write_packs(tiles, levels, folder)
    packs.write_packs(tiles, levels, folder)  # writing again gives the same store
    with open(f"{folder}/s/tiles/level_0.idx", "rb") as f:
        assert f.read() == struct.pack("<8sIHH", b"FPLIDX1\0", 1, 2, 1) + struct.pack("<QIQI", 0, 4, 0, 0)
    assert os.path.getsize(f"{folder}/t/tiles/level_0.pack") == 0
    assert not [f for _, _, fs in os.walk(folder) for f in fs if f.endswith(".part")]
    index, rejects = packs.read_tile_index(spark, folder)
    assert rows(index, "slide_id", "level", "col", "row", "offset", "length") == [
        ("s", 0, 0, 0, 0, 4), ("s", 0, 1, 0, 0, 0), ("s", 1, 0, 0, 0, 9), ("t", 0, 0, 0, 0, 0)]
    assert rejects.count() == 0
    wanted = index.select("slide_id", "level", "col", "row").union(spark.createDataFrame([("s", 0, 9, 9)], "a string, b int, c int, d int"))
    got = {(r.slide_id, r.level, r.col): (r.data, r.error) for r in packs.read_tile_bytes(index, wanted).collect()}
    assert got["s", 0, 0] == (b"aaaa", None) and got["s", 0, 1] == (None, None) and got["s", 0, 9] == (None, None)
    far = index.withColumn("offset", F.lit(7).cast("bigint"))
    assert {r.error for r in packs.read_tile_bytes(far, wanted).filter("level = 1").collect()} == {"tile range exceeds pack"}
    assert rows(packs.pack_files(spark, folder), "slide_id", "level", "pack_length") == [("s", 0, 4), ("s", 1, 9)]


def test_bad_index_files(spark, folder):
    good = struct.pack("<8sIHH", b"FPLIDX1\0", 1, 1, 1) + struct.pack("<QI", 0, 4)
    cases = {"short": good[:10], "magic": b"X" + good[1:], "version": good[:8] + struct.pack("<I", 2) + good[12:],
             "zero": good[:12] + struct.pack("<HH", 0, 1) + good[16:], "table": good[:-1]}
    for name, content in cases.items():
        touch(f"{folder}/{name}/tiles/level_0.idx", content)
    touch(f"{folder}/twice/tiles/level_1.idx", good)
    touch(f"{folder}/twice/tiles/level_01.idx", good)
    index, rejects = packs.read_tile_index(spark, folder)
    assert index.count() == 0
    assert sorted({(r.slide_id, r.reason) for r in rejects.collect()}) == [
        ("magic", "magic mismatch"), ("short", "too small"), ("table", "missing entry table"), ("twice", "duplicate level"),
        ("version", "unsupported version: 2"), ("zero", "zero cols/rows")]


def test_deep_zoom_tree(spark, folder):
    touch(f"{folder}/s/tiles_files/0/0_0.jpg", b"12")
    touch(f"{folder}/s/tiles_files/1/1_0.jpeg", b"345")
    touch(f"{folder}/s/tiles_files/1/bad.jpg")
    touch(f"{folder}/s/tiles_files/1/0_0.png")
    assert rows(packs.read_dz_tree(spark, folder), "slide_id", "level", "col", "row", "length", "data") == [
        ("s", 0, 0, 0, 2, b"12"), ("s", 1, 1, 0, 3, b"345")]


def png(pixels, color_type):
    h, w = pixels.shape[:2]
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color_type, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_of_one_three_and_four_bands(spark, folder):
    rgba = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4) + 100
    touch(f"{folder}/rgb.png", png(np.ascontiguousarray(rgba[:, :, :3]), 2))
    touch(f"{folder}/gray.png", png(np.ascontiguousarray(rgba[:, :, 0]), 0))
    touch(f"{folder}/rgba.png", png(rgba, 6))
    got = {os.path.basename(r.path): np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) for r in read_images(spark, folder)[0].collect()}
    assert np.array_equal(got["rgb.png"], rgba[:, :, :3]) and np.array_equal(got["rgba.png"], rgba[:, :, :3])
    assert np.array_equal(got["gray.png"], np.repeat(rgba[:, :, :1], 3, axis=2))


def test_projects(spark, folder):
    touch(f"{folder}/in/a.json", b'{"version": "1.0", "slide_path": "/s", "view_state": {"x": 3, "scale": 2}, "metadata": {"k": "v"}}')
    touch(f"{folder}/in/b.json", b'{"version": "7", "annotations_file": "/ann"}')
    touch(f"{folder}/in/c.json", b"{nope")
    good, rejects = projects.read_projects(spark, f"{folder}/in")
    named = good.withColumn("project_id", F.regexp_extract("path", r"([a-z])\.json$", 1))
    assert rows(named, "project_id", "version", "slide_path", "known_version") == [("a", "1.0", "/s", True), ("b", "7", "", False)]
    views = {r.project_id: tuple(r.view_state) for r in named.collect()}
    assert views == {"a": (3.0, 0.0, 2.0), "b": (0.0, 0.0, 0.1)} and rejects.count() == 1
    projects.write_projects(named.drop("path"), f"{folder}/out")
    again, _ = projects.read_projects(spark, f"{folder}/out")
    same = ("version", "slide_path", "annotations_file", "view_state", "known_version")
    assert rows(again, *same) == rows(good, *same)
    checked = projects.check_projects(named, spark.createDataFrame([("/s",)], "slide_path string"), spark.createDataFrame([("/other",)], "path string"))
    assert rows(checked, "project_id", "reason") == [("b", "missing slide path")]
